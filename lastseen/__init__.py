"""Analytics over append-only archives of repeatedly scraped departures.

The archive holds one row per sighting of a departure.  Every view first
reduces the sightings to the newest one per departure and then counts,
sums or compares.  All work is expressed as DataFrame operations.
"""

from lastseen.operators.filters import FilterSpec
from lastseen.session import build_session

__all__ = ["FilterSpec", "build_session"]
