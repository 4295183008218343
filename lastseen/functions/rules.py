"""Classification rules: operator, product type, Volvo tag."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Operator label, text its name must contain, text that excludes it.
# The first matching rule decides.
OPERATOR_RULES = (
    ("flix", "flix", None),
    ("intrcity", "intrcity", None),
    ("zingbus", "zingbus", "maxx"),
    ("nuego", "nuego", None),
    ("freshbus", "freshbus", None),
    ("laxmi", "laxmi holidays", "pvt"),
)
OTHER_OPERATOR = "other"
LINE_OPERATOR = "flix"
LINE_GROUP, REST_GROUP = "flix", "comp"

# Product labels and the berth count that decides on its own.
SEATER, SLEEPER, HYBRID, VOLVO, UNKNOWN = "Seater", "Sleeper", "Hybrid", "Volvo", "Unknown"
PRODUCTS = (SEATER, SLEEPER, HYBRID, VOLVO)
ALL_BERTH_SEATS = 36

OPERATORS = tuple(label for label, _, _ in OPERATOR_RULES)


def first_match(rules: Iterable[tuple[str, Column]], default: str | None) -> Column:
    """Label of the first condition that holds, ``default`` if none does."""
    chain = F
    for label, condition in rules:
        chain = chain.when(condition, F.lit(label))
    return chain.otherwise(F.lit(default))


def operator_conditions(name: Column) -> dict[str, Column]:
    lowered = F.lower(name)
    conditions = {}
    for label, wanted, excluded in OPERATOR_RULES:
        condition = lowered.contains(wanted)
        conditions[label] = condition & ~lowered.contains(excluded) if excluded else condition
    return conditions


def operator_of(name: Column, default: str | None = OTHER_OPERATOR) -> Column:
    return first_match(operator_conditions(name).items(), default)


def operated_by(name: Column, labels: Sequence[str]) -> Column:
    """True when any chosen rule matches; rules are not exclusive here.

    One pattern for all of them: a filter is evaluated at the source, where ``name`` may be
    a long expression, and a copy of it for each rule makes code too large to be compiled.
    """
    patterns = {
        label: f"^(?!.*{re.escape(excluded)}).*{re.escape(wanted)}" if excluded else re.escape(wanted)
        for label, wanted, excluded in OPERATOR_RULES
    }
    return F.lower(name).rlike("(?s)" + ("|".join(patterns[label] for label in labels) or "(?!)"))


def operator_group(name: Column) -> Column:
    is_line = F.lower(name).contains(LINE_OPERATOR)
    return F.when(is_line, F.lit(LINE_GROUP)).otherwise(F.lit(REST_GROUP))


def product_of(total_seats: Column, bus_type: Column) -> Column:
    """Product label; a null seat count or text simply matches fewer rules."""
    text = F.lower(F.coalesce(bus_type, F.lit("")))
    seater, sleeper, semi = (text.contains(word) for word in ("seater", "sleeper", "semi"))
    two_sleepers = text.rlike("sleeper.*sleeper")
    return first_match(
        [
            (SLEEPER, total_seats == ALL_BERTH_SEATS),
            (HYBRID, seater & sleeper),
            # "Semi sleeper" names a reclining seat; a second "sleeper" is a berth.
            (HYBRID, semi & two_sleepers),
            (SEATER, semi & sleeper),
            (SLEEPER, sleeper),
            (SEATER, seater),
        ],
        UNKNOWN,
    )


def is_volvo(bus_type: Column) -> Column:
    return F.coalesce(F.lower(bus_type).contains("volvo"), F.lit(False))


def has_product(total_seats: Column, bus_type: Column, wanted: Iterable[str]) -> Column:
    """Filter for a set of product types.

    Unlike the label, a layout filter never keeps a bus whose seat count is
    unknown: without it the berth-count rule cannot be ruled out.
    """
    wanted = set(wanted)
    layouts = sorted(wanted - {VOLVO})
    keep = F.lit(False)
    if layouts:
        keep = total_seats.isNotNull() & product_of(total_seats, bus_type).isin(layouts)
    return keep | is_volvo(bus_type) if VOLVO in wanted else keep


def product_of_flags(is_seater: Column, is_sleeper: Column) -> Column:
    """Coarser label from the feed's booleans, where semi-sleepers are hybrids."""
    return first_match(
        [
            (HYBRID, is_seater & is_sleeper),
            (SEATER, is_seater & ~is_sleeper),
            (SLEEPER, ~is_seater & is_sleeper),
        ],
        UNKNOWN,
    )
