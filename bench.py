"""Wall time of every registered query of the reference's operators.

Reads ``BENCH_SF_DIR``, ``BENCH_CPUS`` and ``BENCH_RUNS``; prints one JSON line.  The names
in ``BENCH_ONLY``, if set, are the queries to time.  ``BENCH_LAZY`` adds the second form.
Results go to Spark's no-op sink, so every row is computed and none collected.
Two forms are timed: ``queries`` on an archive that is typed and stored first (warm,
median of the runs), and ``lazy`` straight on the given table, once.  ``value`` is
the stored form with its ingest included.
"""

from __future__ import annotations

import json
import os
import statistics
import tempfile
import time

from lastseen import build_session
from verification.fixtures import ingest
from verification.queries import QUERIES


def seconds(build, spark, sf_dir: str) -> float:
    start = time.perf_counter()
    build(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    only = os.environ.get("BENCH_ONLY")
    chosen = {n: b for n, b in QUERIES.items() if not only or n in only.split(",")}
    spark = build_session(
        "lastseen-bench",
        master=f"local[{cpus}]",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="16g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    # Local mode: one machine, so its temporary folder is shared by all tasks.
    with tempfile.TemporaryDirectory(prefix="bench-") as folder:
        start = time.perf_counter()
        archive = ingest(spark, sf_dir, folder)
        stored_in = round(time.perf_counter() - start, 3)
        timings = {}
        for name, build in chosen.items():
            seconds(build, spark, archive)
            timings[name] = round(
                statistics.median(seconds(build, spark, archive) for _ in range(runs)), 3
            )
        lazy = {}
        if os.environ.get("BENCH_LAZY"):
            lazy = {name: seconds(build, spark, sf_dir) for name, build in chosen.items()}
        spark.stop()
    print(
        json.dumps(
            {
                "metric": "ingest and sum of warm query times on the stored archive",
                "value": round(stored_in + sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "ingest": stored_in,
                "lazy_total": round(sum(lazy.values()), 3),
                "lazy": lazy,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": int(cpus),
            }
        )
    )


if __name__ == "__main__":
    main()
