"""Small documents with every awkward case, and plain versions of the operators."""

from __future__ import annotations

import random
import re

from pyspark.sql import types as T

WORD = re.compile(r"[^\x20\x09-\x0D]+")

#: Columns whose names operators use for results or in between.
SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("size", T.StringType()),
        T.StructField("key", T.StringType()),
        T.StructField("n_bytes", T.StringType()),
        T.StructField("n_tokens", T.StringType()),
        T.StructField("component_id", T.StringType()),
        T.StructField("quality_score", T.StringType()),
        T.StructField("node", T.StringType()),
        T.StructField("email", T.StringType()),
    ]
)


def prose(seed: int, words: int) -> str:
    chance = random.Random(seed)
    return " ".join(
        "".join(chance.choice(("ta", "ri", "mon", "el", "sku", "é")) for _ in range(chance.randint(1, 4)))
        for _ in range(words)
    )


def awkward_rows() -> list[tuple]:
    shared, notice = prose(1, 150), "All rights reserved by somebody"
    texts = [
        None,
        "",
        "   \n\t ",
        "one",
        "two words",
        prose(2, 60),
        prose(2, 60),
        prose(2, 60) + " one more word",
        prose(3, 20_000),
        shared,
        prose(4, 90) + " " + shared + " " + prose(5, 90),
        prose(6, 90) + " " + shared,
        "a" * 3_000,
        "Mail a.b@c.de or x_y@z.org.uk, 10.0.0.1 or 999.1.1.1, +1 (255) 555-8013, 4310 0823 2932 2593 é",
        "No card: 1234567890123456, a@b, 1.2.3, +12",
        "line\n" * 30,
        "\n".join([prose(7, 12), notice, prose(8, 9), notice]),
        "🙂 あい mixed  spaces   and\ttabs\x85end it's 12,5 <|endoftext|>",
    ]
    rows = [
        (i, text, ("en", "fr", None)[i % 3], f"s{i % 4}" if i % 5 else None, len(text or ""))
        for i, text in enumerate(texts)
    ]
    rows += [(100 + i, f"{prose(20 + i, 30)}\n{notice}", "en", f"s{i}", 0) for i in range(8)]
    rows += [rows[5], rows[5], (None, prose(9, 40), None, None, None)]
    return [(*row, *["x"] * (len(SCHEMA) - 5)) for row in rows]


def awkward(spark):
    return spark.createDataFrame(awkward_rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def documents(spark, sf: str = "sf0.001"):
    return spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")


def pairs_of(frame, *columns: str) -> list[tuple]:
    """Rows in a fixed order, nulls included."""
    return sorted((tuple(row) for row in frame.select(*columns).collect()), key=repr)
