"""Quality rules: robust multivariate outliers of text statistics.

Each text gives a vector of transformed statistics.  Per language and source, a
minimum-covariance-determinant estimate (FAST-MCD with a deterministic start and
concentration steps) finds the centre and scatter of the bulk of the documents;
a document whose Mahalanobis distance from it is beyond a chi-square quantile is
rejected.

Only DataFrame functions.  A group is never gathered: every step is a mergeable
aggregate (sums of integers, exact percentiles over quantised values), so a
language and source with a third of all documents is pre-aggregated like any
other.  Statistics are integers in thousandths and sums are decimals, so the
estimates do not depend on the order of rows.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lastseen.llm.common import SPACES, stored, symbol_count, text_of, words_of

#: Fixed values of the contract: fewest words, window length, repeat limit in percent.
FEWEST_WORDS, WINDOW, MOST_REPEATED = 10, 5, 20
#: Statistics of a vector and the least standard deviation each is credited with.
STATISTICS = {
    "v_words": 0.5,  # ln of the words
    "v_length": 0.15,  # ln of the mean word length
    "v_symbols": 0.6,  # ln of the mark-up characters per thousand
    "v_repeats": 0.05,  # share of words in repeated windows
    "v_lines": 0.08,  # share of repeated lines
    "v_variety": 0.06,  # ln of distinct words against ln of words
}
SCALE = 1000
#: Share of a group the estimate rests on, concentration steps, and tail left out.
BULK, STEPS, TAIL = 0.75, 4, 1e-6
#: Groups below this size are estimated together.
FEWEST_DOCUMENTS = 100
#: Unit of all documents, by which a small pool is judged if its language is small too.
EVERY = "every"

_NAMES = tuple(STATISTICS)
_D = len(_NAMES)


def chi_square_cdf(x: float, degrees: int) -> float:
    """For an even number of degrees of freedom."""
    terms = (math.exp(k * math.log(x / 2) - math.lgamma(k + 1)) for k in range(1, degrees // 2))
    return 1.0 - math.exp(-x / 2) * (1.0 + sum(terms))


def chi_square_quantile(p: float, degrees: int) -> float:
    low, high = 1e-9, 1e4
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square_cdf(middle, degrees) < p else (low, middle)
    return high


#: Makes the scatter of the bulk consistent with that of the whole.
CONSISTENCY = BULK / chi_square_cdf(chi_square_quantile(BULK, _D), _D + 2)
CUTOFF = chi_square_quantile(1 - TAIL, _D)


def text_statistics(docs: DataFrame, *carried: str) -> DataFrame:
    """The contract's counts of each text, with the carried columns.

    Store the result before filtering it: a filter pushed into these expressions
    would evaluate them once for every element of their arrays.
    """
    text = text_of()
    lines = F.filter(F.split(text, "\n", -1), lambda line: F.btrim(line, F.lit(SPACES)) != "")
    word = lambda i, k: F.get(F.col("__words"), i + k)
    windows = F.transform(
        F.sequence(F.lit(0), F.size("__words") - WINDOW),
        lambda i: F.xxhash64(*(word(i, k) for k in range(WINDOW))),
    )
    none = F.array().cast("array<bigint>")
    ranked = F.array_sort(
        F.transform("__windows", lambda p, i: F.struct(p.alias("p"), i.alias("i")))
    )
    twice = F.filter(
        F.col("__ranked"),
        lambda w, i: F.coalesce(F.get(F.col("__ranked"), i + 1)["p"] == w["p"], F.lit(False))
        | F.coalesce(F.get(F.col("__ranked"), F.when(i > 0, i - 1))["p"] == w["p"], F.lit(False)),
    )
    places = F.array_sort(F.transform(twice, lambda w: w["i"]))
    covered = F.aggregate(
        F.transform(
            "__places",
            lambda at, i: F.least(
                F.lit(WINDOW), F.coalesce(F.get(F.col("__places"), i + 1) - at, F.lit(WINDOW))
            ),
        ),
        F.lit(0),
        lambda total, words: total + words,
    )
    # Texts whose windows are all distinct, the usual case, end after one hash
    # pass; only the others put their windows in order.
    return (
        docs.select(*carried, text.alias("__text"), words_of(text).alias("__words"), lines.alias("__lines"))
        .withColumn(
            "__windows", F.when(F.size("__words") >= WINDOW, windows).otherwise(none)
        )
        .withColumn(
            "__ranked",
            F.when(F.size(F.array_distinct("__windows")) < F.size("__windows"), ranked),
        )
        .withColumn("__places", F.when(F.col("__ranked").isNotNull(), places))
        .select(
            *carried,
            F.size("__words").cast("long").alias("n_words"),
            F.char_length(F.translate("__text", SPACES, "")).cast("long").alias("word_chars"),
            symbol_count(F.col("__text")).alias("n_symbols"),
            (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
            F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
            F.size("__lines").cast("long").alias("n_lines"),
            F.size(F.array_distinct("__words")).cast("long").alias("n_distinct"),
        )
        .withColumn(
            "base_failed",
            (F.col("n_words") < FEWEST_WORDS)
            | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")),
        )
    )


def with_vector(statistics: DataFrame) -> DataFrame:
    """Add the transformed statistics, as integers in thousandths."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    values = {
        "v_words": F.log1p("n_words"),
        "v_length": F.log1p(F.col("word_chars") / words),
        "v_symbols": F.log1p(1000 * F.col("n_symbols") / F.greatest("word_chars", F.lit(1))),
        "v_repeats": F.col("n_repeat_words") / words,
        "v_lines": F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)),
        "v_variety": F.log1p("n_distinct") / F.log1p(words),
    }
    return statistics.withColumns(
        {name: F.round(value * SCALE).cast("long") for name, value in values.items()}
    )


def _moments(rows: DataFrame) -> DataFrame:
    """Mean and inverse Cholesky factor of each group's (regularised) scatter."""
    exact = {name: F.col(name).cast("decimal(18,0)") for name in _NAMES}
    sums = [F.sum(exact[a]).cast("double").alias(f"s_{a}") for a in _NAMES]
    products = [
        F.sum(exact[a] * exact[b]).cast("double").alias(f"p_{i}_{j}")
        for i, a in enumerate(_NAMES)
        for j, b in enumerate(_NAMES[: i + 1])
    ]
    frame = rows.groupBy("unit").agg(F.count(F.lit(1)).alias("n"), *sums, *products)
    frame = frame.withColumns({f"m_{a}": F.col(f"s_{a}") / F.col("n") for a in _NAMES})
    # Row by row: the factor, then its inverse.
    for i, a in enumerate(_NAMES):
        for j, b in enumerate(_NAMES[: i + 1]):
            value = CONSISTENCY * (
                F.col(f"p_{i}_{j}") / F.col("n") - F.col(f"m_{a}") * F.col(f"m_{b}")
            )
            if i == j:
                value = value + (STATISTICS[a] * SCALE) ** 2
            for k in range(j):
                value = value - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
            value = F.sqrt(F.greatest(value, F.lit(1e-9))) if i == j else value / F.col(f"l_{j}_{j}")
            frame = frame.withColumn(f"l_{i}_{j}", value)
    for i in range(_D):
        for j in range(i + 1):
            if i == j:
                value = 1 / F.col(f"l_{i}_{i}")
            else:
                parts = [F.col(f"l_{i}_{k}") * F.col(f"w_{k}_{j}") for k in range(j, i)]
                value = -reduce(lambda x, y: x + y, parts) / F.col(f"l_{i}_{i}")
            frame = frame.withColumn(f"w_{i}_{j}", value)
    return frame.select(
        F.col("unit").alias("__unit"),
        *(f"m_{a}" for a in _NAMES),
        *(f"w_{i}_{j}" for i in range(_D) for j in range(i + 1)),
    )


def _distance() -> Column:
    """Squared Mahalanobis distance of a row joined with ``_moments``."""
    total = F.lit(0.0)
    for i in range(_D):
        parts = [
            F.col(f"w_{i}_{j}") * (F.col(a) - F.col(f"m_{a}")) for j, a in enumerate(_NAMES[: i + 1])
        ]
        total = total + F.pow(reduce(lambda x, y: x + y, parts), F.lit(2.0))
    return total


def _bulk(rows: DataFrame, distance: Column) -> DataFrame:
    """The rows of each group whose distance is among its smallest."""
    # A logarithmic scale keeps the distinct values, and so the percentile's state, few.
    rank = F.least(F.round(F.log1p(distance) * 200), F.lit(4000.0)).cast("int")
    ranked = rows.withColumn("__rank", rank)
    limits = stored(
        ranked.groupBy(F.col("unit").alias("__limit_unit")).agg(
            F.ceil(F.percentile("__rank", F.lit(BULK))).alias("__limit")
        ),
        "mcd-limits",
    )
    return ranked.join(limits, F.col("unit") == F.col("__limit_unit")).filter(
        F.col("__rank") <= F.col("__limit")
    )


def robust_moments(vectors: DataFrame) -> DataFrame:
    """Centre and scatter of the bulk of each ``unit``."""
    quartiles = [
        F.percentile(a, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"q_{a}") for a in _NAMES
    ]
    start = stored(
        vectors.groupBy(F.col("unit").alias("__unit")).agg(*quartiles), "mcd-start"
    )
    started = vectors.join(start, F.col("unit") == F.col("__unit"))
    widest = F.greatest(
        *(
            F.abs(F.col(a) - F.col(f"q_{a}")[1])
            / F.greatest(F.col(f"q_{a}")[2] - F.col(f"q_{a}")[0], F.lit(STATISTICS[a] * SCALE))
            for a in _NAMES
        )
    )
    moments = stored(_moments(_bulk(started, widest * 4)), "mcd-moments")
    for _ in range(STEPS):
        placed = vectors.join(moments, F.col("unit") == F.col("__unit"))
        moments = stored(_moments(_bulk(placed, _distance())), "mcd-moments")
    return moments


def _with_lenders(units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``units`` with the pooled groups under a unit of their language or of everything.

    Also these units with the language they stand for; there are fewer than
    ``FEWEST_DOCUMENTS``, as each has a document in the pool.
    """
    languages = units.groupBy(F.col("__lang").alias("of")).agg(F.sum("n_own").alias("n_lang"))
    named = F.concat(F.lit("lang "), F.to_json(F.struct("__lang"), {"ignoreNullFields": "false"}))
    lender = F.when(F.col("n_lang") >= FEWEST_DOCUMENTS, named).otherwise(F.lit(EVERY))
    moved = stored(
        units.join(languages, F.col("__lang").eqNullSafe(F.col("of"))).select(
            "__own", "__lang", F.when(F.col("unit") == "", lender).otherwise(F.col("unit")).alias("unit")
        ),
        "mcd-units",
    )
    lent = moved.filter(~F.col("unit").startswith("{")).select(
        F.col("unit").alias("lent_unit"), F.when(F.col("unit") != EVERY, F.col("__lang")).alias("lent_lang")
    )
    return moved, lent.distinct()


def judged(statistics: DataFrame) -> DataFrame:
    """Add ``distance`` (squared) and ``kept`` to rows of ``text_statistics``.

    The rows have the columns lang and source, which may be null.  Documents that
    fail the base rules take no part in the estimates and are not kept.  Groups of
    fewer than ``FEWEST_DOCUMENTS`` are estimated together; if all of these are
    fewer too, they are judged by their language, or by all documents if that has as
    few.  Of fewer documents in all nothing is known, and they are kept.
    """
    own = F.to_json(F.struct("lang", "source"), {"ignoreNullFields": "false"})
    # Stored first: filters must not be pushed into the expressions over the texts,
    # and the texts are read once.
    vectors = with_vector(stored(statistics, "text-statistics")).withColumn("own", own)
    sizes = vectors.filter(~F.col("base_failed")).groupBy("own", "lang").agg(F.count(F.lit(1)).alias("n_own"))
    units = stored(
        sizes.select(
            F.col("own").alias("__own"),
            F.col("lang").alias("__lang"),
            "n_own",
            F.when(F.col("n_own") >= FEWEST_DOCUMENTS, F.col("own")).otherwise(F.lit("")).alias("unit"),
        ),
        "mcd-units",
    )
    pooled = units.filter("unit = ''").agg(F.sum("n_own")).first()[0] or 0
    lent = None
    if 0 < pooled < FEWEST_DOCUMENTS:
        units, lent = _with_lenders(units)
    placed = vectors.join(units.select("__own", "unit"), F.col("own") == F.col("__own"), "left")
    clean = placed.filter(~F.col("base_failed")).select("unit", "lang", *_NAMES)
    if lent is not None:
        own_units = clean.filter(F.col("unit").startswith("{")).select("unit", *_NAMES)
        lending = (F.col("lent_unit") == EVERY) | F.col("lang").eqNullSafe(F.col("lent_lang"))
        borrowed = clean.join(F.broadcast(lent), lending).select(F.col("lent_unit").alias("unit"), *_NAMES)
        clean = own_units.unionByName(borrowed)
    clean = clean.select("unit", *_NAMES)
    counts = clean.groupBy("unit").agg(F.count(F.lit(1)).alias("n_unit"))
    known = stored(counts.filter(F.col("n_unit") >= FEWEST_DOCUMENTS), "mcd-known")
    moments = robust_moments(clean.join(known.select("unit"), "unit", "left_semi"))
    # Rows that failed may be of a group without any other: the join keeps them.
    scored = placed.join(moments, F.col("unit") == F.col("__unit"), "left")
    return scored.withColumn("distance", F.when(F.col("__unit").isNotNull(), _distance())).withColumn(
        "kept", ~F.col("base_failed") & F.coalesce(F.col("distance") <= CUTOFF, F.lit(True))
    )


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judged(text_statistics(docs, "doc_id", "lang", "source")).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        "distance",
    )
