"""Mixing of sources to target weights, by Efraimidis-Spirakis sampling.

A source takes part with whole epochs first.  What its target leaves over is
drawn without replacement: each document gets an exponential key divided by its
quality weight, documents are taken by ascending key until the budget of words is
used up, and the last one is cut to what is left.

No source is ordered as a whole.  Keys are cut into bins, the same for every
source; bin sums, pre-aggregated before the shuffle, say which bin a source's
budget ends in, and only the documents of that one bin are put in order.  Keys
come from a hash of the id, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lastseen.llm.common import stored, symbol_count, text_of, word_count

#: Weights of the sources in code-point order, repeated as often as needed.
SOURCE_WEIGHTS = (5, 2, 1)
#: Size of the mix and greatest use of a source, as multiples of what there is.
MIX_SHARE, MOST_EPOCHS = 1.5, 2
#: Bins of the sampling keys; a bin of a source with 10^9 documents holds 250,000.
KEY_BINS = 4096


def quality_weight(text: Column, size: Column) -> Column:
    """Sampling weight of a document: 1 for prose, less with more mark-up."""
    return F.lit(1.0) / (F.lit(1.0) + F.lit(10.0) * symbol_count(text) / F.greatest(size, F.lit(1)))


def sampling_key(identity: Column, weight: Column) -> Column:
    """Exponential key of a document; null ids share one."""
    digits = F.substring(F.md5(F.coalesce(identity.cast("string"), F.lit(""))), 1, 12)
    uniform = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(2**48)
    return -F.log(uniform) / weight


def source_targets(sizes: DataFrame) -> DataFrame:
    """Columns source, source_size -> target of each source.

    One row for each source, so one task may order them.  The targets share
    ``MIX_SHARE`` of all words by weight; no source exceeds ``MOST_EPOCHS`` times
    its size, and what it cannot give is shared by weight among the others.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(SOURCE_WEIGHTS)
    weight = F.element_at(F.array(*map(F.lit, SOURCE_WEIGHTS)), (turn + 1).cast("int"))
    ranked = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * MOST_EPOCHS)
    by_fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    earlier = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = (
        F.lit(MIX_SHARE) * F.sum("source_size").over(everything)
        - F.coalesce(F.sum("cap").over(earlier), F.lit(0))
    ) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(earlier), F.lit(0)))
    filled = ranked.withColumn("level", level).withColumn(
        "full", F.col("cap") / F.col("weight") <= F.col("level")
    )
    # The level of the first source that stays below its cap holds for all later ones.
    final = F.max(F.when(~F.col("full"), F.col("level"))).over(everything)
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(final * F.col("weight"))
    return filled.select("source", "source_size", target.alias("target"))


def mixed(sized: DataFrame) -> DataFrame:
    """Add source_size, target, epochs and extra to rows with source, size, key.

    ``epochs`` is how often the document is taken whole, ``extra`` the words of
    its fractional turn (0: none, below ``size`` for the last one of a source).
    Null sizes do not occur; documents without words get no extra turn.  Rows
    equal in key and id are taken in either order, which gives equal results.
    """
    bin_of = F.floor(F.lit(KEY_BINS) * (F.lit(1.0) - F.exp(-F.col("key")))).cast("int")
    binned = sized.withColumn("bin", F.least(bin_of, F.lit(KEY_BINS - 1)))
    bins = stored(
        binned.groupBy("source", "bin").agg(F.sum("size").alias("bin_size")), "mix-bins"
    )
    sources = bins.groupBy("source").agg(F.sum("bin_size").alias("source_size"))
    targets = source_targets(sources)
    epochs = F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(0))
    budgets = targets.withColumn("epochs", epochs.cast("long")).withColumn(
        "budget", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long")
    )
    earlier = (
        Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    )
    before = F.coalesce(F.sum("bin_size").over(earlier), F.lit(0))
    # The bin in which the budget ends, and the words taken before it.
    limits = budgets.select(F.col("source").alias("limit_source"), "budget")
    last = (
        bins.withColumn("before", before)
        .join(limits, F.col("source").eqNullSafe(F.col("limit_source")))
        .filter(F.col("before") < F.col("budget"))
        .groupBy(F.col("source").alias("last_source"))
        .agg(F.max_by(F.struct("bin", "before"), "bin").alias("last"))
    )
    plan = stored(
        budgets.join(last, F.col("source").eqNullSafe(F.col("last_source")), "left").select(
            F.col("source").alias("plan_source"),
            "source_size",
            "target",
            "epochs",
            "budget",
            F.coalesce("last.bin", F.lit(-1)).alias("last_bin"),
            F.coalesce("last.before", F.lit(0)).alias("last_before"),
        ),
        "mix-plan",
    )
    # One row for each source: Spark broadcasts it if its size allows, else it joins by source.
    planned = binned.join(plan, F.col("source").eqNullSafe(F.col("plan_source")))
    inner = planned.filter(F.col("bin") != F.col("last_bin")).withColumn(
        "extra", F.when(F.col("bin") < F.col("last_bin"), F.col("size")).otherwise(F.lit(0))
    )
    by_key = (
        Window.partitionBy("source", "bin")
        .orderBy("key", "order_id", "size")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    taken = F.col("last_before") + F.coalesce(F.sum("size").over(by_key), F.lit(0))
    edge = planned.filter(F.col("bin") == F.col("last_bin")).withColumn(
        "extra", F.greatest(F.lit(0), F.least(F.col("size"), F.col("budget") - taken))
    )
    return inner.unionByName(edge).drop(
        "plan_source", "budget", "last_bin", "last_before", "bin", "key", "order_id"
    )


def sized_documents(docs: DataFrame, *carried: str) -> DataFrame:
    """What ``mixed`` needs of documents, and the carried columns."""
    size = word_count(text_of())
    return docs.select(
        *carried,
        F.col("source"),
        size.alias("size"),
        F.col("doc_id").alias("order_id"),
        sampling_key(F.col("doc_id"), quality_weight(text_of(), size)).alias("key"),
    )


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: each document as often as it is taken, with its columns.

    The last document of a source's fractional turn is taken whole.
    """
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "doc_id", "text", "source")
    chosen = mixed(sized_documents(rows, "row"))
    times = (F.col("epochs") + F.when(F.col("extra") > 0, 1).otherwise(0)).cast("int")
    return chosen.select("row", F.explode(F.array_repeat(F.lit(0), times))).select("row.*")


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    """Words each document gives to the mix; see ``mixed``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sized = stored(sized_documents(docs, "doc_id"), "mix-sizes")
    return mixed(sized).select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("epochs") * F.col("size") + F.col("extra")).cast("long").alias("taken"),
    )


OP4_SQL = r"""
WITH sized AS (
  SELECT doc_id, source,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')) AS symbols
  FROM documents),
keyed AS (
  SELECT doc_id, source, size,
    -ln((CAST('0x' || substr(md5(coalesce(CAST(doc_id AS varchar), '')), 1, 12) AS bigint) + 0.5::double)
        / 281474976710656.0::double)
      / (1.0::double / (1.0::double + 10.0::double * symbols / greatest(size, 1))) AS key
  FROM sized),
sources AS (
  SELECT source, CAST(sum(size) AS bigint) AS source_size,
    [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight
  FROM sized GROUP BY source),
filled AS (
  SELECT *, 2 * source_size AS cap,
    (1.5::double * sum(source_size) OVER () - coalesce(sum(2 * source_size) OVER earlier, 0))
      / (sum(weight) OVER () - coalesce(sum(weight) OVER earlier, 0)) AS level
  FROM sources
  WINDOW earlier AS (ORDER BY 2 * source_size / weight, source NULLS LAST
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, source_size,
    CASE WHEN cap / weight <= level THEN cap::double
         ELSE weight * max(CASE WHEN cap / weight > level THEN level END) OVER () END AS target
  FROM filled),
budgets AS (
  SELECT *, CAST(coalesce(floor(target / nullif(source_size, 0)), 0) AS bigint) AS epochs FROM targets),
ordered AS (
  SELECT k.doc_id, k.size, b.source_size, b.target, b.epochs,
    CAST(round(b.target - b.epochs * b.source_size) AS bigint) AS budget,
    coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY key, k.doc_id, k.size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM keyed k JOIN budgets b ON k.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, CAST(size AS bigint) AS size, source_size, target,
  CAST(epochs * size + greatest(0, least(size, budget - before)) AS bigint) AS taken
FROM ordered
"""
