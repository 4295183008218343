"""Line dedup by the spread of a line over sites.

Boilerplate such as notices and navigation stands on many sites.  Every line hash
gets a HyperLogLog sketch of its sites, merged by aggregation.  Lines whose estimate
is clearly above or below the threshold are decided; those near it get an exact
distinct count.  Boilerplate lines are then taken out of the documents.

Copied documents put their lines on many sites too.  They are told from boilerplate
by evidence: documents that mostly consist of such lines are compared with each other
as near-copy removal does it, a group of copies counts as one site of its lines, and
only lines that still stand on enough sites are boilerplate.  Those leave every
document, also one they dominate; only a document of which nothing would be left
stays whole.  Blank lines stay where they are.

``op7_line_dedup`` keeps the rule of its SQL instead: lines are counted with the
copies, and a document that would lose half of its characters or more stays whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lastseen.llm.common import SPACES, stored, text_of
from lastseen.llm.near_dup import near_groups

#: Sites that make a line boilerplate, and the share of its characters up to which a
#: document may lose lines in ``op7_line_dedup``.
LEAST_SITES, MOST_REMOVED = 5, 0.5
#: Share of widespread lines from which a document may be a copy and is compared, and
#: the shingles and similarity of near-copy removal.
ASKED, COPY_WORDS, COPY_PERCENT = 0.5, 5, 80
#: Sketch size (2^12 registers, 1.6 % error) and the band that is counted exactly.
SKETCH_LOG, BAND, BAND_SITES = 12, 0.1, 1


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(SPACES))


def _lines(docs: DataFrame, *carried: Column, size: bool = False) -> DataFrame:
    """One row for each line with a word: its hashes, and the carried columns.

    Two hashes name a line, 96 bits together.  With ``size``, also its characters.
    """
    lines = docs.select(*carried, F.explode(F.split(text_of(), "\n", -1)).alias("__line"))
    line = _trimmed(F.col("__line"))
    named = lines.select(
        *(c for c in lines.columns if c != "__line"),
        line.alias("__line"),
    ).filter(F.col("__line") != "")
    added = {"h": F.xxhash64("__line"), "g": F.hash("__line")}
    if size:
        added["__size"] = F.char_length("__line")
    return named.withColumns(added).drop("__line")


def boilerplate(docs: DataFrame, least_sites: int = LEAST_SITES) -> DataFrame:
    """Hashes h, g of the lines that stand on ``least_sites`` sources or more.

    A null source is no site.
    """
    lines = _lines(docs, F.col("source").alias("site"))
    spread = lines.groupBy("h", "g").agg(F.hll_sketch_agg("site", SKETCH_LOG).alias("sketch"))
    estimated = stored(
        spread.select("h", "g", F.hll_sketch_estimate("sketch").alias("sites")).filter(
            F.col("sites") >= least_sites * (1 - BAND) - BAND_SITES
        ),
        "line-spread",
    )
    sure = F.col("sites") > least_sites * (1 + BAND) + BAND_SITES
    near = estimated.filter(~sure).select("h", "g")
    exact = (
        lines.filter(F.col("site").isNotNull())
        .join(near, ["h", "g"], "left_semi")
        .distinct()
        .groupBy("h", "g")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") >= least_sites)
    )
    return stored(estimated.filter(sure).select("h", "g").unionByName(exact.select("h", "g")), "boilerplate")


def _size(lines: Column) -> Column:
    """Characters of an array of lines."""
    return F.aggregate(lines, F.lit(0), lambda total, line: total + F.char_length(_trimmed(line)))


def independent_boilerplate(docs: DataFrame, least_sites: int = LEAST_SITES) -> DataFrame:
    """Hashes h, g of the lines of ``boilerplate`` that copies alone do not explain.

    A text, or a group of near copies among the texts that widespread lines dominate,
    is one site of a line, however many sources it stands on.
    """
    print_ = F.xxhash64(text_of())
    numbered = docs.select("text", "source", F.monotonically_increasing_id().alias("__row"))
    lines = _lines(
        numbered,
        F.col("__row"),
        print_.alias("print"),
        F.col("source").alias("site"),
        _size(F.split(text_of(), "\n", -1)).alias("__all"),
        size=True,
    )
    holders = stored(
        lines.join(boilerplate(docs, least_sites), ["h", "g"], "left_semi")
        .groupBy("__row", "print", "site", "__all")
        .agg(F.sum("__size").alias("__shared"), F.collect_set(F.struct("h", "g")).alias("held"))
        .select("print", "site", "held", (F.col("__shared") >= ASKED * F.col("__all")).alias("asked")),
        "line-holders",
    )
    asked = holders.filter("asked").select(F.col("print").alias("doc_id")).distinct()
    texts = docs.select(print_.alias("doc_id"), "text").join(asked, "doc_id", "left_semi")
    groups = near_groups(stored(texts.dropDuplicates(["doc_id"]), "line-texts"), COPY_WORDS, COPY_PERCENT)
    copies = stored(groups.select(F.col("doc_id").alias("print"), F.col("component_id").alias("of")), "line-copies")
    # One row for each line and text or group of copies, and whether it has several sites.
    places = (
        holders.filter(F.col("site").isNotNull())
        .join(copies, "print", "left")
        .select(F.explode("held").alias("line"), F.coalesce("of", "print").alias("of"), "site")
        .groupBy("line.h", "line.g", "of")
        .agg(F.min("site").alias("site"), (F.min("site") != F.max("site")).alias("several"))
    )
    # A line stands on enough sites in all: a group on several has one to itself.
    counted = (
        places.filter(~F.col("several"))
        .select("h", "g", "site")
        .distinct()
        .select("h", "g")
        .unionByName(places.filter("several").select("h", "g"))
        .groupBy("h", "g")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return stored(counted.filter(F.col("n") >= least_sites).select("h", "g"), "independent-boilerplate")


def without_boilerplate(
    docs: DataFrame, least_sites: int = LEAST_SITES, most_removed: float | None = None
) -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text``; ``n_chars`` follows.

    Adds ``n_lines`` (lines with a word) and ``n_removed``; columns of these names
    are replaced.  Null and blank texts, and those of boilerplate lines alone, stay as
    they are.  With ``most_removed`` copies count as sites too, and a document that
    would lose this share of its characters or more stays whole.
    """
    find = independent_boilerplate if most_removed is None else boilerplate
    found = find(docs, least_sites)
    identity, print_ = F.col("doc_id"), F.xxhash64(text_of())
    held = (
        _lines(docs, identity.alias("__id"), print_.alias("__print"))
        .join(found, ["h", "g"], "left_semi")
        .groupBy("__id", "__print")
        .agg(F.collect_set("h").alias("__found"))
    )
    kept = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    joined = docs.select(*(F.col(f"`{c}`") for c in kept), print_.alias("__own")).join(
        held, identity.eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__print")), "left"
    )
    lines = F.split(F.col("text"), "\n", -1)
    goes = lambda line: F.array_contains("__found", F.xxhash64(_trimmed(line)))
    split = joined.withColumn("__lines", lines).withColumns(
        {
            "n_lines": F.coalesce(
                F.size(F.filter("__lines", lambda line: _trimmed(line) != "")), F.lit(0)
            ).cast("long"),
            "__going": F.when(F.col("__found").isNotNull(), F.filter("__lines", goes)),
        }
    )
    share = F.lit(1.0 if most_removed is None else most_removed)
    cut = F.col("__going").isNotNull() & (_size(F.col("__going")) < share * _size(F.col("__lines")))
    staying = F.filter("__lines", lambda line: ~goes(line))
    text = F.when(F.col("__cut"), F.array_join(staying, "\n")).otherwise(F.col("text"))
    removed = F.when(F.col("__cut"), F.size("__going")).otherwise(0).cast("long")
    out = split.withColumn("__cut", cut).withColumns({"text": text, "n_removed": removed})
    if "n_chars" in kept:
        out = out.withColumn(
            "n_chars",
            F.when(F.col("n_removed") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(
                F.col("n_chars")
            ),
        )
    return out.select(*(F.col(f"`{c}`") for c in kept), "n_lines", "n_removed")


def op7_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return without_boilerplate(docs, most_removed=MOST_REMOVED).select(
        "doc_id", "n_lines", "n_removed", F.md5(text_of()).alias("kept_md5")
    )


OP7_SQL = r"""
WITH l AS (
  SELECT doc_id, source, i, lines[i] AS line, trim(lines[i], E' \t\n\x0b\x0c\r') AS bare
  FROM (SELECT doc_id, source, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
    unnest(range(1, len(lines) + 1)) AS u(i)),
boilerplate AS (
  SELECT bare FROM l WHERE bare <> '' GROUP BY bare HAVING count(DISTINCT source) >= 5),
marked AS (SELECT l.*, bare IN (SELECT bare FROM boilerplate) AS goes FROM l),
judged AS (
  SELECT doc_id, count(*) FILTER (WHERE bare <> '') AS n_lines, count(*) FILTER (WHERE goes) AS n_goes,
    coalesce(sum(length(bare)) FILTER (WHERE goes), 0) < 0.5 * sum(length(bare)) AS cut
  FROM marked GROUP BY doc_id)
SELECT j.doc_id, n_lines, CASE WHEN cut THEN n_goes ELSE 0 END AS n_removed,
  md5(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT (goes AND cut)), '')) AS kept_md5
FROM judged j JOIN marked m ON j.doc_id = m.doc_id
GROUP BY j.doc_id, n_lines, n_goes, cut
"""
