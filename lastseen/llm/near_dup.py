"""Near-duplicate documents: MinHash bands, odd sketches, exact confirmation.

1. Every text becomes a set of shingles; texts of equal sets form a class, and only
   classes go on.
2. MinHash bands propose candidates: a pair at the threshold is missed with a
   probability below 10^-7.  In each bucket all classes are compared with the
   bucket's first, never all with all.
3. An odd sketch holds the parities of the hashed MinHash samples.  The population
   count of the XOR of two sketches estimates a high similarity closely; candidates
   far below the threshold leave.
4. The rest is confirmed on the full shingle sets.
5. Connected components of the links.  Where a bucket still holds classes of
   different components, those outside its largest component are compared with the
   others too, so that no link between different texts is lost: by odd sketches of
   many more samples and by one of the whole set, inside the join, so that only close
   pairs leave it.  The bits in which two whole sketches differ are never more than the
   shingles in which the sets do, so that test loses nothing, and for sets up to a few
   thousand shingles hardly a pair below the threshold passes it.  A first round
   confirms the closest few of each class, which joins nearly all that belong together;
   a second one all that are left between components.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lastseen.llm.common import shipped, stored

BANDS, ROWS = 32, 4
SAMPLES = BANDS * ROWS
#: Bits of an odd sketch; samples and bits of the fine sketches of step 5.
SKETCH_BITS = 512
FINE_SAMPLES, FINE_BITS = 1024, 2048
#: Standard errors a candidate's estimate may lie below the threshold.
SLACK = 6.5
#: Partners that a class has confirmed in the first round of step 5.
CLOSEST = 4

_SEEDS = np.random.default_rng(84_317).integers(0, 2**64, (3, FINE_SAMPLES), dtype=np.uint64)
_MULTIPLY, _ADD, _TURN = _SEEDS[0] | np.uint64(1), _SEEDS[1], _SEEDS[2]
_BYTE_VALUES = np.random.default_rng(55_021).integers(0, 2**64, 256, dtype=np.uint64)
_BASE = np.uint64(0xC2B2AE3D27D4EB4F)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(32))


def _word_prints(data: bytes) -> np.ndarray:
    """Fingerprint of every word of a text, in order."""
    raw = np.frombuffer(data, np.uint8)
    inside = np.concatenate(([False], ~((raw == 32) | ((raw >= 9) & (raw <= 13))), [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    if not len(edges):
        return np.empty(0, np.uint64)
    starts, ends = edges[::2], edges[1::2]
    # Offsets count from the word's start, so equal words get equal sums.
    offsets = np.arange(len(raw)) - np.repeat(np.concatenate(([0], starts)), np.diff(np.concatenate(([0], starts, [len(raw)]))))
    longest = int((ends - starts).max())
    powers = np.full(max(longest, int(offsets.max()) + 1), _BASE, np.uint64)
    powers[0] = 1
    values = _BYTE_VALUES[raw] * np.multiply.accumulate(powers)[offsets]
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values)))
    return _mixed(sums[ends] - sums[starts] + (ends - starts).astype(np.uint64))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct fingerprints of the text's shingles.

    Letters A-Z are lowered.  A text of fewer words is one shingle; without words
    the set is empty.
    """
    prints = _word_prints((text or "").encode().lower())
    size = min(words, len(prints))
    if not size:
        return prints
    count = len(prints) - size + 1
    found = np.full(count, np.uint64(0x51_7C_C1 + size))
    for k in range(size):
        found = _mixed(found * np.uint64(0x9E3779B97F4A7C15) + prints[k : k + count])
    return np.unique(found)


def min_hashes(shingles: np.ndarray, count: int = SAMPLES) -> np.ndarray:
    lowest = np.full(count, np.uint64(2**64 - 1))
    step = 1 << 19
    for start in range(0, len(shingles), max(1, step // count)):
        some = shingles[start : start + max(1, step // count)]
        values = _MULTIPLY[:count, None] * some + _ADD[:count, None]
        np.minimum(lowest, values.min(axis=1), out=lowest)
    return lowest


def _parities(prints: np.ndarray, size: int) -> np.ndarray:
    odd = np.bincount((prints % np.uint64(size)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def odd_sketch(samples: np.ndarray, size: int = SKETCH_BITS) -> np.ndarray:
    """Parities of the samples that fall on each bit, as signed 64-bit words."""
    return _parities(_mixed(samples ^ _TURN[: len(samples)]), size)


def whole_sketch(shingles: np.ndarray, size: int = FINE_BITS) -> np.ndarray:
    """The same of all shingles of a set."""
    return _parities(_mixed(shingles), size)


def differing_bits(one: str, other: str, bits: int) -> Column:
    """Number of bits in which two sketch columns differ."""
    words = (
        F.bit_count(F.get(one, F.lit(i)).bitwiseXOR(F.get(other, F.lit(i)))) for i in range(bits // 64)
    )
    return sum(words, F.lit(0))


def may_link(one: str, other: str, size: str, other_size: str, percent: int) -> Column:
    """Whether sketches of whole sets, and their sizes, leave a link possible.

    Linked sets differ in at most (100 - percent) / (100 + percent) of the sum of their
    sizes.
    """
    most = (100 - percent) * (F.col(size) + F.col(other_size))
    return ((100 + percent) * F.abs(F.col(size) - F.col(other_size)) <= most) & (
        (100 + percent) * differing_bits(one, other, FINE_BITS) <= most
    )


def estimate(one: str, other: str, samples: int = SAMPLES, bits: int = SKETCH_BITS) -> Column:
    """Similarity from the number of bits in which two sketch columns differ."""
    share = F.greatest(1 - 2 * differing_bits(one, other, bits) / F.lit(float(bits)), F.lit(1e-9))
    return 1 + F.lit(bits / (4 * samples)) * F.log(share)


def least_estimate(percent: int, samples: int = SAMPLES) -> float:
    """Estimates of true links stay above this but for one in 10^9."""
    threshold = percent / 100
    return threshold - SLACK * math.sqrt(threshold * (1 - threshold) / samples)


SIGNATURE_SCHEMA = "doc_id long, n_shingles long, node binary, bands array<long>, sketch array<long>"


def _signatures(words: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, nodes, bands, sketches = [], [], [], []
            for text in batch.column(1):
                shingles = shingle_set(text.as_py(), words)
                sizes.append(len(shingles))
                if not len(shingles):
                    nodes.append(None)
                    bands.append([])
                    sketches.append([])
                    continue
                nodes.append(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest())
                samples = min_hashes(shingles)
                keys = np.arange(BANDS, dtype=np.uint64)
                for k in range(ROWS):
                    keys = _mixed(keys * np.uint64(0x9E3779B97F4A7C15) + samples[k::ROWS])
                bands.append(keys.view(np.int64))
                sketches.append(odd_sketch(samples))
            longs = pa.list_(pa.int64())
            arrays = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(nodes, pa.binary())]
            arrays += [pa.array(bands, longs), pa.array(sketches, longs)]
            yield pa.RecordBatch.from_arrays(
                arrays, names=["doc_id", "n_shingles", "node", "bands", "sketch"]
            )

    return work


SET_SCHEMA = "node binary, shingles binary, fine array<long>, whole array<long>"


def _sets(words: int, fine: bool):
    """Columns node, text -> node, shingles and sketches; texts of another set are
    passed over."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sets, sketches, wholes = [], [], [], []
            for node, text in zip(batch.column(0), batch.column(1)):
                shingles = shingle_set(text.as_py(), words)
                data = shingles.tobytes()
                if hashlib.blake2b(data, digest_size=16).digest() == node.as_py():
                    nodes.append(node.as_py())
                    sets.append(data)
                    samples = min_hashes(shingles, FINE_SAMPLES) if fine else None
                    sketches.append(odd_sketch(samples, FINE_BITS) if fine else None)
                    wholes.append(whole_sketch(shingles) if fine else None)
            longs = pa.list_(pa.int64())
            types = (pa.binary(), pa.binary(), longs, longs)
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip((nodes, sets, sketches, wholes), types)],
                names=["node", "shingles", "fine", "whole"],
            )

    return work


def _confirm(percent: int):
    """Columns a, b and their shingles -> the linked pairs."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for one, other in zip(batch.column(2), batch.column(3)):
                x = np.frombuffer(one.as_py(), np.uint64)
                y = np.frombuffer(other.as_py(), np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return work


def components(links: DataFrame) -> DataFrame:
    """Columns a, b -> node, root: the smallest node of each component.

    Labels are lowered to the least among the neighbours and then to the label of
    the label, until none changes.  Every round is written to the shared folder.
    """
    both = stored(
        links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(),
        "links",
    )
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("root")), "labels")
    while True:
        seen = labels.select(F.col("node").alias("b"), F.col("root").alias("seen"))
        lowest = both.join(seen, "b").groupBy(F.col("a").alias("node")).agg(F.min("seen").alias("lowest"))
        lowered = labels.join(lowest, "node").select(
            "node", F.least("root", "lowest").alias("root"), F.col("root").alias("before")
        )
        jump = labels.select(F.col("node").alias("root"), F.col("root").alias("further"))
        after = stored(
            lowered.join(jump, "root").select("node", F.least("root", "further").alias("root"), "before"),
            "labels",
        )
        labels = after.select("node", "root")
        if after.filter(F.col("root") != F.col("before")).isEmpty():
            return labels


def merged(labels: DataFrame, more: DataFrame) -> DataFrame:
    """Labels of the components after more links a, b.

    Only the graph of the components themselves is walked again.
    """
    of_a = labels.select(F.col("node").alias("a"), F.col("root").alias("root_a"))
    of_b = labels.select(F.col("node").alias("b"), F.col("root").alias("root_b"))
    ends = stored(
        more.join(of_a, "a", "left")
        .join(of_b, "b", "left")
        .select("a", "b", F.coalesce("root_a", "a").alias("root_a"), F.coalesce("root_b", "b").alias("root_b")),
        "links",
    )
    between = ends.select(F.col("root_a").alias("a"), F.col("root_b").alias("b")).filter("a != b").distinct()
    raised = components(between).withColumnsRenamed({"node": "of", "root": "to"})
    sides = [ends.select(F.col(n).alias("node"), F.col(f"root_{n}").alias("root")) for n in ("a", "b")]
    known = labels.unionByName(sides[0]).unionByName(sides[1]).distinct()
    joined = known.join(raised, F.col("root") == F.col("of"), "left")
    return stored(joined.select("node", F.coalesce("to", "root").alias("root")), "labels")


def _estimated(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs a, b whose odd sketches do not rule a link out."""
    sketches = classes.select("node", "sketch")
    one = sketches.select(F.col("node").alias("a"), F.col("sketch").alias("x"))
    other = sketches.select(F.col("node").alias("b"), F.col("sketch").alias("y"))
    close = estimate("x", "y") >= least_estimate(percent)
    return pairs.join(one, "a").join(other, "b").filter(close).select("a", "b")


def _shingle_sets(nodes: DataFrame, docs: DataFrame, classes: DataFrame, words: int, fine: bool) -> DataFrame:
    """Full shingle sets of the given classes, from the text of one document each."""
    places = nodes.join(classes.select("node", "first_id"), "node")
    texts = docs.select(F.col("doc_id").alias("first_id"), "text")
    sets = texts.join(places, "first_id").select("node", "text").mapInArrow(_sets(words, fine), SET_SCHEMA)
    return stored(sets.dropDuplicates(["node"]), "shingle-sets")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs that are links by their full shingle sets."""
    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    other = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    joined = pairs.join(one, "a").join(other, "b").select("a", "b", "x", "y")
    return stored(joined.mapInArrow(_confirm(percent), "a binary, b binary"), "links")


def _split_buckets(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of buckets that hold classes of different components, with their roots."""
    placed = buckets.join(labels, "node", "left").select(
        "band", "key", "node", F.coalesce("root", "node").alias("root")
    )
    split = placed.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x != y")
    return stored(placed.join(split.select("key"), "key", "left_semi"), "split-buckets")


def _across(split: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Pairs p, q of a bucket's classes that lie in different components and look close.

    Only classes outside the bucket's largest component ask; within a component
    there is nothing left to find.  A pair is taken from the first bucket that its
    classes share.  The conditions are part of the join: what fails is not emitted.
    """
    parts = split.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    main = parts.groupBy("key").agg(F.max(F.struct("n", "root")).alias("m")).select("key", F.col("m.root").alias("main"))
    sided = split.join(main, "key").join(sketches, "node")
    asking = sided.filter(F.col("root") != F.col("main")).select(
        F.col("key").alias("p_key"),
        F.col("node").alias("p"),
        F.col("root").alias("p_root"),
        F.col("fine").alias("p_fine"),
        F.col("whole").alias("p_whole"),
        F.col("size").alias("p_size"),
        F.col("bands").alias("p_bands"),
    )
    close = may_link("p_whole", "whole", "p_size", "size", percent) & (
        estimate("p_fine", "fine", FINE_SAMPLES, FINE_BITS) >= least_estimate(percent, FINE_SAMPLES)
    )
    earlier = F.exists(
        F.slice(F.zip_with("p_bands", "bands", lambda x, y: x == y), F.lit(1), F.col("band")),
        lambda same: same,
    )
    met = asking.join(
        sided,
        (F.col("p_key") == F.col("key"))
        & (F.col("p_root") != F.col("root"))
        & ((F.col("root") == F.col("main")) | (F.col("p") < F.col("node")))
        & close
        & ~earlier,
    )
    return met.select(
        "p",
        F.col("node").alias("q"),
        estimate("p_fine", "fine", FINE_SAMPLES, FINE_BITS).alias("likeness"),
    )


def near_groups(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``docs``.

    Two documents are linked if 100 times the size of the intersection of their
    shingle sets reaches ``percent`` times that of the union; the component of a
    document is named by its smallest doc_id, and that document is kept.  Texts
    that are null or without words have no shingles, are linked with nothing and
    kept.  Rows of a null doc_id are linked with nothing either, kept, and have a
    null component.  Rows of one doc_id are one document if their sets are equal.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signatures = stored(rows.mapInArrow(_signatures(words), SIGNATURE_SCHEMA), "signatures")
    known = signatures.filter("node IS NOT NULL AND doc_id IS NOT NULL")
    classes = stored(
        known.groupBy("node").agg(
            F.min("doc_id").alias("first_id"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")
        ),
        "classes",
    )
    banded = classes.select("node", F.posexplode("bands").alias("band", "key"))
    shared = (
        banded.groupBy("key")
        .agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("leader"))
        .filter("n > 1")
        .drop("n")
    )
    buckets = stored(banded.join(shared, "key"), "buckets")
    to_leader = (
        buckets.filter("node != leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    )
    tested = stored(to_leader, "tested")
    pairs = stored(_estimated(tested, classes, percent), "pairs")
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node")))
    links = _confirmed(pairs, _shingle_sets(ends.distinct(), rows, classes, words, False), percent)
    labels = components(links)
    sets = None
    for closest in (CLOSEST, None):
        split = _split_buckets(buckets.select("band", "key", "node"), labels)
        if sets is None:
            sets = _shingle_sets(split.select("node").distinct(), rows, classes, words, True)
        size = (F.octet_length("shingles") / 8).cast("long").alias("size")
        sketches = sets.select("node", "fine", "whole", size).join(classes.select("node", "bands"), "node")
        across = _across(split, sketches, percent)
        if closest:
            order = Window.partitionBy("p").orderBy(F.col("likeness").desc(), "q")
            across = across.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= closest)
        named = across.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()
        fresh = stored(named.join(tested, ["a", "b"], "left_anti"), "pairs")
        more = _confirmed(fresh, sets, percent)
        if not more.isEmpty():
            labels = merged(labels, more)
        tested = tested.unionByName(fresh)
    placed = classes.select("node", "first_id").join(labels, "node", "left")
    rooted = placed.select("node", "first_id", F.coalesce("root", "node").alias("root"))
    names = rooted.groupBy("root").agg(F.min("first_id").alias("name"))
    named = stored(
        rooted.join(names, "root").select(F.col("node").alias("of"), F.col("name").alias("class_id")), "components"
    )
    joined = signatures.select("doc_id", "n_shingles", "node").join(
        named, (F.col("node") == F.col("of")) & F.col("doc_id").isNotNull(), "left"
    )
    component = F.coalesce("class_id", "doc_id")
    return joined.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def without_near_copies(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The documents that are kept, with all their columns."""
    gone = near_groups(docs, words, percent).filter(~F.col("kept")).select(F.col("doc_id").alias("__gone_id"))
    gone = stored(gone.distinct(), "near-copies")
    return docs.join(gone, F.col("doc_id") == F.col("__gone_id"), "left_anti")


@shipped
def op2_near_dup(spark, sf_dir: str) -> DataFrame:
    """One row per document with its group, by three-word shingles and 85 %.

    Null texts and texts without words have size 0 and stand alone; null ids have a null
    component and are kept; equal texts share a group, named by the smallest id; an empty
    table gives no rows.  Columns beside doc_id and text are not read.
    """
    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=3, percent=85)


OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS words
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE
    WHEN len(words) = 0 THEN []
    WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 1),
      lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) END) AS shingle
  FROM w),
sizes AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n
  FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id),
links AS (
  SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
  WHERE 100 * shared.n >= 85 * (p.n + q.n - shared.n)),
sides AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents
  UNION
  SELECT reach.x, sides.y FROM reach JOIN sides ON reach.y = sides.x)
SELECT d.doc_id, CAST(coalesce(n, 0) AS bigint) AS n_shingles, component_id,
  d.doc_id = component_id AS kept
FROM documents d
LEFT JOIN sizes ON sizes.doc_id = d.doc_id
JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY x) c ON c.x = d.doc_id
"""
