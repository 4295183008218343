"""Exact top-k search by inner product: columnar branch and bound.

Vectors are turned into integers and packed into blocks in vertical layout, one row
for each dimension.  For a block of queries and a block of candidates, scores are
accumulated a few dimensions at a time; what the remaining dimensions can still add
is bounded by the product of the remaining norms, and candidates that cannot reach
the k-th best score any more are dropped from the columns.

Every query meets every candidate, in blocks: query blocks and candidate blocks are
dealt to keys of both, so no side is broadcast or gathered, and only the k best of
each pair of blocks leave a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lastseen.llm.common import shipped, stored

#: Vectors in a block, queries of a block scored at a time, dimensions accumulated at a
#: time, shares of the candidates.  A candidate is sent once for each block of queries.
QUERY_BLOCK, CANDIDATE_BLOCK = 4096, 4096
QUERIES_AT_A_TIME = 256
DIMENSIONS_AT_A_TIME = 16
SLOTS = 16
#: Sums below this are exact in double precision.
EXACT = 2**53
#: Integers from here on are no components; scores beyond the largest long are that long.
TOO_LARGE, LARGEST = 2**62, 2**63 - 1

BLOCK_SCHEMA = "n int, dims int, ids binary, values binary"


def _packer(size: int, scale: float):
    """Rows id, vector -> blocks of integers floor(scale * x), one row a dimension."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, size):
                some = batch.slice(start, size)
                vectors = some.column(1).to_pylist()
                # Shorter vectors have no more dimensions: zeros add nothing.
                dims = max(map(len, vectors), default=0)
                grid = np.zeros((len(vectors), dims), dtype=np.float64)
                for row, vector in zip(grid, vectors):
                    row[: len(vector)] = vector
                scaled = np.floor(grid * scale)
                columns = scaled.astype(np.int64).T
                ids = some.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                values = [[len(vectors)], [dims], [ids.tobytes()], [np.ascontiguousarray(columns).tobytes()]]
                types = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, t) for v, t in zip(values, types)], names=["n", "dims", "ids", "values"]
                )

    return pack


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best, ties to smaller ids; equal rows count once."""
    order = np.lexsort((ids, -scores))
    ids, scores = ids[order], scores[order]
    new = np.ones(len(ids), dtype=bool)
    new[1:] = (ids[1:] != ids[:-1]) | (scores[1:] != scores[:-1])
    return ids[new][:k], scores[new][:k]


def _as_long(scores: np.ndarray) -> np.ndarray:
    """Scores as longs; those beyond, held as Python integers, as the largest or smallest."""
    if scores.dtype == object:
        scores = np.array([max(-LARGEST, min(LARGEST, s)) for s in scores], dtype=np.int64)
    return scores.astype(np.int64)


def search_blocks(
    query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, columns: np.ndarray, k: int
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query (columns of ``queries``) its k best of the candidates."""
    dims = min(len(queries), len(columns))
    queries, columns = queries[:dims], columns[:dims]
    largest = int(np.abs(queries).max(initial=0)) * int(np.abs(columns).max(initial=0))
    if largest * max(dims, 1) < EXACT:
        queries, columns = queries.astype(np.float64), columns.astype(np.float64)
    elif largest * max(dims, 1) >= 2**63:
        queries, columns = queries.astype(object), columns.astype(object)
    cuts = [*range(0, dims, DIMENSIONS_AT_A_TIME), dims]
    blocks = list(zip(cuts, cuts[1:]))
    # Norms of what is left after each block; a little more than exact.
    mass = lambda m: [np.sqrt((m[b:].astype(np.float64) ** 2).sum(axis=0)) for _, b in blocks]
    query_mass, mass_left = mass(queries), mass(columns)
    norms = np.sqrt((columns.astype(np.float64) ** 2).sum(axis=0))
    seeds = np.argsort(-norms, kind="stable")[: 8 * k]
    first_end = blocks[0][1] if blocks else 0
    first = queries[:first_end].T @ columns[:first_end]
    seeded = queries.T @ columns[:, seeds]
    for q, query_id in enumerate(query_ids.tolist()):
        own = ids[seeds] == query_id
        _, known = _best(ids[seeds][~own], _as_long(seeded[q][~own]), k)
        limit = known[-1] if len(known) >= k else -np.inf
        alive = np.flatnonzero(ids != query_id)
        sums = first[q][alive]
        for step, (a, b) in enumerate(blocks):
            if step:
                sums = sums + queries[a:b, q] @ columns[a:b, alive]
            reach = query_mass[step][q] * mass_left[step][alive] * (1 + 1e-9) + 1e-6
            stay = sums.astype(np.float64) + reach >= limit
            alive, sums = alive[stay], sums[stay]
        best, scores = _best(ids[alive], _as_long(sums), k)
        yield query_id, best, scores


PAIR_SCHEMA = "query_id long, vec_id long, score long"


def _searcher(k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                grids = []
                for side in ("q", "c"):
                    ids = np.frombuffer(row[f"{side}_ids"], np.int64)
                    values = np.frombuffer(row[f"{side}_values"], np.int64)
                    grids += [ids, values.reshape(row[f"{side}_dims"], row[f"{side}_n"])]
                query_ids, queries, *others = grids
                found = []
                for start in range(0, len(query_ids), QUERIES_AT_A_TIME):
                    some = slice(start, start + QUERIES_AT_A_TIME)
                    found += search_blocks(query_ids[some], queries[:, some], *others, k)
                sizes = [len(ids) for _, ids, _ in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(np.array([q for q, _, _ in found], np.int64), sizes)),
                        pa.array(np.concatenate([i for _, i, _ in found])),
                        pa.array(np.concatenate([s for _, _, s in found])),
                    ],
                    names=["query_id", "vec_id", "score"],
                )

    return search


def nearest(queries: DataFrame, candidates: DataFrame, k: int, scale: float) -> DataFrame:
    """The k candidates of highest integer inner product of each query.

    Both frames have the columns vec_id and embedding.  Vectors that are null or
    hold null or non-finite components, and null ids, take no part, nor do vectors with a
    component of 2^62 or more once scaled.  Scores are exact; one that a long cannot hold
    is returned, and ranked, as the largest or smallest.  A query's own id is no candidate;
    rows equal in id and score count once; missing dimensions are zeros; an empty table
    gives no rows.  Returns query_id, rank (from 1), vec_id, score.
    """

    def usable(frame: DataFrame) -> DataFrame:
        vector = F.col("embedding").cast("array<double>")
        fits = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * scale) < TOO_LARGE)
        finite = F.forall(vector, fits)
        return frame.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector")).filter(
            F.col("vec_id").isNotNull() & finite
        )

    def blocks(frame: DataFrame, size: int, side: str) -> DataFrame:
        packed = usable(frame).mapInArrow(_packer(size, scale), BLOCK_SCHEMA)
        return packed.withColumnsRenamed({c: f"{side}_{c}" for c in packed.columns})

    asked = stored(
        blocks(queries, QUERY_BLOCK, "q").withColumn("number", F.monotonically_increasing_id()), "topk-queries"
    )
    keys = max(1, asked.count())
    asked = asked.withColumn("key", F.pmod(F.xxhash64("number"), F.lit(keys))).drop("number")
    asked = asked.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(SLOTS - 1))))
    given = blocks(candidates, CANDIDATE_BLOCK, "c")
    given = given.withColumn("slot", F.pmod(F.xxhash64("c_ids"), F.lit(SLOTS)).cast("int"))
    every = F.sequence(F.lit(0).cast("long"), F.lit(keys - 1).cast("long"))
    given = given.withColumn("key", F.explode(every))
    pairs = given.join(asked, ["key", "slot"]).drop("key", "slot")
    scored = pairs.mapInArrow(_searcher(k), PAIR_SCHEMA).dropDuplicates()
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


@shipped
def op8_exact_topk(spark, sf_dir: str) -> DataFrame:
    """The 20 best candidates of each vector whose id is divisible by 20.

    Null, non-finite, very large, tied and repeated vectors are as in :func:`nearest`; an
    empty table gives no rows and other columns are ignored.
    """
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors.filter("vec_id % 20 = 0"), vectors, k=20, scale=64.0)


OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    CAST(list_inner_product(q.e, c.e) AS bigint) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored)
SELECT query_id, CAST(r AS integer) AS rank, vec_id, score FROM ranked WHERE r <= 20
"""
