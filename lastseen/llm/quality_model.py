"""Quality classifier: a generalised additive model with pairwise interactions.

Statistics of a text are cut into bins.  Cyclic boosting visits one statistic at a
time and fits a shallow tree of the loss gradient over its bins; the trees of a
statistic add up to one lookup table.  Afterwards the pairs of statistics that
explain most of what is left get tables over two bins.  A score is the logistic
function of a sum of table entries, added up for a whole batch at once.

Training takes at most ``TRAINING_ROWS`` labelled documents, chosen by a hash of
their id, and runs on the driver; everything else runs where the texts are.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lastseen.llm.common import shipped, stored

#: Bound of the training sample.
TRAINING_ROWS = 40_000
BINS, PAIR_BINS = 32, 8
ROUNDS, PAIR_ROUNDS, PAIRS = 150, 60, 6
RATE, LEAST_HESSIAN, LEAVES = 0.15, 2.0, 3

STATISTICS = (
    "words",
    "word_length",
    "word_length_spread",
    "variety",
    "top_share",
    "letters",
    "digits",
    "capitals",
    "marks",
    "symbols",
    "sentence",
    "lines",
    "line_variety",
    "short_words",
    "compression",
)

# Classes of byte values (bytes beyond ASCII count as letters).
_CLASSES = np.zeros((256, 5))
_CLASSES[[*range(65, 91), *range(97, 123), *range(128, 256)], 0] = 1
_CLASSES[48:58, 1] = 1
_CLASSES[65:91, 2] = 1
_CLASSES[[ord(c) for c in ".,;:!?'\"-()"], 3] = 1
_CLASSES[[ord(c) for c in "#*$%&|<>@/\\^_~=+[]{}`"], 4] = 1


def statistics_of(text: str | None) -> tuple[float, ...]:
    """The statistics of a text, zeros for one without words."""
    data = (text or "").encode()
    words = data.split()
    n = len(words)
    if not n:
        return (0.0,) * len(STATISTICS)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    letters, digits, capitals, marks, symbols = (counts @ _CLASSES) / len(data)
    lengths = np.fromiter(map(len, words), np.float64, n)
    seen: dict[bytes, int] = {}
    for word in words:
        seen[word] = seen.get(word, 0) + 1
    lines = [line for line in data.split(b"\n") if line.strip()]
    # Texts beyond 32 KB are compressed in pieces of that size, all of them.
    packed = sum(len(zlib.compress(data[i : i + 32768], 1)) for i in range(0, len(data), 32768))
    return (
        math.log1p(n),
        lengths.mean(),
        lengths.std(),
        len(seen) / n,
        max(seen.values()) / n,
        letters,
        digits,
        capitals,
        marks,
        symbols,
        math.log1p(n / (1 + data.count(b".") + data.count(b"!") + data.count(b"?"))),
        math.log1p(len(lines)),
        len(set(lines)) / max(1, len(lines)),
        float((lengths <= 3).mean()),
        packed / len(data),
    )


@dataclass
class AdditiveModel:
    """Bin edges, a table for each statistic, and tables for some pairs."""

    start: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pair_edges: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]

    def score(self, values: np.ndarray) -> np.ndarray:
        total = np.full(len(values), self.start)
        for column, edges, table in zip(values.T, self.edges, self.tables):
            total += table[np.searchsorted(edges, column, "right")]
        bins = {}
        for i, j, table in self.pairs:
            for k in (i, j):
                if k not in bins:
                    bins[k] = np.searchsorted(self.pair_edges[k], values[:, k], "right")
            total += table[bins[i], bins[j]]
        return 1.0 / (1.0 + np.exp(-np.clip(total, -30.0, 30.0)))


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1]))


def _gain(g, h):
    return g * g / (h + LEAST_HESSIAN)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int = LEAVES) -> np.ndarray:
    """A tree over ordered bins: leaf values per bin, best splits first."""
    parts = [(0, len(g))]
    sums_g, sums_h = np.concatenate(([0], np.cumsum(g))), np.concatenate(([0], np.cumsum(h)))
    while len(parts) < leaves:
        best = (1e-9, None)
        for a, b in parts:
            if b - a < 2:
                continue
            cut = np.arange(a + 1, b)
            left_g, left_h = sums_g[cut] - sums_g[a], sums_h[cut] - sums_h[a]
            all_g, all_h = sums_g[b] - sums_g[a], sums_h[b] - sums_h[a]
            gains = _gain(left_g, left_h) + _gain(all_g - left_g, all_h - left_h) - _gain(all_g, all_h)
            k = int(gains.argmax())
            if gains[k] > best[0]:
                best = (gains[k], (a, int(cut[k]), b))
        if best[1] is None:
            break
        a, middle, b = best[1]
        parts.remove((a, b))
        parts += [(a, middle), (middle, b)]
    values = np.zeros(len(g))
    for a, b in parts:
        values[a:b] = (sums_g[b] - sums_g[a]) / (sums_h[b] - sums_h[a] + LEAST_HESSIAN)
    return values


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best split of a grid of bins into four: its gain and its values."""
    sums = [np.pad(m.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for m in (g, h)]
    best, values = 0.0, np.zeros_like(g)
    rows, columns = g.shape
    for i in range(1, rows):
        for j in range(1, columns):
            gain, grid = -_gain(sums[0][-1, -1], sums[1][-1, -1]), np.zeros_like(g)
            for a, b in ((0, i), (i, rows)):
                for c, d in ((0, j), (j, columns)):
                    x, y = (s[b, d] - s[a, d] - s[b, c] + s[a, c] for s in sums)
                    gain += _gain(x, y)
                    grid[a:b, c:d] = x / (y + LEAST_HESSIAN)
            if gain > best:
                best, values = gain, grid
    return best, values


def fit(values: np.ndarray, labels: np.ndarray) -> AdditiveModel:
    """Train on rows of statistics and labels 0 or 1; without rows, score one half."""
    d = len(STATISTICS)
    if not len(labels):
        none = [np.empty(0)] * d
        return AdditiveModel(0.0, none, [np.zeros(1)] * d, none, [])
    share = (labels.sum() + 0.5) / (len(labels) + 1.0)
    start = math.log(share / (1 - share))
    edges = [_edges(column, BINS) for column in values.T]
    bins = [np.searchsorted(e, column, "right") for e, column in zip(edges, values.T)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    score = np.full(len(labels), start)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1.0 / (1.0 + np.exp(-score))
        return labels - p, p * (1 - p)

    for _ in range(ROUNDS):
        for k in range(d):
            g, h = slopes()
            size = len(tables[k])
            step = RATE * _tree(np.bincount(bins[k], g, size), np.bincount(bins[k], h, size))
            tables[k] += step
            score += step[bins[k]]
    pair_edges = [_edges(column, PAIR_BINS) for column in values.T]
    coarse = [np.searchsorted(e, column, "right") for e, column in zip(pair_edges, values.T)]

    def grids(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        g, h = slopes()
        shape = (len(pair_edges[i]) + 1, len(pair_edges[j]) + 1)
        flat = coarse[i] * shape[1] + coarse[j]
        return tuple(np.bincount(flat, m, shape[0] * shape[1]).reshape(shape) for m in (g, h))

    ranked = sorted(combinations(range(d), 2), key=lambda p: -_quadrants(*grids(*p))[0])
    pairs = [(i, j, np.zeros((len(pair_edges[i]) + 1, len(pair_edges[j]) + 1))) for i, j in ranked[:PAIRS]]
    for _ in range(PAIR_ROUNDS):
        for i, j, table in pairs:
            step = RATE * _quadrants(*grids(i, j))[1]
            table += step
            score += step[coarse[i], coarse[j]]
    return AdditiveModel(start, edges, tables, pair_edges, pairs)


def held_out(identity):
    """A third of the ids, never trained on."""
    return F.coalesce(F.crc32(identity.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def trained(docs: DataFrame, labels: DataFrame) -> AdditiveModel:
    """Model of ``labels`` (doc_id, quality) outside the held-out third.

    Rows without a quality of 0 or 1 or without a document are passed over; of
    documents with the same id one is used.
    """
    chosen = (
        labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
        .filter(~held_out(F.col("doc_id")))
        .select(F.col("doc_id").alias("label_id"), F.col("quality").cast("int").alias("quality"))
        .orderBy(F.xxhash64("label_id"), "label_id", "quality")
        .limit(TRAINING_ROWS)
    )
    # At most TRAINING_ROWS rows of two numbers: small enough to send everywhere.
    sample = docs.select("doc_id", "text").join(
        F.broadcast(stored(chosen, "quality-labels")), F.col("doc_id") == F.col("label_id")
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [list(statistics_of(text.as_py())) for text in batch.column(2)]
            columns = [batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "quality", "found"])

    rows = (
        sample.select(F.col("doc_id").cast("long"), "quality", "text")
        .mapInArrow(work, "doc_id long, quality int, found array<double>")
        .groupBy("doc_id")
        .agg(F.min(F.struct("found", "quality")).alias("row"))
        .orderBy("doc_id")
        .collect()
    )
    values = np.array([row["row"]["found"] for row in rows]).reshape(-1, len(STATISTICS))
    return fit(values, np.array([row["row"]["quality"] for row in rows], dtype=np.float64))


def scored(docs: DataFrame, model: AdditiveModel, least: float | None = None) -> DataFrame:
    """Add ``quality_score`` to documents; with ``least``, keep only those reaching it.

    Without ``least`` the text is left out of the result.  A column named
    quality_score is replaced.
    """
    others = [c for c in docs.columns if c not in ("text", "quality_score")]
    kept = others + (["text"] if least is not None else [])
    source = docs.select(*(F.col(f"`{c}`") for c in others), "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [statistics_of(text.as_py()) for text in batch.column(batch.num_columns - 1)]
            scores = pa.array(model.score(np.array(found).reshape(-1, len(STATISTICS))))
            out = pa.RecordBatch.from_arrays(
                batch.columns[: len(kept)] + [scores], names=kept + ["quality_score"]
            )
            yield out if least is None else out.filter(pa.compute.greater_equal(scores, least))

    fields = {f.name: f.dataType.simpleString() for f in source.schema}
    schema = ", ".join([f"`{c}` {fields[c]}" for c in kept] + ["quality_score double"])
    return source.mapInArrow(work, schema)


@shipped
def op3_quality_model(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = trained(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = F.col("quality_score")
    return scored(docs, model).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        score.alias("score"),
        F.when(score >= 0.5, 1).otherwise(0).alias("predicted"),
    )
