"""Spelling variants: words one edit apart, found with k-d trees over letter counts.

An edit moves few letter counts: a replaced letter takes one from a count and adds one
to another, an inserted letter only adds one.  A k-d tree over the count vectors of all
words of one length is searched with every word of that length (one up, one down) and of
the length below (one up); boxes that are further away are pruned.  What is left in a
leaf is compared by a linear checksum of its counts and then letter by letter.

The upper part of the trees is planned on a sample of words and cuts the vector space
into cells; every word goes to its own cell and asks in each cell in reach.  A task
then builds the lower part over the words of one cell.  The sample decides only where
the cuts are: every word is placed and every pair one edit apart is found.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lastseen.llm.common import shipped, stored, text_of

# Letters of words, and what makes a word and a variant.
RUN_PATTERN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHORTEST, RAREST, MORE_OFTEN = 5, 3, 2

#: Words that plan the cells; about as many are collected, of however many.
SAMPLE = 262_144
#: Words of one length in a cell, as the sample foretells.
CELL = 8_192
#: Sampled words a cell is cut no finer than.
FEWEST_SAMPLED = 8
#: Words in a leaf of a cell's tree.
LEAF = 32
#: Pairs compared at once.
PAIRS_AT_ONCE = 1 << 21

_LETTERS = np.array([*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)])
_DIMENSION = np.zeros(256, dtype=np.int64)
_DIMENSION[_LETTERS] = np.arange(len(_LETTERS))
DIMENSIONS = len(_LETTERS)

# A checksum linear in the counts: one edit changes it by one of few known amounts.
_BITS = 20
_WEIGHTS = np.random.default_rng(97).integers(0, 1 << 62, DIMENSIONS)
_MASK = (1 << _BITS) - 1


def _amounts(differences: np.ndarray) -> np.ndarray:
    table = np.zeros(1 << _BITS, dtype=bool)
    table[differences & _MASK] = True
    return table


_ADDED = _amounts(_WEIGHTS)
_MOVED_UP = _amounts((_WEIGHTS[None, :] - _WEIGHTS[:, None])[np.triu_indices(DIMENSIONS, 1)])

# Rows of a cell: a word that lies there, one that asks with as many letters, one with
# a letter less.
PLACED, SAME, SHORTER = range(3)


def letters_of(codes: pa.Array, length: int) -> np.ndarray:
    """Words of one length as a matrix of letter codes, a row a word."""
    joined = b"".join(codes.to_pylist())
    return np.frombuffer(joined, dtype=np.uint8).reshape(-1, length)


def counts_of(letters: np.ndarray) -> np.ndarray:
    """Letter counts of each row."""
    rows, length = letters.shape
    counts = np.zeros((rows, DIMENSIONS), dtype=np.int8 if length < 100 else np.int32)
    # A column at a time: rows differ, so that no count is added to twice at once.
    row = np.arange(rows)
    for place in range(length):
        counts[row, _DIMENSION[letters[:, place]]] += 1
    return counts


@dataclass
class Tree:
    """Cuts of the vector space: a row a node, ``letter`` -1 for a leaf."""

    letter: np.ndarray
    most: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def leaf_of(self, counts: np.ndarray) -> np.ndarray:
        """Leaf each vector lies in."""
        node = np.zeros(len(counts), dtype=np.int64)
        rows = np.arange(len(counts))
        while (inner := self.letter[node] >= 0).any():
            at, who = node[inner], rows[inner]
            below = counts[who, self.letter[at]] <= self.most[at]
            node[inner] = np.where(below, self.low[at], self.high[at])
        return node

    def reach(self, counts: np.ndarray, removed: int) -> Iterator[tuple[int, np.ndarray]]:
        """Leaves within reach, each with the rows that reach it.

        A letter may be added, and with ``removed`` one that comes before it in the
        alphabet taken away.
        """
        none = np.full(len(counts), -1, dtype=np.int16)
        todo = [(0, np.arange(len(counts)), none, none)]
        while todo:
            node, rows, added, taken = todo.pop()
            if not len(rows):
                continue
            letter = int(self.letter[node])
            if letter < 0:
                yield node, rows
                continue
            have = counts[rows, letter].astype(np.int64)
            # Into the box below: letters in excess must go, and only one may.
            excess = have - int(self.most[node])
            stays, goes = excess <= 0, (excess == 1) & ((taken == -1) | (taken == letter))
            goes &= (removed > 0) & ((added == -1) | (letter < added))
            keep = stays | goes
            todo.append(
                (
                    int(self.low[node]),
                    rows[keep],
                    added[keep],
                    np.where(goes[keep], letter, taken[keep]).astype(np.int16),
                )
            )
            # Into the box above: the letters missing must come.
            missing = 1 - excess
            stays, comes = missing <= 0, (missing == 1) & ((added == -1) | (added == letter))
            comes &= (taken == -1) | (taken < letter)
            keep = stays | comes
            todo.append(
                (
                    int(self.high[node]),
                    rows[keep],
                    np.where(comes[keep], letter, added[keep]).astype(np.int16),
                    taken[keep],
                )
            )


def grown(counts: np.ndarray, leaf: int) -> Tree:
    """A tree over vectors whose leaves hold ``leaf`` of them, or equal ones."""
    letter, most, low, high = [], [], [], []

    def node() -> int:
        for column in (letter, most, low, high):
            column.append(-1)
        return len(letter) - 1

    todo = [(node(), np.arange(len(counts)))]
    while todo:
        at, rows = todo.pop()
        if len(rows) <= leaf:
            continue
        inside = counts[rows]
        # The most even cut of any letter at any count.
        best, cut = 0, None
        for limit in range(int(inside.max())):
            below = (inside <= limit).sum(axis=0)
            even = np.minimum(below, len(rows) - below)
            if even.max() > best:
                best, cut = even.max(), (int(even.argmax()), limit)
        if cut is None:
            continue
        letter[at], most[at] = cut
        below = inside[:, cut[0]] <= cut[1]
        low[at], high[at] = node(), node()
        todo += [(low[at], rows[below]), (high[at], rows[~below])]
    return Tree(*(np.array(column, dtype=np.int32) for column in (letter, most, low, high)))


def _one_replaced(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Rows of ``right`` that are rows of ``left`` with one letter replaced by a later one."""
    later = right.sum(axis=1, dtype=np.int64) > left.sum(axis=1, dtype=np.int64)
    return later & ((left != right).sum(axis=1) == 1)


def _one_inserted(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Rows of ``left`` that are rows of ``right`` without one letter."""
    ahead = np.logical_and.accumulate(left == right[:, :-1], axis=1).sum(axis=1)
    behind = np.logical_and.accumulate((left == right[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return ahead + behind >= left.shape[1]


def pairs_in_cell(
    placed: np.ndarray, asking: np.ndarray, same: bool
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (asking row, placed row) one edit apart, each once.

    Rows that ask with as many letters find those with a later letter in place of an
    earlier one; the others are found the other way round.
    """
    counts, wanted = counts_of(placed), counts_of(asking)
    sums, sought = counts.astype(np.int64) @ _WEIGHTS, wanted.astype(np.int64) @ _WEIGHTS
    tree = grown(counts, LEAF)
    leaves = tree.leaf_of(counts)
    order = np.argsort(leaves, kind="stable")
    starts = np.searchsorted(leaves[order], np.arange(len(tree.letter) + 1))
    amounts, differ = (_MOVED_UP, _one_replaced) if same else (_ADDED, _one_inserted)
    for leaf, rows in tree.reach(wanted, int(same)):
        inside = order[starts[leaf] : starts[leaf + 1]]
        at_once = max(1, PAIRS_AT_ONCE // max(1, len(inside)))
        for i in range(0, len(rows), at_once):
            some = rows[i : i + at_once]
            close = amounts[(sums[inside][None, :] - sought[some][:, None]) & _MASK]
            a, b = np.nonzero(close)
            a, b = some[a], inside[b]
            sure = differ(asking[a], placed[b])
            if sure.any():
                yield a[sure], b[sure]


CELL_SCHEMA = "length int, cell int, kind int, code binary, n long"
NEAR_SCHEMA = "code binary, n_near long, best_n long, best binary"


def _sent(trees: dict[int, Tree]):
    """Rows of the cells a batch of words lies and asks in."""

    def asked(kind: int, length: int, counts: np.ndarray, rows: np.ndarray) -> list[tuple]:
        tree = trees.get(length)
        if tree is None:  # a length the sample does not hold is one cell
            return [(length, 0, kind, rows)]
        return [
            (length, leaf, kind, rows[found])
            for leaf, found in tree.reach(counts, int(kind == SAME))
        ]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = batch.column("code")
            lengths = pc.binary_length(code).to_numpy(zero_copy_only=False)
            parts = []
            for length in np.unique(lengths).tolist():
                rows = np.flatnonzero(lengths == length)
                counts = counts_of(letters_of(code.take(pa.array(rows)), length))
                tree = trees.get(length)
                cells = np.zeros(len(rows), int) if tree is None else tree.leaf_of(counts)
                parts += [(length, int(c), PLACED, rows[cells == c]) for c in np.unique(cells)]
                parts += asked(SAME, length, counts, rows)
                parts += asked(SHORTER, length + 1, counts, rows)
            sizes = [len(part[3]) for part in parts]
            picked = pa.array(np.concatenate([np.empty(0, np.int64), *(p[3] for p in parts)]))
            columns = [
                pa.array(np.repeat(np.array([p[i] for p in parts], dtype=np.int32), sizes))
                for i in range(3)
            ]
            columns += [batch.column(name).take(picked) for name in ("code", "n")]
            yield pa.RecordBatch.from_arrays(columns, ["length", "cell", "kind", "code", "n"])

    return send


def _judged(cell: pa.Table) -> pa.Table:
    """Of each word of a cell: how many words near it it met there, and the most frequent."""
    kinds = cell.column("kind").to_numpy()
    length = cell.column("length")[0].as_py()
    code, often = cell.column("code").combine_chunks(), cell.column("n").to_numpy()
    rows = [np.flatnonzero(kinds == kind) for kind in (PLACED, SAME, SHORTER)]
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    if len(rows[PLACED]):
        placed = letters_of(code.take(pa.array(rows[PLACED])), length)
        for kind, letters in ((SAME, length), (SHORTER, length - 1)):
            if len(rows[kind]):
                asking = letters_of(code.take(pa.array(rows[kind])), letters)
                for a, b in pairs_in_cell(placed, asking, kind == SAME):
                    left.append(rows[kind][a])
                    right.append(rows[PLACED][b])
    left, right = np.concatenate(left), np.concatenate(right)
    # Both ways, by word: most frequent first, then in order of code points.
    word, near = np.concatenate([left, right]), np.concatenate([right, left])
    names, rank = np.unique(np.array(code.to_pylist(), dtype=object), return_inverse=True)
    order = np.lexsort((rank[near], -often[near], rank[word]))
    word, near = rank[word][order], near[order]
    words, first, count = np.unique(word, return_index=True, return_counts=True)
    best = near[first]
    return pa.table(
        {
            "code": pa.array(names[words].tolist(), pa.binary()),
            "n_near": pa.array(count.astype(np.int64)),
            "best_n": pa.array(often[best].astype(np.int64)),
            "best": code.take(pa.array(best)).cast(pa.binary()),
        }
    )


def planned(words: DataFrame, sample: int = SAMPLE, cell: int = CELL) -> dict[int, Tree]:
    """Upper trees by word length, planned on about ``sample`` words chosen by hash."""
    total = words.count()
    chosen = words.filter(F.pmod(F.xxhash64("code"), F.lit(max(total, 1))) < sample)
    by_length: dict[int, list[bytes]] = {}
    for (code,) in chosen.select("code").sort("code").collect():
        by_length.setdefault(len(code), []).append(code)
    leaf = max(FEWEST_SAMPLED, int(cell * min(1.0, sample / max(total, 1))))
    return {
        length: grown(counts_of(letters_of(pa.array(codes), length)), leaf)
        for length, codes in by_length.items()
    }


def near_words(words: DataFrame, sample: int = SAMPLE, cell: int = CELL) -> DataFrame:
    """``code, n_near, best_n, best``: of each word that has near words, their number and
    the most frequent of them, ties to the smallest in code-point order.

    ``words`` holds ``code`` (the word, a byte a letter) and ``n``, a row a word.  ``sample``
    and ``cell`` change where the work is done, not the result.
    """
    trees = planned(words, sample, cell)
    asked = words.select("code", "n").mapInArrow(_sent(trees), CELL_SCHEMA)
    met = asked.groupBy("length", "cell").applyInArrow(_judged, NEAR_SCHEMA)
    first = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("best")))
    return (
        met.groupBy("code")
        .agg(F.sum("n_near").alias("n_near"), first.alias("first"))
        .select("code", "n_near", (-F.col("first.less")).alias("best_n"), "first.best")
    )


def variants(words: DataFrame, sample: int = SAMPLE, cell: int = CELL) -> DataFrame:
    """Each word with its form and root: ``word, form, root, n, n_near, form_n``.

    ``words`` holds ``word`` (letters of :data:`RUN_PATTERN`) and ``n``, a row a word; an
    empty table gives no rows.  A word's form is its most frequent near word if that is at
    least :data:`MORE_OFTEN` times as frequent, else null; its root is where the forms lead.
    Equal frequencies go to the smallest word in code-point order.
    """
    coded = words.select(F.encode("word", "ISO-8859-1").alias("code"), "n")
    coded = stored(coded, "spelling-words")
    found = near_words(coded, sample, cell)
    often = F.col("best_n") >= MORE_OFTEN * F.col("n")
    judged = coded.join(found, "code", "left").select(
        "code",
        "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(often, F.col("best")).alias("form"),
        F.when(often, F.col("best_n")).alias("form_n"),
    )
    judged = stored(judged, "spelling-forms")
    result = judged.join(_roots(judged), "code", "left")

    def text(column: str):
        return F.decode(column, "ISO-8859-1")

    return result.select(
        text("code").alias("word"),
        text("form").alias("form"),
        text(F.coalesce("root", "code")).alias("root"),
        "n",
        "n_near",
        "form_n",
    )


def _roots(judged: DataFrame) -> DataFrame:
    """Last form of each word that has one: ``code, root``.

    Each round doubles the steps taken.  A form is at least twice as frequent as its word,
    so a chain has fewer steps than a frequency has bits.
    """
    steps = judged.filter(F.col("form").isNotNull()).select("code", F.col("form").alias("root"))
    while True:
        onward = steps.select(F.col("code").alias("root"), F.col("root").alias("_next"))
        further = steps.join(onward, "root", "left").select(
            "code", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")
        )
        further = stored(further, "spelling-roots")
        steps = further.select("code", "root")
        if further.filter("moved").isEmpty():
            return steps


def words_of_documents(docs: DataFrame) -> DataFrame:
    """Words of a corpus and how often they occur, one letter of few runs deleted.

    Takes ``doc_id`` and ``text`` and returns ``word, n``.  Null and empty texts have no
    words; a null ``doc_id`` is read as an empty string; repeated rows count again.
    """
    text = F.translate(text_of(), UPPER, LOWER)
    runs = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"),
        F.explode(F.regexp_extract_all(text, F.lit(RUN_PATTERN), F.lit(0))).alias("run"),
    ).filter(F.char_length("run") >= SHORTEST)
    dealt, length = F.crc32(F.concat("_id", F.lit(":"), "run")), F.char_length("run")
    place = (F.col("_h") % length).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), place), F.substring("run", place + 2, length))
    word = F.when(F.col("_h") % 97 == 0, cut).otherwise(F.col("run"))
    return (
        runs.withColumn("_h", dealt)
        .select(word.alias("word"))
        .filter(F.char_length("word") >= SHORTEST)
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") >= RAREST)
    )


@shipped
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents, each with its form, root and number of near words.

    Null, empty and repeated texts are as in :func:`words_of_documents`, ties as in
    :func:`variants`.  An empty table gives no rows; other columns are ignored.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return variants(words_of_documents(docs))
