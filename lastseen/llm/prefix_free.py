"""Removal of long byte strings that occur more than once in a corpus.

Prefix-free parsing: a hash rolled over a few bytes triggers phrase starts, so
equal stretches of text are cut at equal places wherever they stand.  A phrase
start with the text around it is an entry of the dictionary; the sequence of
entries is the parse.  Corpus order is only needed up to the match length L: two
windows of L bytes can be equal only if the first phrase start inside them has
the same entry class, so

1. entries whose stem (the text every window of the entry holds) is unique in the
   corpus are proven free of repeats and leave;
2. an entry whose whole context occurs again has only repeated windows;
3. the windows of the remaining dictionary entries are sorted out in two rounds by
   the same two tests: first in cells of a few neighbouring windows, by what all windows
   of a cell share and by all that they cover, then one by one.

The dictionary holds each context once, so a text with thousands of copies is
looked at once in step 3.  No step gathers the occurrences of an entry or the entries
of a stem: counts are pre-aggregated, and occurrences meet them in a join that can be
split.  A round makes few rows for an entry, whatever the number of entries.

Everything is compared by two 64-bit fingerprints that must both agree: of stem and
context, of a cell's core and cover, and two of each single window.  A text is named by
two hashes as well, one of them seeded with its id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lastseen.llm.common import shipped, stored, text_of

#: Length of a match in bytes.
MATCH_BYTES = 400
#: Bytes the trigger hash looks at, and its mean distance between triggers.
TRIGGER_BYTES, TRIGGER_EVERY = 8, 40
#: A window start without a trigger in so many bytes is an entry of its own.
LONGEST_REACH = 250

_TRIGGER = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93
_BYTE_VALUES = np.random.default_rng(20_240_607).integers(0, 2**64, 256, dtype=np.uint64)
#: A second, independent fingerprint.
_SECOND_BASE = 0x2545F4914F6CDD1D
_SECOND_VALUES = np.random.default_rng(20_261_201).integers(0, 2**64, 256, dtype=np.uint64)
#: Neighbouring windows sorted out together in the first round.
CELL = 8
#: Bytes parsed in one go.
_CHUNK = 1 << 20

_powers = np.ones(1, dtype=np.uint64)
_inverses = np.ones(1, dtype=np.uint64)


def _grown(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    global _powers, _inverses
    if len(_powers) < size:
        size = max(size, 2 * len(_powers))
        step = np.full(size, _BASE, dtype=np.uint64)
        step[0] = 1
        _powers = np.multiply.accumulate(step)
        step[1:] = pow(_BASE, -1, 2**64)
        _inverses = np.multiply.accumulate(step)
    return _powers, _inverses


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(32))


class Entries:
    """Dictionary entries of some texts: whose they are, where, what they cover.

    ``at`` is the phrase start in its text; windows begin ``low`` to ``high``
    bytes before it.  ``stem`` and ``context`` are fingerprints.
    """

    def __init__(self, texts: list[bytes], match: int = MATCH_BYTES, reach: int = LONGEST_REACH):
        data = b"".join(texts)
        ends = np.cumsum([len(text) for text in texts], dtype=np.int64)
        starts = ends - [len(text) for text in texts]
        n = len(data)
        powers, inverses = _grown(n + 1)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTE_VALUES[np.frombuffer(data, np.uint8)] * powers[:n], out=sums[1:])
        size = max(0, n - TRIGGER_BYTES + 1)
        grams = np.ndarray((size,), "<u8", data if size else b"".ljust(8), strides=(1,))
        hits = np.flatnonzero(grams * _TRIGGER < np.uint64(2**64 // TRIGGER_EVERY))
        owner = np.searchsorted(ends, hits, "right")
        inside = hits + TRIGGER_BYTES <= ends[owner]
        hits, owner = hits[inside], owner[inside]
        before = np.maximum(np.concatenate(([-1], hits[:-1]))[: len(hits)], starts[owner] - 1)
        high = np.minimum(hits - before - 1, reach)
        low = np.maximum(0, hits + match - ends[owner])
        keep = low <= high
        # Window starts that no trigger follows within the reach.
        first = np.concatenate((starts, hits + 1))
        whose = np.concatenate((np.arange(len(texts)), owner))
        following = np.concatenate((hits, [n + reach]))[np.searchsorted(hits, first)]
        following = np.where(following < ends[whose], following, n + match + reach)
        stop = np.minimum(following - reach, ends[whose] - match + 1)
        lengths = np.maximum(0, stop - first)
        skipped = np.cumsum(lengths) - lengths
        alone = np.repeat(first - skipped, lengths) + np.arange(lengths.sum())

        def prints(start: np.ndarray, end: np.ndarray) -> np.ndarray:
            return (sums[end] - sums[start]) * inverses[start]

        at, low, high = hits[keep], low[keep], high[keep]
        span = np.uint64(1 << 20) * high.astype(np.uint64) + low.astype(np.uint64)
        whole = _mixed(prints(alone, alone + match) ^ np.uint64(0xA5A5A5A5A5A5A5A5))
        zero = np.zeros(len(alone), dtype=np.int64)
        self.owner = np.concatenate((owner[keep], np.repeat(whose, lengths)))
        self.at = np.concatenate((at, alone)) - starts[self.owner]
        self.low = np.concatenate((low, zero))
        self.high = np.concatenate((high, zero))
        self.stem = np.concatenate((_mixed(prints(at, at + match - reach)), whole))
        context = _mixed(prints(at - high, at - low + match) ^ _mixed(span))
        self.context = np.concatenate((context, whole))

    def groups(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Indices of the first of equal entries of a text, the group of each
        entry, and the sizes of the groups."""
        order = np.lexsort((self.at, self.context, self.stem, self.owner))
        owner, stem, context = self.owner[order], self.stem[order], self.context[order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (
            (owner[1:] != owner[:-1]) | (stem[1:] != stem[:-1]) | (context[1:] != context[:-1])
        )
        group = np.empty(len(order), dtype=np.int64)
        group[order] = np.cumsum(new) - 1
        return order[new], group, np.bincount(group, minlength=int(new.sum()))


def _runs_of_texts(texts: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive texts in pieces of bounded size, with the index of the first."""
    first, size, held = 0, 0, []
    for i, text in enumerate(texts):
        data = (text.as_py() or "").encode()
        held.append(data)
        size += len(data)
        if size >= _CHUNK or i + 1 == len(texts):
            yield first, held
            first, size, held = i + 1, 0, []


PARSE_SCHEMA = "stem long, context long, key long, sum long, place int, n long"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns key, sum, text -> the distinct entries of each text, at their first place."""
    for batch in batches:
        for start, held in _runs_of_texts(batch.column(2)):
            entries = Entries(held)
            first, _, sizes = entries.groups()
            whose = pa.array(entries.owner[first] + start)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(entries.stem[first].view(np.int64)),
                    pa.array(entries.context[first].view(np.int64)),
                    batch.column(0).take(whose),
                    batch.column(1).take(whose),
                    pa.array(entries.at[first], pa.int32()),
                    pa.array(sizes),
                ],
                names=["stem", "context", "key", "sum", "place", "n"],
            )


CONTEXT_SCHEMA = "stem long, context long, low int, high int, n long, bytes binary"


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns text, wanted (place, stem, context, n) -> the bytes of each entry."""
    for batch in batches:
        out: dict[str, list] = {name.split()[0]: [] for name in CONTEXT_SCHEMA.split(", ")}
        for i in range(batch.num_rows):
            data = (batch.column(0)[i].as_py() or "").encode()
            entries = Entries([data])
            index = {at: k for k, at in enumerate(entries.at.tolist())}
            for wanted in batch.column(1)[i].as_py():
                k = index[wanted["place"]]
                at, low, high = int(entries.at[k]), int(entries.low[k]), int(entries.high[k])
                for name in ("stem", "context", "n"):
                    out[name].append(wanted[name])
                out["low"].append(low)
                out["high"].append(high)
                out["bytes"].append(data[at - high : at - low + MATCH_BYTES])
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(v, t) for v, t in zip(out.values(), types)], names=list(out)
        )


class _Prints:
    """Both fingerprints of any stretch of some bytes."""

    def __init__(self, data: bytes):
        self._tables = []
        codes = np.frombuffer(data, np.uint8)
        for base, values in ((_BASE, _BYTE_VALUES), (_SECOND_BASE, _SECOND_VALUES)):
            step = np.full(len(data) + 1, base, dtype=np.uint64)
            step[0] = 1
            powers = np.multiply.accumulate(step)
            step[1:] = pow(base, -1, 2**64)
            sums = np.zeros(len(data) + 1, dtype=np.uint64)
            np.cumsum(values[codes] * powers[:-1], out=sums[1:])
            self._tables.append((sums, np.multiply.accumulate(step)))

    def of(self, which: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        sums, inverses = self._tables[which]
        return (sums[end] - sums[start]) * inverses[start]


NODE_SCHEMA = "core long, cover long, stem long, context long, n long, first int, last int"


def _sorted_out(cell: int, singly: bool = False):
    """Rows of CONTEXT_SCHEMA and cells -> a row for each cell or window of an entry.

    A window reaches ``r`` bytes before its phrase start.  Cells lie at multiples of their
    size, the same in every entry.  The core is what all windows of a cell share, also
    those the entry does not have; the cover is what those it has lie in.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in (batch.slice(i, 2_000) for i in range(0, batch.num_rows, 2_000)):
                yield one_piece(some)

    def one_piece(batch: pa.RecordBatch) -> pa.RecordBatch:
        low, high = (batch.column(i).to_numpy().astype(np.int64) for i in (2, 3))
        texts = batch.column(5).to_pylist()
        sizes = np.array([len(text) for text in texts], dtype=np.int64)
        begins = np.cumsum(sizes) - sizes
        if not singly:
            first_cell = low // cell
            counts = high // cell - first_cell + 1
            owner = np.repeat(np.arange(len(texts)), counts)
            number = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            lowest = (number + first_cell[owner]) * cell
            highest = lowest + cell - 1
        else:
            cells = batch.column(6)
            owner = np.repeat(np.arange(len(texts)), np.diff(cells.offsets.to_numpy()))
            starts = cells.flatten().to_numpy().astype(np.int64)
            owner = np.repeat(owner, cell)
            lowest = (starts[:, None] + np.arange(cell)).ravel()
            inside = (lowest >= low[owner]) & (lowest <= high[owner])
            owner, lowest = owner[inside], lowest[inside]
            highest = lowest
        first, last = np.maximum(lowest, low[owner]), np.minimum(highest, high[owner])
        at = begins[owner] + high[owner]  # the phrase start
        prints = _Prints(b"".join(texts))
        stem = batch.column(0).to_numpy().view(np.uint64)[owner]
        core = prints.of(0, at - lowest, at - highest + MATCH_BYTES)
        core = _mixed(core ^ _mixed(stem ^ lowest.astype(np.uint64)))
        cover = prints.of(1, at - last, at - first + MATCH_BYTES)
        span = np.uint64(1 << 20) * last.astype(np.uint64) + first.astype(np.uint64)
        cover = _mixed(cover ^ _mixed(span))
        whose = pa.array(owner)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(core.view(np.int64)),
                pa.array(cover.view(np.int64)),
                *(batch.column(i).take(whose) for i in (0, 1, 4)),
                pa.array(first, pa.int32()),
                pa.array(last, pa.int32()),
            ],
            names=["core", "cover", "stem", "context", "n", "first", "last"],
        )

    return split


REMOVAL_SCHEMA = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>"


def _removed(data: bytes, whole: list[int], part: list[dict]) -> list[tuple[int, int]]:
    """Spans of a text covered by repeated windows: of ``whole`` entries and of runs of them."""
    entries = Entries([data])
    _, group, sizes = entries.groups()
    change = np.zeros(len(data) + 1, dtype=np.int64)
    index = {at: k for k, at in enumerate(entries.at.tolist())}
    full = sizes >= 2
    full[group[[index[place] for place in whole]]] = True
    chosen = full[group]
    np.add.at(change, (entries.at - entries.high)[chosen], 1)
    np.add.at(change, (entries.at - entries.low)[chosen] + MATCH_BYTES, -1)
    for entry in part:
        at, runs = entry["place"], entry["runs"]
        for low, high in zip(runs[::2], runs[1::2]):
            change[at - high] += 1
            change[at - low + MATCH_BYTES] -= 1
    covered = np.cumsum(change[:-1]) > 0
    edges = np.flatnonzero(np.diff(np.concatenate(([0], covered.view(np.int8), [0]))))
    return [(int(a), int(b)) for a, b in zip(edges[::2], edges[1::2])]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Last columns text, whole, part -> the other columns and what is removed."""
    for batch in batches:
        texts, wholes, parts = batch.columns[-3:]
        kept = list(batch.columns[:-3])
        out: list[list] = [[], [], [], [], []]
        for i in range(batch.num_rows):
            data = (texts[i].as_py() or "").encode()
            whole, part = wholes[i].as_py() or [], parts[i].as_py() or []
            spans = _removed(data, whole, part) if whole or part else []
            digest, end = hashlib.sha256(), 0
            for a, b in spans:
                digest.update(data[end:a])
                end = b
            digest.update(data[end:])
            removed = sum(b - a for a, b in spans)
            flat = [edge for span in spans for edge in span]
            values = (len(data), removed, len(spans), digest.hexdigest(), flat)
            for column, value in zip(out, values):
                column.append(value)
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()))
        names = batch.schema.names[:-3] + [c.split()[0] for c in REMOVAL_SCHEMA.split(", ")]
        kept += [pa.array(values, kind) for values, kind in zip(out, types)]
        yield pa.RecordBatch.from_arrays(kept, names=names)


def _resolved(contexts: DataFrame) -> DataFrame:
    """Repeated windows of the dictionary entries that share their stem: ``stem, context, runs``.

    ``runs`` holds the least and greatest reach of stretches of windows, one after the other.
    """
    cells = stored(contexts.mapInArrow(_sorted_out(CELL), NODE_SCHEMA), "cells")
    cores = cells.groupBy("core").agg(
        F.sum("n").alias("all"),
        F.min("n").alias("rarest"),
        (F.min("cover") != F.max("cover")).alias("mixed"),
    )
    # Entries that occur more than once are done; they only stand against the others.
    open_ = cores.filter("all > 1 AND rarest < 2").select("core", "mixed")
    kept = stored(cells.join(open_, "core"), "cells-open")
    alike = kept.filter("NOT mixed AND n < 2").select("stem", "context", "first", "last")
    split = kept.filter("mixed").groupBy("stem", "context").agg(
        F.collect_set((F.floor(F.col("first") / CELL) * CELL).cast("int")).alias("cells")
    )
    windows = contexts.join(split, ["stem", "context"]).select(*contexts.columns, "cells")
    windows = stored(windows.mapInArrow(_sorted_out(CELL, singly=True), NODE_SCHEMA), "windows-open")
    again = windows.groupBy("core", "cover").agg(F.sum("n").alias("all")).filter("all > 1")
    single = windows.filter("n < 2").join(again, ["core", "cover"], "left_semi")
    found = alike.unionByName(single.select("stem", "context", "first", "last"))
    runs = F.flatten(F.collect_list(F.array("first", "last"))).alias("runs")
    return found.groupBy("stem", "context").agg(runs)


def repeated_spans(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Every row of ``docs`` with the byte spans that stand more than once.

    Returns the columns of ``docs`` but the text, and ``n_bytes``, ``n_removed``,
    ``n_spans``, ``kept_sha256`` and ``spans`` (start, end, start, end, ...).  A
    byte is removed if a string of ``MATCH_BYTES`` bytes that covers it starts
    anywhere else too, in another text or in the same one; matches overlap but do
    not cross texts.  Null texts are empty; shorter texts keep everything.  Rows
    that are equal in id and text are copies of each other.  The id is an integer
    and may be null.  Other columns pass through, those of the added names are
    replaced.
    """
    key = F.xxhash64(F.col(id_column).cast("long"), text_of(text_column))
    check = F.xxhash64(text_of(text_column))
    source = docs.select(key.alias("key"), check.alias("sum"), F.col(text_column).alias("text"))
    parsed = source.mapInArrow(_parse, PARSE_SCHEMA)
    seen = (
        parsed.groupBy("stem")
        .agg(F.sum("n").alias("all"), F.min("context").alias("a"), F.max("context").alias("b"))
        .filter("all > 1")
        .select("stem", (F.col("a") != F.col("b")).alias("mixed"))
    )
    repeated = stored(parsed.join(seen, "stem"), "repeated")
    mixed = repeated.filter("mixed")
    entries = mixed.groupBy("stem", "context").agg(
        F.sum("n").alias("n"), F.min(F.struct("place", "key", "sum")).alias("at")
    )
    dictionary = stored(entries, "dictionary")
    wanted = (
        dictionary.select("at.key", "at.sum", F.struct("at.place", "stem", "context", "n").alias("entry"))
        .groupBy("key", "sum")
        .agg(F.collect_list("entry").alias("wanted"))
    )
    # Equal rows of docs hold the same contexts; one of them is enough.
    contexts = (
        source.join(wanted, ["key", "sum"])
        .dropDuplicates(["key", "sum"])
        .select("text", "wanted")
        .mapInArrow(_contexts, CONTEXT_SCHEMA)
    )
    partly = stored(_resolved(stored(contexts, "contexts")), "windows")
    one = dictionary.filter("n < 2").select("stem", "context")
    whole = repeated.filter(~F.col("mixed")).unionByName(
        mixed.join(one, ["stem", "context"], "left_anti").select(*repeated.columns)
    )
    marks = whole.select("key", "sum", "place", F.lit(None).cast("array<int>").alias("runs")).unionByName(
        mixed.join(partly, ["stem", "context"]).select("key", "sum", "place", "runs")
    )
    # Sets: equal rows bring equal marks.
    found = marks.groupBy(F.col("key").alias("__id"), F.col("sum").alias("__check")).agg(
        F.collect_set(F.when(F.col("runs").isNull(), F.col("place"))).alias("__whole"),
        F.collect_set(F.when(F.col("runs").isNotNull(), F.struct("place", "runs"))).alias("__part"),
    )
    added = {column.split()[0] for column in REMOVAL_SCHEMA.split(", ")}
    others = [f for f in docs.schema if f.name != text_column and f.name not in added]
    joined = docs.withColumns({"__key": key, "__sum": check}).join(
        found,
        (F.col("__key") == F.col("__id")) & (F.col("__sum") == F.col("__check")),
        "left",
    )
    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in others] + [REMOVAL_SCHEMA]
    columns = [F.col(f"`{f.name}`") for f in others] + [F.col(text_column), "__whole", "__part"]
    return joined.select(*columns).mapInArrow(_cut, ", ".join(schema))


@shipped
def op5_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """What :func:`repeated_spans` finds in every document, without the spans.

    Null, empty, long, tied and repeated texts are as stated there; an empty table gives no
    rows and other columns are ignored.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return repeated_spans(docs).drop("spans")
