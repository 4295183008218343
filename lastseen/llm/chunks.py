"""Cutting of text where byte-level BPE tokenizers cut it anyway.

The split pattern of these tokenizers starts a new match at a single space that
stands between two characters that are not white space.  Text is cut there
first; each different chunk is encoded once and looked up afterwards.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_CUT = re.compile(r"(?<=\S)(?= \S)")

#: Chunks a worker remembers; beyond it the older half is forgotten.
REMEMBERED = 1_200_000


class ChunkEncoder:
    """Encodes texts through the codes of their chunks.

    ``encode_new`` turns a list of chunks into a list of byte strings, the token
    ids in the caller's width.
    """

    def __init__(self, encode_new: Callable[[list[str]], list[bytes]], limit: int = REMEMBERED):
        self._encode_new = encode_new
        self._limit = limit
        #: Codes of chunks by their text; of ``after_space`` by what follows the space.
        self._whole: dict[str, bytes] = {}
        self._after_space: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        firsts, rests = [], []
        for text in texts:
            first, *rest = text.split(" ")
            firsts.append(first)
            rests.append(rest)
        wanted = set().union(firsts, *rests)
        # Where a part is empty or has white space at an end, not every space is
        # a cut; such texts are cut by the full rule.
        unsafe = {part for part in wanted if not part or part[0].isspace() or part[-1].isspace()}
        if unsafe:
            for i, text in enumerate(texts):
                if " " in text and not unsafe.isdisjoint((firsts[i], *rests[i])):
                    first, *rest = _CUT.split(text)
                    firsts[i], rests[i] = first, [part[1:] for part in rest]
        wanted = set().union(*rests)
        self._learn(self._whole, set(firsts), "")
        self._learn(self._after_space, wanted, " ")
        whole, after = self._whole, self._after_space
        return [
            whole[first] + b"".join([after[part] for part in rest])
            for first, rest in zip(firsts, rests)
        ]

    def _learn(self, known: dict[str, bytes], wanted: set[str], prefix: str) -> None:
        new = list(wanted.difference(known))
        if len(known) + len(new) > self._limit:
            kept = {chunk: known[chunk] for chunk in wanted if chunk in known}
            for chunk in list(known)[: len(known) // 2]:
                del known[chunk]
            known.update(kept)
        for start in range(0, len(new), 50_000):
            some = new[start : start + 50_000]
            known.update(zip(some, self._encode_new([prefix + chunk for chunk in some])))


def _loose(part: str) -> bool:
    """A part between spaces at which not every space is a cut."""
    return not part or part != part.strip()


#: Characters joined to be encoded in one call.
JOINED = 4096


class ArrowChunkEncoder:
    """:class:`ChunkEncoder` on Arrow strings: parts are split, numbered and looked up in bulk.

    ``encode_batch`` turns a list of texts into arrays of ids; ``opens`` tells of each id
    whether its token starts with a space.  New parts are joined and encoded together: each
    of them starts with a space and holds no other, so the ids tell where it starts.
    """

    def __init__(
        self,
        encode_batch: Callable[[list[str]], list[np.ndarray]],
        opens: np.ndarray,
        dtype: np.dtype,
        limit: int = REMEMBERED,
    ):
        self._encode_batch, self._opens, self._dtype, self._limit = encode_batch, opens, dtype, limit
        self._forget()

    def _forget(self) -> None:
        #: Number of a chunk by its text, if it is a first one, and by what follows its space.
        self._number: tuple[dict[str, int], dict[str, int]] = ({}, {})
        self._sizes, self._codes = [np.empty(0, np.int64)], [np.empty(0, self._dtype)]
        self._count = 0

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and how many each has."""
        if self._count > self._limit:
            self._forget()
        parts = pc.split_pattern(texts.cast(pa.large_string()), " ")
        ends = parts.offsets.to_numpy()
        coded = parts.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        # Twice the number of the word, and one more if a space stands before it.
        keys = coded.indices.to_numpy().astype(np.int64) * 2 + 1
        keys[ends[:-1] - ends[0]] -= 1
        loose = np.fromiter(map(_loose, words), bool, len(words))[keys >> 1]
        touched = np.add.reduceat(loose, ends[:-1] - ends[0]) if len(texts) else np.empty(0, int)
        slow = np.flatnonzero((touched > 0) & (np.diff(ends) > 1))
        if len(slow):
            keys, ends, words = self._cut_again(texts, slow, keys, ends, words)
        numbers = self._numbers(keys, words)
        if len(self._codes) > 1:
            self._codes, self._sizes = [np.concatenate(self._codes)], [np.concatenate(self._sizes)]
        codes, sizes = self._codes[0], self._sizes[0]
        starts = np.cumsum(sizes) - sizes
        used = numbers[keys]
        lengths = sizes[used]
        before = np.cumsum(lengths) - lengths
        ids = codes[np.repeat(starts[used] - before, lengths) + np.arange(lengths.sum())]
        totals = np.concatenate(([0], np.cumsum(lengths)))
        return ids, np.diff(totals[ends - ends[0]])

    def _cut_again(self, texts, slow, keys, ends, words):
        """Keys with those of some texts replaced by their cuts under the full rule."""
        words, known, runs, sizes = list(words), {}, [], np.diff(ends)
        at = 0
        for i in slow.tolist():
            first, *rest = _CUT.split(texts[i].as_py())
            own = []
            for part in (first, *(part[1:] for part in rest)):
                if part not in known:
                    known[part] = len(words)
                    words.append(part)
                own.append(known[part] * 2 + 1)
            own[0] -= 1
            runs += [keys[at : ends[i] - ends[0]], np.array(own)]
            at = ends[i + 1] - ends[0]
            sizes[i] = len(own)
        runs.append(keys[at:])
        return np.concatenate(runs), np.concatenate(([0], np.cumsum(sizes))), words

    def _numbers(self, keys: np.ndarray, words: list[str]) -> np.ndarray:
        """Number of the chunk each key stands for, new ones encoded first."""
        numbers = np.zeros(2 * len(words), dtype=np.int64)
        used = np.zeros(2 * len(words), dtype=bool)
        used[keys] = True
        for spaced, known in enumerate(self._number):
            wanted = np.flatnonzero(used[spaced::2]).tolist()
            new = list(dict.fromkeys(words[i] for i in wanted if words[i] not in known))
            if spaced:
                self._learn_joined(new, known)
            else:
                self._learn(new, known, "")
            numbers[np.array(wanted, np.int64) * 2 + spaced] = [known[words[i]] for i in wanted]
        return numbers

    def _learn(self, new: list[str], known: dict[str, int], prefix: str) -> None:
        for start in range(0, len(new), 10_000):
            some = new[start : start + 10_000]
            found = self._encode_batch([prefix + chunk for chunk in some])
            self._add(some, known, [len(ids) for ids in found], found)

    def _learn_joined(self, new: list[str], known: dict[str, int]) -> None:
        alone = [part for part in new if _loose(part) or " " in part]
        self._learn(alone, known, " ")
        if alone:
            new = [part for part in new if part not in known]
        groups, size = [[]], 0
        for part in new:
            if size > JOINED:
                groups.append([])
                size = 0
            groups[-1].append(part)
            size += len(part)
        for start in range(0, len(groups), 256):
            some = groups[start : start + 256]
            found = self._encode_batch(["".join(f" {part}" for part in group) for group in some])
            for group, ids in zip(some, found):
                opens = np.flatnonzero(self._opens[ids])
                self._add(group, known, np.diff(np.append(opens, len(ids))), [ids])

    def _add(self, parts: list[str], known: dict[str, int], sizes, codes: list[np.ndarray]) -> None:
        known.update(zip(parts, range(self._count, self._count + len(parts))))
        self._count += len(parts)
        self._sizes.append(np.asarray(sizes, dtype=np.int64))
        self._codes += codes


def pieces_of(texts, size: int = 1 << 21):
    """Runs of Arrow string values as Python text of bounded size; null: empty."""
    start, held, total = 0, [], 0
    for i, value in enumerate(texts):
        text = value.as_py() or ""
        held.append(text)
        total += len(text)
        if total >= size:
            yield start, held
            start, held, total = i + 1, [], 0
    if held:
        yield start, held
