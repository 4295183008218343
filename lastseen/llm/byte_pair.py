"""Byte-level BPE encoding and decoding by vectorised merge rounds.

Different pieces of text are sorted into buckets by length and laid out as padded
matrices, one row for each piece.  In every round each row merges its leftmost
pair of lowest rank; ranks come from a hash table of pairs, and one boolean
selection closes the gaps, which narrows the matrix by one column.  Rows without
a pair to merge leave.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lastseen.llm.chunks import ChunkEncoder, pieces_of
from lastseen.llm.common import shipped

_NONE = np.int32(2**31 - 1)
#: Pieces of more bytes are merged one by one, with a heap.
LONGEST_ROW = 512
_HASH = np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """Rank of the token that two tokens merge to; open addressing, vectorised."""

    def __init__(self, ranks: dict[bytes, int]):
        left, right, merged = [], [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    merged.append(rank)
        keys = np.array(left, np.uint64) << np.uint64(32) | np.array(right, np.uint64)
        bits = max(4, int(2 * len(keys)).bit_length())
        self._shift = np.uint64(64 - bits)
        self._mask = np.int64((1 << bits) - 1)
        self._keys = np.full(1 << bits, np.uint64(2**64 - 1))
        self._ranks = np.full(1 << bits, _NONE)
        slots, values = self._home(keys), np.array(merged, np.int32)
        while len(keys):
            free = self._keys[slots] == np.uint64(2**64 - 1)
            _, first = np.unique(slots[free], return_index=True)
            placed = np.flatnonzero(free)[first]
            self._keys[slots[placed]] = keys[placed]
            self._ranks[slots[placed]] = values[placed]
            left_over = np.ones(len(keys), dtype=bool)
            left_over[placed] = False
            keys, values = keys[left_over], values[left_over]
            slots = (slots[left_over] + 1) & self._mask
        self._longest = self._probes()

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _HASH) >> self._shift).astype(np.int64)

    def _probes(self) -> int:
        used = np.flatnonzero(self._keys != np.uint64(2**64 - 1))
        return int(((used - self._home(self._keys[used])) & self._mask).max(initial=0)) + 1

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids; negative ids are padding."""
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        slots = self._home(keys)
        found = np.where(self._keys[slots] == keys, self._ranks[slots], _NONE)
        open_ = np.flatnonzero((found == _NONE) & (left >= 0) & (right >= 0))
        slots = slots[open_]
        for _ in range(self._longest - 1):
            slots = (slots + 1) & self._mask
            hit = self._keys[slots] == keys[open_]
            found[open_[hit]] = self._ranks[slots[hit]]
            going = ~hit & (self._keys[slots] != np.uint64(2**64 - 1))
            open_, slots = open_[going], slots[going]
            if not len(open_):
                break
        return found


class BytePairCodec:
    """Encoder and decoder of a rank file; the id of a token is its rank."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self._pattern = regex.compile(pattern)
        self._pairs = PairTable(ranks)
        self._ranks = ranks
        self._single = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        order = sorted(ranks.items(), key=lambda item: item[1])
        top = order[-1][1] + 1
        self._lengths = np.zeros(top, dtype=np.int64)
        self._offsets = np.zeros(top, dtype=np.int64)
        at = 0
        for token, rank in order:
            self._lengths[rank], self._offsets[rank] = len(token), at
            at += len(token)
        self._bytes = np.frombuffer(b"".join(token for token, _ in order), dtype=np.uint8)
        self._chunks = ChunkEncoder(self.encode_chunks)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        return self._chunks.encode(texts)

    def encode_chunks(self, chunks: list[str]) -> list[bytes]:
        split = [self._pattern.findall(chunk) for chunk in chunks]
        codes = self._encode_pieces({piece for pieces in split for piece in pieces})
        return [
            codes[pieces[0]] if len(pieces) == 1 else b"".join([codes[p] for p in pieces])
            for pieces in split
        ]

    def _encode_pieces(self, pieces: set[str]) -> dict[str, bytes]:
        codes: dict[str, bytes] = {}
        buckets: dict[int, list[tuple[str, bytes]]] = {}
        for piece in pieces:
            data = piece.encode()
            rank = self._ranks.get(data)
            if rank is not None:
                codes[piece] = rank.to_bytes(4, "little")
            elif len(data) > LONGEST_ROW:
                codes[piece] = self._merge_long(data)
            else:
                width = len(data) if len(data) <= 16 else 1 << (len(data) - 1).bit_length()
                buckets.setdefault(width, []).append((piece, data))
        for width, rows in buckets.items():
            step = max(1, (1 << 20) // width)
            for start in range(0, len(rows), step):
                some = rows[start : start + step]
                for (piece, _), code in zip(some, self._merge_rows([d for _, d in some], width)):
                    codes[piece] = code
        return codes

    def _merge_rows(self, rows: list[bytes], width: int) -> list[bytes]:
        packed = b"".join([row.ljust(width, b"\0") for row in rows])
        tokens = self._single[np.frombuffer(packed, np.uint8).reshape(len(rows), width)]
        lengths = np.array([len(row) for row in rows])
        tokens[np.arange(width) >= lengths[:, None]] = -1
        ranks = self._pairs.ranks(tokens[:, :-1].ravel(), tokens[:, 1:].ravel())
        ranks = ranks.reshape(len(rows), width - 1)
        alive = np.arange(len(rows))
        done: list[bytes] = [b""] * len(rows)

        def retire(who: np.ndarray, what: np.ndarray) -> None:
            counts = (what >= 0).sum(axis=1)
            flat = what[what >= 0].astype("<u4").tobytes()
            ends = np.cumsum(counts) * 4
            for k, end, count in zip(who.tolist(), ends.tolist(), counts.tolist()):
                done[k] = flat[end - 4 * count : end]

        while len(alive) and ranks.shape[1]:
            best = ranks.argmin(axis=1)
            line = np.arange(len(alive))
            rank = ranks[line, best]
            over = rank == _NONE
            if over.any():
                retire(alive[over], tokens[over])
                going = ~over
                alive, tokens, ranks = alive[going], tokens[going], ranks[going]
                best, rank = best[going], rank[going]
                line = np.arange(len(alive))
                if not len(alive):
                    break
            tokens[line, best] = rank
            keep = np.ones(tokens.shape, dtype=bool)
            keep[line, best + 1] = False
            tokens = tokens[keep].reshape(len(alive), -1)
            keep = np.ones(ranks.shape, dtype=bool)
            keep[line, best] = False
            ranks = ranks[keep].reshape(len(alive), -1)
            # The two pairs next to the merged token have changed.
            after = np.flatnonzero(best < ranks.shape[1])
            ranks[after, best[after]] = self._pairs.ranks(
                tokens[after, best[after]], tokens[after, best[after] + 1]
            )
            before = np.flatnonzero(best > 0)
            ranks[before, best[before] - 1] = self._pairs.ranks(
                tokens[before, best[before] - 1], tokens[before, best[before]]
            )
        if len(alive):
            retire(alive, tokens)
        return done

    def _merge_long(self, data: bytes) -> bytes:
        """The same merges for one long piece, in n log n steps."""
        ids = self._single[np.frombuffer(data, np.uint8)]
        first = self._pairs.ranks(ids[:-1], ids[1:])
        tokens: list[int] = ids.tolist()
        n = len(tokens)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        spell = [data[i : i + 1] for i in range(n)]
        heap = [(rank, i, i + 1) for i, rank in enumerate(first.tolist()) if rank != _NONE]
        heapq.heapify(heap)
        gone = bytearray(n)

        def offer(i: int, j: int) -> None:
            rank = self._ranks.get(spell[i] + spell[j])
            if rank is not None:
                heapq.heappush(heap, (rank, i, j))

        while heap:
            rank, i, j = heapq.heappop(heap)
            if gone[i] or j >= n or gone[j] or after[i] != j:
                continue
            if self._ranks.get(spell[i] + spell[j]) != rank:
                continue
            tokens[i], gone[j] = rank, 1
            spell[i] += spell[j]
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                offer(i, after[i])
            if before[i] >= 0:
                offer(before[i], i)
        kept = [token for token, over in zip(tokens, gone) if not over]
        return np.array(kept, dtype="<u4").tobytes()

    def decode(self, code: bytes) -> bytes:
        ids = np.frombuffer(code, dtype="<u4")
        lengths = self._lengths[ids]
        ends = np.cumsum(lengths)
        shift = np.repeat(self._offsets[ids] - (ends - lengths), lengths)
        return self._bytes[shift + np.arange(len(shift))].tobytes()


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> BytePairCodec:
    """The codec of a rank file, built once in a Python worker."""
    with open(path, "rb") as lines:
        ranks = {
            base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())
        }
    return BytePairCodec(ranks, pattern)


ENCODED = {
    "n_tokens": pa.int64(),
    "ids": pa.binary(),
    "ids_sha256": pa.string(),
    "decoded_sha256": pa.string(),
}


def encoded(docs: DataFrame, path: str, pattern: str, with_ids: bool = True) -> DataFrame:
    """Replace ``text`` by its token ids.

    Adds ``n_tokens``, ``ids`` (little-endian unsigned 32-bit; left out without
    ``with_ids``), ``ids_sha256`` and ``decoded_sha256`` of the decoded bytes.
    Null texts are empty and have no ids.  ``path`` is a rank file every worker
    can read.  Other columns pass through; columns of the added names are replaced.
    """
    added = {k: t for k, t in ENCODED.items() if with_ids or k != "ids"}
    others = [c for c in docs.columns if c != "text" and c not in ENCODED]
    source = docs.select(*(F.col(f"`{c}`") for c in others), F.col("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            for start, texts in pieces_of(batch.column(batch.num_columns - 1)):
                codes = own.encode(texts)
                columns = {
                    "n_tokens": [len(code) // 4 for code in codes],
                    "ids": codes,
                    "ids_sha256": [hashlib.sha256(code).hexdigest() for code in codes],
                    "decoded_sha256": [hashlib.sha256(own.decode(code)).hexdigest() for code in codes],
                }
                kept = [c.slice(start, len(texts)) for c in batch.columns[:-1]]
                yield pa.RecordBatch.from_arrays(
                    kept + [pa.array(columns[k], t) for k, t in added.items()],
                    names=others + list(added),
                )

    spark_types = {"n_tokens": "long", "ids": "binary"}
    schema = ", ".join(
        [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != "text"]
        + [f"{k} {spark_types.get(k, 'string')}" for k in added]
    )
    return source.mapInArrow(work, schema)


@shipped
def op10_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return encoded(docs, ranks, public_tokenizers.PATTERN, with_ids=False)
