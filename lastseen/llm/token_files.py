"""Token ids in Arrow stream files of fixed-size lists.

A file is a plain Arrow stream: record batches of ``SEQUENCES_IN_BATCH`` rows, each
a list of exactly ``SEQUENCE_LENGTH`` token ids and a mask of the same length that
is false for padding.  All rows are equally long, so sequence ``i`` lies at a
known place of the mapped file, and reading it copies nothing.  A second small
stream holds the place of each document.

Documents are dealt by id range, each task writes the files of its range, and a
manifest with one row for each file gives their order.  A file is written under a
name of its task attempt and then renamed: a task that runs again replaces it with
the same content.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lastseen.llm.chunks import ArrowChunkEncoder
from lastseen.llm.common import scratch_path, shipped, stored

SEQUENCE_LENGTH, SEQUENCES_IN_BATCH = 2048, 256
#: The id that ends a document.
END_ID = 0
#: How byte-level vocabularies write a space.
SPACE = "\u0120"
#: Characters encoded at a time.
TEXT_AT_ONCE = 1 << 23


def token_type(vocabulary: int) -> np.dtype:
    """The narrowest unsigned type that holds every id."""
    return np.dtype("<u2") if vocabulary <= 1 << 16 else np.dtype("<u4")


def token_schema(dtype: np.dtype) -> pa.Schema:
    return pa.schema(
        [
            pa.field("tokens", pa.list_(pa.from_numpy_dtype(dtype), SEQUENCE_LENGTH), nullable=False),
            pa.field("mask", pa.list_(pa.bool_(), SEQUENCE_LENGTH), nullable=False),
        ]
    )


INDEX_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> tuple[ArrowChunkEncoder, np.dtype]:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark fills the cores
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    names = tokenizer.get_vocab(with_added_tokens=True)
    dtype = token_type(max(names.values(), default=0) + 1)
    opens = np.zeros(max(names.values(), default=0) + 1, dtype=bool)
    opens[[number for name, number in names.items() if name.startswith(SPACE)]] = True

    def encode_batch(texts: list[str]) -> list[np.ndarray]:
        codes = tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(code.ids, dtype=dtype) for code in codes]

    return ArrowChunkEncoder(encode_batch, opens, dtype), dtype


class _Packer:
    """Cuts a stream of ids into sequences and writes full batches."""

    def __init__(self, sink, dtype: np.dtype):
        self._schema, self._dtype = token_schema(dtype), dtype
        self._writer = pa.ipc.new_stream(sink, self._schema)
        self._held: list[bytes] = []
        self._size = 0
        self._batch = SEQUENCE_LENGTH * SEQUENCES_IN_BATCH * dtype.itemsize
        self.sequences = 0

    def add(self, code: bytes) -> None:
        self._held.append(code)
        self._size += len(code)
        if self._size >= self._batch:
            data = b"".join(self._held)
            whole = len(data) - len(data) % self._batch
            for start in range(0, whole, self._batch):
                ids = np.frombuffer(data, self._dtype, self._batch // self._dtype.itemsize, start)
                self._write(ids, np.ones(len(ids), dtype=bool))
            self._held, self._size = [data[whole:]], len(data) - whole

    def _write(self, ids: np.ndarray, mask: np.ndarray) -> None:
        arrays = [
            pa.FixedSizeListArray.from_arrays(pa.array(values), SEQUENCE_LENGTH)
            for values in (ids, mask)
        ]
        self._writer.write_batch(pa.RecordBatch.from_arrays(arrays, schema=self._schema))
        self.sequences += len(ids) // SEQUENCE_LENGTH

    def close(self) -> None:
        ids = np.frombuffer(b"".join(self._held), self._dtype)
        padded = -(-len(ids) // SEQUENCE_LENGTH) * SEQUENCE_LENGTH
        if padded:
            mask = np.arange(padded) < len(ids)
            self._write(np.concatenate((ids, np.zeros(padded - len(ids), self._dtype))), mask)
        self._writer.close()


def _stretches(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs of texts that together have about :data:`TEXT_AT_ONCE` bytes."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    run = (np.cumsum(sizes) - sizes) // TEXT_AT_ONCE
    cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(texts)]
    return ((a, b) for a, b in zip(cuts, cuts[1:]) if b > a)


MANIFEST_SCHEMA = "part int, tokens string, index string, n_docs long, n_tokens long, n_sequences long"


def write_token_files(docs: DataFrame, tokenizer_path: str, folder: str) -> DataFrame:
    """Write the ids of ``docs`` (doc_id, text) to ``folder``; returns the manifest.

    Null texts are empty and hold only the end id.  Documents are in ascending
    order of id, nulls first; rows of the same id follow the hash of their text.
    ``folder`` is a URI that every executor reaches with Arrow's file systems.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, dtype = _tokenizer(tokenizer_path)
        context = TaskContext.get()
        part = context.partitionId()
        system, base = fs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        names = {k: f"{base}/part-{part:05d}.{k}.arrows" for k in ("tokens", "index")}
        drafts = {k: f"{name}.attempt-{context.taskAttemptId()}" for k, name in names.items()}
        n_docs = n_tokens = 0
        with system.open_output_stream(drafts["tokens"]) as tokens, system.open_output_stream(
            drafts["index"]
        ) as index:
            packer = _Packer(tokens, dtype)
            writer = pa.ipc.new_stream(index, INDEX_SCHEMA)
            for batch in batches:
                for start, stop in _stretches(batch.column(1)):
                    some = batch.slice(start, stop - start)
                    ids, sizes = encoder.encode(pc.fill_null(some.column(1), ""))
                    packer.add(np.insert(ids, np.cumsum(sizes), END_ID).tobytes())
                    sizes = sizes + 1
                    starts = n_tokens + np.cumsum(sizes) - sizes
                    rows = [some.column(0), pa.array(starts), pa.array(sizes)]
                    writer.write_batch(pa.RecordBatch.from_arrays(rows, schema=INDEX_SCHEMA))
                    n_docs += some.num_rows
                    n_tokens += int(sizes.sum())
            packer.close()
            writer.close()
        if not n_docs:
            for draft in drafts.values():
                system.delete_file(draft)
            return
        for k in names:
            system.move(drafts[k], names[k])
        row = [part, f"{folder}/part-{part:05d}.tokens.arrows", f"{folder}/part-{part:05d}.index.arrows"]
        row += [n_docs, n_tokens, packer.sequences]
        types = [pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([value], kind) for value, kind in zip(row, types)],
            names=[field.split()[0] for field in MANIFEST_SCHEMA.split(", ")],
        )

    # The key is narrow; the text only breaks ties of ids, by its hash.
    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .withColumn("tie", F.xxhash64("text"))
        .repartitionByRange("doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie")
        .select("doc_id", "text")
    )
    return stored(ordered.mapInArrow(work, MANIFEST_SCHEMA), "token-manifest")


class TokenFile:
    """One written file, mapped: sequences and documents without copies."""

    def __init__(self, tokens: str, index: str):
        self.table = pa.ipc.open_stream(_opened(tokens)).read_all()
        self.index = pa.ipc.open_stream(_opened(index)).read_all()
        self._batches = [
            batch.column(0).flatten().to_numpy(zero_copy_only=True) for batch in self.table.to_batches()
        ]
        self._size = SEQUENCE_LENGTH * SEQUENCES_IN_BATCH

    def sequence(self, i: int) -> np.ndarray:
        batch, row = divmod(i, SEQUENCES_IN_BATCH)
        return self._batches[batch][row * SEQUENCE_LENGTH : (row + 1) * SEQUENCE_LENGTH]

    def mask(self, i: int) -> np.ndarray:
        return np.array(self.table.column("mask")[i].as_py(), dtype=bool)

    def tokens(self, start: int, count: int) -> np.ndarray:
        """Ids of a stretch of the file; copies only where batches meet."""
        parts = []
        while count > 0:
            batch, at = divmod(start, self._size)
            part = self._batches[batch][at : at + count]
            parts.append(part)
            start, count = start + len(part), count - len(part)
        return parts[0] if len(parts) == 1 else np.concatenate(parts)


def _opened(uri: str):
    system, path = fs.FileSystem.from_uri(uri)
    if isinstance(system, fs.LocalFileSystem):
        return pa.memory_map(path)
    return system.open_input_file(path)


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Columns doc_id, start, n_tokens, ids_crc32 of every document in the files."""
    # One row for each file; its order is that of the files.
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                file = TokenFile(row["tokens"], row["index"])
                for some in file.index.to_batches(max_chunksize=10_000):
                    starts = some.column("start").to_numpy()
                    sizes = some.column("n_tokens").to_numpy()
                    sums = [
                        zlib.crc32(file.tokens(int(a), int(n)).astype("<u4"))
                        for a, n in zip(starts, sizes)
                    ]
                    yield pa.RecordBatch.from_arrays(
                        [some.column(0), pa.array(starts + row["base"]), some.column(2), pa.array(sums, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    # A stated number of partitions: rows this small would else meet in one task.
    tasks = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = placed.select("part", "tokens", "index", "base").repartition(tasks, "part")
    return spread.mapInArrow(work, "doc_id long, start long, n_tokens long, ids_crc32 long")


@shipped
def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = scratch_path(spark, "token-files")
    path = public_tokenizers.path("byte_bpe_50k.json")
    return read_token_files(write_token_files(docs, path, folder))
