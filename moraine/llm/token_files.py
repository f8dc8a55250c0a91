"""Operator 3: token ids as Arrow stream files of fixed-size-list batches."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import give_back, new_path, small_batches, written
from .tokens import default_tokenizer, with_end, word_encoder

FILES_SCHEMA = "part int, path string, index_path string, docs long, tokens long"


def write_token_files(
    docs: DataFrame, path: str | None = None, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None,
    end_id: int = 1, sequence: int = 2048, batch_rows: int = 512, parts: int | None = None,
) -> DataFrame:
    """Encode every whole text, in ascending ``id_col`` order, into Arrow stream files; returns one row for each file.

    A file holds record batches of two fixed-size-list columns, ``ids`` (unsigned, 16 bits if the vocabulary allows) and
    ``mask`` (true for a token, false for filling), all lists ``sequence`` long, uncompressed: a reader maps the file and
    reaches any sequence with no copy (:class:`Sequences`).  A second stream file lists its documents: id, first position, number of ids.
    Documents run on from sequence to sequence; only the last sequence of a file is filled up with id 0 under a false mask.

    A null or empty text gives only ``end_id``.  Null ids come first; rows with equal ids are ordered by text and all kept.
    An empty table gives no file.  Other columns are ignored.  Files are named by their part and replaced whole, so a task
    that runs again leaves the same file.
    """
    spark = docs.sparkSession
    path = path or new_path(spark, "token-files")
    tokenizer = tokenizer or default_tokenizer()
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.repartitionByRange(*([parts] if parts else []), "id").sortWithinPartitions("id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part = word_encoder(tokenizer), TaskContext.get().partitionId()
        out = None
        for batch in batches:
            if not batch.num_rows:
                continue
            out = out or _Writer(path, part, encoder.dtype, sequence, batch_rows)
            ids, counts = with_end(*encoder.encode(batch.column("text")), end_id)
            out.add(batch.column("id"), ids, counts)
        give_back()
        if out:
            docs_in, tokens_in = out.close()
            yield pa.RecordBatch.from_pylist(
                [{"part": part, "path": out.ids_path, "index_path": out.index_path, "docs": docs_in, "tokens": tokens_in}],
                pa.schema([("part", pa.int32()), ("path", pa.string()), ("index_path", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64())]),
            )

    with small_batches(spark, 3000):
        return written(rows.mapInArrow(write, FILES_SCHEMA), "token-file-list")


class _Writer:
    """One part's pair of stream files, written under a temporary name and moved into place at the end."""

    def __init__(self, path: str, part: int, dtype: type, sequence: int, batch_rows: int):
        import os

        self.fs, root = pa.fs.FileSystem.from_uri(path)
        self.fs.create_dir(root, recursive=True)
        name = f"part-{part:06d}"
        self.ids_path, self.index_path = f"{path}/{name}.arrows", f"{path}/{name}.index.arrows"
        self.moves = [(f"{root}/{name}{kind}.{os.getpid()}.writing", f"{root}/{name}{kind}") for kind in (".arrows", ".index.arrows")]
        self.sequence, self.full, self.dtype = sequence, sequence * batch_rows, dtype
        note = {"sequence": str(sequence), "order": json.dumps("ascending id")}
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(dtype), sequence)), ("mask", pa.list_(pa.bool_(), sequence))], note)
        self.index_schema = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.files = [self.fs.open_output_stream(x) for x, _ in self.moves]
        self.out, self.index = (pa.ipc.new_stream(f, s) for f, s in zip(self.files, (self.schema, self.index_schema), strict=True))
        self.held, self.docs, self.tokens = np.empty(0, dtype), 0, 0

    def add(self, doc_ids: pa.Array, ids: np.ndarray, counts: np.ndarray) -> None:
        starts = self.tokens + np.cumsum(counts) - counts
        self.index.write_batch(pa.record_batch([doc_ids, pa.array(starts), pa.array(counts)], schema=self.index_schema))
        self.docs, self.tokens = self.docs + len(counts), self.tokens + len(ids)
        self.held = np.concatenate((self.held, ids))
        while len(self.held) >= self.full:
            self._put(self.held[: self.full], self.full)
            self.held = self.held[self.full :]

    def _put(self, ids: np.ndarray, n: int) -> None:
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.sequence) for x in (ids, np.arange(len(ids)) < n)]
        self.out.write_batch(pa.record_batch([x.cast(t) for x, t in zip(lists, self.schema.types, strict=True)], schema=self.schema))

    def close(self) -> tuple[int, int]:
        if n := len(self.held):
            self._put(np.pad(self.held, (0, -n % self.sequence)), n)
        for x in (self.out, self.index, *self.files):
            x.close()
        for a, b in self.moves:
            self.fs.move(a, b)
        return self.docs, self.tokens


def open_sequences(path: str) -> Iterator[pa.RecordBatch]:
    """The record batches of an ids file; buffers of a mapped local file are used in place."""
    fs, inner = pa.fs.FileSystem.from_uri(path)
    source = pa.memory_map(inner) if isinstance(fs, pa.fs.LocalFileSystem) else fs.open_input_stream(inner)
    with pa.ipc.open_stream(source) as stream:
        yield from stream


class Sequences:
    """Random access to the sequences of an ids file: ``len``, ``ids(i)`` and ``mask(i)``.

    A local file is mapped; opening it reads only the headers of its record batches, and ``ids(i)`` is a view of the mapped
    bytes, not a copy.  Every record batch but the last holds equally many sequences, so a sequence's place is a division.
    """

    def __init__(self, path: str):
        self.batches = list(open_sequences(path))
        self.each = self.batches[0].num_rows if self.batches else 1
        if any(b.num_rows != self.each for b in self.batches[:-1]):
            raise ValueError(f"record batches of {path} differ in size")

    def __len__(self) -> int:
        return sum(b.num_rows for b in self.batches)

    def _row(self, name: str, i: int) -> pa.Array:
        if not 0 <= i < len(self):
            raise IndexError(i)
        lists = self.batches[i // self.each].column(name)
        size = lists.type.list_size
        return lists.values.slice((lists.offset + i % self.each) * size, size)

    def ids(self, i: int) -> np.ndarray:
        return self._row("ids", i).to_numpy(zero_copy_only=True)

    def mask(self, i: int) -> np.ndarray:
        return self._row("mask", i).to_numpy(zero_copy_only=False)


def read_token_files(files: DataFrame) -> DataFrame:
    """Documents from the files that :func:`write_token_files` listed: ``id``, ``start`` (ids of all documents before, over
    all files), ``n_tokens`` and ``ids_crc32`` (of the ids as little-endian unsigned 32-bit integers).

    Only the running totals of the files (one row each) are summed in a window; the ids stay in their files' tasks.
    """
    from pyspark.sql import Window

    listed = files.withColumn("base", F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    listed = listed.select("path", "index_path", F.coalesce("base", F.lit(0)).alias("base")).repartition(max(1, files.count()), "path")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from _read_part(row["path"], row["index_path"], row["base"])

    return listed.mapInArrow(read, "id long, start long, n_tokens long, ids_crc32 long")


def _read_part(path: str, index_path: str, base: int) -> Iterator[pa.RecordBatch]:
    """One file's documents; holds a record batch and the ids of the document that is still open as a running checksum."""
    sequences = open_sequences(path)
    ids, at = np.empty(0, np.uint32), 0
    for index in open_sequences(index_path):
        counts, sums = index.column("n_tokens").to_numpy(), []
        for n in counts.tolist():
            crc = 0
            while n:
                if at == len(ids):
                    batch = next(sequences)
                    values, mask = (batch.column(k).flatten().to_numpy(zero_copy_only=False) for k in ("ids", "mask"))
                    ids, at = values[mask].astype("<u4"), 0
                step = min(n, len(ids) - at)
                crc, at, n = zlib.crc32(ids[at : at + step], crc), at + step, n - step
            sums.append(crc)
        yield pa.record_batch([index.column("id"), pa.array(index.column("start").to_numpy() + base), index.column("n_tokens"), pa.array(sums, pa.int64())], ["id", "start", "n_tokens", "ids_crc32"])
