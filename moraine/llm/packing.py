"""Operator 10: packing documents into token sequences by matching large pieces and best-fitting small ones."""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .groups import together, whole_groups
from .storage import PLAIN_FILES, give_back, new_path, size_of, small_batches, written
from .tokens import default_tokenizer, with_end, word_encoder

PIECE_SCHEMA = "id long, piece int, start long, length long, ids binary, part int, place long"
#: Tasks whose counts share a file: at most so many times ``capacity`` rows are read for one of them.
PARTS_A_FILE = 64
SEQUENCE_SCHEMA = "sequence_id long, ids binary, pieces array<struct<id: bigint, piece: int, start: bigint, length: bigint, offset: bigint>>"


def pieces(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Every document's pieces of at most ``capacity`` tokens; only longer documents are cut, the last piece may be shorter.

    ``ids`` holds the piece's ids as little-endian unsigned integers, of 16 bits if the vocabulary allows, else of 32.
    ``part`` is the task that made a piece and ``place`` the piece's position among that task's pieces of its length.
    """
    tokenizer = tokenizer or default_tokenizer()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part, seen = word_encoder(tokenizer), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, counts = with_end(*encoder.encode(batch.column("text")), end_id)
            n_pieces = -(-counts // capacity)
            owner = np.repeat(np.arange(len(counts)), n_pieces)
            number = np.arange(len(owner)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)
            start = number * capacity
            length = np.minimum(counts[owner] - start, capacity)
            at = (np.cumsum(counts) - counts)[owner] + start
            flat = ids.astype(encoder.dtype)  # pieces stand end to end, in order
            bounds = np.append(at, len(flat)).astype(np.int64) * flat.itemsize
            own = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(owner), [None, pa.py_buffer(bounds), pa.py_buffer(flat)]).cast(pa.binary())
            order = np.argsort(length, kind="stable")
            same = length[order]
            first = np.flatnonzero(np.diff(same, prepend=-1))
            runs = np.diff(np.append(first, len(same)))
            place = np.empty(len(length), np.int64)
            place[order] = np.arange(len(same)) - np.repeat(first, runs) + np.repeat(seen[same[first]], runs)
            seen[same[first]] += runs
            yield pa.record_batch(
                [batch.column("id").take(pa.array(owner)), pa.array(number, pa.int32()), pa.array(start), pa.array(length), own, pa.array(np.full(len(owner), part, np.int32)), pa.array(place)],
                ["id", "piece", "start", "length", "ids", "part", "place"],
            )
        give_back()

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(cut, PIECE_SCHEMA)


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """How many bins of which lengths pack ``counts`` pieces of each length: (number of equal bins, their lengths).

    Pieces above a third of the capacity go at most two to a bin: the longest left takes the longest other one that fits.
    Smaller pieces, longest first, go to the bin whose gap they leave smallest, or to a new bin.  Bins with equal contents
    are handled together, so time and memory depend on ``capacity``, never on the number of pieces.
    """
    left = {n: c for n, c in counts.items() if c}
    bins: dict[int, list[list]] = defaultdict(list)  # by gap: [number of bins, contents]
    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        n = large[-1]
        fit = bisect.bisect_right(large, capacity - n) - 1
        if fit < 0:
            bins[capacity - n].append([left[n], (n,)])
            left[n] = 0
        elif large[fit] == n:
            bins[capacity - 2 * n].append([left[n] // 2, (n, n)])
            if left[n] % 2:
                left[n] = 1
                partner = fit - 1
                if partner >= 0:
                    other = large[partner]
                    bins[capacity - n - other].append([1, (n, other)])
                    left[other] -= 1
                else:
                    bins[capacity - n].append([1, (n,)])
            left[n] = 0
        else:
            other = large[fit]
            number = min(left[n], left[other])
            bins[capacity - n - other].append([number, (n, other)])
            left[n] -= number
            left[other] -= number
        large = [x for x in large if left[x]]
    gaps = sorted(bins)
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        need = left[n]
        while need:
            at = bisect.bisect_left(gaps, n)
            if at == len(gaps):
                gap, whole = capacity, [need, ()]
            else:
                gap = gaps[at]
                whole = bins[gap].pop()
                if not bins[gap]:
                    del bins[gap], gaps[at]
            number, held = whole
            each = gap // n
            full = min(number, need // each)
            placed = [(full, each), (min(1, number - full), min(need - full * each, each))] if number > full else [(full, each)]
            for many, pieces_each in placed:
                if many and pieces_each:
                    rest = gap - pieces_each * n
                    if rest not in bins:
                        bisect.insort(gaps, rest)
                    bins[rest].append([many, held + (n,) * pieces_each])
                    need -= many * pieces_each
                    number -= many
            if number and held:
                if gap not in bins:
                    bisect.insort(gaps, gap)
                bins[gap].append([number, held])
    return [(number, held) for gap in sorted(bins) for number, held in bins[gap] if number]


def _slots(plan: list[tuple[int, tuple[int, ...]]]) -> dict[str, np.ndarray]:
    """Per slot kind, sorted by length: ranks ``low`` .. of pieces of ``length`` go to sequences ``sequence`` .. at ``offset``."""
    used: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for number, held in plan:
        offset = 0
        for n in held:
            rows.append((n, used[n], sequence, offset))
            used[n] += number
            offset += n
        sequence += number
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 4)
    return dict(zip(("length", "low", "sequence", "offset"), table.T, strict=True))


def pack_sequences(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Pack all documents into as few sequences as the method finds; one row for each sequence, read from a written table.

    Columns: ``sequence_id`` (from 0), ``ids`` (the sequence's ids, as :func:`pieces` keeps them) and ``pieces``, in order: ``id``,
    ``piece`` (from 0), ``start`` (the document's ids before it), ``length`` and ``offset`` (gapless from 0).

    Only the number of pieces of each length (at most ``capacity`` values) reaches the driver, which plans equal bins
    together; pieces are ranked within their length by summed counts of tasks, so a length that a third of all pieces
    share is no task's group.  A task's counts before it (at most ``capacity`` numbers) are read by whoever reads its
    pieces, so ids move once, to their sequence.  A null text counts as empty: one end id.  Null and repeated ids keep all
    their rows.  An empty table gives no row.  Other columns are ignored.
    """
    spark = docs.sparkSession
    with small_batches(spark, 2000):
        made = written(pieces(docs, id_col=id_col, text_col=text_col, tokenizer=tokenizer, capacity=capacity, end_id=end_id), "pieces", codec="zstd")
        by_part = made.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
        counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
        slots = spark.sparkContext.broadcast(_slots(plan_bins(counts, capacity)))
        before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        offsets = by_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
        path = new_path(spark, "pieces-before")
        offsets.withColumn("block", F.expr(f"part div {PARTS_A_FILE}")).repartition("block").write.options(**PLAIN_FILES).partitionBy("block").parquet(path)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, ranks_before = None, None
            for batch in batches:
                parts = batch.column("part").to_numpy()
                change = np.flatnonzero(np.diff(parts)) + 1
                for a, b in zip([0, *change.tolist()], [*change.tolist(), len(parts)], strict=True):
                    if a == b:
                        continue
                    if parts[a] != held:
                        held, ranks_before = parts[a], _before(path, int(parts[a]), capacity)
                    own = batch.slice(a, b - a)
                    length = own.column("length").to_numpy()
                    sequence, offset = _placed(slots.value, length, own.column("place").to_numpy() + ranks_before[length])
                    yield pa.record_batch([pa.array(sequence), pa.array(offset)] + [own.column(k) for k in ("id", "piece", "start", "length", "ids")], ["sequence_id", "offset", "id", "piece", "start", "length", "ids"])

        def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table, bounds in whole_groups(batches, "sequence_id"):
                at = pa.array(bounds.astype(np.int32))
                column = {k: table.column(k).combine_chunks() for k in table.column_names}
                column = {k: x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for k, x in column.items()}
                names = ["id", "piece", "start", "length", "offset"]
                ends = np.concatenate(([0], np.cumsum(pc.binary_length(column["ids"]).to_numpy())))[bounds]
                flat = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(table)], pa.int32()), column["ids"]), b"")[0].as_buffer()
                ids = pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(ends.astype(np.int32)), flat])
                yield pa.record_batch([column["sequence_id"].take(at[:-1]), ids, pa.ListArray.from_arrays(at, pa.StructArray.from_arrays([column[k] for k in names], names))], ["sequence_id", "ids", "pieces"])
            give_back()

        placed = made.mapInArrow(assign, "sequence_id long, offset long, id long, piece int, start long, length long, ids binary")
        return written(together(placed, "sequence_id", "offset").mapInArrow(join, SEQUENCE_SCHEMA), "packed", size_of(made), codec="zstd")


def _before(path: str, part: int, capacity: int) -> np.ndarray:
    """By length: pieces of it that the tasks before ``part`` made."""
    import pyarrow.fs
    import pyarrow.parquet as pq

    fs, root = pyarrow.fs.FileSystem.from_uri(f"{path}/block={part // PARTS_A_FILE}")
    table = np.zeros(capacity + 1, np.int64)
    for info in fs.get_file_info(pyarrow.fs.FileSelector(root)):
        if info.base_name.endswith(".parquet"):
            with fs.open_input_file(info.path) as file:
                rows = pq.read_table(file, columns=["part", "length", "before"])
            rows = rows.filter(pc.equal(rows.column("part"), part))
            table[rows.column("length").to_numpy()] = rows.column("before").to_numpy()
    return table


def _placed(s: dict[str, np.ndarray], length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of pieces of ``length`` that are ``rank``-th of theirs."""
    lengths, first = np.unique(s["length"], return_index=True)
    bound = np.append(first, len(s["length"]))
    slot = np.empty(len(length), np.int64)
    order = np.argsort(length, kind="stable")
    own, start = np.unique(length[order], return_index=True)
    for n, a, b in zip(own, start, np.append(start[1:], len(order)), strict=True):
        k = np.searchsorted(lengths, n)
        low = s["low"][bound[k] : bound[k + 1]]
        slot[order[a:b]] = bound[k] + np.searchsorted(low, rank[order[a:b]], side="right") - 1
    return s["sequence"][slot] + rank - s["low"][slot], s["offset"][slot]


def read_packed(sequences: DataFrame) -> DataFrame:
    """The pieces of packed sequences, as they stand there: ``id``, ``piece``, ``start``, ``length``, ``ids_crc32`` (of the ids
    as little-endian unsigned 32-bit integers), ``sequence_id`` and ``offset``."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            listed = batch.column("pieces")
            flat, owner = listed.flatten(), pc.list_parent_indices(listed)
            piece = {k: flat.field(i) for i, k in enumerate(("id", "piece", "start", "length", "offset"))}
            total = np.bincount(owner.to_numpy(), piece["length"].to_numpy(), batch.num_rows).astype(np.int64)
            ids, sums = batch.column("ids"), []
            held, wide = -1, np.empty(0, "<u4")
            for k, a, n in zip(owner.to_pylist(), piece["offset"].to_pylist(), piece["length"].to_pylist(), strict=True):
                if k != held:  # one sequence at a time
                    own = ids[k].as_buffer()
                    held, wide = k, np.frombuffer(own, "<u2" if own.size == 2 * total[k] else "<u4").astype("<u4")
                sums.append(zlib.crc32(wide[a : a + n]))
            yield pa.record_batch(
                [piece[k] for k in ("id", "piece", "start", "length")] + [pa.array(sums, pa.int64()), batch.column("sequence_id").take(owner), piece["offset"]],
                ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return sequences.mapInArrow(read, "id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack(docs: DataFrame, **options) -> DataFrame:
    """One row for each piece of each document, read back from the sequences that :func:`pack_sequences` writes."""
    return read_packed(pack_sequences(docs, **options))
