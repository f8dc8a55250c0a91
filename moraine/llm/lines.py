"""Operator 8: duplicate and near-duplicate lines by a segment-partition edit join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .groups import tiled, together, whole_groups
from .shingles import _inverse_powers, _powers, mixed
from .storage import Scratch, give_back, light_slices, size_of, small_batches, written

INDEX, PROBE = 1, 2


def segments(length: np.ndarray, edits: int, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and size of segment ``i`` of ``edits + 1`` even ones; the last ones take the rest."""
    parts = edits + 1
    size, rest = length // parts, length % parts
    late = np.maximum(0, i - (parts - rest))
    return i * size + late, size + (i >= parts - rest)


def segment_keys(codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, edits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, line, role) of every index entry and probe of lines held end to end as code points.

    A line of length n enters its segments under (n, number, content).  It probes the entries of lines up to ``edits``
    shorter: of two lines within ``edits`` edits, the longer holds one of the shorter's segments, shifted by no more than
    the edits to its left and to its right allow.  An unshifted segment of its own length is entry and probe at once.
    """
    keys, lines, roles = [], [], []
    done = 0
    ends = starts + lengths
    while done < len(starts):
        base = starts[done]
        upto = max(done + 1, int(np.searchsorted(ends, base + (1 << 20), side="right")))
        span = codes[base : ends[upto - 1]].astype(np.uint64) + np.uint64(1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(span * _powers(len(span)), dtype=np.uint64)))
        inverse = _inverse_powers(len(span) + 1)
        own, n = starts[done:upto] - base, lengths[done:upto]
        number = np.arange(done, upto)
        for less in range(edits + 1):
            short = n - less
            for i in range(edits + 1):
                at, size = segments(short, edits, i)
                for shift in range(max(-i, less - (edits - i)), min(i, less + (edits - i)) + 1):
                    a = at + shift
                    fits = (a >= 0) & (a + size <= n) & (size > 0)
                    a, s, w = (own + a)[fits], size[fits], short[fits].astype(np.uint64)
                    h = (sums[a + s] - sums[a]) * inverse[a]
                    keys.append(mixed(h + mixed(w * np.uint64(64) + np.uint64(i))))
                    lines.append(number[fits])
                    roles.append(np.full(len(a), PROBE if less or shift else INDEX | PROBE, np.int8))
        done = upto
    if not keys:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int8)
    return np.concatenate(keys), np.concatenate(lines), np.concatenate(roles)


def within(a: str, b: str, edits: int) -> bool:
    """Whether the edit distance is at most ``edits``: equal ends are cut, the rest runs through a bit-parallel band.

    Bit j of row d, after i characters of ``b``, says that ``a[: i + j - edits]`` is within d edits of ``b[:i]``.
    """
    if abs(len(a) - len(b)) > edits:
        return False
    low = _equal(a, b, min(len(a), len(b)))
    a, b = a[low:], b[low:]
    high = _equal(a[::-1], b[::-1], min(len(a), len(b)))
    a, b = a[: len(a) - high], b[: len(b) - high]
    if not a or not b:
        return max(len(a), len(b)) <= edits
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << (i + edits)
    full = (1 << (2 * edits + 1)) - 1
    rows = [((1 << (d + 1)) - 1) << edits & full for d in range(edits + 1)]
    for i, c in enumerate(b):
        same = where.get(c, 0) >> i & full
        new = rows[0] & same
        out = [new]
        for d in range(1, edits + 1):
            before = rows[d - 1]
            new = (rows[d] & same | before | before >> 1 | new << 1) & full
            out.append(new)
        rows = out
        if not rows[-1]:
            return False
    place = len(a) - len(b) + edits
    return bool(rows[-1] >> place & 1)


def _equal(a: str, b: str, n: int) -> int:
    """Length of the common beginning, by halving."""
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def _lines(batch: pa.Array, least: int) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Which text and which line number each line of ``least`` or more characters has, and the trimmed lines."""
    split = pc.split_pattern(pc.fill_null(batch, ""), "\n")
    counts = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    trimmed = pc.ascii_trim_whitespace(split.flatten())
    long = pc.greater_equal(pc.utf8_length(trimmed), least)
    keep = np.flatnonzero(long.to_numpy(zero_copy_only=False))
    owner = np.repeat(np.arange(len(counts)), counts)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    return owner[keep], number[keep], trimmed.take(pa.array(keep))


def _digest(texts: list[str | None]) -> list[bytes]:
    import xxhash

    return [xxhash.xxh3_128_digest((x or "").encode("utf-8", "surrogatepass")) for x in texts]


def _short(digests: list[bytes]) -> np.ndarray:
    """The first half of each digest as a number."""
    return np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)[:, 0] if digests else np.empty(0, np.int64)


def _occurrences(rows: DataFrame, least: int, id_type: str) -> DataFrame:
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in light_slices(batch, "text", 500):
                owner, number, lines = _lines(part.column("text"), least)
                docs = pa.array(_digest(part.column("text").to_pylist()), pa.binary())
                line = _digest(lines.to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(owner)), docs.take(pa.array(owner)), pa.array(number.astype(np.int32)), pa.array(line, pa.binary()), pa.array(_short(line))], ["id", "doc", "number", "line", "short"])
        give_back()

    return rows.mapInArrow(find, f"id {id_type}, doc binary, number int, line binary, short long")


def _entries(rows: DataFrame, least: int, edits: int) -> DataFrame:
    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = pa.concat_arrays([_lines(part.column("text"), least)[2] for part in light_slices(batch, "text", 500)]).unique()
            for at in range(0, len(lines), 4000):
                part = lines.slice(at, 4000)
                lengths = pc.utf8_length(part).to_numpy(zero_copy_only=False).astype(np.int64)
                texts = part.to_pylist()
                codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
                key, line, role = segment_keys(codes, np.cumsum(lengths) - lengths, lengths, edits)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(_short(_digest(texts))[line]), pa.array(role)], ["key", "short", "role"])
        give_back()

    return rows.select("text").mapInArrow(enter, "key long, short long, role byte")


def _bits(shorts: DataFrame, count: int) -> tuple[int, np.ndarray]:
    """A filter of at most 64 Mbit over ``shorts``: it only spares rows, what it lets through is joined exactly."""
    size = 1 << max(10, min(26, (16 * max(count, 1)).bit_length()))
    words = shorts.select(F.pmod("short", F.lit(size)).alias("b")).groupBy(F.shiftright("b", 5).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(b & 31 AS INT))")).alias("m"))
    found = words.toArrow()
    out = np.zeros(size >> 5, np.int64)
    out[found.column("w").to_numpy()] = found.column("m").to_numpy()
    return size, out.astype(np.uint32)


def _texts(rows: DataFrame, shorts: DataFrame, least: int) -> DataFrame:
    """The text of each wanted line, once."""
    size, bits = _bits(shorts, shorts.count())
    wanted = rows.sparkSession.sparkContext.broadcast(bits)

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = pa.concat_arrays([_lines(part.column("text"), least)[2] for part in light_slices(batch, "text", 500)]).unique()
            short = _short(_digest(lines.to_pylist()))
            b = short % size
            keep = np.flatnonzero(wanted.value[b >> 5] >> (b & 31).astype(np.uint32) & 1)
            yield pa.RecordBatch.from_arrays([pa.array(short[keep]), lines.take(pa.array(keep))], ["short", "line_text"])

    found = rows.select("text").mapInArrow(fetch, "short long, line_text string")
    return found.join(shorts, "short", "left_semi").groupBy("short").agg(F.min("line_text").alias("line_text"))


def _histograms(texts: list[str]) -> np.ndarray:
    """Counts of code points by their low five bits: one edit moves their sum of differences by two at most."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.bincount(np.repeat(np.arange(len(texts)), lengths) * 32 + (codes & 31), minlength=32 * len(texts)).reshape(-1, 32)


def near_lines(rows: DataFrame, least: int, edits: int, tile: int = 512) -> DataFrame:
    """Edges between the ``short`` digests of distinct lines within ``edits`` edits, one for each line and shared key."""
    scratch = Scratch(rows.sparkSession, "line-entries")
    entries = scratch.put(_entries(rows, least, edits))
    # a line that stands in several tasks' texts entered several times: first the keys of several entries, by a count that
    # shuffles little, then those of several lines among what is left
    many = entries.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.bit_or("role").alias("r")).where(f"n > 1 AND r = {INDEX | PROBE}").select("key")
    some = scratch.put(entries.join(many, "key").select("key", "short", "role").distinct(), size_of(entries))
    scratch.keep_last()  # the entries are the largest table here, and done with
    meets = some.groupBy("key").agg(F.min("short").alias("a"), F.max("short").alias("b")).where("a <> b").select("key")
    both = scratch.put(some.join(meets, "key"), size_of(some))
    scratch.keep_last()
    shorts = both.select("short").distinct()
    dealt = tiled(both, "key", "short", tile).select("cell", "tile_a", "tile_b", "tile_own", "short", "role")
    dealt = dealt.join(_texts(rows, shorts, least), "short")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, bounds in whole_groups(batches, "cell"):
            tile_a, tile_b, own, short, role = (group.column(c).to_numpy() for c in ("tile_a", "tile_b", "tile_own", "short", "role"))
            texts = group.column("line_text").to_pylist()
            histogram, size = _histograms(texts), np.fromiter(map(len, texts), np.int64, len(texts))
            known: dict[tuple[int, int], bool] = {}
            edges = []
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                n, h, s = size[a:b], histogram[a:b], short[a:b]
                close = (np.abs(n[:, None] - n[None, :]) <= edits) & (s[:, None] < s[None, :])
                close &= ((role[a:b][:, None] | role[a:b][None, :]) == (INDEX | PROBE))
                if tile_a[a] != tile_b[a]:
                    close &= own[a:b][:, None] != own[a:b][None, :]
                i, j = np.nonzero(close)
                if len(i):
                    few = np.concatenate([np.abs(h[i[k : k + 65536]] - h[j[k : k + 65536]]).sum(1) for k in range(0, len(i), 65536)]) <= 2 * edits
                    for x, y in zip(i[few].tolist(), j[few].tolist(), strict=True):
                        pair = (int(s[x]), int(s[y]))
                        if pair not in known:
                            known[pair] = within(texts[a + x], texts[a + y], edits)
                            if known[pair]:
                                edges.append(pair)
            if edges:
                # one edge a line: a forest of the links that this batch of groups holds
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*_forest(edges), strict=True)], ["u", "v"])

    return together(dealt, "cell").mapInArrow(verify, "u long, v long")


def _forest(edges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for u, v in edges:
        a, b = root(u), root(v)
        if a != b:
            parent[max(a, b)] = min(a, b)
            kept.append((u, v))
    return kept


def removed_lines(rows: DataFrame, id_type: str, *, edits: int = 2, least: int = 24, exact: int | None = None) -> DataFrame:
    """``id``, ``doc`` (digest of the text) and the numbers of the lines that stand elsewhere first."""
    found = written(_occurrences(rows, least if exact is None else min(exact, least), id_type), "lines")
    distinct = written(found.groupBy("line", "short").agg(F.min(F.struct("id", "doc", "number")).alias("first"), F.count(F.lit(1)).alias("n")), "distinct-lines", size_of(found))
    groups = components(near_lines(rows, least, edits), "line-components", within=size_of(distinct))
    keyed = distinct.join(groups.withColumnRenamed("node", "short"), "short", "left")
    near = keyed.where("component IS NOT NULL")
    lead = near.groupBy("component").agg(F.min("first").alias("lead"))
    leads = near.join(lead, "component").select("line", "lead").unionByName(keyed.where("component IS NULL AND n > 1").select("line", F.col("first").alias("lead")))
    gone = found.join(leads, "line").where(~F.struct("id", "doc", "number").eqNullSafe(F.col("lead")))
    return written(gone.groupBy("id", "doc").agg(F.collect_set("number").alias("gone")), "removed-lines", size_of(found))


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", edits: int = 2, least: int = 24, exact: int | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Documents without the lines that stand in the corpus before: ``id``, ``keep``, ``text``, ``n_lines``, ``n_removed``.

    Lines are what line feeds part.  Those of ``least`` or more characters, outer white space aside, belong to one class if
    a chain of lines within ``edits`` edits of each other connects them; of each class only the first line stays, by id,
    then text, then position.  Shorter lines of ``exact`` or more characters (none, if it is not given) are in a class with
    their equals only: two edits change much of a short line.  Lines shorter than both always stay.

    Equal lines are taken once.  Segment keys of all distinct lines are counted; only keys that two lines share move on, with
    their texts, in tiles of bounded size; candidate pairs are never rows.  Documents move once, compressed, to meet the
    numbers of their removed lines.

    A null text stays null, an empty one empty (one empty line).  Rows with equal ids and texts are one document and lose the
    same lines; null ids come first.  An empty table gives no row; other columns are ignored.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    with small_batches(docs.sparkSession, 3000):
        removed = removed_lines(rows, id_type, edits=edits, least=least, exact=exact)
    gone = removed.select(F.col("id").alias("gone_id"), F.col("doc").alias("gone_doc"), "gone")
    all_rows = docs.select(F.col(id_col).alias("id"), *[F.col(c) for c in keep], F.col(text_col).cast("string").alias("_text"))
    own = all_rows.schema.fields[:-1]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own)

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        for batch in batches:
            texts = batch.column("_text").to_pylist()
            packer = zstandard.ZstdCompressor(level=3)
            packed = [None if x is None else packer.compress(x.encode("utf-8", "surrogatepass")) for x in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(packed, pa.binary()), pa.array(_digest(texts), pa.binary())], [*batch.schema.names[:-1], "packed", "doc"])
        give_back()

    small = all_rows.mapInArrow(squeeze, f"{fields}, packed binary, doc binary")
    joined = small.join(gone, small["id"].eqNullSafe(gone["gone_id"]) & (small["doc"] == gone["gone_doc"]), "left").select(*[small[f.name] for f in own], "packed", "gone")

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        for batch in batches:
            texts, totals, losses = [], [], []
            opener = zstandard.ZstdDecompressor()
            for packed, out in zip(batch.column("packed").to_pylist(), batch.column("gone").to_pylist(), strict=True):
                if packed is None:
                    texts.append(None)
                    totals.append(0)
                    losses.append(0)
                    continue
                text = opener.decompress(packed).decode("utf-8", "surrogatepass")
                totals.append(text.count("\n") + 1)
                losses.append(len(out or ()))
                if out:
                    drop = set(out)
                    text = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in drop)
                texts.append(text)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(texts, pa.string()), pa.array(totals, pa.int64()), pa.array(losses, pa.int64())], [*batch.schema.names[:-2], "text", "n_lines", "n_removed"])
        give_back()

    return joined.mapInArrow(rewrite, f"{fields}, text string, n_lines long, n_removed long")
