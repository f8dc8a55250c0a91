"""Operator 4: near-duplicate vectors by collision counting over sorted one-dimensional projections."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .groups import tiled, together, whole_groups
from .storage import give_back, size_of, written

#: Places of a projection: its order is cut into as many steps, half a byte each, the outer two open.
PLACES = 16


@dataclass(frozen=True)
class Plan:
    """What is drawn and how much of it; every number follows from the threshold, the recall and the number of vectors."""

    threshold: float
    tables: int  # partitions of the space
    bits: int  # projections whose halves make a table's cells
    projections: int  # projections whose windows are counted, an even number
    step: float  # size of a place
    window: int  # places to either side of the query's own that its window takes in
    least: int  # collisions that a pair needs
    seed: int = 5

    @staticmethod
    def of(n: int, threshold: float, recall: float, *, cell: int = 400, projections: int = 64, window: int = 1) -> Plan:
        """Tables of cells with about ``cell`` vectors, enough that a pair at the threshold shares one with probability
        ``recall``; and the collision count that such a pair reaches but for a tenth of what recall leaves.

        A pair's difference on a projection is normal with deviation sqrt(2 - 2 threshold).  Places are 1.25 deviations wide, so
        that its chance to be within ``window`` places follows by averaging over where in its place the query stands.
        """
        bits = max(0, min(24, round(math.log2(max(n, 1) / cell))))
        same_side = 1 - math.acos(threshold) / math.pi
        hit = same_side**bits
        tables = 1 if hit >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - hit))
        deviation = math.sqrt(2 - 2 * threshold)
        below = lambda x: 0.5 * (1 + math.erf(x / math.sqrt(2)))
        spots = [(k + 0.5) / 200 for k in range(200)]
        inside = sum(below(1.25 * (window + 1 - t)) - below(-1.25 * (window + t)) for t in spots) / len(spots)
        missed, least = 0.0, 0
        while least < projections:
            missed += math.comb(projections, least) * inside**least * (1 - inside) ** (projections - least)
            if missed > (1 - recall) / 10:
                break
            least += 1
        return Plan(threshold, tables, bits, projections, 1.25 * deviation, window, least)


@functools.lru_cache(maxsize=16)
def directions(plan: Plan, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Directions of the tables' cells and of the counted windows, the same in every task."""
    rng = np.random.default_rng((plan.seed, dim))
    return rng.standard_normal((dim, plan.tables * plan.bits)), rng.standard_normal((dim, plan.projections))


def cells(plan: Plan, v: np.ndarray) -> np.ndarray:
    """Each vector's cell in every table, as one number: 24 bits of halves, 12 of the table, above them the dimension."""
    side = (v @ directions(plan, v.shape[1])[0] > 0).reshape(len(v), plan.tables, plan.bits)
    code = side @ (1 << np.arange(plan.bits, dtype=np.int64)) if plan.bits else np.zeros((len(v), plan.tables), np.int64)
    return code + (np.arange(plan.tables, dtype=np.int64) << 24) + (np.int64(v.shape[1]) << 36)


def places(plan: Plan, v: np.ndarray) -> np.ndarray:
    """The place of each vector in the order of every counted projection."""
    at = np.floor(v @ directions(plan, v.shape[1])[1] / plan.step) + PLACES // 2
    return np.clip(at, 0, PLACES - 1).astype(np.int8)


def packed(at: np.ndarray) -> np.ndarray:
    return (at[:, ::2] | at[:, 1::2] << 4).astype(np.uint8)


def unpacked(column: pa.Array, n: int) -> np.ndarray:
    both = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(n, -1)
    return np.stack((both & 15, both >> 4), 2).reshape(n, -1).astype(np.int8)


def counted(plan: Plan, at: np.ndarray, dense: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i < j) that fall into each other's windows on ``least`` projections or more.

    Rows are sorted by each projection; a row's window, centred on its own place, is a run of that order, and the rows whose
    rank lies in the run collide with it.  Pairs that can no longer reach the count are let go: after the first ``dense``
    projections, of which every pair's collisions are added up, only the pairs that are left are looked at.
    """
    n, m = at.shape
    if n < 2:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    order = np.argsort(at, axis=0, kind="stable")
    rank, low, high = (np.empty((m, n), np.int32) for _ in range(3))
    for k in range(m):
        ranked = at[order[:, k], k]
        rank[k, order[:, k]] = np.arange(n)
        ends = np.searchsorted(ranked, np.arange(-plan.window, PLACES + plan.window + 1))
        low[k], high[k] = ends[at[:, k]], ends[at[:, k] + 2 * plan.window + 1]
    found = []
    dense, step = min(m, dense), max(1, (1 << 20) // n)
    for a in range(0, n, step):
        count = np.zeros((min(step, n - a), n), np.int8)
        for k in range(dense):
            count += (rank[k] >= low[k, a : a + step, None]) & (rank[k] < high[k, a : a + step, None])
        i, j = np.nonzero(np.triu(count >= plan.least - (m - dense), a + 1))
        so_far, i = count[i, j], i + a
        for k in range(dense, m):
            if not len(i):
                break
            so_far = so_far + ((rank[k, j] >= low[k, i]) & (rank[k, j] < high[k, i]))
            good = so_far >= plan.least - (m - 1 - k)
            i, j, so_far = i[good], j[good], so_far[good]
        found.append((i, j))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def verified(v: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float, at_once: int = 1 << 16) -> np.ndarray:
    """Which of the counted pairs of unit vectors have a cosine of ``threshold`` or more, in double precision."""
    return np.concatenate([np.einsum("ij,ij->i", v[i[k : k + at_once]], v[j[k : k + at_once]]) >= threshold for k in range(0, len(i), at_once)] or [np.empty(0, bool)])


def _labels(linked: np.ndarray) -> np.ndarray:
    """Smallest index of each row's component in a symmetric matrix of links."""
    label = np.arange(len(linked))
    while True:
        low = np.minimum(label, np.where(linked, label[None, :], len(label)).min(1))
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    linked = np.zeros((n, n), bool)
    linked[i, j] = linked[j, i] = True
    return _labels(linked)


def _read(rows: DataFrame) -> DataFrame:
    """``id``, ``rep`` (digest of a vector that can link, else null) and ``v`` (its components as bytes, of their own width)."""
    width = np.float32 if rows.schema["v"].dataType.elementType.typeName() == "float" else np.float64

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            lists = batch.column("v")
            sizes = np.where(lists.is_valid().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy()), 0)
            flat = lists.values.to_numpy(zero_copy_only=False).astype(width)
            starts = lists.offsets.to_numpy()[:-1]
            reps, own = [None] * len(sizes), [None] * len(sizes)
            for dim in np.unique(sizes[sizes > 0]).tolist():
                pick = np.flatnonzero(sizes == dim)
                block = flat[starts[pick][:, None] + np.arange(dim)] + width(0)
                good = np.isfinite(block).all(1) & (block != 0).any(1)
                for at, x in zip(pick[good].tolist(), block[good], strict=True):
                    own[at] = x.tobytes()
                    reps[at] = xxhash.xxh3_128_digest(own[at])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(reps, pa.binary()), pa.array(own, pa.binary())], ["id", "rep", "v"])

    return rows.mapInArrow(read, "id long, rep binary, v binary")


def _units(values: list[bytes], width: type) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, unit vectors) of each length; scaled first, so that no square overflows."""
    sizes = np.array([len(x) for x in values], np.int64)
    for size in np.unique(sizes).tolist():
        pick = np.flatnonzero(sizes == size)
        raw = np.frombuffer(b"".join(values[k] for k in pick.tolist()), width).reshape(len(pick), -1).astype(np.float64)
        raw = raw / np.abs(raw).max(1, keepdims=True)
        yield pick, raw / np.linalg.norm(raw, axis=1, keepdims=True)


def _candidates(distinct: DataFrame, plan: Plan, width: type, tile: int) -> DataFrame:
    """Edges between vectors that collide often enough within a cell: one for each such vector and cell.

    Half a byte a projection moves for each table, never the vectors.
    """

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pick, v in _units(batch.column("v").to_pylist(), width):
                for a in range(0, len(pick), 2048):
                    key, rows = np.unique(cells(plan, v[a : a + 2048]), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(rows)], ["key", "rows"])

    filled = distinct.select("v").mapInArrow(fill, "key long, rows long").groupBy("key").agg(F.sum("rows").alias("rows")).where(F.col("rows") > tile)
    hot = written(filled.select(F.col("key").alias("hot_key"), F.ceil(F.col("rows") / tile).cast("int").alias("tiles")), "crowded-cells")
    crowded = hot.count()

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = batch.column("node")
            for pick, v in _units(batch.column("v").to_pylist(), width):
                for a in range(0, len(pick), 1024):
                    part = v[a : a + 1024]
                    again = pa.array(np.repeat(np.arange(len(part)), plan.tables))
                    codes = pa.array([x.tobytes() for x in packed(places(plan, part))], pa.binary())
                    own = node.take(pa.array(pick[a : a + 1024])).take(again)
                    yield pa.RecordBatch.from_arrays([pa.array(cells(plan, part).reshape(-1)), own, codes.take(again)], ["key", "node", "codes"])

    dealt = distinct.select("node", "v").mapInArrow(spread, "key long, node long, codes binary")
    if crowded:
        dealt = dealt.join(F.broadcast(hot) if crowded <= 100_000 else hot, dealt["key"] == hot["hot_key"], "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
        mine = F.pmod(F.xxhash64("node", F.lit(7)), F.col("tiles")).cast("int")
        dealt = dealt.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        dealt = dealt.withColumn("key", F.when(F.col("tiles") == 1, F.col("key")).otherwise(F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other"))))
    dealt = together(dealt.select("key", "node", "codes"), "key")

    def collide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, bounds in whole_groups(batches, "key"):
            node, found = group.column("node").to_numpy(), []
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if b - a < 2:
                    continue
                i, j = counted(plan, unpacked(group.column("codes").slice(a, b - a), b - a))
                if len(i):
                    busy = np.unique(np.concatenate((i, j)))
                    found.append((node[a + busy], node[a + _roots(b - a, i, j)[busy]]))
            if found:
                u, v = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"]).filter(pa.array(u != v))
        give_back()

    return dealt.mapInArrow(collide, "u long, v long")


def near_vectors(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9, recall: float = 0.995, tile: int = 1024) -> DataFrame:
    """Links of cosine ``threshold`` or more among all rows: one row for each, with ``n_links``, ``component_id``, ``kept``.

    Counting window collisions over whole sorted projections would meet a constant share of all pairs, so each of several
    tables first cuts the space into cells by the halves of other projections; within a cell, every pair's collisions over
    the sorted projections are counted.  Vectors whose pairs reach the count that a true pair all but surely reaches make
    one candidate cluster; within a cluster, pairs are counted again and those that pass are verified by their exact cosine
    in double precision, each pair once.  The number of tables follows from ``recall``, the chance to find a pair exactly at
    the threshold on its own; nearer pairs, and pairs whose cluster others connect, are found with greater chance.

    Equal vectors are taken once, with their number.  A crowded cell or cluster is cut into tiles of ``tile`` rows that meet
    pairwise in tasks of their own; no list of pairs is ever made, only counts and one edge per row and cell.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of other lengths
    don't link.  Rows with equal ids are rows of their own with the same id.  Null ids come out as rows with null
    ``component_id`` unless linked to others.  An empty table gives no row; other columns are ignored.
    """
    kind = vectors.schema[vector_col].dataType.elementType.typeName()
    width = np.float32 if kind == "float" else np.float64
    rows = _read(vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>" if kind == "float" else "array<double>").alias("v")))
    table = written(rows.select("id", "rep"), "vectors")
    merged = rows.where(F.col("rep").isNotNull()).groupBy("rep").agg(F.first("v").alias("v"), F.count(F.lit(1)).alias("n"), F.min("id").alias("low"))
    distinct = written(merged.withColumn("node", F.monotonically_increasing_id()), "distinct-vectors")
    plan = Plan.of(distinct.count(), threshold, recall)
    clusters = components(_candidates(distinct, plan, width, tile), "vector-clusters", within=size_of(table)).withColumnRenamed("component", "cluster")
    members = written(distinct.select("node", "n", "v").join(clusters, "node"), "vector-members")
    dealt = together(tiled(members, "cluster", "node", tile).select("cell", "tile_a", "tile_b", "tile_own", "node", "n", "v"))

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, bounds in whole_groups(batches, "cell"):
            found = []
            tile_a, tile_b, own, n, node = (group.column(c).to_numpy() for c in ("tile_a", "tile_b", "tile_own", "n", "node"))
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if b - a < 2:
                    continue
                for pick, v in _units(group.column("v").slice(a, b - a).to_pylist(), width):
                    at = a + pick
                    i, j = counted(plan, places(plan, v))
                    if tile_a[a] != tile_b[a]:
                        apart = own[at[i]] != own[at[j]]
                        i, j = i[apart], j[apart]
                    true = verified(v, i, j, plan.threshold)
                    i, j = i[true], j[true]
                    if len(i):
                        count = np.bincount(i, n[at[j]], len(at)) + np.bincount(j, n[at[i]], len(at))
                        busy = np.flatnonzero(count)
                        found.append((node[at[busy]], node[at[_roots(len(at), i, j)[busy]]], count[busy].astype(np.int64)))
            if found:
                u, root, count = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(root), pa.array(count)], ["node", "root", "n_links"])
        give_back()

    links = written(dealt.mapInArrow(link, "node long, root long, n_links long"), "vector-links")
    groups = components(links.select(F.col("node").alias("u"), F.col("root").alias("v")), "vector-components", within=size_of(links))
    counted_links = links.groupBy("node").agg(F.sum("n_links").alias("others"))
    labelled = distinct.select("node", "rep", "n", "low").join(counted_links, "node", "left").join(groups, "node", "left")
    labelled = labelled.select("rep", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("links"), F.coalesce("component", "node").alias("component"), "low")
    labelled = written(labelled, "vector-classes")
    lows = labelled.groupBy("component").agg(F.min("low").alias("component_id"))
    classes = labelled.join(lows, "component").select("rep", "links", "component_id")
    out = table.join(classes, "rep", "left")
    return out.select("id", F.coalesce("links", F.lit(0)).alias("n_links"), F.when(F.col("rep").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id")).withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)))


SQL = """
WITH RECURSIVE e AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
), ok AS (
  SELECT vec_id, v FROM e WHERE v IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.9
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM e UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a
), degree AS (
  SELECT a AS vec_id, count(*) AS n FROM link GROUP BY a
), component AS (
  SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a
)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM e LEFT JOIN degree USING (vec_id) LEFT JOIN component USING (vec_id)
"""
