"""Operator 1: n-gram Jaccard join by chosen paths over min-hash embedded shingle sets."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .groups import tiled, together, whole_groups
from .shingles import min_hashes, mixed, shingle_sets
from .storage import Scratch, give_back, light_slices, size_of, small_batches, written
from .vectors import _labels


@dataclass(frozen=True)
class Plan:
    """Numbers of the recursion, from the threshold and the recall."""

    threshold: float
    coordinates: int
    runs: int
    agreement: int  # coordinates that a pair at the threshold shares all but surely
    small: int  # a bucket of so many sets is compared at once
    depth: int
    seed: int = 3

    @staticmethod
    def of(threshold: float, recall: float, *, coordinates: int = 64, small: int = 64, depth: int = 5) -> Plan:
        """A node splits on one shared token and has two children, so a pair at the threshold t stays together down to any
        depth with a chance above 2 - 1/t, the fixed point of s = t (1 - (1 - s)^2); runs repeat until that would meet the
        recall, were they independent.  They permute the same coordinates, so that a pair at the threshold is in fact lost a
        little more often: with the defaults about once in 50,000 (measured in the tests by simulating pairs)."""
        stay = max(2 - 1 / threshold, threshold**depth)
        runs = max(1, math.ceil(math.log(1 - recall) / math.log(1 - stay)))
        spread = math.sqrt(coordinates * threshold * (1 - threshold))
        return Plan(threshold, coordinates, runs, max(1, math.floor(coordinates * threshold - 4.75 * spread)), small, depth)

    def order(self, run: np.ndarray) -> np.ndarray:
        """The coordinates in the order in which each run's tree uses them."""
        return np.stack([np.random.default_rng((self.seed, int(r))).permutation(self.coordinates) for r in run])


def _digests(flat: np.ndarray, counts: np.ndarray) -> list[bytes | None]:
    import xxhash

    ends = np.cumsum(counts)
    return [xxhash.xxh3_128_digest(flat[e - n : e].data) if n else None for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]


def _sketches(rows: DataFrame, plan: Plan, shingle: int, id_type: str) -> DataFrame:
    """Id, text hash, digest of the shingle set, its size and its min-hashes, for every row."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in light_slices(batch, "text", 2000):
                flat, counts = shingle_sets(part.column("text"), shingle)
                low = min_hashes(flat, counts, plan.coordinates, plan.seed)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("mark"), pa.array(_digests(flat, counts), pa.binary()), pa.array(counts), pa.array([x.tobytes() for x in low], pa.binary())], ["id", "mark", "rep", "size", "sketch"]
                )
        give_back()

    return rows.mapInArrow(sketch, f"id {id_type}, mark long, rep binary, size long, sketch binary")


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), np.uint32).reshape(len(values), -1)


def _roots(distinct: DataFrame, plan: Plan) -> DataFrame:
    """The first bucket of every set in each run's tree."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = plan.order(np.arange(plan.runs))
        for batch in batches:
            values = _matrix(batch.column("sketch"))[:, order[:, 0]].astype(np.uint64)
            node = mixed(values + (np.arange(plan.runs, dtype=np.uint64) << np.uint64(33)))
            again = pa.array(np.repeat(np.arange(len(values)), plan.runs))
            yield pa.RecordBatch.from_arrays([pa.array(node.reshape(-1).view(np.int64)), batch.column("rep").take(again), pa.array(np.tile(np.arange(plan.runs, dtype=np.int32) * 64, len(values)))], ["node", "rep", "spot"])

    return distinct.select("rep", "sketch").mapInArrow(split, "node long, rep binary, spot int")


def _children(rows: DataFrame, plan: Plan) -> DataFrame:
    """Both children of every large bucket: each splits on the next token of its place in the run's tree."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = plan.order(np.arange(plan.runs))
        for batch in batches:
            sketch = _matrix(batch.column("sketch"))
            node, spot = batch.column("node").to_numpy().view(np.uint64), batch.column("spot").to_numpy()
            for child in (1, 2):
                place = (spot % 64) * 2 + child
                run = spot // 64
                value = sketch[np.arange(len(node)), order[run, place % plan.coordinates]].astype(np.uint64)
                inner = mixed(node + mixed(value + (place.astype(np.uint64) << np.uint64(33))))
                yield pa.RecordBatch.from_arrays([pa.array(inner.view(np.int64)), batch.column("rep"), pa.array((run * 64 + place).astype(np.int32)), batch.column("sketch"), batch.column("rows")], ["node", "rep", "spot", "sketch", "parent_rows"])

    return rows.select("node", "rep", "spot", "sketch", "rows").mapInArrow(split, "node long, rep binary, spot int, sketch binary, parent_rows long")


def _small_buckets(rows: DataFrame, plan: Plan) -> DataFrame:
    """One edge to a near set's root for each row of a small bucket whose sketch agrees with another's."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, bounds in whole_groups(batches, "node"):
            sketch, size = _matrix(group.column("sketch")), group.column("size").to_numpy()
            rep, found = group.column("rep").combine_chunks(), []
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if b - a < 2:
                    continue
                s, n = sketch[a:b], size[a:b]
                near = (s[:, None, :] == s[None, :, :]).sum(2) >= plan.agreement
                near &= np.minimum(n[:, None], n[None, :]) >= plan.threshold * np.maximum(n[:, None], n[None, :]) - 1e-9
                np.fill_diagonal(near, False)
                busy = np.flatnonzero(near.any(1))
                if len(busy):
                    found.append((a + busy, a + _labels(near)[busy]))
            if found:
                at, to = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([rep.take(pa.array(at)), rep.take(pa.array(to))], ["u", "v"])

    return together(rows, "node").mapInArrow(compare, "u binary, v binary")


def candidates(distinct: DataFrame, plan: Plan) -> DataFrame:
    """Edges that join every two sets that may be near into one candidate cluster.

    Every run splits all sets by one shared token; buckets that are still large split again, along two more tokens each.
    A small bucket's sets are compared by their sketches.  A bucket that keeps seven tenths of its parent is dense: its sets
    are near each other, so all go to one cluster without comparing.  Only (bucket, set) rows move until a bucket is ready;
    buckets of single sets end at once and equal buckets of several runs are handled once.
    """
    scratch = Scratch(distinct.sparkSession, "buckets")
    level = scratch.put(_roots(distinct, plan).withColumn("parent_rows", F.lit(None).cast("long")))
    ready = []
    for depth in range(1, plan.depth + 1):
        sizes = level.groupBy("node").agg(F.count(F.lit(1)).alias("rows"), F.bit_xor(F.xxhash64("rep")).alias("who"), F.max("parent_rows").alias("parent")).where("rows > 1")
        dense = F.lit(depth == plan.depth) | F.coalesce(F.col("rows") >= 0.7 * F.col("parent"), F.lit(False))
        sizes = sizes.withColumn("kind", F.when(F.col("rows") <= plan.small, "small").when(dense, "dense").otherwise("large"))
        # buckets of equal sets, ready ones once; large ones, with their number as a part of the key, all
        alone = F.when(F.col("kind") == "large", F.col("node"))
        named = sizes.groupBy("rows", "who", "kind", alone.alias("alone")).agg(F.min("node").alias("node")).select("node", "kind", "rows")
        rows = scratch.put(level.drop("parent_rows").join(named, "node"), size_of(level))
        ready.append(rows.where("kind <> 'large'").select("node", "rep", "kind"))
        large = rows.where("kind = 'large'")
        if depth == plan.depth or not large.limit(1).count():
            break
        if "sketch" not in large.columns:
            large = large.join(distinct.select("rep", "sketch"), "rep")
        level = scratch.put(_children(large, plan), size_of(rows) + size_of(distinct))
    ready = reduce(DataFrame.unionByName, ready)
    heart = ready.where("kind = 'dense'").groupBy("node").agg(F.min("rep").alias("v"))
    crowded = ready.where("kind = 'dense'").join(heart, "node").select(F.col("rep").alias("u"), "v")
    small = ready.where("kind = 'small'").select("node", "rep").join(distinct.select("rep", "size", "sketch"), "rep")
    return crowded.unionByName(_small_buckets(small, plan))


def _verified(sets: DataFrame, threshold: float) -> DataFrame:
    """Exact links within each tile pair: ``rep``, ``root`` (an edge of the links' component) and ``n_links``."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, bounds in whole_groups(batches, "cell"):
            tile_a, tile_b, own, weight = (group.column(c).to_numpy() for c in ("tile_a", "tile_b", "tile_own", "n"))
            rep = group.column("rep").combine_chunks()
            held, found = group.column("shingles").combine_chunks(), []
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                names = rep.slice(a, b - a).to_pylist()
                pick = np.array([a + i for i, x in enumerate(names) if not i or x != names[i - 1]])
                if len(pick) < 2:
                    continue
                sets_here = [np.frombuffer(held[int(i)].as_buffer(), np.uint64) for i in pick]
                near = near_pairs(sets_here, threshold)
                if tile_a[a] != tile_b[a]:
                    near &= own[pick][:, None] != own[pick][None, :]
                i, j = np.nonzero(near)
                if len(i):
                    busy = np.unique(i)
                    count = np.bincount(i, weight[pick][j], len(pick)).astype(np.int64)
                    found.append((pick[busy], pick[_labels(near)[busy]], count[busy]))
            if found:
                at, to, count = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([rep.take(pa.array(at)), rep.take(pa.array(to)), pa.array(count)], ["rep", "root", "n_links"])
        give_back()

    return sets.mapInArrow(verify, "rep binary, root binary, n_links long")


def near_pairs(sets: list[np.ndarray], threshold: float, columns: int = 8192) -> np.ndarray:
    """Which pairs of sorted distinct arrays have a Jaccard similarity of ``threshold`` or more, exactly."""
    sizes = np.array([len(s) for s in sets])
    values, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    shared = count[inverse] > 1
    rank = np.cumsum(count > 1) - 1
    column, owner = rank[inverse[shared]], owner[shared]
    both = np.zeros((len(sets), len(sets)), np.float64)
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    for low in range(0, int(rank[-1]) + 1 if len(rank) else 0, columns):
        a, b = np.searchsorted(column, (low, low + columns))
        block = np.zeros((len(sets), columns), np.float32)
        block[owner[a:b], column[a:b] - low] = 1
        both += block @ block.T
    union = sizes[:, None] + sizes[None, :] - both
    near = both / np.maximum(union, 1) >= threshold
    np.fill_diagonal(near, False)
    return near


def jaccard_classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, threshold: float = 0.8, recall: float = 0.999999, tile: int = 256) -> DataFrame:
    """Links of Jaccard similarity ``threshold`` or more between the texts' sets of ``shingle``-word shingles.

    Words are runs of ASCII letters and digits and of any other characters, A-Z as a-z; a text of fewer words than
    ``shingle`` is one shingle.  Returns one row for each row of ``docs``: ``id``, ``class_id`` (smallest id in the connected
    component of links, its own included), ``n_links`` (other rows directly linked, equal texts too), ``kept`` and ``mark``
    (``xxhash64`` of the text, null for a null text), which tells rows of equal ids apart.

    Equal sets are taken once, with their number.  Candidate clusters come from the chosen-path recursion (``candidates``),
    whose runs are as many as ``recall`` asks of independent ones (``Plan.of`` says what that comes to); within a cluster every pair is then
    verified on the exact sets, in tiles of bounded size, so no list of pairs is made and no group is one task's.  Whole
    texts move once, and only those of clusters are turned into sets again.

    Null texts and texts with no word have no set and link with nothing.  Repeated rows link with each other; rows with null
    ids keep a row, ids being left out of the minimum where null.  An empty table gives no row; other columns are ignored.
    """
    with small_batches(docs.sparkSession):
        return _classes(docs, id_col, text_col, shingle, threshold, recall, tile)


def _classes(docs: DataFrame, id_col: str, text_col: str, shingle: int, threshold: float, recall: float, tile: int) -> DataFrame:
    plan = Plan.of(threshold, recall)
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    table = written(_sketches(rows.withColumn("mark", F.when(F.col("text").isNotNull(), F.xxhash64("text"))), plan, shingle, id_type), "sketches")
    distinct = written(table.where(F.col("rep").isNotNull()).groupBy("rep", "size", "sketch").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("low")), "distinct-sets", size_of(table))
    clusters = components(candidates(distinct, plan), "candidate-clusters", within=size_of(distinct)).select(F.col("node").alias("rep"), F.col("component").alias("cluster"))
    needed = distinct.select("rep", "n", "low", "size").join(clusters, "rep")
    source = rows.join(needed, rows["id"].eqNullSafe(needed["low"])).select("text", "rep", "n", "cluster")

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in light_slices(batch, "text", 500):
                flat, counts = shingle_sets(part.column("text"), shingle)
                ends = np.cumsum(counts)
                same = np.array([x == y for x, y in zip(_digests(flat, counts), part.column("rep").to_pylist(), strict=True)], bool)
                own = [flat[e - n : e].tobytes() for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
                out = pa.RecordBatch.from_arrays([part.column("cluster"), part.column("rep"), part.column("n"), pa.array(counts), pa.array(own, pa.binary())], ["cluster", "rep", "n", "size", "shingles"])
                yield out.filter(pa.array(same))
        give_back()

    sets = written(source.mapInArrow(again, "cluster binary, rep binary, n long, size long, shingles binary"), "cluster-sets")
    dealt = tiled(sets, "cluster", "rep", tile, "size", 400_000).select("cell", "tile_a", "tile_b", "tile_own", "rep", "n", "shingles")
    links = written(_verified(together(dealt, "cell", "rep"), threshold), "jaccard-links")
    groups = components(links.select(F.col("rep").alias("u"), F.col("root").alias("v")), "jaccard-components", within=size_of(links)).withColumnRenamed("node", "rep")
    counted = links.groupBy("rep").agg(F.sum("n_links").alias("others"))
    labelled = distinct.select("rep", "n", "low").join(counted, "rep", "left").join(groups, "rep", "left")
    labelled = written(labelled.select("rep", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("links"), F.coalesce("component", "rep").alias("component"), "low"), "jaccard-classes", size_of(distinct))
    lows = labelled.groupBy("component").agg(F.min("low").alias("class_id"))
    classes = labelled.join(lows, "component").select("rep", "links", "class_id")
    out = table.select("id", "mark", "rep").join(classes, "rep", "left")
    return out.select("id", "mark", F.when(F.col("rep").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("links", F.lit(0)).alias("n_links")).withColumn("kept", F.coalesce(F.col("id") == F.col("class_id"), F.lit(False)))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all columns, of which one document of each class stays: the one with the smallest id.

    Rows equal in id and text are one document.  Documents with null ids stay unless their class has a member with an id.
    """
    verdicts = jaccard_classes(docs, id_col=id_col, text_col=text_col, **options)
    stays = F.col("kept") | (F.col("id").isNull() & F.col("class_id").isNull())
    chosen = verdicts.where(stays).groupBy(F.col("id").alias("_id"), F.col("mark").alias("_mark")).agg(F.count(F.lit(1)).alias("_copies"))
    mark = F.when(F.col(text_col).isNotNull(), F.xxhash64(F.col(text_col).cast("string")))
    joined = docs.withColumn("_own", mark).join(chosen, F.col(id_col).eqNullSafe(F.col("_id")) & F.col("_own").eqNullSafe(F.col("_mark")))
    once = joined.where("_copies = 1").select(*docs.columns)
    return once.unionByName(joined.where("_copies > 1").select(*docs.columns).dropDuplicates([id_col, text_col]))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), p AS (
  SELECT doc_id, w, unnest(range(1, CAST(greatest(len(w) - 4, 1) + 1 AS BIGINT))) AS p FROM w WHERE len(w) > 0
), s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, p, p + 4), ' ') AS g FROM p
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
), link AS (
  SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE CAST(k AS DOUBLE) / (x.n + y.n - k) >= 0.8
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a
), class AS (
  SELECT a AS doc_id, min(b) AS class_id FROM reach GROUP BY a
), degree AS (
  SELECT a AS doc_id, count(*) AS n_links FROM link GROUP BY a
)
SELECT d.doc_id, class_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, d.doc_id = class_id AS kept
FROM documents d LEFT JOIN class USING (doc_id) LEFT JOIN degree USING (doc_id)
"""
