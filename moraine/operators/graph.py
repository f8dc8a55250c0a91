"""Networks of epochs, clusters of pixels, flow trees: operators that need rounds or small dense solves."""

from __future__ import annotations

import heapq
import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one is set only where that is unset and Spark is local."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        place = f"file://{tempfile.gettempdir()}/moraine-{uuid.uuid4().hex}"
        spark.conf.set("spark.checkpoint.dir", place)
        spark.sparkContext.setCheckpointDir(place)
    return place


def checkpointed(df: DataFrame) -> DataFrame:
    """Lineage cut in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def connected_components(edges: DataFrame, a: str, b: str, nodes: DataFrame | None = None, rounds: int = 200) -> DataFrame:
    """``node`` and ``component`` (its smallest node).  Labels take the least of their neighbours', then of their label's label,
    so a round more than halves most distances; stops when a round changes nothing."""
    both = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).unionByName(edges.select(F.col(b).alias("x"), F.col(a).alias("y"))).distinct()
    both = checkpointed(both)
    start = both.select(F.col("x").alias("node"))
    if nodes is not None:
        start = start.unionByName(nodes.select(F.col(nodes.columns[0]).alias("node")))
    labels = checkpointed(start.distinct().withColumn("component", F.col("node")))
    for _ in range(rounds):
        near = both.join(labels, both["y"] == labels["node"]).groupBy(F.col("x").alias("node")).agg(F.min("component").alias("near"))
        moved = labels.join(near, "node", "left").select("node", F.col("component").alias("was"), F.least("component", F.coalesce("near", "component")).alias("component"))
        jump = moved.select(F.col("node").alias("component"), F.col("component").alias("further"))
        after = checkpointed(moved.join(jump, "component", "left").select("node", "was", F.coalesce("further", "component").alias("component")))
        changed = after.where("component <> was").limit(1).count()
        labels = after.select("node", "component")
        if not changed:
            return labels
    raise RuntimeError(f"labels did not settle in {rounds} rounds")


def redundancy(pairs: DataFrame, keys: list[str], ref: str, sec: str, labels: DataFrame) -> DataFrame:
    """Per component: epochs, pairs, and pairs beyond a tree's."""
    joined = pairs.join(labels, pairs[ref] == labels["node"])
    epochs = joined.select(*keys, "component", F.explode(F.array(ref, sec)).alias("e")).groupBy(*keys, "component").agg(F.count_distinct("e").alias("epochs"), F.min("e").alias("first_epoch"))
    n = joined.groupBy(*keys, "component").agg(F.count(F.lit(1)).alias("pairs"))
    return epochs.join(n, [*keys, "component"]).withColumn("redundancy", F.col("pairs") - (F.col("epochs") - 1))


def solve_network(pdf: pd.DataFrame) -> dict:
    """Least squares displacement at each epoch of one connected network, the first fixed at zero, and its linear rate."""
    known = pdf[pdf["value"].notna()]
    epochs = sorted({*pdf["ref"], *pdf["sec"]})
    out = {"epochs": epochs, "n_pairs": len(known), "rate": np.nan, "rate_error": np.nan, "dof": None, "sigma": np.nan}
    if not len(known) or len(epochs) < 2:
        return out
    place = {e: i for i, e in enumerate(epochs)}
    design = np.zeros((len(known), len(epochs)))
    rows = np.arange(len(known))
    design[rows, known["sec"].map(place)] += 1
    design[rows, known["ref"].map(place)] -= 1
    design, observed = design[:, 1:], known["value"].to_numpy(float)
    found = np.linalg.lstsq(design, observed, rcond=None)[0]
    left = design @ found - observed
    dof = len(known) - (len(epochs) - 1)
    errors = np.full(len(epochs), np.nan)
    if dof > 0:
        out["sigma"] = float(np.sqrt((left**2).sum() / dof))
        normal = design.T @ design
        if np.linalg.matrix_rank(normal) == len(normal):
            errors = np.concatenate(([0.0], out["sigma"] * np.sqrt(np.diag(np.linalg.inv(normal)))))
    total = np.concatenate(([0.0], found))
    if len(epochs) >= 3:
        days = np.array([(e - epochs[0]).days for e in epochs], float)
        about = days - days.mean()
        out["rate"] = float(about @ total / (about @ about))
        off = total - total.mean() - out["rate"] * about
        out["rate_error"] = float(np.sqrt(off @ off / (len(days) - 2) / (about @ about)))
    return out | {"cumulative": total, "errors": errors, "dof": dof, "rms": float(np.sqrt((left**2).mean()))}


def invert_network(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Displacement and error at every epoch of each network (``ref``, ``sec``, ``value``; keys name one component each).

    A network is a few dozen epochs, so its dense solve is one group's; without redundancy errors are NULL, not zero.
    """
    types = dict(pairs.dtypes)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        r = solve_network(pdf)
        n = len(r["epochs"])
        names = {k: [pdf[k].iloc[0]] * n for k in keys}
        return pd.DataFrame(names | {"epoch": r["epochs"], "cumulative": r.get("cumulative", [None] * n), "error": r.get("errors", [None] * n), "dof": [r["dof"]] * n, "rate": [r["rate"]] * n, "rate_error": [r["rate_error"]] * n, "sigma": [r["sigma"]] * n})

    return pairs.groupBy(*keys).applyInPandas(solve, ", ".join([*(f"`{k}` {types[k]}" for k in keys), f"epoch {types['ref']}, cumulative double, error double, dof int, rate double, rate_error double, sigma double"]))


def _parts(pairs: list[tuple]) -> int:
    parent: dict = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[root(a)] = root(b)
    return sum(root(x) == x for x in list(parent))


def jackknife(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Rate of each network with each pair left out in turn.

    Fewer than four pairs give no row.  A pair whose loss splits the network is load-bearing and no data point; a network of
    such pairs only is not testable.  Robust means that all refits agree in sign.
    """
    types = dict(pairs.dtypes)
    columns = ["n_pairs", "rate", "low", "high", "load_bearing", "sign_flips", "testable", "robust"]

    def leave_out(pdf: pd.DataFrame) -> pd.DataFrame:
        known = pdf[pdf["value"].notna()].reset_index(drop=True)
        full = solve_network(known)["rate"] if len(known) >= 4 else np.nan
        if not np.isfinite(full):
            return pd.DataFrame(columns=[*keys, *columns])
        ends = list(zip(known["ref"], known["sec"], strict=True))
        whole, bearing, rates = _parts(ends), 0, []
        for i in range(len(known)):
            if _parts(ends[:i] + ends[i + 1 :]) > whole:
                bearing += 1
                continue
            rate = solve_network(known.drop(index=i))["rate"]
            if np.isfinite(rate):
                rates.append(rate)
        row = [*(pdf[k].iloc[0] for k in keys), len(known), full, min(rates, default=None), max(rates, default=None), bearing, sum(r * full < 0 for r in rates), bool(rates), bool(rates) and min(rates) * max(rates) > 0]
        return pd.DataFrame([row], columns=[*keys, *columns])

    return pairs.groupBy(*keys).applyInPandas(leave_out, ", ".join([*(f"`{k}` {types[k]}" for k in keys), "n_pairs int, rate double, low double, high double, load_bearing int, sign_flips int, testable boolean, robust boolean"]))


def neighbours(spark: SparkSession, diagonal: bool = True) -> DataFrame:
    """Offsets to a cell's neighbours, in the order that breaks ties: a table of four or eight rows."""
    steps = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i, j) != (0, 0) and (diagonal or 0 in (i, j))]
    return spark.createDataFrame([(k, i, j) for k, (i, j) in enumerate(steps)], "step int, di int, dj int")


def grid_edges(cells: DataFrame, diagonal: bool = True) -> DataFrame:
    """Edges (a, b) between neighbouring cells of a mask; cells are numbered by row and column."""
    number = (F.col("row").cast("long") * (1 << 31) + F.col("col")).alias("id")
    own = cells.select("row", "col", number)
    forward = neighbours(cells.sparkSession, diagonal).where("di > 0 OR (di = 0 AND dj > 0)")
    moved = own.crossJoin(F.broadcast(forward)).select(F.col("id").alias("a"), (F.col("row") + F.col("di")).alias("row"), (F.col("col") + F.col("dj")).alias("col"))
    return moved.join(own, ["row", "col"]).select("a", F.col("id").alias("b"))


def clusters(cells: DataFrame, least: int = 1, diagonal: bool = True) -> DataFrame:
    """Cells with ``cluster`` (1 for the largest; ties in row order) of the connected groups of at least ``least`` cells."""
    from pyspark.sql import Window

    number = F.col("row").cast("long") * (1 << 31) + F.col("col")
    own = cells.withColumn("node", number)
    labels = connected_components(grid_edges(cells, diagonal), "a", "b", own.select("node"))
    sizes = labels.groupBy("component").agg(F.count(F.lit(1)).alias("n_px")).where(F.col("n_px") >= least)
    ranked = sizes.withColumn("cluster", F.row_number().over(Window.orderBy(F.desc("n_px"), "component")))
    return own.join(labels, "node").join(ranked, "component").drop("node", "component")


def grown(mask: DataFrame, row: int, col: int) -> DataFrame:
    """Cells of the mask that touch the seed through others, diagonals too; none if the seed isn't in the mask."""
    number = F.col("row").cast("long") * (1 << 31) + F.col("col")
    labels = connected_components(grid_edges(mask), "a", "b", mask.select(number.alias("node")))
    own = mask.withColumn("node", number).join(labels, "node")
    seed = own.where((F.col("row") == row) & (F.col("col") == col)).select("component")
    return own.join(seed, "component", "left_semi").drop("node", "component")


def _settled(pdf: pd.DataFrame) -> pd.DataFrame:
    """One tile's own cells, each lowered as far as the tile's cells and the rim around them allow, lowest cell first."""
    r0, c0 = pdf["row"].min(), pdf["col"].min()
    shape = (int(pdf["row"].max() - r0) + 3, int(pdf["col"].max() - c0) + 3)
    i, j = (pdf["row"] - r0 + 1).to_numpy(int), (pdf["col"] - c0 + 1).to_numpy(int)
    own = pdf["own"].to_numpy(bool)
    height, level = np.full(shape, np.inf), np.full(shape, np.inf)
    height[i[own], j[own]] = pdf["z"].to_numpy(float)[own]
    level[i, j] = pdf["filled"].to_numpy(float)
    rows, cols = np.nonzero(np.isfinite(level))
    queue = sorted(zip(level[rows, cols].tolist(), rows.tolist(), cols.tolist(), strict=True))
    while queue:
        v, r, c = heapq.heappop(queue)
        if v > level[r, c]:
            continue
        for a in range(max(r - 1, 0), min(r + 2, shape[0])):
            for b in range(max(c - 1, 0), min(c + 2, shape[1])):
                reached = max(height[a, b], v)
                if reached < level[a, b]:
                    level[a, b] = reached
                    heapq.heappush(queue, (reached, a, b))
    out = pdf.loc[own, ["row", "col", "z", "filled"]].rename(columns={"filled": "was"})
    out["filled"] = level[i[own], j[own]]
    return out


def depressions_filled(dem: DataFrame, rounds: int = 10_000, tile: int = 128) -> DataFrame:
    """Cells with ``filled``: the least height over which water leaves the grid.

    Starts from the grid's border at its own height and everything else unbounded.  Every round settles each tile of
    ``tile`` x ``tile`` cells at once, given the levels of the cells around it, until no tile changes; so the rounds follow
    the number of tiles that water crosses, not of cells.  NULL heights are barriers; cells that no path leads out of stay
    NULL.  Levels that still change after ``rounds`` are an error.
    """
    edge = dem.agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"))
    far = F.lit(float("inf"))
    border = (F.col("row") == F.col("r0")) | (F.col("row") == F.col("r1")) | (F.col("col") == F.col("c0")) | (F.col("col") == F.col("c1"))
    known = dem.where(F.col("z").isNotNull() & ~F.isnan("z")).crossJoin(F.broadcast(edge))
    now = checkpointed(known.select("row", "col", F.col("z").cast("double").alias("z"), F.when(border, F.col("z").cast("double")).otherwise(far).alias("filled")))
    types = dict(dem.dtypes)
    at = lambda c, k: F.floor((F.col(c) + k) / tile)
    tiles = F.array_distinct(F.array(*[F.struct(at("row", i).alias("tr"), at("col", j).alias("tc")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    for _ in range(rounds):
        dealt = now.withColumn("_t", F.explode(tiles)).select("row", "col", "z", "filled", F.col("_t.tr").alias("tr"), F.col("_t.tc").alias("tc"))
        dealt = dealt.withColumn("own", (F.col("tr") == at("row", 0)) & (F.col("tc") == at("col", 0))).where(F.col("own") | (F.col("filled") < far))
        after = checkpointed(dealt.groupBy("tr", "tc").applyInPandas(_settled, f"row {types['row']}, col {types['col']}, z double, was double, filled double"))
        changed = after.where("filled < was").limit(1).count()
        now = after.select("row", "col", "z", "filled")
        if not changed:
            return now.withColumn("filled", F.when(F.col("filled") < far, F.col("filled")))
    raise RuntimeError(f"levels did not settle in {rounds} rounds")


def receivers(filled: DataFrame, dx: float, dy: float, height: str = "filled") -> DataFrame:
    """(row, col, to_row, to_col): the neighbour of steepest strictly downward slope, the first in order on a tie.

    Cells on a level have none, so accumulation starts anew there.
    """
    own = filled.where(F.col(height).isNotNull()).select("row", "col", F.col(height).alias("h"))
    steps = neighbours(filled.sparkSession)
    length = F.when(F.col("di") == 0, F.lit(dx)).when(F.col("dj") == 0, F.lit(dy)).otherwise(F.lit(2**0.5 * (dx + dy) / 2))
    moved = own.crossJoin(F.broadcast(steps.withColumn("length", length))).withColumn("to_row", F.col("row") + F.col("di")).withColumn("to_col", F.col("col") + F.col("dj"))
    low = own.select(F.col("row").alias("to_row"), F.col("col").alias("to_col"), F.col("h").alias("to_h"))
    slopes = moved.join(low, ["to_row", "to_col"]).withColumn("slope", (F.col("h") - F.col("to_h")) / F.col("length")).where("slope > 0")
    best = slopes.groupBy("row", "col").agg(F.min_by(F.struct("to_row", "to_col", "slope"), F.struct(-F.col("slope"), F.col("step"))).alias("b"))
    return best.select("row", "col", "b.*")


def upstream_pairs(flow: DataFrame, cells: DataFrame, rounds: int = 10_000) -> DataFrame:
    """(row, col, up_row, up_col) for every cell and each cell that drains through it, itself included.

    Paths double in each round, so a path of n cells takes about log2(n) rounds.
    """
    step = checkpointed(flow.select("row", "col", "to_row", "to_col"))
    total = cells.select("row", "col", F.col("row").alias("up_row"), F.col("col").alias("up_col")).unionByName(step.select(F.col("to_row").alias("row"), F.col("to_col").alias("col"), F.col("row").alias("up_row"), F.col("col").alias("up_col")))
    total = checkpointed(total)
    hop = step
    for _ in range(rounds):
        # hop leads 2^k cells down; everything below a hop's end gains what the hop's start carries
        later = hop.select(F.col("row").alias("to_row"), F.col("col").alias("to_col"), F.col("to_row").alias("end_row"), F.col("to_col").alias("end_col"))
        hop = checkpointed(hop.join(later, ["to_row", "to_col"]).select("row", "col", F.col("end_row").alias("to_row"), F.col("end_col").alias("to_col")))
        if not hop.limit(1).count():
            return total
        carried = hop.join(total, ["row", "col"]).select(F.col("to_row").alias("row"), F.col("to_col").alias("col"), "up_row", "up_col")
        total = checkpointed(total.unionByName(carried).distinct())
    raise RuntimeError("flow did not settle: is it free of cycles?")


def flow_accumulation(flow: DataFrame, cells: DataFrame) -> DataFrame:
    """Number of cells that drain through each cell, itself included.

    Leaf cells are peeled off level by level and hand on their sums, so only (cell, sum) rows move.
    """
    pending = checkpointed(cells.select("row", "col").distinct().withColumn("acc", F.lit(1).cast("long")))
    links, done = checkpointed(flow.select("row", "col", "to_row", "to_col")), None
    while True:
        targets = links.select(F.col("to_row").alias("row"), F.col("to_col").alias("col")).distinct()
        leaves = checkpointed(pending.join(targets, ["row", "col"], "left_anti"))
        done = leaves if done is None else done.unionByName(leaves)
        if not links.limit(1).count():
            return done
        handed = leaves.join(links, ["row", "col"]).groupBy(F.col("to_row").alias("row"), F.col("to_col").alias("col")).agg(F.sum("acc").alias("more"))
        rest = pending.join(leaves.select("row", "col"), ["row", "col"], "left_anti").join(handed, ["row", "col"], "left")
        pending = checkpointed(rest.select("row", "col", (F.col("acc") + F.coalesce("more", F.lit(0))).alias("acc")))
        links = checkpointed(links.join(leaves.select("row", "col"), ["row", "col"], "left_anti"))
        done = checkpointed(done)
