"""Neighbour graphs and what is computed on them, as edge tables ``(src, dst, weight)``."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.krylov import leading_eigenpairs, signed
from .stats import scalar

BLOCK = 2048
#: Blocks from which on they are four times as large, as each point is sent to all blocks twice.
FEW_BLOCKS = 8


def in_one_task(df: DataFrame, kernel, schema: str, most: int) -> DataFrame:
    """Run a function of one Arrow table, for algorithms that are sequential.

    The task is sent ``most`` rows and one at the utmost, whatever the size of the table; with more than ``most`` the job fails
    before the function runs.
    """

    def checked(t: pa.Table) -> pa.Table:
        if t.num_rows > most:
            raise ValueError(f"more than {most} rows")
        return kernel(t.drop_columns(["_one"]))

    return df.limit(most + 1).withColumn("_one", F.lit(0)).groupBy("_one").applyInArrow(checked, schema)


def kept(df: DataFrame) -> DataFrame:
    """A table that several steps read, computed once: below ``spark.checkpoint.dir``, or with the executors where there is none."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.localCheckpoint()


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """A column of lists of numbers as rows; lists of different lengths are an error."""
    sizes = pc.list_value_length(column)
    if not len(column) or column.null_count or pc.min(sizes) != pc.max(sizes):
        return np.array(column.to_pylist(), np.float64)
    return np.asarray(column.combine_chunks().flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)


#: Edges for each node that a task of a graph is sent at the utmost.
EDGES_A_NODE = 64


# --- neighbours


def _nearest(a: np.ndarray, b: np.ndarray, same: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(places in b, distances) of the k nearest rows of b to each row of a, ties to the first; ``same`` marks those left out.

    Squares of distances come from one matrix product; all within its rounding of the k-th are measured exactly.
    """
    k = min(k, len(b))
    top = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :]
    rough = top - 2 * (a @ b.T)
    rough[same] = np.inf
    cut = np.partition(rough, k - 1, axis=1)[:, k - 1]
    slack = 1e-12 * (1 + a.shape[1]) * top.max(axis=1)
    near = rough <= (cut + slack)[:, None]
    wide = int(near.sum(1).max())
    order = np.argsort(~near, axis=1, kind="stable")[:, :wide]  # the near ones, in the order of b
    exact = np.full(order.shape, np.inf)
    for at in range(0, len(a), max(1, 4_000_000 // max(1, wide * a.shape[1]))):
        part = slice(at, at + max(1, 4_000_000 // max(1, wide * a.shape[1])))
        gaps = a[part, None, :] - b[order[part]]
        exact[part] = np.sqrt((gaps * gaps).sum(2))
    exact[~np.take_along_axis(near, order, 1) | np.take_along_axis(same, order, 1)] = np.inf
    best = np.argsort(exact, axis=1, kind="stable")[:, :k]
    return np.take_along_axis(order, best, 1), np.take_along_axis(exact, best, 1)


def knn(points: DataFrame, n_neighbors: int = 15, vec: str = "vec") -> DataFrame:
    """``(src, rank, dst, dist)``: each point's ``n_neighbors - 1`` nearest others by Euclidean distance, ties by smaller id.

    Exact, as a nested loop over pairs of blocks: a task holds two blocks and keeps each query's nearest of one of them; the
    few that are left per query and block are ranked.
    """
    if n_neighbors < 2:
        raise ValueError("n_neighbors has to be 2 or more")
    k = n_neighbors - 1
    n = points.count()
    blocks = max(1, min(-(-n // BLOCK), FEW_BLOCKS), -(-n // (4 * BLOCK)))
    named = points.select("cell_id", F.col(vec).cast("array<double>").alias("vec")).withColumn("own", F.pmod(F.xxhash64("cell_id"), F.lit(blocks)).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    queries = named.withColumn("other", every).select("cell_id", "vec", F.col("own").alias("q"), F.col("other").alias("d"), F.lit(True).alias("asks"))
    data = named.withColumn("other", every).select("cell_id", "vec", F.col("other").alias("q"), F.col("own").alias("d"), F.lit(False).alias("asks"))

    def nearest(t: pa.Table) -> pa.Table:
        ids, v = np.array(t.column("cell_id").to_pylist(), np.int64), matrix(t.column("vec"))
        asks = np.array(t.column("asks").to_pylist(), bool)
        a, b = np.flatnonzero(asks), np.flatnonzero(~asks)
        b = b[np.argsort(ids[b], kind="stable")]
        src, dst, dist = [], [], []
        step = max(1, 4_000_000 // max(1, len(b)))
        for at in range(0, len(a), step):
            part = a[at : at + step]
            order, got = _nearest(v[part], v[b], ids[part][:, None] == ids[b][None, :], k)
            ok = np.isfinite(got)
            src.append(np.repeat(ids[part], ok.sum(1)))
            dst.append(ids[b][order][ok])
            dist.append(got[ok])
        cat = lambda x, kind: np.concatenate(x) if x else np.empty(0, kind)
        return pa.table({"src": cat(src, np.int64), "dst": cat(dst, np.int64), "dist": cat(dist, np.float64)})

    found = queries.unionByName(data).groupBy("q", "d").applyInArrow(nearest, "src long, dst long, dist double")
    rank = F.row_number().over(Window.partitionBy("src").orderBy("dist", "dst"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("src", "rank", "dst", "dist")


def smooth_distances(graph: DataFrame, n_neighbors: int) -> DataFrame:
    """``(src, rho, sigma)``: the first positive distance, and the width at which the memberships sum to log2(n_neighbors).

    64 halvings in one expression per row; a width is at least a thousandth of the row's mean distance, or of the mean of all
    where the first distance is 0.
    """
    rows = graph.groupBy("src").agg(F.sort_array(F.collect_list("dist")).alias("d"))  # n_neighbors - 1 values
    mean_all = scalar(graph.agg((F.sum("dist") / F.count_distinct("src") / n_neighbors).alias("mean_all")))
    rho = F.coalesce(F.array_min(F.filter("d", lambda x: x > 0)), F.lit(0.0))
    rows = rows.withColumn("rho", rho).crossJoin(mean_all)
    target = float(np.log2(n_neighbors))

    def step(s: Column, _: Column) -> Column:
        total = F.aggregate("d", F.lit(0.0), lambda acc, x: acc + F.exp(-F.greatest(x - F.col("rho"), F.lit(0.0)) / s["mid"]))
        high = total > target
        lo, hi = F.when(high, s["lo"]).otherwise(s["mid"]), F.when(high, s["mid"]).otherwise(s["hi"])
        mid = F.when(hi == float("inf"), s["mid"] * 2).otherwise((lo + hi) / 2)
        done = s["done"] | (F.abs(total - target) < 1e-5)
        keep = lambda old, new: F.when(done, old).otherwise(new)
        return F.struct(keep(s["lo"], lo).alias("lo"), keep(s["hi"], hi).alias("hi"), keep(s["mid"], mid).alias("mid"), done.alias("done"))

    start = F.struct(F.lit(0.0).alias("lo"), F.lit(float("inf")).alias("hi"), F.lit(1.0).alias("mid"), F.lit(False).alias("done"))
    sigma = F.aggregate(F.sequence(F.lit(1), F.lit(64)), start, step)["mid"]
    mean_row = F.aggregate("d", F.lit(0.0), lambda acc, x: acc + x) / n_neighbors
    floor = 1e-3 * F.when(F.col("rho") > 0, mean_row).otherwise(F.col("mean_all"))
    return rows.withColumn("sigma", sigma).select("src", "rho", F.greatest("sigma", floor).alias("sigma"))


def connectivities(graph: DataFrame, n_neighbors: int = 15) -> DataFrame:
    """The fuzzy union ``a + a' - a a'`` of the neighbourhoods' memberships; zeros are left out. The neighbours, which several
    steps need, are found once, when this is called."""
    graph = kept(graph)
    met = graph.join(smooth_distances(graph, n_neighbors), "src")
    w = F.when((F.col("dist") <= F.col("rho")) | (F.col("sigma") == 0), F.lit(1.0)).otherwise(F.exp(-(F.col("dist") - F.col("rho")) / F.col("sigma")))
    own = met.select("src", "dst", w.alias("w")).where("w > 0")
    both = own.unionByName(own.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    a, b = F.max("w"), F.min("w")
    joined = both.groupBy("src", "dst").agg(F.count("*").alias("n"), a.alias("a"), b.alias("b"))
    return joined.select("src", "dst", F.when(F.col("n") == 1, F.col("a")).otherwise(F.col("a") + F.col("b") - F.col("a") * F.col("b")).alias("weight"))


def symmetrised(graph: DataFrame) -> DataFrame:
    """(A + A') / 2."""
    half = graph.select("src", "dst", (F.col("weight") / 2).alias("weight"))
    return half.unionByName(half.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


# --- partitions and groups


def modularity(graph: DataFrame, labels: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row ``modularity`` of a partition ``(cell_id, label)`` on the symmetrised graph."""
    a = labels.select(F.col("cell_id").alias("src"), F.col("label").alias("la"))
    b = labels.select(F.col("cell_id").alias("dst"), F.col("label").alias("lb"))
    e = graph.join(a, "src").join(b, "dst")
    inside = e.groupBy("la").agg(F.sum("weight").alias("k"), F.sum(F.when(F.col("la") == F.col("lb"), F.col("weight")).otherwise(0.0)).alias("inside"))
    into = e.groupBy("lb").agg(F.sum("weight").alias("kin"))
    per = inside.join(into, F.col("la") == F.col("lb"), "full").select(((F.coalesce("k", F.lit(0.0)) + F.coalesce("kin", F.lit(0.0))) / 2).alias("k"), F.coalesce("inside", F.lit(0.0)).alias("inside"))
    return per.agg(F.sum("k").alias("m2"), F.sum("inside").alias("s"), F.sum(F.col("k") * F.col("k")).alias("kk")).select((F.try_divide("s", "m2") - resolution * F.try_divide(F.col("kk"), F.col("m2") * F.col("m2"))).alias("modularity"))


def paga(graph: DataFrame, labels: DataFrame) -> DataFrame:
    """``(g1, g2, connectivity)`` of groups with edges between them: edges seen over those expected, at most 1.

    Stored entries count, also those of weight 0; each ordered pair of groups has a row.
    """
    sizes = labels.groupBy("label").agg(F.count("*").alias("n"))
    a = labels.select(F.col("cell_id").alias("src"), F.col("label").alias("g1"))
    b = labels.select(F.col("cell_id").alias("dst"), F.col("label").alias("g2"))
    between = graph.join(a, "src").join(b, "dst").groupBy("g1", "g2").agg(F.count("*").alias("c"))
    out = between.groupBy("g1").agg(F.sum("c").alias("e")).withColumnRenamed("g1", "label")
    facts = sizes.join(out, "label", "left").fillna(0, ["e"])
    crossing = between.where("g1 <> g2")
    both = crossing.unionByName(crossing.select(F.col("g2").alias("g1"), F.col("g1").alias("g2"), "c")).groupBy("g1", "g2").agg(F.sum("c").alias("seen"))
    total = scalar(sizes.agg(F.sum("n").alias("total")))
    i, j = (facts.select(F.col("label").alias(g), F.col("n").alias(f"n_{g}"), F.col("e").alias(f"e_{g}")) for g in ("g1", "g2"))
    met = both.join(F.broadcast(i), "g1").join(F.broadcast(j), "g2").crossJoin(total)
    expected = (F.col("e_g1") * F.col("n_g2") + F.col("e_g2") * F.col("n_g1")) / (F.col("total") - 1)
    return met.select("g1", "g2", F.least(F.col("seen") / expected, F.lit(1.0)).alias("connectivity"))


def spanning_forest(table: DataFrame, most: int = 3_000) -> DataFrame:
    """``(g1, g2, connectivity)``: a maximum spanning forest of a PAGA table, each edge once with g1 < g2."""
    if table.select("g1").union(table.select("g2")).distinct().limit(most + 1).count() > most:
        raise ValueError(f"more than {most} groups")
    rows = table.where("g1 < g2").orderBy(F.desc("connectivity"), "g1", "g2").collect()
    names = {x for r in rows for x in r[:2]}
    root = {x: x for x in names}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    kept = []
    for g1, g2, c in rows:
        a, b = find(g1), find(g2)
        if a != b:
            root[a] = b
            kept.append((g1, g2, c))
    return table.sparkSession.createDataFrame(kept, table.select("g1", "g2", "connectivity").schema)


# --- autocorrelation


def _products_over_edges(graph: DataFrame, x: DataFrame) -> DataFrame:
    """``(gene_id, xx)``: sums over edges of the weight times the values at both ends. An edge meets its ends' entries as two
    lists, so it is one row however many features there are; tasks add up per feature."""
    cells = x.groupBy("cell_id").agg(F.array_sort(F.collect_list(F.struct("gene_id", "value"))).alias("e"))
    cells = cells.select("cell_id", F.col("e.gene_id").alias("g"), F.col("e.value").alias("v"))
    ends = graph.join(cells.select(F.col("cell_id").alias("src"), F.col("g").alias("ga"), F.col("v").alias("va")), "src").join(cells.select(F.col("cell_id").alias("dst"), F.col("g").alias("gb"), F.col("v").alias("vb")), "dst")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        genes, sums = np.empty(0, np.int64), np.empty(0)
        for batch in batches:
            weight = batch.column(0).to_numpy(zero_copy_only=False)
            lists = []
            for g, v in ((1, 2), (3, 4)):
                sizes = pc.list_value_length(batch.column(g)).to_numpy(zero_copy_only=False).astype(np.int64)
                lists.append((np.repeat(np.arange(len(sizes)), sizes), batch.column(g).flatten().to_numpy(), batch.column(v).flatten().to_numpy(zero_copy_only=False)))
            named, place = np.unique(np.concatenate([lists[0][1], lists[1][1]]), return_inverse=True)
            n, m = len(named), len(lists[0][1])
            a, b = lists[0][0] * n + place[:m], lists[1][0] * n + place[m:]  # increasing: by edge, then by feature
            at = np.searchsorted(b, a)
            both = np.flatnonzero(np.append(b, -1)[at] == a)
            part = np.bincount(place[:m][both], weight[lists[0][0][both]] * lists[0][2][both] * lists[1][2][at[both]], n)
            merged = np.union1d(genes, named)
            total = np.zeros(len(merged))
            total[np.searchsorted(merged, genes)] = sums
            total[np.searchsorted(merged, named)] += part
            genes, sums = merged, total
        yield pa.RecordBatch.from_arrays([pa.array(genes, pa.int64()), pa.array(sums, pa.float64())], names=["gene_id", "xx"])

    return ends.select("weight", "ga", "va", "gb", "vb").mapInArrow(work, "gene_id long, xx double").groupBy("gene_id").agg(F.sum("xx").alias("xx"))


def _autocorrelation(graph: DataFrame, x: DataFrame, obs: DataFrame) -> DataFrame:
    """Per feature: n, W, sum of squares about the mean, z'Gz and the degree-weighted squares, from stored entries alone."""
    n = scalar(obs.agg(F.count("*").alias("n")))
    total = scalar(graph.agg(F.when(F.sum("weight") > 0, F.sum("weight")).otherwise(F.raise_error(F.lit("the graph has no weight")).cast("double")).alias("W")))
    half = graph.select(F.col("src").alias("cell_id"), "weight").unionByName(graph.select(F.col("dst").alias("cell_id"), "weight"))
    degree = half.groupBy("cell_id").agg(F.sum("weight").alias("deg"))
    per = x.join(degree, "cell_id", "left").fillna(0.0, ["deg"]).groupBy("gene_id").agg(
        F.sum("value").alias("s1"), F.sum(F.col("value") * F.col("value")).alias("s2"), F.sum(F.col("value") * F.col("deg")).alias("d1"), F.sum(F.col("value") * F.col("value") * F.col("deg")).alias("d2")
    )
    cross = _products_over_edges(graph, x)
    met = per.join(cross, "gene_id", "left").fillna(0.0, ["xx"]).crossJoin(n).crossJoin(total).withColumn("m", F.col("s1") / F.col("n"))
    m = F.col("m")
    return met.select(
        "gene_id", "n", "W", (F.col("s2") - F.col("n") * m * m).alias("zz"), (F.col("xx") - m * F.col("d1") + m * m * F.col("W")).alias("zgz"),
        (F.col("d2") - 2 * m * F.col("d1") + 2 * m * m * F.col("W")).alias("dzz"), (F.col("s2") * 1e-14).alias("small"),
    )


def morans_i(graph: DataFrame, x: DataFrame, obs: DataFrame) -> DataFrame:
    """``(gene_id, morans_i)``; NaN for a constant feature."""
    nan = F.lit(float("nan"))
    return _autocorrelation(graph, x, obs).select("gene_id", F.when(F.col("zz") > F.col("small"), F.col("n") / F.col("W") * F.col("zgz") / F.col("zz")).otherwise(nan).alias("morans_i"))


def gearys_c(graph: DataFrame, x: DataFrame, obs: DataFrame) -> DataFrame:
    """``(gene_id, gearys_c)``; NaN for a constant feature."""
    nan = F.lit(float("nan"))
    c = (F.col("n") - 1) * (F.col("dzz") - 2 * F.col("zgz")) / (2 * F.col("W") * F.col("zz"))
    return _autocorrelation(graph, x, obs).select("gene_id", F.when(F.col("zz") > F.col("small"), c).otherwise(nan).alias("gearys_c"))


# --- diffusion


def transitions(graph: DataFrame) -> DataFrame:
    """``(src, dst, weight)`` of the symmetric transition operator with density normalised away. The graph is computed once, when
    this is called."""
    graph = kept(graph)
    q = graph.groupBy("dst").agg(F.sum("weight").alias("q"))
    qi, qj = q.select(F.col("dst").alias("src"), F.col("q").alias("qi")), q.select("dst", F.col("q").alias("qj"))
    k = graph.join(qi, "src").join(qj, "dst").select("src", "dst", (F.col("weight") / F.col("qi") / F.col("qj")).alias("k"))
    z = k.groupBy("dst").agg(F.sqrt(F.sum("k")).alias("z"))
    zi, zj = z.select(F.col("dst").alias("src"), F.col("z").alias("zi")), z.select("dst", F.col("z").alias("zj"))
    return k.join(zi, "src").join(zj, "dst").select("src", "dst", (F.col("k") / F.col("zi") / F.col("zj")).alias("weight"))


def diffmap(graph: DataFrame, n_comps: int = 15, most: int = 200_000, dense: int = 2_000) -> DataFrame:
    """``(cell_id, vec, evals)``: leading eigenvectors of the transition operator by size, the trivial one first.

    One task holds the edges and some hundred vectors, so more than ``most`` nodes or ``EDGES_A_NODE`` times as many edges, a
    disconnected graph, or too many components are errors. Up to ``dense`` nodes the operator is decomposed whole, else its
    products with blocks of vectors are.
    """
    t = transitions(graph)

    def kernel(table: pa.Table) -> pa.Table:
        src, dst = (np.array(table.column(c).to_pylist(), np.int64) for c in ("src", "dst"))
        ids, at = np.unique(np.concatenate([src, dst]), return_inverse=True)
        n = len(ids)
        if n > most:
            raise ValueError(f"more than {most} nodes")
        if n_comps >= n:
            raise ValueError("fewer components than nodes are needed")
        i, j = at[: len(src)], at[len(src) :]
        w = np.array(table.column("weight").to_pylist())
        root = np.arange(n)
        while True:
            low = root.copy()
            np.minimum.at(low, i, root[j])
            np.minimum.at(low, j, root[i])
            low = low[low]
            if (low == root).all():
                break
            root = low
        if root.any():
            raise ValueError("the graph is not connected")
        if n <= dense:
            m = np.zeros((n, n))
            m[i, j] = w
            values, vectors = np.linalg.eigh((m + m.T) / 2)
            top = np.argsort(-np.abs(values))[:n_comps]
            top = top[np.argsort(-values[top])]
            values, vectors = values[top], vectors[:, top]
        else:
            both = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([w, w]) / 2
            order = np.argsort(both[0], kind="stable")
            row, col, weight = (x[order] for x in both)
            first = np.searchsorted(row, np.arange(n))  # connected, so every node has an edge
            times = lambda x: np.stack([np.add.reduceat(weight * c[col], first) for c in np.ascontiguousarray(x.T)], 1)
            values, vectors = leading_eigenpairs(times, n, n_comps, by_size=True, most=max(120, 4 * n_comps))
        v = signed(vectors)
        return pa.table({"cell_id": ids, "vec": pa.array(list(v), pa.list_(pa.float64())), "evals": pa.array([values] * n, pa.list_(pa.float64()))})

    return in_one_task(t, kernel, "cell_id long, vec array<double>, evals array<double>", EDGES_A_NODE * most)


def dpt(diffusion: DataFrame, root: int, n_dcs: int = 10) -> DataFrame:
    """``(cell_id, pseudotime)``: distance from the root in diffusion coordinates weighted by l / (1 - l), scaled to 1."""
    origin = scalar(diffusion.where(F.col("cell_id") == root).select(F.col("vec").alias("o")))
    weight = lambda l: F.when(l >= 0.9994, F.lit(1.0)).otherwise(l / (1 - l))
    k = F.least(F.size("vec"), F.lit(n_dcs))
    terms = F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.pow(weight(F.get("evals", i)) * (F.get("vec", i) - F.get("o", i)), 2))
    d = diffusion.crossJoin(origin).select("cell_id", F.sqrt(F.aggregate(terms, F.lit(0.0), lambda a, b: a + b)).alias("d"))
    most = scalar(d.agg(F.max("d").alias("most")))
    return d.crossJoin(most).select("cell_id", F.when(F.col("most") > 0, F.col("d") / F.col("most")).otherwise(F.lit(0.0)).alias("pseudotime"))


# --- density and trees


#: Points of a block of a kernel density.
DENSE_BLOCK = 8192


def embedding_density(points: DataFrame, group: str | None = None, vec: str = "vec") -> DataFrame:
    """``(cell_id, density)``: Gaussian kernel density with full covariance at each point, scaled to [0, 1] within its group.

    Exact, as a nested loop over pairs of blocks of a group, each pair a task. The work grows with the square of a group.
    """
    g = F.when(F.col(group).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(group).cast("string"))) if group else F.lit("")
    rows = points.select("cell_id", F.col(vec).cast("array<double>").alias("vec"), g.alias("g"))
    long = rows.select("g", "vec", F.posexplode("vec").alias("i", "x")).select("g", "i", "x", F.posexplode("vec").alias("j", "y"))
    spread = long.groupBy("g", "i", "j").agg(F.count("*").alias("n"), F.covar_samp("x", "y").alias("c"))

    def whiten(t: pa.Table) -> pa.Table:
        """The matrix that takes a group's covariance, times the square of the bandwidth, off its points."""
        t = t.sort_by([("i", "ascending"), ("j", "ascending")])
        d, n = max(t.column("i").to_pylist()) + 1, t.column("n")[0].as_py()
        cov = np.array(t.column("c").to_pylist(), float).reshape(d, d) * n ** (-2.0 / (d + 4))
        if n < 2 or np.linalg.matrix_rank(cov) < d:
            raise ValueError("the points of a group lie on a line")
        return pa.table({"g": t.column("g").slice(0, 1), "n": [n], "w": pa.array([np.linalg.inv(np.linalg.cholesky((cov + cov.T) / 2)).ravel()], pa.list_(pa.float64()))})

    facts = spread.groupBy("g").applyInArrow(whiten, "g string, n long, w array<double>")
    blocks = F.ceil(F.col("n") / DENSE_BLOCK).cast("int")
    named = rows.join(F.broadcast(facts), "g").withColumn("own", F.pmod(F.xxhash64("cell_id"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    queries = named.select("g", "cell_id", "vec", "w", F.col("own").alias("q"), F.col("other").alias("d"), F.lit(True).alias("asks"))
    data = named.select("g", "cell_id", "vec", "w", F.col("other").alias("q"), F.col("own").alias("d"), F.lit(False).alias("asks"))

    def kernel(t: pa.Table) -> pa.Table:
        p, asks = matrix(t.column("vec")), t.column("asks").to_numpy()
        white = p @ np.reshape(t.column("w")[0].as_py(), (p.shape[1], -1)).T
        a, b = white[asks], np.ascontiguousarray(white[~asks].T)
        out = np.zeros(len(a))
        for at in range(0, len(a), 16):
            far = np.zeros((len(a[at : at + 16]), b.shape[1]))
            for x, y in zip(a[at : at + 16].T, b, strict=True):
                gap = x[:, None] - y[None, :]
                gap *= gap
                far += gap
            far *= -0.5
            out[at : at + 16] = np.exp(far, out=far).sum(1)
        return pa.table({"g": t.column("g").filter(pa.array(asks)), "cell_id": t.column("cell_id").filter(pa.array(asks)), "k": out})

    found = queries.unionByName(data).groupBy("g", "q", "d").applyInArrow(kernel, "g string, cell_id long, k double")
    sums = kept(found.groupBy("g", "cell_id").agg(F.sum("k").alias("k")))
    ends = F.broadcast(sums.groupBy("g").agg(F.min("k").alias("low"), F.max("k").alias("high")))
    return sums.join(ends, "g").select("cell_id", F.when(F.col("high") > F.col("low"), (F.col("k") - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(F.lit(0.0)).alias("density"))


def centroids(points: DataFrame, group: str, n_pcs: int = 50, vec: str = "vec") -> DataFrame:
    """``(group, dim, mean)`` of the first ``n_pcs`` coordinates."""
    long = points.select(F.col(group).cast("string").alias("group"), F.posexplode(F.slice(F.col(vec), 1, n_pcs)).alias("dim", "x"))
    return long.groupBy("group", "dim").agg(F.avg("x").alias("mean"))


def centroid_correlation(points: DataFrame, group: str, n_pcs: int = 50, vec: str = "vec") -> DataFrame:
    """``(g1, g2, correlation)`` of every ordered pair of groups."""
    c = centroids(points, group, n_pcs, vec)
    a, b = c.select(F.col("group").alias("g1"), "dim", F.col("mean").alias("x")), c.select(F.col("group").alias("g2"), "dim", F.col("mean").alias("y"))
    return a.join(b, "dim").groupBy("g1", "g2").agg(F.corr("x", "y").alias("correlation"))


def dendrogram(points: DataFrame, group: str, n_pcs: int = 50, vec: str = "vec", most: int = 1024) -> tuple[DataFrame, list[str]]:
    """Complete linkage on 1 - correlation: ``(step, left, right, dist, size)`` and the leaves' order from left to right.

    Between 2 and ``most`` groups; ties take the first pair by row and column.
    """
    if points.select(F.col(group)).distinct().limit(most + 2).count() > most + 1:  # one may be null
        raise ValueError(f"between 2 and {most} groups are needed")
    rows = centroid_correlation(points, group, n_pcs, vec).collect()
    names = sorted({r[0] for r in rows})
    if not 2 <= len(names) <= most:
        raise ValueError(f"between 2 and {most} groups are needed")
    d = np.full((len(names),) * 2, np.nan)
    for g1, g2, c in rows:
        if c is None or np.isnan(c):
            raise ValueError("a group's centroid is constant")
        d[names.index(g1), names.index(g2)] = 1 - c
    d = (d + d.T) / 2
    np.fill_diagonal(d, np.inf)
    ids, size, kids, steps = list(range(len(names))), [1] * len(names), {}, []
    for step in range(len(names) - 1):
        i, j = np.unravel_index(np.argmin(d), d.shape)
        i, j = min(i, j), max(i, j)
        new = len(names) + step
        steps.append((step, ids[i], ids[j], float(d[i, j]), size[i] + size[j]))
        kids[new] = (ids[i], ids[j])
        d[i, :] = d[:, i] = np.maximum(d[i, :], d[j, :])
        d[i, i] = np.inf
        d = np.delete(np.delete(d, j, 0), j, 1)
        ids[i], size[i] = new, size[i] + size[j]
        del ids[j], size[j]
    order, stack = [], [2 * len(names) - 2]
    while stack:
        node = stack.pop()
        stack += reversed(kids[node]) if node in kids else []
        order += [names[node]] if node not in kids else []
    table = points.sparkSession.createDataFrame(steps, "step int, left int, right int, dist double, size int")
    return table, order


def confusion_matrix(cells: DataFrame, a: str, b: str, normalize: bool = True) -> DataFrame:
    """``(row, column, value)`` over the union of both label sets; rows are scaled to 1 unless empty."""
    rows = cells.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).cast("string").alias("row"), F.col(b).cast("string").alias("column"))
    names = rows.select(F.col("row").alias("l")).union(rows.select("column")).distinct()
    counts = rows.groupBy("row", "column").agg(F.count("*").cast("double").alias("c"))
    grid = names.select(F.col("l").alias("row")).crossJoin(names.select(F.col("l").alias("column"))).join(counts, ["row", "column"], "left").fillna(0.0, ["c"])
    total = F.sum("c").over(Window.partitionBy("row"))
    return grid.select("row", "column", (F.when(total > 0, F.col("c") / total).otherwise(F.col("c")) if normalize else F.col("c")).alias("value"))


def natural_order(labels: Sequence[str]) -> list[str]:
    """Labels with their digit runs compared as numbers."""
    import re

    return sorted(labels, key=lambda s: [(0, int(p), "") if p.isdigit() else (1, 0, p) for p in re.split(r"(\d+)", s)])
