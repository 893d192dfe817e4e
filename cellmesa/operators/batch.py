"""Batch correction: empirical Bayes on matrices, soft clustering on embeddings."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import CellDataset
from .graph import in_one_task
from .linalg import design

# --- ComBat


def combat(ds: CellDataset, key: str = "batch", covariates: Sequence[str] = (), tolerance: float = 1e-4, most_iterations: int = 1000) -> CellDataset:
    """Adjust location and scale of each batch towards the pooled ones (Johnson, Li and Rabinovic 2007).

    The fit needs only sums by (batch, gene); each batch's prior and fixed point run in one group over its genes. Genes without
    variance become 0. A batch of one cell is an error in the job. The result is dense.
    """
    obs = ds.obs.withColumn("_b", F.col(key).cast("string"))
    if covariates:
        names_d, cov = design(obs, covariates)
        cov = cov[1:]
    else:
        names_d, cov = obs.select("cell_id"), []
    levels = [r[0] for r in obs.select("_b").distinct().orderBy("_b").collect()]
    d = obs.select("cell_id", "_b").join(names_d, "cell_id")
    d = d.select("cell_id", "_b", *((F.col("_b") == b).cast("double").alias(f"b{i}") for i, b in enumerate(levels)), *cov)
    columns = [*(f"b{i}" for i in range(len(levels))), *cov]
    normal = d.agg(*(F.sum(F.col(a) * F.col(b)).alias(f"{a}_{b}") for a in columns for b in columns)).first()
    m = np.array([[normal[f"{a}_{b}"] for b in columns] for a in columns])
    if np.linalg.matrix_rank(m) < len(columns):
        raise ValueError("batches and covariates are linearly dependent")
    counts = np.diag(m)[: len(levels)]
    if counts.min() < 2:
        raise ValueError("each batch needs two cells or more")
    inverse, n = np.linalg.inv(m), float(counts.sum())
    sums = ds.X.join(d, "cell_id").groupBy("gene_id").agg(*(F.sum(F.col("value") * F.col(a)).alias(f"s_{a}") for a in columns))
    betas = ds.var.select("gene_id").join(sums, "gene_id", "left").na.fill(0.0)
    betas = betas.select("gene_id", *(sum((F.col(f"s_{b}") * float(inverse[i, j]) for j, b in enumerate(columns)), F.lit(0.0)).alias(f"w_{a}") for i, a in enumerate(columns)))
    grand = sum((F.col(f"w_b{i}") * float(c / n) for i, c in enumerate(counts)), F.lit(0.0))
    dense = d.crossJoin(betas.withColumn("grand", grand)).join(ds.X, ["cell_id", "gene_id"], "left").withColumn("y", F.coalesce("value", F.lit(0.0)))
    fitted = sum((F.col(a) * F.col(f"w_{a}") for a in columns), F.lit(0.0))
    shared = F.col("grand") + sum((F.col(a) * F.col(f"w_{a}") for a in cov), F.lit(0.0))
    dense = dense.select("cell_id", "gene_id", "_b", "y", fitted.alias("fit"), shared.alias("shared"))
    spread = dense.groupBy("gene_id").agg(F.avg((F.col("y") - F.col("fit")) * (F.col("y") - F.col("fit"))).alias("v"))
    z = dense.join(spread, "gene_id").withColumn("z", F.when(F.col("v") > 1e-20, (F.col("y") - F.col("shared")) / F.sqrt("v")).otherwise(0.0))
    stats = z.groupBy("_b", "gene_id").agg(F.count("*").alias("n"), F.sum("z").alias("s1"), F.sum(F.col("z") * F.col("z")).alias("s2"), F.avg("z").alias("gamma"), F.var_samp("z").alias("delta"))

    def shrink(t: pa.Table) -> pa.Table:
        n, s1, s2, g, d2 = (np.array(t.column(c).to_pylist(), float) for c in ("n", "s1", "s2", "gamma", "delta"))
        bar, tau = g.mean(), g.var(ddof=1) if len(g) > 1 else 0.0
        mean, var = d2.mean(), d2.var(ddof=1) if len(g) > 1 else 0.0
        a, b = ((2 * var + mean**2) / var, (mean * var + mean**3) / var) if var > 0 else (None, None)
        gs, ds_ = g.copy(), d2.copy()
        for _ in range(most_iterations):
            g_new = (tau * n * g + ds_ * bar) / (tau * n + ds_) if tau > 0 else np.full_like(g, bar)
            d_new = ds_ if a is None else (0.5 * (s2 - 2 * g_new * s1 + n * g_new**2) + b) / (n / 2 + a - 1)
            with np.errstate(divide="ignore", invalid="ignore"):
                change = max(np.nanmax(np.abs(g_new - gs) / np.abs(gs), initial=0), np.nanmax(np.abs(d_new - ds_) / ds_, initial=0))
            gs, ds_ = g_new, d_new
            if change < tolerance:
                break
        return pa.table({"_b": t.column("_b"), "gene_id": t.column("gene_id"), "g": gs, "d": ds_})

    fit = stats.groupBy("_b").applyInArrow(shrink, "_b string, gene_id long, g double, d double")
    out = z.join(fit, ["_b", "gene_id"])
    value = F.when(F.col("v") > 1e-20, F.coalesce(F.try_divide(F.col("z") - F.col("g"), F.sqrt("d")), F.lit(0.0)) * F.sqrt("v") + F.col("shared")).otherwise(F.lit(0.0))
    return ds.with_(X=out.select("cell_id", "gene_id", value.alias("value")))


# --- Harmony


def harmony_integrate(
    points: DataFrame, key: str = "batch", vec: str = "vec", theta: float = 2.0, sigma: float = 0.1, lamb: float = 1.0, n_clusters: int | None = None, max_iter: int = 10, max_iter_kmeans: int = 20, seed: int = 0, most: int = 200_000
) -> DataFrame:
    """``(cell_id, vec)``: an embedding with batches mixed (Korsunsky et al. 2019), in one task of at most ``most`` cells.

    Soft k-means on cosines with a penalty on clusters that lack a batch, in blocks of a twentieth of the cells, and ridge
    regression of each cluster on the batches with the intercept left in. Fewer than two batches change nothing.
    """
    rows = points.select("cell_id", F.col(vec).alias("vec"), F.col(key).cast("string").alias("batch"))

    def kernel(t: pa.Table) -> pa.Table:
        ids = np.array(t.column("cell_id").to_pylist(), np.int64)
        order = np.argsort(ids)
        x = np.array(t.column("vec").to_pylist(), float)[order]
        names, codes = np.unique(np.array(t.column("batch").to_pylist())[order], return_inverse=True)
        n, nb = len(ids), len(names)
        if n > most:
            raise ValueError(f"more than {most} cells")
        if nb >= 2:
            x = _harmony(x, codes, nb, theta, sigma, lamb, n_clusters, max_iter, max_iter_kmeans, seed)
        return pa.table({"cell_id": ids[order], "vec": pa.array(list(x), pa.list_(pa.float64()))})

    return in_one_task(rows, kernel, "cell_id long, vec array<double>", most)


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


def _harmony(x, codes, nb, theta, sigma, lamb, n_clusters, max_iter, max_kmeans, seed):
    rng, n = np.random.RandomState(seed), len(x)
    k = n_clusters or int(np.clip(round(n / 30), 1, 100))
    phi = np.eye(nb)[codes]
    share = phi.mean(0)
    z = _unit(x)
    centres = z[rng.choice(n, k, replace=False)]
    for _ in range(25):
        near = (z @ centres.T).argmax(1)
        sums = np.zeros((k, x.shape[1]))
        np.add.at(sums, near, z)
        centres = _unit(np.where(np.bincount(near, minlength=k)[:, None] > 0, sums, centres))

    def memberships(zz, penalty):
        e = np.exp(-2 * (1 - zz @ centres.T) / sigma) * penalty
        return e / np.maximum(e.sum(1, keepdims=True), 1e-300)

    r = memberships(z, 1.0)
    observed, last, out = r.T @ phi, np.inf, x

    def objective():
        d = 2 * (1 - z @ centres.T)
        expected = np.outer(r.sum(0), share)
        return float((r * d).sum() + sigma * (r * np.log(np.maximum(r, 1e-12))).sum() + sigma * theta * (observed * np.log((observed + 1) / (expected + 1))).sum())

    for _ in range(max_iter):
        before = np.inf
        for _ in range(max_kmeans):
            centres = _unit(r.T @ z)
            for part in np.array_split(rng.permutation(n), 20):
                observed -= r[part].T @ phi[part]
                mass = r.sum(0) - r[part].sum(0)
                penalty = ((np.outer(mass, share) + 1) / (observed + 1)) ** theta
                r[part] = memberships(z[part], phi[part] @ penalty.T)
                observed += r[part].T @ phi[part]
            now = objective()
            if abs(before - now) < 1e-3 * abs(now):
                break
            before = now
        full = np.hstack([np.ones((n, 1)), phi])
        ridge = lamb * np.eye(nb + 1)
        ridge[0, 0] = 0
        out = x.copy()
        for c in range(k):
            weighted = full * r[:, [c]]
            w = np.linalg.solve(weighted.T @ full + ridge, weighted.T @ x)
            w[0] = 0
            out -= weighted @ w
        z = _unit(out)
        if abs(last - now) < 1e-2 * abs(now):
            break
        last = now
    return out


def ilisi(points: DataFrame, neighbours: DataFrame, key: str = "batch") -> DataFrame:
    """``(cell_id, ilisi)``: inverse Simpson index of the batches among each cell's neighbours."""
    labels = points.select(F.col("cell_id").alias("dst"), F.col(key).alias("b"))
    counts = neighbours.join(labels, "dst").groupBy("src", "b").agg(F.count("*").alias("c"))
    per = counts.groupBy("src").agg((F.sum("c") * F.sum("c") / F.sum(F.col("c") * F.col("c"))).alias("ilisi"))
    return per.withColumnRenamed("src", "cell_id")
