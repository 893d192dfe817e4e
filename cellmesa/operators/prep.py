"""Filters, quality metrics, normalisation, variable genes, scaling and sampling."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.digests import numbered as digests
from ..model import CellDataset
from .stats import gene_moments, n_cells, scalar

# --- filters


def _one(a: object, b: object, names: str) -> None:
    if (a is None) == (b is None):
        raise ValueError(f"give exactly one of {names}")


def _mask(x: DataFrame, ids: DataFrame, key: str, least: int | None, total: float | None) -> DataFrame:
    agg = x.groupBy(key).agg(F.count_if(F.col("value") > 0).alias("n"), F.sum("value").alias("t"))
    test = F.coalesce("n", F.lit(0)) >= least if least is not None else F.coalesce("t", F.lit(0.0)) >= total
    return ids.select(key).join(agg, key, "left").select(key, test.alias("keep"))


def cell_mask(ds: CellDataset, min_genes: int | None = None, min_counts: float | None = None) -> DataFrame:
    """``(cell_id, keep)`` by exactly one criterion: genes with a positive value, or the sum of values."""
    _one(min_genes, min_counts, "min_genes and min_counts")
    return _mask(ds.X, ds.obs, "cell_id", min_genes, min_counts)


def gene_mask(ds: CellDataset, min_cells: int | None = None, min_counts: float | None = None) -> DataFrame:
    _one(min_cells, min_counts, "min_cells and min_counts")
    return _mask(ds.X, ds.var, "gene_id", min_cells, min_counts)


def filter_cells(ds: CellDataset, **criterion: float) -> CellDataset:
    return ds.subset(obs=cell_mask(ds, **criterion).where("keep"))


def filter_genes(ds: CellDataset, **criterion: float) -> CellDataset:
    return ds.subset(var=gene_mask(ds, **criterion).where("keep"))


# --- element-wise


def cell_totals(ds: CellDataset) -> DataFrame:
    """``(cell_id, total)`` of every cell, empty ones included."""
    return ds.obs.select("cell_id").join(ds.X.groupBy("cell_id").agg(F.sum("value").alias("total")), "cell_id", "left").fillna(0.0, ["total"])


def normalize_total(ds: CellDataset, target_sum: float | None = None) -> CellDataset:
    """Scale each cell to ``target_sum``, or to the median total of all cells; cells of total 0 stay as they are.

    A target that is not positive and finite is an error: at once if given, in the job if it is the median.
    """
    if target_sum is not None and not 0 < target_sum < float("inf"):
        raise ValueError("target_sum has to be positive and finite")
    totals = cell_totals(ds)
    if target_sum is None:
        median = scalar(totals.agg(F.percentile("total", F.lit(0.5)).alias("target")))
        totals = totals.crossJoin(median).withColumn("target", F.when(F.col("target") > 0, F.col("target")).otherwise(F.raise_error(F.lit("the median total is not positive")).cast("double")))
    else:
        totals = totals.withColumn("target", F.lit(float(target_sum)))
    scaled = ds.X.join(totals.where("total <> 0"), "cell_id", "left").withColumn("value", F.coalesce(F.col("value") * F.col("target") / F.col("total"), F.col("value")))
    return ds.with_(X=scaled.select(ds.X.columns))


def log1p(ds: CellDataset) -> CellDataset:
    return ds.with_(X=ds.X.withColumn("value", F.log1p("value")), uns={**ds.uns, "log1p": {"base": None}})


def sqrt(ds: CellDataset) -> CellDataset:
    return ds.with_(X=ds.X.withColumn("value", F.sqrt("value")))


def normalize_per_cell(ds: CellDataset, counts_per_cell_after: float | None = None) -> CellDataset:
    """Record totals as ``obs.n_counts``, drop cells with a total below 1 and normalise the others."""
    counts = cell_totals(ds).withColumnRenamed("total", "n_counts")
    kept = ds.with_(obs=ds.obs.join(counts, "cell_id")).subset(obs=counts.where("n_counts >= 1"))
    return normalize_total(kept, counts_per_cell_after)


# --- quality metrics


def qc_cells(ds: CellDataset, qc_vars: Sequence[str] = (), percent_top: Sequence[int] = (50, 100, 200, 500), log1p: bool = True) -> DataFrame:
    """Metrics per cell; ``qc_vars`` are boolean columns of ``var``. Shares of an empty cell are NaN."""
    if any(k < 1 for k in percent_top):
        raise ValueError("percent_top entries have to be positive")
    x = ds.X
    if qc_vars:
        x = x.join(ds.var.select("gene_id", *qc_vars), "gene_id")
    if percent_top:
        x = x.withColumn("_rn", F.row_number().over(Window.partitionBy("cell_id").orderBy(F.desc("value"))))
    aggs = [F.count_if(F.col("value") != 0).alias("n_genes_by_counts"), F.sum("value").alias("total_counts")]
    aggs += [F.sum(F.when(F.col("_rn") <= k, F.col("value"))).alias(f"_top{k}") for k in percent_top]
    aggs += [F.sum(F.when(F.col(v), F.col("value"))).alias(f"total_counts_{v}") for v in qc_vars]
    got = ds.obs.select("cell_id").join(x.groupBy("cell_id").agg(*aggs), "cell_id", "left").na.fill(0)
    share = lambda a: F.when(F.col("total_counts") != 0, 100.0 * F.col(a) / F.col("total_counts")).otherwise(F.lit(float("nan")))
    logged = lambda a: [F.log1p(a).alias(f"log1p_{a}")] if log1p else []
    out = ["cell_id", F.col("n_genes_by_counts"), *logged("n_genes_by_counts"), F.col("total_counts"), *logged("total_counts")]
    out += [share(f"_top{k}").alias(f"pct_counts_in_top_{k}_genes") for k in percent_top]
    for v in qc_vars:
        out += [F.col(f"total_counts_{v}"), *logged(f"total_counts_{v}"), share(f"total_counts_{v}").alias(f"pct_counts_{v}")]
    return got.select(*out)


def qc_genes(ds: CellDataset, log1p: bool = True) -> DataFrame:
    agg = ds.X.groupBy("gene_id").agg(F.count_if(F.col("value") != 0).alias("n_cells_by_counts"), F.sum("value").alias("total_counts"))
    got = ds.var.select("gene_id").join(agg, "gene_id", "left").na.fill(0).crossJoin(n_cells(ds.obs))
    out = [F.col("gene_id"), F.col("n_cells_by_counts"), F.try_divide("total_counts", "n_cells").alias("mean_counts")]
    out += [(100.0 * (1 - F.try_divide("n_cells_by_counts", "n_cells"))).alias("pct_dropout_by_counts"), F.col("total_counts")]
    if log1p:
        out += [F.log1p(F.try_divide("total_counts", "n_cells")).alias("log1p_mean_counts"), F.log1p("total_counts").alias("log1p_total_counts")]
    return got.select(*out)


# --- variable genes

BINS = 20
MAD_TO_SD = 0.6744897501960817


def dispersions(ds: CellDataset, flavor: str = "seurat") -> DataFrame:
    """``(gene_id, means, dispersions, dispersions_norm)``; undefined values are NaN."""
    if flavor not in ("seurat", "cell_ranger"):
        raise ValueError(f"unknown flavor {flavor!r}")
    seurat = flavor == "seurat"
    # one row per gene, used for the bins' edges, their statistics and the result
    stats = gene_moments(ds.X, ds.obs, ds.var, F.expm1("value") if seurat else None).persist()
    nan = F.lit(float("nan"))
    mean = F.when(F.col("mean") == 0, F.lit(1e-12)).otherwise(F.col("mean"))
    disp = F.col("var") / mean
    if seurat:
        stats = stats.select("gene_id", F.log1p(mean).alias("means"), F.when(disp == 0, nan).otherwise(F.log(disp)).alias("dispersions"))
        span = scalar(stats.agg(F.min("means").alias("lo"), F.max("means").alias("hi")))
        # right-closed bins of equal width, the first edge moved down by a thousandth of the range
        at = F.ceil(F.try_divide(F.col("means") - F.col("lo"), F.col("hi") - F.col("lo")) * BINS - 1e-12).cast("int")
        binned = stats.crossJoin(span).withColumn("bin", F.when(F.col("hi") > F.col("lo"), F.greatest(F.lit(1), F.least(F.lit(BINS), at))).otherwise(F.lit(1)))
        defined = ~F.isnan("dispersions")
        own = binned.where(defined).groupBy("bin").agg(F.avg("dispersions").alias("m"), F.stddev_samp("dispersions").alias("s"), F.count("*").alias("k"))
        met = binned.join(F.broadcast(own), "bin", "left")
        norm = F.when(F.isnan("dispersions"), nan).when(F.col("k") == 1, F.lit(1.0)).otherwise(F.coalesce(F.try_divide(F.col("dispersions") - F.col("m"), F.col("s")), nan))
        return met.select("gene_id", "means", "dispersions", norm.alias("dispersions_norm"))
    stats = stats.select("gene_id", mean.alias("means"), disp.alias("dispersions"))
    points = [round(0.05 * i, 2) for i in range(2, 21)]
    edges = scalar(stats.agg(F.percentile("means", F.array(*map(F.lit, points))).alias("edges")))
    checked = F.when(F.size(F.array_distinct("edges")) == F.size("edges"), F.col("edges")).otherwise(F.raise_error(F.lit("percentile edges coincide")).cast("array<double>"))
    edges = edges.select(checked.alias("edges"))
    binned = stats.crossJoin(edges).withColumn("bin", F.size(F.filter("edges", lambda e: e < F.col("means"))))
    med = F.broadcast(binned.groupBy("bin").agg(F.percentile("dispersions", F.lit(0.5)).alias("med")))
    met = binned.join(med, "bin")
    mad = F.broadcast(met.groupBy("bin").agg((F.percentile(F.abs(F.col("dispersions") - F.col("med")), F.lit(0.5)) / MAD_TO_SD).alias("mad")))
    gap = F.col("dispersions") - F.col("med")
    flat = F.when(gap == 0, nan).otherwise(F.signum(gap) * float("inf"))
    return met.join(mad, "bin").select("gene_id", "means", "dispersions", F.coalesce(F.try_divide(gap, F.col("mad")), flat).alias("dispersions_norm"))


def highly_variable_genes(ds: CellDataset, n_top_genes: int = 2000, flavor: str = "seurat") -> DataFrame:
    """``(gene_id, means, dispersions_norm, highly_variable)``: genes at or above the cut-off of the n-th; ties widen."""
    table = dispersions(ds, flavor)
    ranked = table.where(~F.isnan("dispersions_norm")).withColumn("_r", F.rank().over(Window.orderBy(F.desc(F.round("dispersions_norm", 10)))))
    top = ranked.where(F.col("_r") <= n_top_genes).select("gene_id", F.lit(True).alias("highly_variable"))
    return table.join(top, "gene_id", "left").select("gene_id", "means", "dispersions_norm", F.coalesce("highly_variable", F.lit(False)).alias("highly_variable"))


def filter_genes_dispersion(ds: CellDataset, flavor: str = "seurat", n_top_genes: int | None = None, min_mean: float = 0.0125, max_mean: float = 3.0, min_disp: float = 0.5) -> DataFrame:
    if n_top_genes is not None:
        return highly_variable_genes(ds, n_top_genes, flavor)
    norm = F.nanvl("dispersions_norm", F.lit(0.0))
    keep = (F.col("means") > min_mean) & (F.col("means") < max_mean) & (norm > min_disp)
    return dispersions(ds, flavor).select("gene_id", "means", "dispersions_norm", keep.alias("highly_variable"))


# --- scaling


def gene_scale(ds: CellDataset) -> DataFrame:
    """``(gene_id, mean, sd)`` with sd 1 where a gene is constant; fewer than two cells is an error in the job."""
    two = ds.obs.agg(F.when(F.count("*") < 2, F.raise_error(F.lit("scaling needs two cells or more")).cast("long")).otherwise(F.count("*")).alias("_n"))
    sd = F.sqrt("var")
    return gene_moments(ds.X, ds.obs, ds.var).crossJoin(scalar(two)).where("_n > 0").select("gene_id", "mean", F.when(sd == 0, F.lit(1.0)).otherwise(sd).alias("sd"))


def scale(ds: CellDataset, zero_center: bool = True, max_value: float | None = None) -> CellDataset:
    """Each gene to unit variance. Centred values are dense: one row for each cell and gene, so subset genes first.

    Clipping is on both sides where values are centred, else from above.
    """
    stats = gene_scale(ds)
    if zero_center:
        dense = ds.obs.select("cell_id").crossJoin(stats).join(ds.X, ["cell_id", "gene_id"], "left")
        v = (F.coalesce("value", F.lit(0.0)) - F.col("mean")) / F.col("sd")
    else:
        dense, v = ds.X.join(stats, "gene_id"), F.col("value") / F.col("sd")
    if max_value is not None:
        v = F.least(v, F.lit(float(max_value)))
        v = F.greatest(v, F.lit(-float(max_value))) if zero_center else v
    return ds.with_(X=dense.select("cell_id", "gene_id", v.alias("value")))


def scale_sparse(ds: CellDataset, max_value: float | None = None) -> CellDataset:
    """Each gene centred and to unit variance, without a row for every zero: ``var.offset`` is what a zero becomes, and ``X`` holds
    what the stored entries are beyond it. Value and offset add up to what ``scale`` gives. As an offset is the same for all
    cells, principal components, which take the mean off, are those of the scaled values."""
    at = lambda v: v if max_value is None else F.greatest(F.least(v, F.lit(float(max_value))), F.lit(-float(max_value)))
    stats = gene_scale(ds).select("gene_id", "mean", "sd", at(-F.col("mean") / F.col("sd")).alias("offset"))
    beyond = at((F.col("value") - F.col("mean")) / F.col("sd")) - F.col("offset")
    return ds.with_(X=ds.X.join(stats, "gene_id").select("cell_id", "gene_id", beyond.alias("value")), var=ds.var.drop("offset").join(stats.select("gene_id", "offset"), "gene_id"))


def numbered(df: DataFrame, key: str, buckets: int = 256) -> DataFrame:
    """``df`` with ``at``, the place of each row from 0 in the order of a numeric key without repeats.

    Rows are numbered within ranges of the key that its quantiles set, each a task, and the ranges' sizes, one row each, are
    added up.
    """
    points = [i / buckets for i in range(1, buckets)]
    edges = scalar(df.agg(F.percentile_approx(key, F.array(*map(F.lit, points)), F.lit(10 * buckets)).alias("_edges")))
    dealt = df.crossJoin(edges).withColumn("_bucket", F.size(F.filter("_edges", lambda e: e < F.col(key)))).drop("_edges")
    sizes = dealt.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(sizes.select("_bucket", before.alias("_before")))
    own = F.row_number().over(Window.partitionBy("_bucket").orderBy(key)) - 1
    return dealt.withColumn("_own", own).join(starts, "_bucket").select(*df.columns, (F.col("_own") + F.col("_before")).cast("long").alias("at"))


# --- sampling: draws are hashes of ids and the seed, so they do not depend on partitions


def draw(seed: int, *ids: str) -> Column:
    return F.md5(F.concat_ws("-", F.lit(str(seed)), *(F.col(i).cast("string") for i in ids)))


def sample_size(n: int, fraction: float | None, n_obs: int | None) -> int:
    if (fraction is None) == (n_obs is None):
        raise TypeError("give exactly one of fraction and n_obs")
    if fraction is not None and not 0 <= fraction <= 1:
        raise ValueError("fraction has to lie between 0 and 1")
    return n_obs if n_obs is not None else int(fraction * n)


def subsample(ds: CellDataset, fraction: float | None = None, n_obs: int | None = None, seed: int = 0) -> CellDataset:
    size = sample_size(ds.obs.count(), fraction, n_obs)
    return ds.subset(obs=ds.obs.select("cell_id", draw(seed, "cell_id").alias("_d")).orderBy("_d", "cell_id").limit(size))


def sample(ds: CellDataset, n: int, replace: bool = False, seed: int = 0) -> DataFrame:
    """``(draw, cell_id)``: n cells, possibly repeated."""
    if not replace:
        picked = ds.obs.select("cell_id", draw(seed, "cell_id").alias("_d")).orderBy("_d", "cell_id").limit(n)
        return picked.select((F.row_number().over(Window.orderBy("_d", "cell_id")) - 1).cast("long").alias("draw"), "cell_id")  # n rows
    spark = ds.obs.sparkSession
    size = ds.obs.count()
    if n and not size:
        raise ValueError("there are no cells to draw from")
    picks = spark.range(n).select(F.col("id").alias("draw"), (F.conv(F.substring(draw(seed, "id"), 1, 8), 16, 10).cast("long") % max(1, size)).alias("at"))
    return picks.join(numbered(ds.obs.select("cell_id"), "cell_id"), "at").select("draw", "cell_id")


def downsample_counts(ds: CellDataset, counts_per_cell: int | None = None, total_counts: int | None = None, seed: int = 0, replace: bool = False) -> CellDataset:
    """Thin counts to a target per cell, or of the whole matrix; cells at or below it are untouched.

    Without replacement each count is a slot and the slots with the smallest hashes stay, which is a hypergeometric draw. With
    replacement target slots are drawn by hash. Values that are not whole numbers are an error in the job.
    """
    _one(counts_per_cell, total_counts, "counts_per_cell and total_counts")
    target = counts_per_cell if counts_per_cell is not None else total_counts
    whole = F.when((F.col("value") >= 0) & (F.floor("value") == F.col("value")), F.col("value")).otherwise(F.raise_error(F.lit("counts have to be whole numbers")).cast("double"))
    x = ds.X.withColumn("value", whole)
    if counts_per_cell is not None:
        return ds.with_(X=_thinned_cells(x, target, seed, replace))
    if replace:
        return ds.with_(X=_drawn_whole(x, target, seed))
    return ds.with_(X=_thinned_whole(x, target, seed))


def _smallest(high: np.ndarray, low: np.ndarray, target: int) -> np.ndarray:
    """Which of the hashes, given by their halves, are the ``target`` smallest; of equal ones the first."""
    if len(high) <= target:
        return np.ones(len(high), bool)
    if target < 1:
        return np.zeros(len(high), bool)
    last = np.partition(high, target - 1)[target - 1]
    keep, at = high < last, np.flatnonzero(high == last)
    keep[at[np.argsort(low[at], kind="stable")][: target - int(keep.sum())]] = True
    return keep


def _thinned_cells(x: DataFrame, target: int, seed: int, replace: bool) -> DataFrame:
    """The entries of a matrix with each cell thinned to ``target`` counts.

    A cell's entries meet as one row, and its slots are hashed in runs of which only the ``target`` smallest are held, so no slot
    is ever a row.
    """
    entry = F.struct("gene_id", "value")
    cells = x.groupBy("cell_id").agg(F.array_sort(F.collect_list(entry)).alias("e"))
    words = lambda *ids: "".join(f"{i}-" for i in ids if i is not None).encode()

    def without(cell: list, sizes: np.ndarray, gene: list, value: np.ndarray, many: np.ndarray) -> np.ndarray:
        out = np.where(np.repeat(many, sizes), 0.0, value)
        of = np.repeat(np.arange(len(sizes)), sizes)
        slots = np.flatnonzero(many[of] & (value > 0))
        held: list[list[np.ndarray]] = [[np.empty(0, np.int64)], [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]]
        now = -1

        def settle() -> list[list[np.ndarray]]:
            met = [np.concatenate(h) for h in held]
            keep = _smallest(met[1], met[2], target)
            return [[m[keep]] for m in met]

        def close() -> None:
            np.add.at(out, settle()[0][0], 1.0)

        for own, high, low in digests([words(seed, cell[of[s]], gene[s]) for s in slots.tolist()], value[slots].astype(np.int64)):
            at = slots[own]
            edges = np.append(np.flatnonzero(np.diff(of[at], prepend=-1)), len(at))
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if of[at[a]] != now:
                    if now >= 0:
                        close()
                    now, held = of[at[a]], [[], [], []]
                for h, got in zip(held, (at, high, low), strict=True):
                    h.append(got[a:b])
                if sum(map(len, held[0])) > target + (1 << 17):
                    held = settle()
        if now >= 0:
            close()
        return out

    def within(cell: list, sizes: np.ndarray, gene: list, value: np.ndarray, many: np.ndarray) -> np.ndarray:
        out = np.where(np.repeat(many, sizes), 0.0, value)
        stops = np.cumsum(sizes)
        picked = np.flatnonzero(many)
        for own, high, _ in digests([words(seed, cell[k]) for k in picked.tolist()], np.full(len(picked), target)):
            edges = np.append(np.flatnonzero(np.diff(own, prepend=-1)), len(own))
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                k = picked[own[a]]
                part = slice(stops[k] - sizes[k], stops[k])
                ends = np.cumsum(value[part])
                u = (high[a:b] >> np.uint64(16)).astype(np.float64) / 2.0**48 * ends[-1]
                out[part] += np.bincount(np.searchsorted(ends, u, side="right"), minlength=sizes[k])
        return out

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                sizes = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)
                gene, value = (batch.column(1).flatten().field(c) for c in ("gene_id", "value"))
                value = value.to_numpy(zero_copy_only=False)
                many = np.add.reduceat(value, np.cumsum(sizes) - sizes) > target
                out = (within if replace else without)(batch.column(0).to_pylist(), sizes, gene.to_pylist(), value, many)
                left = np.flatnonzero(out != 0)
                of = np.repeat(np.arange(len(sizes)), sizes)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of[left])), gene.take(pa.array(left)), pa.array(out[left])], names=["cell_id", "gene_id", "value"])

    return cells.mapInArrow(work, "cell_id long, gene_id long, value double")


def _drawn_whole(x: DataFrame, target: int, seed: int) -> DataFrame:
    """The entries of a matrix of ``target`` counts drawn with replacement, or as they are where they are no more than that."""
    one = F.lit(0)
    before = F.sum("value").over(Window.partitionBy(one).orderBy("cell_id", "gene_id")) - F.col("value")
    ends = x.select("cell_id", "gene_id", "value", before.alias("lo"), F.sum("value").over(Window.partitionBy(one)).alias("total"), one.alias("_k"))
    many = ends.where(F.col("total") > target)
    picks = many.select("_k", "total").distinct().withColumn("j", F.explode(F.sequence(F.lit(1), F.lit(target)))).withColumn("u", F.conv(F.substring(draw(seed, "_k", "j"), 1, 12), 16, 10).cast("double") / float(16**12) * F.col("total"))
    hit = many.alias("a").join(picks.alias("b"), (F.col("a._k") == F.col("b._k")) & (F.col("u") >= F.col("lo")) & (F.col("u") < F.col("lo") + F.col("value")))
    thinned = hit.groupBy("a.cell_id", "a.gene_id").agg(F.count("*").cast("double").alias("value"))
    kept = ends.where(F.col("total") <= target).where("value <> 0").select("cell_id", "gene_id", "value")
    return thinned.unionByName(kept)


#: Hexadecimal digits of a slot's hash by which slots are first counted.
PREFIX = 4


def _thinned_whole(x: DataFrame, target: int, seed: int) -> DataFrame:
    """The entries of a matrix thinned to ``target`` counts in all: the slots with the smallest hashes stay.

    Slots are counted by the first digits of their hash, which tells where the last one that stays lies; only slots that share
    those digits with it are put in order.
    """
    all_ = scalar(x.agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("_all")))
    met = x.crossJoin(all_)
    slots = met.where((F.col("_all") > target) & (F.col("value") > 0)).select("cell_id", "gene_id", F.explode(F.sequence(F.lit(1), F.col("value").cast("int"))).alias("j"))
    hashed = slots.withColumn("_h", draw(seed, "cell_id", "gene_id", "j")).withColumn("_p", F.substring("_h", 1, PREFIX))
    sizes = hashed.groupBy("_p").agg(F.count("*").alias("_n")).withColumn("_upto", F.sum("_n").over(Window.orderBy("_p")))  # 16 ** PREFIX rows
    last = scalar(sizes.where((F.col("_upto") >= target) & (F.col("_upto") - F.col("_n") < target)).select(F.col("_p").alias("_last"), (target - F.col("_upto") + F.col("_n")).alias("_left")))
    placed = hashed.crossJoin(last)
    below = placed.where("_p < _last").select("cell_id", "gene_id")
    order = F.row_number().over(Window.orderBy("_h", "cell_id", "gene_id", "j"))
    within = placed.where("_p = _last").withColumn("_r", order).where("_r <= _left").select("cell_id", "gene_id")
    thinned = below.unionByName(within).groupBy("cell_id", "gene_id").agg(F.count("*").cast("double").alias("value"))
    kept = met.where((F.col("_all") <= target) & (F.col("value") != 0)).select("cell_id", "gene_id", "value")
    return thinned.unionByName(kept)
