"""Tidy frames of cells and genes, and grouped aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import CellDataset, require
from .stats import group_moments

FUNCS = ("count_nonzero", "mean", "median", "sum", "var")


def _frame(ds: CellDataset, keys: Sequence[str], m_keys: Sequence[tuple[str, int]], layer: str | None, side: str) -> DataFrame:
    ids, other, key, far = (ds.obs, ds.var, "cell_id", "gene_id") if side == "obs" else (ds.var, ds.obs, "gene_id", "cell_id")
    name = "var_name" if side == "obs" else "obs_name"
    slots = ds.obsm if side == "obs" else ds.varm
    x = require(ds.layers, layer, "layers") if layer else ds.X
    columns = [c for c in ids.columns if c != key]
    wanted = list(dict.fromkeys(k for k in keys if k not in columns))
    found: dict[str, int] = {}
    if wanted:
        named = other.withColumn("_name", F.col(name) if name in other.columns else F.col(far).cast("string"))
        for r in named.where(F.col("_name").isin(wanted)).select("_name", far).collect():
            if r[0] in found:
                raise ValueError(f"{r[0]!r} names more than one entry")
            found[r[0]] = r[1]
        if missing := [k for k in wanted if k not in found]:
            raise KeyError(f"unknown keys {missing}")
    if both := [k for k in keys if k in columns and name in other.columns and other.where(F.col(name) == k).limit(1).count()]:
        raise KeyError(f"ambiguous keys {both}")
    out = ids
    if found:
        values = x.where(F.col(far).isin(list(found.values()))).groupBy(key).agg(*(F.sum(F.when(F.col(far) == i, F.col("value"))).alias(f"_x{i}") for i in found.values()))
        out = out.join(values, key, "left")
    for slot in dict.fromkeys(s for s, _ in m_keys):
        out = out.join(require(slots, slot, f"{side}m").select(key, F.col("vec").alias(f"_m_{slot}")), key, "left")
    select = [F.col(key)] + [F.col(k) if k in columns else F.coalesce(f"_x{found[k]}", F.lit(0.0)).alias(k) for k in keys]
    return out.select(*select, *(F.get(f"_m_{s}", F.lit(i)).alias(f"{s}-{i}") for s, i in m_keys))


def obs_df(ds: CellDataset, keys: Sequence[str] = (), obsm_keys: Sequence[tuple[str, int]] = (), layer: str | None = None) -> DataFrame:
    """One row per cell: annotation columns, genes by name (0 where absent) and array elements as ``key-i``, in the order given."""
    return _frame(ds, keys, obsm_keys, layer, "obs")


def var_df(ds: CellDataset, keys: Sequence[str] = (), varm_keys: Sequence[tuple[str, int]] = (), layer: str | None = None) -> DataFrame:
    """The same for genes, with cells by name."""
    return _frame(ds, keys, varm_keys, layer, "var")


def aggregate(ds: CellDataset, by: str | Sequence[str], func: str | Sequence[str], axis: int = 0, layer: str | None = None) -> DataFrame:
    """``(group, gene_id, n_obs_aggregated, <func>...)`` over all cells of each group, absent entries as zeros.

    Several columns make groups by their values joined with ``_``; cells without one are left out. ``axis=1`` groups genes.
    The variance (ddof 1) of a single cell is NaN.
    """
    funcs = [func] if isinstance(func, str) else list(func)
    if bad := [f for f in funcs if f not in FUNCS]:
        raise ValueError(f"unknown functions {bad}")
    x = require(ds.layers, layer, "layers") if layer else ds.X
    if axis == 1:
        ds = CellDataset(x.select(F.col("gene_id").alias("cell_id"), F.col("cell_id").alias("gene_id"), "value"), ds.var.withColumnRenamed("gene_id", "cell_id"), ds.obs.select(F.col("cell_id").alias("gene_id")))
        return aggregate(ds, by, funcs).withColumnRenamed("gene_id", "cell_id")
    names = [by] if isinstance(by, str) else list(by)
    group = F.when(~F.greatest(*(F.col(c).isNull().cast("int") for c in names), F.lit(0)).cast("boolean"), F.concat_ws("_", *(F.col(c).cast("string") for c in names)))
    obs = ds.obs.select("cell_id", group.alias("group"))
    m = group_moments(x, obs, ds.var, "group")
    n = F.col("n").cast("double")
    mean = F.col("s1") / n
    columns = {
        "count_nonzero": F.col("nz"),
        "mean": mean,
        "sum": F.col("s1"),
        "var": F.when(n > 1, F.greatest(F.lit(0.0), (F.col("s2") - n * mean * mean) / (n - 1))).otherwise(F.lit(float("nan"))),
        "median": F.col("median"),
    }
    if "median" in funcs:
        m = m.join(group_medians(x, obs, ds.var), ["group", "gene_id"])
    return m.select("group", "gene_id", F.col("n").alias("n_obs_aggregated"), *(columns[f].alias(f) for f in funcs))


def group_medians(x: DataFrame, obs: DataFrame, var: DataFrame) -> DataFrame:
    """``(group, gene_id, median)`` with the zeros as one block of known size: only stored entries are sorted."""
    labels = obs.where("group is not null")
    sizes = labels.groupBy("group").agg(F.count("*").alias("n"))
    own = x.where("value <> 0").join(labels, "cell_id").select("group", "gene_id", "value")
    counts = own.groupBy("group", "gene_id").agg(F.count("*").alias("k"), F.count_if(F.col("value") < 0).alias("neg"))
    rank = F.row_number().over(Window.partitionBy("group", "gene_id").orderBy("value"))
    met = own.withColumn("r", rank).join(counts, ["group", "gene_id"]).join(F.broadcast(sizes), "group")
    place = F.when(F.col("r") <= F.col("neg"), F.col("r")).otherwise(F.col("r") + F.col("n") - F.col("k"))
    low, high = F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1
    halves = met.withColumn("place", place).groupBy("group", "gene_id").agg(F.sum(F.when(F.col("place") == low, F.col("value"))).alias("a"), F.sum(F.when(F.col("place") == high, F.col("value"))).alias("b"))
    grid = sizes.select("group").crossJoin(var.select("gene_id")).join(halves, ["group", "gene_id"], "left")
    return grid.select("group", "gene_id", ((F.coalesce("a", F.lit(0.0)) + F.coalesce("b", F.lit(0.0))) / 2).alias("median"))
