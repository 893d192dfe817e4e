"""Aggregates that count absent entries as zeros, and p-value adjustment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def scalar(df: DataFrame) -> DataFrame:
    """A one-row table, for a cross join that Spark broadcasts whatever the input's size."""
    return F.broadcast(df)


def n_cells(obs: DataFrame) -> DataFrame:
    return scalar(obs.agg(F.count("*").alias("n_cells")))


def gene_moments(x: DataFrame, obs: DataFrame, var: DataFrame, value: Column | None = None) -> DataFrame:
    """``(gene_id, mean, var)`` over all cells, ddof 1. Stored entries are merged with the block of zeros (Chan et al.), so
    large means do not cancel. One cell has variance 0."""
    v = value if value is not None else F.col("value")
    own = x.groupBy("gene_id").agg(F.count(v).alias("k"), F.avg(v).alias("m"), F.coalesce(F.var_pop(v), F.lit(0.0)).alias("s"))
    all_ = var.select("gene_id").join(own, "gene_id", "left").crossJoin(n_cells(obs))
    k, m, n = F.coalesce("k", F.lit(0)), F.coalesce("m", F.lit(0.0)), F.col("n_cells")
    square = k * F.coalesce("s", F.lit(0.0)) + F.try_divide(m * m * k * (n - k), n)
    return all_.select("gene_id", F.try_divide(k * m, n).alias("mean"), F.when(n > 1, square / (n - 1)).otherwise(F.lit(0.0)).alias("var"))


def group_moments(x: DataFrame, obs: DataFrame, var: DataFrame, group: str, value: Column | None = None) -> DataFrame:
    """``(group, gene_id, n, s1, s2, nz, n_all, t1, t2, tz)``: sums, sums of squares and counts of entries that are not zero by
    group and gene, and over all groups. Cells without a group are left out."""
    v = value if value is not None else F.col("value")
    labels = obs.where(F.col(group).isNotNull()).select("cell_id", F.col(group).cast("string").alias("group"))
    sizes = labels.groupBy("group").agg(F.count("*").alias("n"))
    own = x.withColumn("_v", v).join(labels, "cell_id").groupBy("group", "gene_id").agg(F.sum("_v").alias("s1"), F.sum(F.col("_v") * F.col("_v")).alias("s2"), F.count_if(F.col("_v") != 0).alias("nz"))
    grid = sizes.crossJoin(var.select("gene_id")).join(own, ["group", "gene_id"], "left").fillna(0, ["s1", "s2", "nz"])
    w = Window.partitionBy("gene_id")
    return grid.select("group", "gene_id", "n", "s1", "s2", "nz", F.sum("n").over(w).alias("n_all"), F.sum("s1").over(w).alias("t1"), F.sum("s2").over(w).alias("t2"), F.sum("nz").over(w).alias("tz"))


def bh(df: DataFrame, p: str, by: list[str], out: str = "pval_adj") -> DataFrame:
    """Benjamini-Hochberg within ``by``; p-values that are null or not finite are left out and passed through."""
    ok = F.col(p).isNotNull() & ~F.isnan(p) & (F.abs(F.col(p)) != float("inf"))
    ranked = df.where(ok)
    up = Window.partitionBy(*by).orderBy(p)
    n = F.count("*").over(Window.partitionBy(*by))
    ranked = ranked.withColumn("_rn", F.row_number().over(up)).withColumn("_q", F.col(p) * n / F.col("_rn"))
    down = Window.partitionBy(*by).orderBy(F.desc("_rn")).rowsBetween(Window.unboundedPreceding, 0)
    done = ranked.withColumn(out, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.min("_q").over(down)))).drop("_rn", "_q")
    return done.unionByName(df.where(~ok | F.col(p).isNull()).withColumn(out, F.col(p).cast("double")))


def bonferroni(df: DataFrame, p: str, by: list[str], out: str = "pval_adj") -> DataFrame:
    n = F.count(F.when(~F.isnan(p), F.col(p))).over(Window.partitionBy(*by))
    return df.withColumn(out, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(p) * n)))
