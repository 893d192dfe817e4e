"""Gene-set scores against control genes of similar mean."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import CellDataset
from .stats import gene_moments


def known_genes(ds: CellDataset, genes: Sequence[int]) -> list[int]:
    """The requested genes that the data has; missing ones are a warning, none at all an error."""
    asked = ds.X.sparkSession.createDataFrame([(int(g),) for g in dict.fromkeys(genes)], "gene_id long")
    found = {r[0] for r in asked.join(ds.var, "gene_id", "left_semi").collect()}
    if missing := [g for g in genes if g not in found]:
        warnings.warn(f"genes that the data does not have: {missing[:10]}", stacklevel=3)
    if not found:
        raise ValueError("none of the genes is in the data")
    return [g for g in dict.fromkeys(genes) if g in found]


def control_genes(ds: CellDataset, genes: Sequence[int], ctrl_size: int = 50, n_bins: int = 25, seed: int = 0) -> list[int]:
    """Genes of the bins (by rank of mean) that hold the given ones. Of a bin with more than ``ctrl_size`` genes, as many as
    that are drawn, bin after bin, from one legacy stream of numpy; given genes are then left out."""
    own = ds.X.sparkSession.createDataFrame([(int(g), True) for g in genes], "gene_id long, own boolean")
    means = gene_moments(ds.X, ds.obs, ds.var).select("gene_id", "mean").join(F.broadcast(own), "gene_id", "left")
    # one row per gene: ranks, and which bins hold a given gene, in one pass over the means
    items = F.greatest(F.lit(1.0), F.bround(F.count("*").over(Window.partitionBy()) / (n_bins - 1)))
    ranked = means.select("gene_id", "own", F.floor(F.rank().over(Window.orderBy("mean")) / items).alias("bin"))
    held = ranked.withColumn("held", F.max("own").over(Window.partitionBy("bin"))).where("held")
    pool: dict[int, list[int]] = {}
    for b, g in held.select("bin", "gene_id").orderBy("bin", "gene_id").collect():
        pool.setdefault(b, []).append(g)
    rng, out = np.random.RandomState(seed), []
    for b in sorted(pool):
        members = pool[b]
        out += [members[i] for i in rng.permutation(len(members))[:ctrl_size]] if ctrl_size < len(members) else members
    taken = set(genes)
    return sorted({g for g in out if g not in taken})


def score_genes(ds: CellDataset, gene_list: Sequence[int], ctrl_size: int = 50, n_bins: int = 25, seed: int = 0, score_name: str = "score") -> DataFrame:
    """``(cell_id, score)``: mean of the set minus mean of its controls."""
    genes = known_genes(ds, gene_list)
    control = control_genes(ds, genes, ctrl_size, n_bins, seed)
    if not control:
        raise ValueError("no control genes are left")
    spark = ds.X.sparkSession
    weights = spark.createDataFrame([(int(g), 1.0 / len(genes)) for g in genes] + [(int(g), -1.0 / len(control)) for g in control], "gene_id long, w double")
    sums = ds.X.join(F.broadcast(weights), "gene_id").groupBy("cell_id").agg(F.sum(F.col("value") * F.col("w")).alias("s"))
    return ds.obs.select("cell_id").join(sums, "cell_id", "left").select("cell_id", F.coalesce("s", F.lit(0.0)).alias(score_name))


def score_genes_cell_cycle(ds: CellDataset, s_genes: Sequence[int], g2m_genes: Sequence[int], ctrl_size: int | None = None) -> DataFrame:
    """``(cell_id, s_score, g2m_score, phase)``."""
    size = ctrl_size if ctrl_size is not None else min(len(s_genes), len(g2m_genes))
    s, g = (score_genes(ds, x, size, score_name=n) for x, n in ((s_genes, "s_score"), (g2m_genes, "g2m_score")))
    phase = F.when((F.col("s_score") < 0) & (F.col("g2m_score") < 0), "G1").when(F.col("g2m_score") > F.col("s_score"), "G2M").otherwise("S")
    return s.join(g, "cell_id").withColumn("phase", phase)
