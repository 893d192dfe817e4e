"""Preprocessing on datasets: each function returns a new dataset, or a table where a table is the result."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .model import CellDataset, require
from .operators import batch, graph, linalg, prep

filter_cells, filter_genes = prep.filter_cells, prep.filter_genes
normalize_total, normalize_per_cell, log1p, sqrt, scale = prep.normalize_total, prep.normalize_per_cell, prep.log1p, prep.sqrt, prep.scale
subsample, sample, downsample_counts = prep.subsample, prep.sample, prep.downsample_counts
regress_out = linalg.regress_out


def calculate_qc_metrics(ds: CellDataset, *, qc_vars: Sequence[str] = (), percent_top: Sequence[int] | None = (50, 100, 200, 500), log1p: bool = True) -> CellDataset:
    """The metrics as columns of ``obs`` and ``var``. Asking for more top genes than there are is an error."""
    if percent_top:
        n = ds.var.count()
        if max(percent_top) > n:
            raise ValueError(f"percent_top asks for more than the {n} genes")
    cells = prep.qc_cells(ds, qc_vars, percent_top or (), log1p)
    return ds.with_(obs=ds.obs.join(cells, "cell_id"), var=ds.var.join(prep.qc_genes(ds, log1p), "gene_id"))


def highly_variable_genes(ds: CellDataset, *, n_top_genes: int = 2000, flavor: str = "seurat") -> CellDataset:
    return ds.with_(var=ds.var.join(prep.highly_variable_genes(ds, n_top_genes, flavor), "gene_id"))


def filter_genes_dispersion(ds: CellDataset, *, flavor: str = "seurat", n_top_genes: int | None = None) -> CellDataset:
    """Flags genes in ``var``; nothing is dropped."""
    return ds.with_(var=ds.var.join(prep.filter_genes_dispersion(ds, flavor, n_top_genes), "gene_id"))


def combat(ds: CellDataset, key: str = "batch", *, covariates: Sequence[str] | None = None) -> CellDataset:
    return batch.combat(ds, key, covariates or ())


def pca(ds: CellDataset, *, n_comps: int = 50, zero_center: bool = True) -> CellDataset:
    """``obsm.X_pca``, ``varm.PCs`` and the explained variance in ``uns.pca``."""
    scores, loadings, info = linalg.pca(ds, n_comps, zero_center)
    return ds.with_(obsm={**ds.obsm, "X_pca": scores}, varm={**ds.varm, "PCs": loadings}, uns={**ds.uns, "pca": info})


def neighbors(ds: CellDataset, *, n_neighbors: int = 15, use_rep: str = "X_pca") -> CellDataset:
    """``obsp.distances`` and ``obsp.connectivities`` of a representation."""
    near = graph.knn(require(ds.obsm, use_rep, "obsm"), n_neighbors)
    distances = near.select("src", "dst", F.col("dist").alias("weight"))
    made = {"distances": distances, "connectivities": graph.connectivities(near, n_neighbors)}
    return ds.with_(obsp={**ds.obsp, **made}, uns={**ds.uns, "neighbors": {"n_neighbors": n_neighbors, "use_rep": use_rep}})


def harmony_integrate(ds: CellDataset, key: str = "batch", *, basis: str = "X_pca", adjusted_basis: str = "X_pca_harmony", **options) -> CellDataset:
    points: DataFrame = require(ds.obsm, basis, "obsm").join(ds.obs.select("cell_id", key), "cell_id")
    return ds.with_(obsm={**ds.obsm, adjusted_basis: batch.harmony_integrate(points, key, **options)})


__all__ = [
    "calculate_qc_metrics", "combat", "downsample_counts", "filter_cells", "filter_genes", "filter_genes_dispersion", "harmony_integrate", "highly_variable_genes",
    "log1p", "neighbors", "normalize_per_cell", "normalize_total", "pca", "regress_out", "sample", "scale", "sqrt", "subsample",
]
