"""Tidy frames of a dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .model import CellDataset, require
from .operators import access, de

obs_df, var_df, aggregate = access.obs_df, access.var_df, access.aggregate


def rank_genes_groups_df(ds: CellDataset, group=None, *, key: str = "rank_genes_groups", pval_cutoff: float | None = None, log2fc_min: float | None = None, log2fc_max: float | None = None) -> DataFrame:
    return de.rank_genes_groups_df(require(ds.uns, key, "uns")["table"], group, pval_cutoff, log2fc_min, log2fc_max)


__all__ = ["aggregate", "obs_df", "rank_genes_groups_df", "var_df"]
