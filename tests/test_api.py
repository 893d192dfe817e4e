import numpy as np
import pytest
from cellmesa import get, metrics, pp, tl
from cellmesa.settings import Settings

from .helpers import dataset


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.RandomState(1)
    rate = np.full((6, 60), 0.2)
    for g in range(6):
        rate[g, g * 10 : g * 10 + 10] = 25
    a = np.vstack([rng.poisson(rate[g], (14, 60)) for g in range(6)])
    groups = [f"group{g}" for g in range(6) for _ in range(14)]
    return dataset(spark, a, {"group": groups, "batch": [str(i % 2) for i in range(84)]}, {"var_name": [f"gene{j}" for j in range(60)], "mt": [j % 7 == 0 for j in range(60)]})


def test_the_whole_path(spark, blobs):
    ds = pp.calculate_qc_metrics(blobs, qc_vars=["mt"], percent_top=[5])
    assert "pct_counts_mt" in ds.obs.columns and "log1p_mean_counts" in ds.var.columns
    ds = pp.log1p(pp.normalize_total(pp.filter_genes(ds, min_cells=3), 1e4))
    ds = pp.highly_variable_genes(ds, n_top_genes=40)
    ds = pp.neighbors(pp.pca(ds, n_comps=10), n_neighbors=8)
    cut = lambda df: spark.createDataFrame(df.collect(), df.schema)  # noqa: E731  the graph is used many times
    ds = ds.with_(obsp={k: cut(v) for k, v in ds.obsp.items()}, obsm={k: cut(v) for k, v in ds.obsm.items()})
    ds = tl.leiden(ds)
    ds = ds.with_(obs=cut(ds.obs))
    table = {(r.row, r.column): r.value for r in metrics.confusion_matrix("group", "leiden", ds.obs).collect()}
    assert sum(v for (row, _), v in table.items() if row.startswith("group") and v == 1) == 6
    assert metrics.modularity(ds, "leiden") > 0.7
    ds = tl.paga(ds)
    assert ds.uns["paga"]["sizes"].count() == 6
    ds = tl.rank_genes_groups(ds, "group")
    top = get.rank_genes_groups_df(ds, "group3").where("rank < 10").collect()
    assert {r.gene_id for r in top} == set(range(30, 40))
    assert tl.marker_gene_overlap(ds, {"m": list(range(10))}, top_n_markers=10).where("group = 'group0'").first().overlap_count == 10
    ds = tl.filter_rank_genes_groups(ds)
    assert ds.uns["rank_genes_groups_filtered"]["table"].where("name is not null").count() == 60
    ds = tl.score_genes(ds, list(range(10)), ctrl_size=5, score_name="s0")
    assert get.obs_df(ds, ["s0", "group", "gene1"], [("X_pca", 0)]).columns == ["cell_id", "s0", "group", "gene1", "X_pca-0"]
    ds = tl.dendrogram(tl.embedding_density(tl.umap(ds, n_epochs=30), groupby="group"), "group", n_pcs=10)
    assert len(ds.uns["dendrogram_group"]["categories_ordered"]) == 6 and "umap_density_group" in ds.obs.columns
    assert metrics.morans_i(ds, vals=["gene1", "gene2"]).count() == 2 and metrics.gearys_c(ds, vals="s0").count() == 1
    assert get.aggregate(ds, "group", "mean").count() == 6 * ds.var.count()


def test_slots_that_are_missing(blobs):
    for bad in (lambda: pp.neighbors(blobs), lambda: tl.leiden(blobs), lambda: tl.umap(blobs), lambda: tl.dpt(blobs), lambda: get.rank_genes_groups_df(blobs), lambda: metrics.morans_i(blobs)):
        with pytest.raises(KeyError):
            bad()
    for bad in (lambda: tl.paga(blobs), lambda: tl.paga(blobs, "group", model="v1.0"), lambda: pp.calculate_qc_metrics(blobs)):
        with pytest.raises(ValueError):
            bad()


def test_the_surface_is_complete():
    assert [len(m.__all__) for m in (pp, tl, metrics, get)] == [18, 15, 4, 4]
    assert all(callable(getattr(m, n)) for m in (pp, tl, metrics, get) for n in m.__all__)


def test_settings():
    s = Settings()
    s.verbosity = "hint"
    s.max_memory_gb, s.chunk_size = 2, 10
    assert (s.verbosity, s.max_memory_gb, s.chunk_size) == (3, 2.0, 10)
    for name, value in (("verbosity", "loud"), ("verbosity", 9), ("max_memory_gb", 0), ("chunk_size", -1)):
        with pytest.raises(ValueError):
            setattr(s, name, value)
