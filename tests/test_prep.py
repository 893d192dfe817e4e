import numpy as np
import pytest
from cellmesa.operators import prep
from cellmesa.sources import tables

from .helpers import by_gene, counts, dataset, dense

TINY = [[1, 3, 0, 0], [0, 0, 0, 0], [5, 0, 2, 3]]


def test_filters_take_exactly_one_criterion(spark):
    ds = dataset(spark, TINY, stored_zeros={(0, 2)})
    assert {r.cell_id for r in prep.filter_cells(ds, min_genes=2).obs.collect()} == {0, 2}
    assert {r.gene_id for r in prep.filter_genes(ds, min_counts=3).var.collect()} == {0, 1, 3}
    assert prep.filter_genes(ds, min_cells=2).X.count() == 2
    for bad in ({}, {"min_genes": 1, "min_counts": 2}):
        with pytest.raises(ValueError):
            prep.cell_mask(ds, **bad)


def test_normalisation_counts_empty_cells_in_the_median(spark):
    ds = dataset(spark, TINY)
    got = dense(prep.normalize_total(ds).X, (3, 4))
    assert np.allclose(got.sum(1), [4, 0, 4])
    assert np.allclose(dense(prep.normalize_total(ds, 100.0).X, (3, 4)).sum(1), [100, 0, 100])
    for bad in (0.0, -1.0, float("inf")):
        with pytest.raises(ValueError):
            prep.normalize_total(ds, bad)
    with pytest.raises(Exception, match="median"):
        prep.normalize_total(dataset(spark, [[0, 0], [0, 0], [1, 0]])).X.collect()
    kept = prep.normalize_per_cell(ds)
    assert {r.cell_id: r.n_counts for r in kept.obs.collect()} == {0: 4.0, 2: 10.0}
    assert np.allclose(dense(kept.X, (3, 4)).sum(1), [7, 0, 7])


def test_log_and_root_keep_stored_entries(spark):
    ds = dataset(spark, TINY, stored_zeros={(1, 1)})
    assert np.allclose(dense(prep.log1p(ds).X, (3, 4)), np.log1p(TINY)) and prep.log1p(ds).X.count() == 6
    assert np.allclose(dense(prep.sqrt(ds).X, (3, 4)), np.sqrt(TINY))


def test_quality_metrics(spark):
    ds = dataset(spark, TINY, var={"mt": [True, False, True, False]}, stored_zeros={(0, 3)})
    got = {r.cell_id: r for r in prep.qc_cells(ds, ["mt"], [1, 50]).collect()}
    assert [got[i].n_genes_by_counts for i in range(3)] == [2, 0, 3]
    assert got[0].pct_counts_in_top_1_genes == 75 and got[2].pct_counts_in_top_1_genes == 50
    assert got[0].pct_counts_in_top_50_genes == 100 and np.isnan(got[1].pct_counts_in_top_1_genes)
    assert got[2].total_counts_mt == 7 and got[2].pct_counts_mt == 70
    genes = {r.gene_id: r for r in prep.qc_genes(ds).collect()}
    assert genes[3].n_cells_by_counts == 1 and genes[3].mean_counts == 1 and abs(genes[3].pct_dropout_by_counts - 200 / 3) < 1e-9
    assert prep.qc_cells(ds, log1p=False, percent_top=[]).columns == ["cell_id", "n_genes_by_counts", "total_counts"]
    with pytest.raises(ValueError):
        prep.qc_cells(ds, percent_top=[0])


def seurat(a):
    e = np.expm1(a)
    mean, var = e.mean(0), e.var(0, ddof=1)
    var[var < 1e-20] = 0
    mean[mean == 0] = 1e-12
    with np.errstate(divide="ignore"):
        disp = np.where(var == 0, np.nan, np.log(np.where(var == 0, 1, var) / mean))
    means = np.log1p(mean)
    edges = np.linspace(means.min(), means.max(), 21)
    at = np.clip(np.ceil((means - edges[0]) / (edges[-1] - edges[0]) * 20 - 1e-12), 1, 20)
    norm = np.full(len(means), np.nan)
    for b in np.unique(at):
        d = disp[at == b]
        ok = ~np.isnan(d)
        with np.errstate(invalid="ignore", divide="ignore"):
            norm[at == b] = np.where(ok, 1.0 if ok.sum() == 1 else (d - d[ok].mean() if ok.any() else d) / (d[ok].std(ddof=1) if ok.sum() > 1 else 1), np.nan)
    return means, norm


def test_variable_genes(spark):
    a = np.log1p(counts(1, 40, 60))
    a[:, 5] = 0
    a[:, 6] = 1.0
    ds = dataset(spark, a)
    table = prep.dispersions(ds)
    means, norm = seurat(a)
    assert np.allclose(by_gene(table, "means", 60), means)
    assert np.allclose(by_gene(table, "dispersions_norm", 60), norm, equal_nan=True)
    top = prep.highly_variable_genes(ds, 10)
    picked = {r.gene_id for r in top.collect() if r.highly_variable}
    assert picked == set(np.argsort(-np.where(np.isnan(norm), -np.inf, norm))[:10].tolist())
    assert prep.highly_variable_genes(ds, 1000).where("highly_variable").count() == int((~np.isnan(norm)).sum())
    with pytest.raises(ValueError):
        prep.dispersions(ds, "other")


def test_ties_of_dispersion_widen_the_selection(spark):
    a = np.log1p(counts(2, 20, 60))
    ds = dataset(spark, np.hstack([a, a]))
    n = prep.highly_variable_genes(ds, 3).where("highly_variable").count()
    assert n == 4


def test_cell_ranger(spark):
    a = counts(3, 50, 80).astype(float)
    table = prep.dispersions(dataset(spark, a), "cell_ranger")
    mean = np.where(a.mean(0) == 0, 1e-12, a.mean(0))
    disp = a.var(0, ddof=1) / mean
    edges = np.percentile(mean, np.arange(10, 105, 5))
    at = (edges[None, :] < mean[:, None]).sum(1)
    want = np.empty(80)
    for b in np.unique(at):
        d = disp[at == b]
        med = np.median(d)
        with np.errstate(invalid="ignore", divide="ignore"):
            want[at == b] = (d - med) / (np.median(np.abs(d - med)) / 0.6744897501960817)
    got = by_gene(table, "dispersions_norm", 80)
    ok = np.isfinite(want)
    assert np.allclose(got[ok], want[ok])
    with pytest.raises(Exception, match="coincide"):
        prep.dispersions(dataset(spark, np.ones((4, 3))), "cell_ranger").collect()


def test_scaling(spark):
    a = counts(4, 25, 9).astype(float)
    a[:, 3] = 2.0
    ds = dataset(spark, a)
    sd = a.std(0, ddof=1)
    sd[sd == 0] = 1
    want = (a - a.mean(0)) / sd
    assert np.allclose(dense(prep.scale(ds).X, a.shape), want)
    assert np.allclose(dense(prep.scale(ds, max_value=1.0).X, a.shape), np.clip(want, -1, 1))
    assert np.allclose(dense(prep.scale(ds, zero_center=False, max_value=1.5).X, a.shape), np.minimum(a / sd, 1.5))
    assert (dense(prep.scale(ds).X, a.shape)[:, 3] == 0).all()
    with pytest.raises(Exception, match="two cells"):
        prep.scale(dataset(spark, [[1, 2]])).X.collect()


def test_samples(spark):
    ds = dataset(spark, counts(5, 40, 6))
    got = {r.cell_id for r in prep.subsample(ds, fraction=0.5, seed=1).obs.collect()}
    assert len(got) == 20 and got == {r.cell_id for r in prep.subsample(ds, n_obs=20, seed=1).obs.collect()}
    assert prep.sample(ds, 100, replace=True).count() == 100 and prep.sample(ds, 7).distinct().count() == 7
    with pytest.raises(TypeError):
        prep.subsample(ds)
    with pytest.raises(ValueError):
        prep.subsample(ds, fraction=1.5)


@pytest.mark.parametrize("replace", [False, True])
def test_thinning(spark, replace):
    a = counts(6, 12, 7) * 10
    a[3] = [0, 0, 2, 0, 0, 0, 0]
    ds = dataset(spark, a, stored_zeros={(3, 0)})
    got = dense(prep.downsample_counts(ds, counts_per_cell=30, seed=2, replace=replace).X, a.shape)
    assert (got.sum(1) == np.minimum(a.sum(1), 30)).all() and (replace or (got <= a).all()) and ((got > 0) <= (a > 0)).all()
    total = dense(prep.downsample_counts(ds, total_counts=100, seed=2, replace=replace).X, a.shape)
    assert total.sum() == 100 and (replace or (total <= a).all())
    assert prep.downsample_counts(ds, total_counts=10**9).X.where("value = 0").count() == 0
    with pytest.raises(Exception, match="whole"):
        prep.downsample_counts(dataset(spark, [[0.5, 3.0]]), counts_per_cell=1).X.collect()


def test_thinning_keeps_expected_shares(spark):
    ds = dataset(spark, np.tile([100, 200, 300, 400], (60, 1)))
    got = dense(prep.downsample_counts(ds, counts_per_cell=100, seed=1).X, (60, 4)).mean(0)
    assert np.abs(got - [10, 20, 30, 40]).max() < 2


def test_dataset_files_and_blocks(spark, tmp_path):
    ds = dataset(spark, counts(7, 23, 5), obs={"g": ["a"] * 23})
    ds.with_(obsm={"X_pca": spark.createDataFrame([(0, [1.0, 2.0])], "cell_id long, vec array<double>")}).write(f"file://{tmp_path}/d")
    back = tables.open_backed(spark, f"file://{tmp_path}/d")
    assert sorted(back.X.collect()) == sorted(ds.X.collect()) and back.obs.columns == ["cell_id", "g"]
    blocks = sorted(tables.row_blocks(ds, 10).collect())
    assert [(b.start, b.n_rows) for b in blocks] == [(0, 10), (10, 10), (20, 3)] and sum(b.n_stored for b in blocks) == ds.X.count()
    assert tables.block_size_for(1000, 0.1, 1.0) == 2**30 // (4000 + 800 + 4) and tables.block_size_for(1000, chunk_size=7) == 7
    for bad in (lambda: tables.open_backed(spark, "x.h5ad"), lambda: tables.row_blocks(ds, 0)):
        with pytest.raises(ValueError):
            bad()
    broken = ds.with_(X=ds.X.union(spark.createDataFrame([(99, 0, 1.0), (0, 99, 1.0), (0, 99, 2.0)], ds.X.schema)))
    assert {r.problem: r.n for r in broken.problems().collect()} == {"unknown cell": 1, "unknown gene": 2, "repeated entry": 1}
    assert 0 < ds.density() < 1


def test_matrix_is_rewritten_on_disk(spark, tmp_path):
    a = counts(8, 15, 4)
    path = f"file://{tmp_path}/d"
    dataset(spark, a).write(path)
    back = tables.rewrite_matrix(spark, path, lambda ds: prep.log1p(prep.normalize_total(ds, 100.0)))
    total = a.sum(1, keepdims=True)
    assert np.allclose(dense(back.X, a.shape), np.log1p(a * 100 / np.where(total == 0, 1, total)))
    with pytest.raises(ValueError):
        tables.rewrite_matrix(spark, path, lambda ds: ds.with_(X=ds.X.where("cell_id < 3")))
    assert tables.open_backed(spark, path).X.count() == (a > 0).sum()
