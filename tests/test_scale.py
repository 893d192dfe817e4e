"""Forms of operators that are there for large inputs, against the plain ones."""

import numpy as np
import pytest
from cellmesa.functions.krylov import leading_eigenpairs
from cellmesa.model import CellDataset
from cellmesa.operators import de, graph, kernels, linalg, prep
from cellmesa.settings import settings
from cellmesa.sources import tables
from pyspark.sql import functions as F

from .helpers import counts, dataset, dense
from .test_graph import cliques, edges, points


@pytest.mark.parametrize(("n", "k", "by_size"), [(5, 5, False), (60, 4, True), (400, 7, True), (400, 7, False)])
def test_leading_eigenpairs(n, k, by_size):
    a = np.random.RandomState(n).normal(size=(n, n))
    a = a + a.T
    a[:, : n // 10] = a[: n // 10, :] = 0  # a null space
    values, vectors = leading_eigenpairs(lambda v: a @ v, n, k, by_size=by_size, most=60)
    every = np.linalg.eigvalsh(a)
    want = np.sort(every[np.argsort(-np.abs(every) if by_size else -every, kind="stable")[:k]])[::-1]
    assert np.allclose(values, want, atol=1e-8) and np.allclose(a @ vectors, vectors * values, atol=1e-6)
    assert np.allclose(vectors.T @ vectors, np.eye(k), atol=1e-8)


def test_equal_eigenvalues_are_all_found():
    ring = np.roll(np.eye(300), 1, 0) + np.roll(np.eye(300), -1, 0)
    values, _ = leading_eigenpairs(lambda v: ring @ v, 300, 5, most=80)
    assert np.allclose(values, 2 * np.cos(2 * np.pi * np.array([0, 1, 1, 2, 2]) / 300), atol=1e-8)


@pytest.mark.parametrize("centred", [True, False])
def test_components_of_many_genes(spark, centred):
    a = counts(3, 80, 40).astype(float)
    a[5] = 0
    ds = dataset(spark, a)
    whole, products = (linalg.pca(ds, 6, centred, most_genes=m) for m in (100, 0))
    assert np.allclose(whole[2]["variance"], products[2]["variance"]) and np.allclose(whole[2]["variance_ratio"], products[2]["variance_ratio"])
    scores = [np.array([r.vec for r in x[0].orderBy("cell_id").collect()]) for x in (whole, products)]
    assert np.allclose(scores[0], scores[1], atol=1e-5)
    b = a - a.mean(0) if centred else a
    assert np.allclose(np.abs(np.linalg.svd(b, full_matrices=False)[0][:, :6] * np.linalg.svd(b)[1][:6]), np.abs(scores[0]), atol=1e-8)


def test_implicit_centring(spark):
    a = counts(4, 30, 8).astype(float)
    a[:, 3] = 2
    ds = dataset(spark, a)
    got = prep.scale_sparse(ds, 1.5)
    offset = {r.gene_id: r.offset for r in got.var.collect()}
    want = dense(prep.scale(ds, max_value=1.5).X, a.shape)
    assert got.X.count() == ds.X.count()
    assert np.allclose(dense(got.X, a.shape) + np.array([offset[j] for j in range(8)]), want)
    full = dataset(spark, want, stored_zeros={(i, j) for i in range(30) for j in range(8)})
    assert np.allclose(linalg.pca(got, 3)[2]["variance"], linalg.pca(full, 3)[2]["variance"])


@pytest.mark.parametrize("target", [0, 1, 50, 119, 120, 500])
def test_a_whole_matrix_is_thinned_to_the_smallest_hashes(spark, target):
    import hashlib

    a = counts(6, 12, 5).astype(float)
    a = a * (120 / a.sum()) // 1
    a[0, 0] += 120 - a.sum()
    got = dense(prep.downsample_counts(dataset(spark, a), total_counts=target, seed=5).X, a.shape)
    slots = sorted((hashlib.md5(f"5-{i}-{j}-{k}".encode()).hexdigest(), i, j) for i in range(12) for j in range(5) for k in range(1, int(a[i, j]) + 1))
    want = np.zeros_like(a)
    for _, i, j in slots[:target]:
        want[i, j] += 1
    assert np.array_equal(got, a if target >= 120 else want)


def test_numbers_of_rows(spark):
    ids = np.random.RandomState(1).permutation(5000)[:700]
    df = spark.createDataFrame([(int(i), str(i)) for i in ids], "cell_id long, name string").repartition(7)
    got = prep.numbered(df, "cell_id", 16).collect()
    assert [(r.cell_id, r.at) for r in sorted(got, key=lambda r: r.at)] == [(int(x), k) for k, x in enumerate(np.sort(ids))]
    assert prep.numbered(df.limit(0), "cell_id").count() == 0


def test_blocks_of_a_backed_dataset(spark, tmp_path, monkeypatch):
    a = counts(2, 23, 6).astype(float)
    ds = dataset(spark, a)
    path = f"file://{tmp_path}/d"
    table = spark.createDataFrame([(1, 2.0)], "gene_id long, score double")
    ds.with_(uns={"iroot": 3, "log1p": {"base": None}, "genes": {"table": table, "names": ["x", "y"]}}, obsm={"X_pca": ds.obs.select("cell_id", F.array(F.lit(1.0)).alias("vec"))}).write(path)
    back = tables.open_backed(spark, path)
    assert back.uns["iroot"] == 3 and back.uns["log1p"] == {"base": None} and back.uns["genes"]["names"] == ["x", "y"]
    assert back.uns["genes"]["table"].collect() == table.collect() and back.obsm["X_pca"].count() == 23
    parts = list(tables.blocks(back, 10))
    assert [(x, y) for x, y, _ in parts] == [(0, 10), (10, 20), (20, 23)]
    for x, y, part in parts:
        assert part.obs.count() == y - x and np.allclose(dense(part.X, a.shape)[x:y], a[x:y])
    monkeypatch.setattr(settings, "_chunk_size", 12)
    assert [(x, y) for x, y, _ in tables.blocks(back)] == [(0, 12), (12, 23)]
    with pytest.raises(ValueError):
        next(tables.blocks(back, 0))


def test_a_rewriting_that_was_cut_off(spark, tmp_path):
    ds = dataset(spark, counts(2, 9, 4).astype(float))
    path = f"file://{tmp_path}/d"
    ds.write(path)
    (tmp_path / "d" / "X").rename(tmp_path / "d" / "X.old")
    assert tables.open_backed(spark, path).X.count() == ds.X.count()
    out = tables.rewrite_matrix(spark, path, prep.log1p)
    assert not (tmp_path / "d" / "X.old").exists() and np.allclose(dense(out.X, (9, 4)), np.log1p(dense(ds.X, (9, 4))))
    with pytest.raises(ValueError):
        tables.rewrite_matrix(spark, path, lambda d: d.with_(X=d.X.limit(1)))
    assert tables.open_backed(spark, path).X.count() == ds.X.count()


def test_too_many_rows_never_reach_the_task(spark):
    e = edges(spark, cliques(3, 5))
    for call in (lambda: kernels.leiden(e, most=1), lambda: kernels.umap(e, most=1), lambda: graph.diffmap(e, 3, most=1), lambda: kernels.tsne(points(spark, np.eye(9)), perplexity=2.0, most=8)):
        with pytest.raises(Exception, match="more than"):
            call().collect()
    table = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 0.5)], "g1 string, g2 string, connectivity double")
    with pytest.raises(ValueError):
        graph.spanning_forest(table, most=2)
    with pytest.raises(ValueError):
        graph.dendrogram(points(spark, np.eye(9), label=list("abcdefghi")), "label", most=8)


def test_neighbours_among_equal_and_distant_points(spark):
    rng = np.random.RandomState(0)
    a = np.concatenate([np.repeat(rng.normal(size=(3, 5)), 9, 0), 1e6 + rng.normal(size=(20, 5)) * 1e-3, rng.normal(size=(20, 5))])
    got = graph.knn(points(spark, a), 5).orderBy("src", "rank").collect()
    d = np.sqrt(((a[:, None] - a[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    want = np.argsort(d, axis=1, kind="stable")[:, :4]
    assert np.array_equal(np.array([r.dst for r in got]).reshape(-1, 4), want)
    assert np.array_equal(np.array([r.dist for r in got]).reshape(-1, 4), np.take_along_axis(d, want, 1))


def test_fold_changes_of_another_grouping(spark):
    a = np.log(1 + counts(5, 40, 6)) / np.log(2)
    labels = ["u" if i % 4 else "v" for i in range(40)]
    ds = dataset(spark, a, {"grp": ["x" if i % 2 else "y" for i in range(40)], "other": labels})
    ds = ds.with_(uns={"log1p": {"base": 2.0}})
    table = spark.createDataFrame([(g, j, 99.0) for g in "uv" for j in range(6)], "group string, gene_id long, logfoldchange double")
    got = {(r.group, r.gene_id): r.name for r in de.filter_rank_genes_groups(ds, table, "other", 0.1, 1.1, 0.1, own_folds=True).collect()}
    for g in "uv":
        own = np.array(labels) == g
        fold = np.log2((2 ** a[own].mean(0) - 1 + 1e-9) / (2 ** a[~own].mean(0) - 1 + 1e-9))
        share = (a[own] != 0).mean(0)
        assert [got[(g, j)] for j in range(6)] == [j if fold[j] > 0.1 and share[j] > 0.1 else None for j in range(6)]
    assert all(v is not None for v in {(r.group, r.gene_id): r.name for r in de.filter_rank_genes_groups(ds, table, "other", -1.0, 1.1, 0.1).collect()}.values())


def test_values_below_zero_in_ranks(spark):
    rng = np.random.RandomState(7)
    a = rng.normal(size=(41, 12)).round(1)
    a[a > 0.2] = 0
    a[:, 2], a[:, 5], a[:, 7] = 0, -1.5, np.abs(a[:, 7])
    groups = ["a"] * 14 + ["b"] * 15 + ["c"] * 12
    ds = dataset(spark, a, {"grp": groups})
    labels = ds.obs.select("cell_id", F.col("grp").alias("group"))
    for reference in ("rest", "b"):
        for r in de.rank_sums(ds, labels, reference).collect():
            col, own = a[:, r.gene_id], np.array(groups) == r.group
            use = np.ones(41, bool) if reference == "rest" else own | (np.array(groups) == reference)
            v = col[use]
            rank = np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])
            ties = sum(k**3 - k for k in np.unique(v, return_counts=True)[1].tolist())
            assert abs(r.rank_sum - rank[own[use]].sum()) < 1e-9 and abs(r.ties - ties) < 1e-6 and r.n_all == use.sum()


def test_logistic_regression_takes_cells_without_entries(spark):
    a = counts(1, 30, 5).astype(float)
    a[4] = a[9] = 0
    ds = dataset(spark, a, {"grp": ["x" if i % 2 else "y" for i in range(30)]})
    assert de.logreg(ds, "grp").count() == 10
    assert isinstance(ds, CellDataset)


@pytest.mark.parametrize("target", [0, 7, 40, 70_000])
def test_cells_are_thinned_to_the_smallest_hashes_without_a_row_for_a_slot(spark, target):
    import hashlib

    a = counts(8, 9, 6).astype(float)
    a[4], a[5], a[6] = [0, 1, 3, 0, 0, 2], [150_000, 0, 1, 20, 0, 9], 0
    ds = dataset(spark, a, stored_zeros={(4, 0)})
    thinned = prep.downsample_counts(ds, counts_per_cell=target, seed=5).X
    plan = thinned._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Window" not in plan
    want = a.copy()
    for i in np.flatnonzero(a.sum(1) > target):
        slots = sorted((hashlib.md5(f"5-{i}-{j}-{k}".encode()).digest(), j) for j in range(6) for k in range(1, int(a[i, j]) + 1))
        want[i] = np.bincount([j for _, j in slots[:target]], minlength=6)
    assert np.array_equal(dense(thinned, a.shape), want) and thinned.where("value = 0").count() == 0


def test_draws_with_replacement_join_nothing(spark):
    import hashlib

    a = counts(8, 9, 6).astype(float)
    a[4], a[6] = [0, 1, 3, 0, 0, 2], 0
    ds = dataset(spark, a, stored_zeros={(4, 0)})
    thinned = prep.downsample_counts(ds, counts_per_cell=12, seed=5, replace=True).X
    plan = thinned._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan
    want = a.copy()
    for i in np.flatnonzero(a.sum(1) > 12):
        u = [int(hashlib.md5(f"5-{i}-{k}".encode()).hexdigest()[:12], 16) / 2**48 * a[i].sum() for k in range(1, 13)]
        want[i] = np.bincount(np.searchsorted(np.cumsum(a[i]), u, side="right"), minlength=6)
    assert np.array_equal(dense(thinned, a.shape), want) and thinned.where("value = 0").count() == 0


def test_branches_by_distances_that_are_worked_out():
    rng = np.random.RandomState(3)
    x = rng.normal(size=(300, 4)) * [5, 3, 1, 1]
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    for n in (0, 1, 3):
        assert np.array_equal(kernels.branches(kernels._Distances(x), 7, n, 3), kernels.branches(d, 7, n, 3))


def test_branches_of_more_cells_than_a_matrix_holds(spark):
    n = 6000
    t = np.linspace(0, 1, n)
    rows = [(i, [1.0, float(t[i]), float(t[i] * (i % 3 == 0)), float(t[i] * (i % 3 == 1))], [1.0, 0.9, 0.8, 0.8]) for i in range(n)]
    got = kernels.dpt_groups(spark.createDataFrame(rows, "cell_id long, vec array<double>, evals array<double>"), 0).orderBy("cell_id").collect()
    assert len(got) == n and got[0].pseudotime == 0 and max(r.pseudotime for r in got) == 1 and len({r.segment for r in got}) >= 3


def test_density_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(graph, "DENSE_BLOCK", 16)
    a = np.random.RandomState(2).normal(size=(90, 2)) + 1e3
    names = ["x"] * 50 + ["y"] * 30 + [None] * 10
    got = {r.cell_id: r.density for r in graph.embedding_density(points(spark, a, g=names), "g").collect()}
    for g in ("x", "y", None):
        own = [i for i in range(90) if names[i] == g]
        p = a[own]
        inverse = np.linalg.inv(np.cov(p.T) * len(p) ** (-1 / 3))
        gaps = p[:, None] - p[None]
        k = np.exp(-0.5 * np.einsum("abi,ij,abj->ab", gaps, inverse, gaps)).sum(1)
        assert np.allclose([got[i] for i in own], (k - k.min()) / (k.max() - k.min()), atol=1e-9)


def test_neighbours_are_found_once(spark, tmp_path):
    found = spark.sparkContext.accumulator(0)

    def counted(t):
        found.add(1)
        return t

    nearest = graph.knn(points(spark, np.random.RandomState(0).normal(size=(40, 3))), 6)
    once = nearest.groupBy("src").applyInArrow(counted, nearest.schema)
    graph.diffmap(graph.connectivities(once, 6), 4).collect()
    assert found.value == 40


def test_repulsion_meets_each_pair_once():
    rng = np.random.RandomState(1)
    y, mass = rng.normal(size=(70, 2)) * 50, rng.randint(1, 9, 70).astype(float)
    y[3] = y[9]
    gap = y[:, None] - y[None]
    want = (gap * (mass[None, :] / np.maximum((gap**2).sum(2), 1e-12))[:, :, None]).sum(1)
    for block in (16, 70, 100):
        assert np.allclose(kernels._repulsion(y, mass, block), want, rtol=1e-12, atol=1e-12)


def test_affinities_and_forces_by_blocks():
    rng = np.random.RandomState(2)
    x, y = rng.normal(size=(90, 5)), rng.normal(size=(90, 2))
    blocks, p = kernels.affinities(x, 10.0, 32), kernels.joint_probabilities(x, 10.0)
    for own, other, part in blocks:
        assert np.allclose(part, p[own, other], rtol=1e-3, atol=1e-12)
    whole = np.zeros((90, 90))
    for own, other, part in blocks:
        whole[own, other], whole[other, own] = part, part.T
    gap = y[:, None] - y[None]
    q = 1 / (1 + (gap**2).sum(2)) - np.eye(90)
    attract, repel, total = kernels._pulls(y, blocks)
    assert np.isclose(total, q.sum()) and np.allclose(attract, ((whole * q)[:, :, None] * gap).sum(1)) and np.allclose(repel, ((q * q)[:, :, None] * gap).sum(1))
    off = ~np.eye(90, dtype=bool)
    assert np.isclose(kernels._loss(y, blocks, total), (whole[off] * np.log(whole[off] / (q[off] / total))).sum())
