import numpy as np
import pytest
from cellmesa import metrics
from cellmesa.operators import access, batch, graph, kernels, linalg
from pyspark.sql import functions as F

from .helpers import by_gene, counts, dataset, dense


def points(spark, a, **columns):
    kind = {str: "string", int: "long"}
    schema = ", ".join(["cell_id long", "vec array<double>", *(f"{k} {kind[type(v[0])]}" for k, v in columns.items())])
    return spark.createDataFrame([(i, [float(x) for x in row], *(v[i] for v in columns.values())) for i, row in enumerate(a)], schema)


def edges(spark, rows):
    return spark.createDataFrame([(int(a), int(b), float(w)) for a, b, w in rows], "src long, dst long, weight double")


def ring(n):
    return [(i, (i + d) % n, 1.0) for i in range(n) for d in (1, -1)]


def cliques(k, size):
    inside = [(c * size + i, c * size + j, 1.0) for c in range(k) for i in range(size) for j in range(size) if i != j]
    bridges = [(c * size, (c + 1) % k * size, 1.0) for c in range(k)]
    return inside + bridges + [(b, a, w) for a, b, w in bridges]


@pytest.mark.parametrize("block", [2048, 7])
def test_neighbours_are_exact(spark, monkeypatch, block):
    monkeypatch.setattr(graph, "BLOCK", block)
    a = np.random.RandomState(0).normal(size=(30, 4))
    a[3] = a[4] = a[5]
    got = graph.knn(points(spark, a), 6).orderBy("src", "rank").collect()
    d = np.sqrt(((a[:, None] - a[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    want = np.argsort(d, axis=1, kind="stable")[:, :5]
    assert np.array_equal(np.array([r.dst for r in got]).reshape(30, 5), want)
    assert np.allclose([r.dist for r in got], np.take_along_axis(d, want, 1).ravel())
    with pytest.raises(ValueError):
        graph.knn(points(spark, a), 1)


def test_memberships(spark):
    a = np.random.RandomState(1).normal(size=(40, 3))
    k = graph.knn(points(spark, a), 8)
    s = {r.src: (r.rho, r.sigma) for r in graph.smooth_distances(k, 8).collect()}
    rows = {}
    for r in k.collect():
        rows.setdefault(r.src, []).append(r.dist)
    for i, d in rows.items():
        rho, sigma = s[i]
        assert rho == min(d) and abs(np.exp(-np.maximum(np.array(d) - rho, 0) / sigma).sum() - np.log2(8)) < 1e-4
    g = {(r.src, r.dst): r.weight for r in graph.connectivities(k, 8).collect()}
    assert all(0 < w <= 1 and g[(b, a)] == w for (a, b), w in g.items())


def test_modularity_and_communities(spark):
    e = edges(spark, cliques(5, 9))
    for f in (kernels.leiden, kernels.louvain):
        got = f(e)
        sets = {}
        for r in got.collect():
            sets.setdefault(r.label, set()).add(r.cell_id // 9)
        assert len(sets) == 5 and all(len(v) == 1 for v in sets.values())
        q = graph.modularity(e, got).first()[0]
        w, m2 = 5 * 9 * 8, 5 * 9 * 8 + 10
        assert abs(q - (w / m2 - 5 * (m2 / 5 / m2) ** 2)) < 1e-9
    single = spark.createDataFrame([(i, str(i)) for i in range(45)], "cell_id long, label string")
    assert graph.modularity(e, single).first()[0] < 0
    same = [kernels.leiden(e, seed=3).orderBy("cell_id").collect() for _ in range(2)]
    assert same[0] == same[1]


def test_leiden_on_random_graphs_is_connected_and_ends():
    rng = np.random.RandomState(0)
    for seed in range(60):
        n = rng.randint(8, 40)
        a = (rng.random_sample((n, n)) < 0.15) * rng.uniform(0.1, 1, (n, n))
        a = np.triu(a, 1) + np.diag(np.full(n - 1, 0.3), 1)
        a = a + a.T
        i, j = np.nonzero(a)
        labels = kernels.communities(i, j, a[i, j], n, seed=seed)
        for c in np.unique(labels):
            inside = np.flatnonzero(labels == c)
            seen, todo = {inside[0]}, [inside[0]]
            while todo:
                for v in inside[a[todo.pop()][inside] > 0]:
                    if v not in seen:
                        seen.add(v)
                        todo.append(v)
            assert len(seen) == len(inside)
        assert (np.bincount(labels)[:-1] >= np.bincount(labels)[1:]).all()


def test_paga(spark):
    e = edges(spark, [(0, 1, 1), (1, 0, 1), (1, 2, 0), (2, 1, 1), (2, 3, 1), (3, 2, 1), (3, 3, 1)])
    labels = spark.createDataFrame([(0, "a"), (1, "a"), (2, "b"), (3, "b")], "cell_id long, label string")
    got = {(r.g1, r.g2): r.connectivity for r in graph.paga(e, labels).collect()}
    assert abs(got[("a", "b")] - 2 / ((3 * 2 + 4 * 2) / 3)) < 1e-12 and got[("b", "a")] == got[("a", "b")]
    table = spark.createDataFrame([("a", "b", 0.5), ("b", "a", 0.5), ("b", "c", 0.2), ("a", "c", 0.1)], "g1 string, g2 string, connectivity double")
    assert sorted(tuple(r) for r in graph.spanning_forest(table).collect()) == [("a", "b", 0.5), ("b", "c", 0.2)]


def test_autocorrelation_on_a_ring(spark):
    n = 64
    x = np.stack([np.cos(2 * np.pi * np.arange(n) / n) + 2, np.arange(n) % 2 * 2.0, np.full(n, 3.0)], 1)
    ds = dataset(spark, x)
    e = edges(spark, ring(n))
    moran, geary = by_gene(graph.morans_i(e, ds.X, ds.obs), "morans_i", 3), by_gene(graph.gearys_c(e, ds.X, ds.obs), "gearys_c", 3)
    assert abs(moran[0] - np.cos(2 * np.pi / n)) < 1e-9 and abs(moran[1] + 1) < 1e-9 and np.isnan(moran[2])
    assert abs(geary[1] - (n - 1) / n * 2) < 1e-9 and np.isnan(geary[2])
    with pytest.raises(Exception, match="weight"):
        graph.morans_i(edges(spark, [(0, 1, 0.0)]), ds.X, ds.obs).collect()


def path(n, gap=None):
    return [(i, i + d, 1.0) for i in range(n) for d in (1, -1) if 0 <= i + d < n and gap not in {min(i, i + d)}] + [(0, 0, 1.0), (n - 1, n - 1, 1.0)]


def test_diffusion_along_a_path(spark):
    m = graph.diffmap(edges(spark, path(30)), 6)
    t = [r.pseudotime for r in graph.dpt(m, 0).orderBy("cell_id").collect()]
    assert t[0] == 0 and t[-1] == 1 and (np.diff(t) > 0).all()
    assert abs(m.first().evals[0] - 1) < 1e-9
    for bad, n in ((path(30, gap=14), 6), (path(5), 5)):
        with pytest.raises(Exception, match="connected|components"):
            graph.diffmap(edges(spark, bad), n).collect()


def test_branches_of_a_star(spark):
    arm = 15
    e = [(0, 0, 1.0)]
    for b in range(3):
        chain = [0, *range(1 + b * arm, 1 + (b + 1) * arm)]
        e += [(x, y, 1.0) for p in zip(chain, chain[1:], strict=False) for x, y in (p, p[::-1])]
    got = kernels.dpt_groups(graph.diffmap(edges(spark, e), 10), 0, 1).collect()
    assert len(got) == 3 * arm + 1 and len({r.segment for r in got}) >= 3
    tips = {next(r.segment for r in got if r.cell_id == (b + 1) * arm) for b in range(3)}
    assert len(tips) == 3


@pytest.mark.parametrize("shift", [True, False])
def test_claims_follow_rank_correlations(shift):
    rng = np.random.RandomState(4)
    for n in (3, 11, 12, 30, 47):
        a, b = rng.normal(size=(2, n))
        a[: n // 2] = np.sort(a[: n // 2])
        b[: n // 2] = np.sort(b[: n // 2])
        tau = lambda x, y: np.mean([np.sign(x[i] - x[j]) * np.sign(y[i] - y[j]) for i in range(len(x)) for j in range(i)])
        if n < 12:
            assert kernels._claimed(a, b, shift) == min(n, 6)
            continue
        score = {k: tau(a[:k], b[:k]) - tau(a[k:], b[k:]) for k in range(6, n - 5)}
        best = max(score, key=score.get)
        assert kernels._claimed(a, b, shift) == (int(0.95 * (best - 1)) if shift and best - 1 > 0.95 * n else best)


def test_segments_of_arms():
    rng = np.random.RandomState(0)
    arm = np.repeat([0, 1, 2], 60)
    angle = np.array([0, 2.1, 4.2])[arm]
    x = np.tile(np.linspace(0.02, 1, 60), 3)[:, None] * np.stack([np.cos(angle), np.sin(angle)], 1) + rng.normal(size=(180, 2)) * 0.01
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    found = kernels.branches(d, 0, 1, 3)
    assert len(set(found)) >= 3 and all(np.bincount(found[arm == k]).max() >= 55 for k in range(3))
    assert len({np.bincount(found[arm == k]).argmax() for k in range(3)}) == 3
    again = kernels.branches(d, 0, 3, 3)
    assert len(set(again)) > len(set(found))
    # too few cells, a least size that no segment has, cells in one place
    assert set(kernels.branches(d[:2, :2], 0, 2, 0)) == {0} and set(kernels.branches(d, 0, 2, 180)) == {0} and set(kernels.branches(np.zeros((20, 20)), 0, 1, 0)) == {0}
    assert len(kernels.branches(d[:9, :9], 0, 3, 0)) == 9


def test_density_and_dendrogram(spark):
    a = np.random.RandomState(2).normal(size=(30, 2))
    got = graph.embedding_density(points(spark, a, g=["x"] * 15 + ["y"] * 15), "g").collect()
    assert min(r.density for r in got) == 0 and max(r.density for r in got) == 1
    with pytest.raises(Exception, match="line"):
        graph.embedding_density(points(spark, [[i, 2 * i] for i in range(9)])).collect()
    b = np.random.RandomState(3).normal(size=(40, 6)) + np.repeat(np.eye(4, 6) * 9, 10, 0)
    table, order = graph.dendrogram(points(spark, b, g=[c for c in "abcd" for _ in range(10)]), "g")
    rows = table.orderBy("step").collect()
    assert len(rows) == 3 and rows[-1].size == 4 and sorted(order) == list("abcd")
    assert all(x.dist <= y.dist for x, y in zip(rows, rows[1:], strict=False))
    with pytest.raises(ValueError):
        graph.dendrogram(points(spark, b, g=["a"] * 40), "g")


def test_confusion(spark):
    df = spark.createDataFrame([("a", "b"), ("a", "a"), ("b", "c"), (None, "a")], "x string, y string")
    got = {(r.row, r.column): r.value for r in graph.confusion_matrix(df, "x", "y").collect()}
    assert len(got) == 9 and got[("a", "a")] == 0.5 and got[("b", "c")] == 1 and got[("c", "a")] == 0
    assert graph.natural_order(["g10", "g2", "g1"]) == ["g1", "g2", "g10"]
    df = spark.createDataFrame([("g10", "x2"), ("g2", "x10"), ("g2", "x2"), ("g1", "x2")], "a string, b string")
    wide = metrics.confusion_matrix("a", "b", df, wide=True, normalize=False)
    assert wide.columns == ["row", "x2", "x10"] and [tuple(r) for r in wide.collect()] == [("g1", 1.0, 0.0), ("g2", 1.0, 1.0), ("g10", 1.0, 0.0)]


def test_layouts(spark):
    a = np.vstack([np.random.RandomState(k).normal(size=(20, 5)) + 8 * k for k in range(3)])
    g = graph.connectivities(graph.knn(points(spark, a), 8), 8)
    group = np.repeat(range(3), 20)

    def apart(df):
        y = np.array([r.vec for r in df.orderBy("cell_id").collect()])
        d = np.linalg.norm(y[:, None] - y[None], axis=2)
        near = np.argsort(d + np.diag(np.full(60, np.inf)), axis=1)[:, :5]
        return (group[near] == group[:, None]).mean()

    assert apart(kernels.umap(g, n_epochs=100)) > 0.9
    assert apart(kernels.draw_graph(g, n_iterations=60)) > 0.9
    t = kernels.tsne(points(spark, a), perplexity=10, n_iter=400)
    assert apart(t) > 0.9 and t.first().kl < 1.5
    a_, b_ = kernels.curve(0.1, 1.0)
    assert abs(a_ - 1.577) < 0.01 and abs(b_ - 0.895) < 0.01
    for bad in (lambda: kernels.curve(4.0, 1.0), lambda: kernels.draw_graph(g, "kk")):
        with pytest.raises(ValueError):
            bad()


def test_frames(spark):
    a = np.array([[0, 2, 0], [1, 0, 0]], float)
    ds = dataset(spark, a, {"g": ["x", "y"], "n": [5, 6]}, {"var_name": ["p", "q", "r"]})
    ds = ds.with_(obsm={"X": spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 4.0])], "cell_id long, vec array<double>")}, layers={"raw": ds.X.withColumn("value", F.col("value") * 2)})
    got = access.obs_df(ds, ["q", "g", "q"], [("X", 1)], layer="raw").orderBy("cell_id")
    assert got.columns == ["cell_id", "q", "g", "q", "X-1"] and [tuple(r) for r in got.collect()] == [(0, 4.0, "x", 4.0, 2.0), (1, 0.0, "y", 0.0, 4.0)]
    assert [tuple(r) for r in access.var_df(ds, ["0", "var_name"]).orderBy("gene_id").collect()][1] == (1, 2.0, "q")
    for bad in (lambda: access.obs_df(ds, ["nothing"]), lambda: access.obs_df(ds, obsm_keys=[("Y", 0)]), lambda: access.obs_df(ds, [], layer="no")):
        with pytest.raises(KeyError):
            bad()
    clash = dataset(spark, a, {"p": ["x", "y"]}, {"var_name": ["p", "q", "r"]})
    with pytest.raises(KeyError):
        access.obs_df(clash, ["p"])
    twice = dataset(spark, a, None, {"var_name": ["p", "p", "r"]})
    with pytest.raises(ValueError):
        access.obs_df(twice, ["p"])


def test_aggregate(spark):
    a = np.random.RandomState(4).poisson(1.5, (8, 5)).astype(float) - (np.arange(5) == 3)
    ds = dataset(spark, a, {"g": list("abacabb") + [None], "b": list("xyxyxyxy")}, {"k": list("uuvvv")})
    got = access.aggregate(ds, "g", list(access.FUNCS))
    rows = {"a": [0, 2, 4], "b": [1, 5, 6], "c": [3]}
    for g, at in rows.items():
        sub = a[at]
        assert np.allclose(by_gene(got, "mean", 5, g), sub.mean(0)) and np.allclose(by_gene(got, "sum", 5, g), sub.sum(0))
        assert np.allclose(by_gene(got, "median", 5, g), np.median(sub, 0)) and np.allclose(by_gene(got, "count_nonzero", 5, g), (sub != 0).sum(0))
        want = sub.var(0, ddof=1) if len(at) > 1 else np.full(5, np.nan)
        assert np.allclose(by_gene(got, "var", 5, g), want, equal_nan=True)
    assert {r.group for r in access.aggregate(ds, ["g", "b"], "sum").collect()} == {"a_x", "b_y", "c_y", "b_x"}
    assert access.aggregate(ds, "k", "sum", axis=1).columns[:2] == ["group", "cell_id"]
    with pytest.raises(ValueError):
        access.aggregate(ds, "g", "mode")


def test_components_and_residuals(spark):
    a = counts(11, 40, 6).astype(float)
    cov = np.random.RandomState(5).normal(size=40)
    kind = ["p", "q"] * 20
    ds = dataset(spark, a, {"c": cov.tolist(), "k": kind})
    scores, loadings, info = linalg.pca(ds, 3)
    centred = a - a.mean(0)
    values = np.linalg.eigvalsh(np.cov(a.T))[::-1]
    assert np.allclose(info["variance"], values[:3]) and np.allclose(sum(info["variance_ratio"]), values[:3].sum() / values.sum())
    v = np.array([r.vec for r in loadings.orderBy("gene_id").collect()])
    assert np.allclose(np.array([r.vec for r in scores.orderBy("cell_id").collect()]), centred @ v)
    assert (v[np.abs(v).argmax(0), range(3)] > 0).all()
    d = np.stack([np.ones(40), cov, [k == "q" for k in kind]], 1)
    want = a - d @ np.linalg.lstsq(d, a, rcond=None)[0]
    assert np.allclose(dense(linalg.regress_out(ds, ["c", "k"]).X, a.shape), want)
    with pytest.raises(ValueError):
        linalg.regress_out(ds.with_(obs=ds.obs.withColumn("c2", F.col("c") * 2)), ["c", "c2"])


def test_combat(spark):
    rng = np.random.RandomState(6)
    a = rng.normal(size=(60, 12)) + np.repeat([[0.0], [3.0], [-1.0]], 20, 0)
    a[:, 4] = 0
    b = ["x"] * 20 + ["y"] * 20 + ["z"] * 20
    got = dense(batch.combat(dataset(spark, a, {"batch": b})).X, a.shape)
    spread = lambda m: np.std([m[i : i + 20].mean() for i in (0, 20, 40)])
    assert spread(got) < 0.1 * spread(a) and (got[:, 4] == 0).all()
    with pytest.raises(ValueError):
        batch.combat(dataset(spark, a[:21], {"batch": b[:21]}))


def test_harmony_mixes_batches(spark):
    rng = np.random.RandomState(7)
    a = rng.normal(size=(120, 8))
    b = [i % 2 for i in range(120)]
    a[1::2] += 3 * rng.normal(size=8)
    p = points(spark, a, batch=b)
    fixed = batch.harmony_integrate(p).join(p.select("cell_id", "batch"), "cell_id")
    mixed = [batch.ilisi(x, graph.knn(x, 15)).agg(F.avg("ilisi")).first()[0] for x in (p, fixed)]
    assert mixed[1] > mixed[0] + 0.3
    alone = batch.harmony_integrate(points(spark, a, batch=[0] * 120)).orderBy("cell_id").collect()
    assert np.allclose([r.vec for r in alone], a)


def test_count_models(spark):
    rng = np.random.RandomState(8)
    depth = rng.lognormal(0, 0.3, 60)
    x = np.arange(60) % 2
    mu = depth[:, None] * 20 * np.exp(np.outer(x, [0.0, 0.7, -0.5, 0, 0, 0, 0, 0]))
    a = rng.poisson(mu).astype(float) + 1
    ds = dataset(spark, a, {"x": [int(v) for v in x]})
    f = linalg.size_factors(ds)
    s = np.array([r.size_factor for r in f.orderBy("cell_id").collect()])
    assert np.corrcoef(s, depth)[0, 1] > 0.9 and abs(np.log(s).mean()) < 1e-9
    d = linalg.nb_dispersions(ds, f)
    fit = linalg.nb_glm(ds, ["x"], f, d, [0.0, 1.0])
    est = by_gene(fit, "estimate", 8)
    assert abs(est[1] - 0.7) < 0.2 and abs(est[2] + 0.5) < 0.2 and by_gene(fit, "pval", 8)[1] < 1e-6
    assert fit.where("not converged").count() == 0
    with pytest.raises(Exception, match="every cell"):
        linalg.size_factors(dataset(spark, np.eye(4))).collect()


def test_registered_layouts_run_the_whole_schedule(monkeypatch):
    from cellmesa.plans import QUERIES, graph_queries

    for name in ("fuzzy", "points"):
        monkeypatch.setattr(graph_queries, name, lambda spark, d: None)
    for name in ("umap", "tsne", "draw_graph"):
        given = {}
        monkeypatch.setattr(kernels, name, lambda df, given=given, **named: given.update(named))
        QUERIES[name](None, "")
        assert not given.keys() & {"n_epochs", "n_iter", "n_iterations"}, name
