import math

import numpy as np
import pytest
from cellmesa.functions import special
from cellmesa.operators import de, score, stats
from pyspark.sql import functions as F

from .helpers import by_gene, counts, dataset


def average_ranks(v):
    order = np.argsort(v, kind="stable")
    ranks = np.empty(len(v))
    ranks[order] = np.arange(1, len(v) + 1)
    for x in np.unique(v):
        ranks[v == x] = ranks[v == x].mean()
    return ranks


def rank_sum(v, own, correct=False):
    n, a = len(v), own.sum()
    c = 1 - sum(t**3 - t for t in np.unique(v, return_counts=True)[1]) / (n**3 - n) if correct else 1.0
    spread = math.sqrt(c * a * (n - a) * (n + 1) / 12)
    return (average_ranks(v)[own].sum() - a * (n + 1) / 2) / spread if spread > 0 else 0.0


@pytest.fixture(scope="module")
def case(spark):
    rng = np.random.RandomState(3)
    a = rng.normal(size=(41, 9))
    a[a > 0.2] = 0
    a[:, 2], a[:, 5] = 0, -1.5
    a[:, 7] = np.abs(a[:, 7])
    groups = ["a"] * 14 + ["b"] * 15 + ["c"] * 11 + ["d"]
    return a, np.array(groups), dataset(spark, a, {"g": groups}, stored_zeros={(0, 2), (1, 4)})


@pytest.mark.parametrize("correct", [False, True])
def test_rank_sums_with_a_zero_block(case, correct):
    a, groups, ds = case
    got = de.wilcoxon(ds, "g", tie_correct=correct)
    for g in "abcd":
        want = [rank_sum(a[:, j], groups == g, correct) for j in range(9)]
        assert np.allclose(by_gene(got, "score", 9, g), want)
        assert np.allclose(by_gene(got, "pval", 9, g), [math.erfc(abs(z) / math.sqrt(2)) for z in want], rtol=1e-12)


def test_rank_sums_against_a_reference(case):
    a, groups, ds = case
    got = de.rank_genes_groups(ds, "g", ["a", "b"], "c")
    for g in "ab":
        pick = (groups == g) | (groups == "c")
        assert np.allclose(by_gene(got, "score", 9, g), [rank_sum(a[pick, j], groups[pick] == g) for j in range(9)])
    neutral = de.rank_genes_groups(ds, "g", ["a", "c"], "c").where("group = 'c'").collect()
    assert len(neutral) == 9 and {(r.score, r.logfoldchange, r.pval) for r in neutral} == {(0.0, 0.0, 1.0)}
    some = de.rank_genes_groups(ds, "g", ["a", "b"])
    pick = (groups == "a") | (groups == "b")
    assert np.allclose(by_gene(some, "score", 9, "a"), [rank_sum(a[pick, j], groups[pick] == "a") for j in range(9)])


def test_t_test(spark):
    a = counts(8, 30, 6).astype(float)
    a[:, 4] = 3.0
    groups = np.array(["x"] * 10 + ["y"] * 19 + ["z"])
    ds = dataset(spark, a, {"g": groups.tolist()})
    for over in (False, True):
        got = de.t_test(ds, "g", overestimate=over)
        for g in "xyz":
            own, rest = a[groups == g], a[groups != g]
            k2 = len(own) if over else len(rest)
            v = (own.var(0, ddof=1) / len(own) if len(own) > 1 else np.zeros(6), rest.var(0, ddof=1) / k2)
            with np.errstate(invalid="ignore", divide="ignore"):
                want = np.where(v[0] + v[1] > 0, (own.mean(0) - rest.mean(0)) / np.sqrt(v[0] + v[1]), 0)
            assert np.allclose(by_gene(got, "score", 6, g), want)
        assert by_gene(got, "pval", 6, "x")[4] == 1


def test_p_values_of_t():
    import pandas as pd

    f = special.t_two_sided.func
    got = f(pd.Series([2.0, 0.0, 12.7062047, float("nan"), 50.0]), pd.Series([10.0, 5.0, 1.0, 3.0, 100.0]))
    assert np.allclose(got[:4], [0.0733880, 1.0, 0.05, 1.0], atol=1e-7) and 0 < got[4] < 1e-60


def test_erfc(spark):
    xs = [0.0, 0.1, 0.46875, 0.5, 1.0, 3.99, 4.01, 8.0, 20.0, 26.0]
    got = spark.createDataFrame([(x * math.sqrt(2),) for x in xs], "z double").select(special.normal_p("z").alias("p")).collect()
    assert np.allclose([r.p for r in got], [math.erfc(x) for x in xs], rtol=1e-13)


def test_adjusted_p_values(spark):
    p = [0.01, 0.04, 0.03, 0.03, 0.9, float("nan"), None]
    df = spark.createDataFrame([("g", i, x) for i, x in enumerate(p)], "g string, i int, p double")
    got = {r.i: r.pval_adj for r in stats.bh(df, "p", ["g"]).collect()}
    assert np.allclose([got[i] for i in range(5)], [0.05, 0.05, 0.05, 0.05, 0.9]) and np.isnan(got[5]) and got[6] is None
    bonf = {r.i: r.pval_adj for r in stats.bonferroni(df, "p", ["g"]).collect()}
    assert np.allclose([bonf[i] for i in range(5)], [0.05, 0.2, 0.15, 0.15, 1.0])


def test_logistic_regression_is_at_its_optimum(spark):
    a = np.log1p(counts(9, 60, 5))
    groups = ["a"] * 20 + ["b"] * 25 + ["c"] * 15
    got = de.rank_genes_groups(dataset(spark, a, {"g": groups}), "g", method="logreg")
    w = np.stack([by_gene(got, "score", 5, g) for g in "abc"])
    y = np.array([[g == k for k in "abc"] for g in groups], float)
    b = np.zeros(3)
    for _ in range(500):  # the intercepts alone
        p = np.exp(a @ w.T + b)
        p /= p.sum(1, keepdims=True)
        b -= 2 * (p - y).mean(0)
    grad = (p - y).T @ a / 60 + w / 60
    assert np.abs(grad).max() < 1e-4
    two = de.logreg(dataset(spark, a, {"g": ["a"] * 30 + ["b"] * 30}), "g")
    assert np.allclose(by_gene(two, "score", 5, "a"), by_gene(two, "score", 5, "b"))
    with pytest.raises(ValueError):
        de.rank_genes_groups(None, "g", method="other")


def test_tables(spark, case):
    _, _, ds = case
    t = de.rank_genes_groups(ds, "g")
    assert t.where("rank = 0").count() == 4
    one = de.rank_genes_groups_df(t, "a", pval_cutoff=0.5, log2fc_min=-100)
    assert "group" not in one.columns and one.where("pval_adj >= 0.5").count() == 0
    filtered = de.filter_rank_genes_groups(ds, t, "g", min_in=0.0, max_out=1.1, min_fold=-1e9)
    assert filtered.where("name is null").count() < filtered.count()
    overlap = de.marker_gene_overlap(t, {"s": list(range(9)), "none": [77]}, top_n=0)
    assert overlap.count() == 8 and overlap.agg(F.max("overlap_count")).first()[0] == 1


def test_scores(spark):
    a = np.log1p(counts(10, 30, 60))
    ds = dataset(spark, a)
    genes = [1, 2, 3]
    with pytest.warns(UserWarning):
        got = score.score_genes(ds, [*genes, 999], ctrl_size=100)
    control = score.control_genes(ds, genes, 100)
    assert not set(control) & set(genes)
    want = a[:, genes].mean(1) - a[:, control].mean(1)
    assert np.allclose([r.score for r in got.orderBy("cell_id").collect()], want)
    assert score.control_genes(ds, genes, 100, seed=1) == control
    assert len(score.control_genes(ds, genes, 1)) <= len(control)
    phases = {r.phase for r in score.score_genes_cell_cycle(ds, [1, 2], [3, 4]).collect()}
    assert phases <= {"S", "G1", "G2M"}
    with pytest.raises(ValueError):
        score.score_genes(ds, [999])
