"""Queries of the differential tests, their tables and the gene-set scores."""

from pyspark.sql import functions as F

from ..functions.special import normal_p_sql
from ..operators import de, score
from ..operators.stats import bh, bonferroni
from ..sources import tables as src
from .prep_queries import logged
from .registry import NORMED, WIDE, query, r, rs, with_

LABELS = "lab AS (SELECT cell_id, grp FROM obs), sz AS (SELECT grp, count(*) AS n FROM lab GROUP BY 1), tn AS (SELECT sum(n) AS n_all FROM sz)"
GROUPS = """
own AS (SELECT grp, gene_id, sum(value) AS s1, sum(value * value) AS s2, count(*) AS k FROM lx JOIN lab USING (cell_id) GROUP BY 1, 2),
mo AS (SELECT grp, gene_id, n, coalesce(s1, 0) AS s1, coalesce(s2, 0) AS s2, coalesce(k, 0) AS k, sum(coalesce(s1, 0)) OVER (PARTITION BY gene_id) AS t1, sum(coalesce(s2, 0)) OVER (PARTITION BY gene_id) AS t2,
  sum(coalesce(k, 0)) OVER (PARTITION BY gene_id) AS tk, n_all FROM sz CROSS JOIN var CROSS JOIN tn LEFT JOIN own USING (grp, gene_id))"""
LFC = "log2((exp({a}) - 1 + 1e-9) / (exp({b}) - 1 + 1e-9))"
RANKS = """
st AS (SELECT gene_id, value, grp, count(*) AS c FROM lx JOIN lab USING (cell_id) WHERE value <> 0 GROUP BY 1, 2, 3),
ct AS (SELECT * FROM st UNION ALL SELECT gene_id, 0.0, grp, n - k AS c FROM mo WHERE n - k > 0),
rk AS (SELECT *, sum(c) OVER (PARTITION BY gene_id, value) AS t, sum(c) OVER (PARTITION BY gene_id ORDER BY value) AS upto FROM ct),
ra AS (SELECT gene_id, grp, sum(c * (upto - (t - 1) / 2.0)) AS rank_sum, sum(c * (CAST(t AS DOUBLE) * t - 1)) AS own_ties FROM rk GROUP BY 1, 2),
wz AS (SELECT grp, gene_id, n, n_all, s1 / n AS mean, (t1 - s1) / (n_all - n) AS other, rank_sum, sum(own_ties) OVER (PARTITION BY gene_id) AS ties FROM ra JOIN mo USING (grp, gene_id))"""


def _bh(source: str) -> str:
    return f"""rn AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY pval) AS i, count(*) OVER (PARTITION BY grp) AS m FROM {source}),
adj AS (SELECT *, least(1.0, min(pval * m / i) OVER (PARTITION BY grp ORDER BY i DESC)) AS pval_adj FROM rn)"""


def _wilcoxon(c: str) -> str:
    z = f"(rank_sum - n * (n_all + 1) / 2.0) / sqrt({c} * n * (n_all - n) * (n_all + 1) / 12.0)"
    return f"sc AS (SELECT grp, gene_id, {z} AS score, {LFC.format(a='mean', b='other')} AS lfc FROM wz), pv AS (SELECT *, {normal_p_sql('score')} AS pval FROM sc)"


DE_OUT = f'SELECT grp AS "group", gene_id, {rs("score", "score")}, {rs("lfc", "logfoldchange")}, {rs("pval", "pval", 9)}, {rs("pval_adj", "pval_adj", 9)}'
WILCOXON = [WIDE, NORMED, LABELS, GROUPS, RANKS, _wilcoxon("1.0"), _bh("pv")]


def de_out(t):
    return t.select("group", "gene_id", r("score"), r("logfoldchange"), r("pval", 9), r("pval_adj", 9))


@query(with_(*WILCOXON, DE_OUT + " FROM adj"))
def rank_genes_wilcoxon(spark, d):
    return de_out(de.rank_genes_groups(logged(src.wide_dataset(spark, d)), "grp"))


@query(with_(WIDE, NORMED, LABELS, GROUPS, RANKS, _wilcoxon("(1 - ties / (CAST(n_all AS DOUBLE) * n_all * n_all - n_all))"), _bh("pv"), DE_OUT + " FROM adj"))
def rank_genes_wilcoxon_tie_corrected(spark, d):
    return de_out(de.wilcoxon(logged(src.wide_dataset(spark, d)), "grp", tie_correct=True))


@query(
    with_(
        WIDE,
        NORMED,
        LABELS,
        GROUPS,
        """pr AS (SELECT DISTINCT grp AS pair FROM sz WHERE grp <> 'BUILDING'),
st AS (SELECT gene_id, value, grp, count(*) AS c FROM lx JOIN lab USING (cell_id) WHERE value <> 0 GROUP BY 1, 2, 3),
ct AS (SELECT * FROM st UNION ALL SELECT gene_id, 0.0, grp, n - k AS c FROM mo WHERE n - k > 0),
cp AS (SELECT pair, ct.* FROM ct JOIN pr ON ct.grp = pair OR ct.grp = 'BUILDING'),
rk AS (SELECT *, sum(c) OVER (PARTITION BY pair, gene_id, value) AS t, sum(c) OVER (PARTITION BY pair, gene_id ORDER BY value) AS upto FROM cp),
ra AS (SELECT gene_id, grp, sum(c * (upto - (t - 1) / 2.0)) AS rank_sum FROM rk WHERE grp = pair GROUP BY 1, 2),
rf AS (SELECT gene_id, s1 / n AS other, n AS n_ref FROM mo WHERE grp = 'BUILDING'),
wz AS (SELECT grp, gene_id, n, n + n_ref AS n_all, s1 / n AS mean, other, rank_sum FROM ra JOIN mo USING (grp, gene_id) JOIN rf USING (gene_id))""".replace("WHERE n - k > 0),\ncp", "WHERE n - k > 0),\ncp"),
        _wilcoxon("1.0"),
        _bh("pv"),
        DE_OUT + " FROM adj",
    )
)
def rank_genes_wilcoxon_reference(spark, d):
    return de_out(de.rank_genes_groups(logged(src.wide_dataset(spark, d)), "grp", reference="BUILDING"))


def _welch(k2: str) -> str:
    return f"""tv AS (SELECT grp, gene_id, s1 / n AS m1, (t1 - s1) / (n_all - n) AS m2, CAST(n AS DOUBLE) AS n1, CAST({k2} AS DOUBLE) AS k2,
  greatest(0, (s2 - n * (s1 / n) * (s1 / n)) / (n - 1)) / n AS a,
  greatest(0, ((t2 - s2) - (n_all - n) * ((t1 - s1) / (n_all - n)) * ((t1 - s1) / (n_all - n))) / (n_all - n - 1)) / {k2} AS b FROM mo)
SELECT grp AS "group", gene_id, {rs("CASE WHEN a + b > 0 THEN (m1 - m2) / sqrt(a + b) ELSE 0 END", "score")},
 {rs("CASE WHEN a * a / (n1 - 1) + b * b / (k2 - 1) > 0 THEN (a + b) * (a + b) / (a * a / (n1 - 1) + b * b / (k2 - 1)) ELSE 1 END", "df", 4)}, {rs(LFC.format(a="m1", b="m2"), "logfoldchange")} FROM tv"""


def _t(spark, d, over):
    ds = logged(src.wide_dataset(spark, d))
    return de.t_scores(ds, ds.obs.select("cell_id", F.col("grp").alias("group")), overestimate=over).select("group", "gene_id", r("score"), r("df", 4), r("logfoldchange"))


@query(with_(WIDE, NORMED, LABELS, GROUPS, *[_welch("(n_all - n)")]).replace(")\ntv AS", "),\ntv AS"))
def rank_genes_t_test(spark, d):
    return _t(spark, d, False)


@query(with_(WIDE, NORMED, LABELS, GROUPS, *[_welch("n")]).replace(")\ntv AS", "),\ntv AS"))
def rank_genes_t_test_overestim(spark, d):
    return _t(spark, d, True)


# Two-sided p-values of t by the continued fraction of the incomplete beta function (modified Lentz), a fixed number of steps.
T_P = """
tt AS (SELECT grp, gene_id, CASE WHEN a + b > 0 THEN (m1 - m2) / sqrt(a + b) ELSE 0 END AS score, m1, m2,
  CASE WHEN a * a / (n1 - 1) + b * b / (k2 - 1) > 0 THEN (a + b) * (a + b) / (a * a / (n1 - 1) + b * b / (k2 - 1)) ELSE 1 END AS df FROM tv),
bx AS (SELECT *, df / (df + score * score) AS x, df / 2 AS half FROM tt),
ba AS (SELECT *, x < (half + 1) / (half + 2.5) AS direct, exp(lgamma(half + 0.5) - lgamma(half) - lgamma(0.5) + half * ln(x) + 0.5 * ln(1 - x)) AS front FROM bx WHERE score <> 0),
cf(grp, gene_id, p, q, x, i, c, d, h) AS (
  SELECT grp, gene_id, p, q, x, 0, CAST(1 AS DOUBLE), 1 / (1 - (p + q) * x / (p + 1)), 1 / (1 - (p + q) * x / (p + 1))
  FROM (SELECT grp, gene_id, CASE WHEN direct THEN half ELSE 0.5 END AS p, CASE WHEN direct THEN 0.5 ELSE half END AS q, CASE WHEN direct THEN x ELSE 1 - x END AS x FROM ba)
  UNION ALL
  SELECT grp, gene_id, p, q, x, i, c2, d2, h * d1 * c1 * d2 * c2 FROM (
    SELECT *, 1 / (1 + odd * d1) AS d2, 1 + odd / c1 AS c2 FROM (
      SELECT *, 1 / (1 + even * d) AS d1, 1 + even / c AS c1 FROM (
        SELECT grp, gene_id, p, q, x, i + 1 AS i, c, d, h, (i + 1) * (q - i - 1) * x / ((p + 2 * i + 1) * (p + 2 * i + 2)) AS even, -(p + i + 1) * (p + q + i + 1) * x / ((p + 2 * i + 2) * (p + 2 * i + 3)) AS odd
        FROM cf WHERE i < 120)))),
pv AS (SELECT tt.grp, tt.gene_id, tt.score, tt.m1, tt.m2, CASE WHEN tt.score = 0 THEN 1.0 WHEN direct THEN front * h / half ELSE 1 - front * h / 0.5 END AS pval
  FROM tt LEFT JOIN ba USING (grp, gene_id) LEFT JOIN (SELECT grp, gene_id, h FROM cf WHERE i = 120) USING (grp, gene_id))"""


@query(
    with_(WIDE, NORMED, LABELS, GROUPS, _welch("(n_all - n)").split("\nSELECT")[0], T_P, _bh("pv"), f'SELECT grp AS "group", gene_id, {rs("score", "score")}, {rs(LFC.format(a="m1", b="m2"), "logfoldchange")}, {rs("pval", "pval")}, {rs("pval_adj", "pval_adj")} FROM adj', recursive=True)
)
def rank_genes_t_test_pvalues(spark, d):
    got = de.rank_genes_groups(logged(src.wide_dataset(spark, d)), "grp", method="t-test")
    return got.select("group", "gene_id", r("score"), r("logfoldchange"), r("pval"), r("pval_adj"))


@query()
def rank_genes_logreg(spark, d):
    return de.rank_genes_groups(logged(src.compact_dataset(spark, d)), "grp", method="logreg").select("group", "rank", "gene_id", r("score", 4))


@query(with_(*WILCOXON, "rr AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY score DESC, gene_id) - 1 AS rank FROM adj)", f'SELECT CAST(rank AS INTEGER) AS rank, gene_id, {rs("score", "score")}, {rs("lfc", "logfoldchange")}, {rs("pval_adj", "pval_adj", 9)} FROM rr WHERE grp = \'MACHINERY\' AND pval_adj < 1.5 AND lfc > 0.25'))
def de_frame(spark, d):
    t = de.rank_genes_groups(logged(src.wide_dataset(spark, d)), "grp")
    return de.rank_genes_groups_df(t, "MACHINERY", 1.5, 0.25).select("rank", "gene_id", r("score"), r("logfoldchange"), r("pval_adj", 9))


@query(with_(*WILCOXON, f"""SELECT grp AS "group", gene_id, CASE WHEN k / n > 0.02 AND (tk - k) / (n_all - n) < 0.5 AND lfc > 0.2 THEN gene_id ELSE -1 END AS name FROM adj JOIN (SELECT grp, gene_id, k, n, tk, n_all FROM mo) USING (grp, gene_id)"""))
def filter_rank_genes(spark, d):
    ds = logged(src.wide_dataset(spark, d))
    return de.filter_rank_genes_groups(ds, de.wilcoxon(ds, "grp"), "grp", 0.02, 0.5, 0.2).select("group", "gene_id", F.coalesce("name", F.lit(-1)).alias("name"))


@query(with_(*WILCOXON, f"""SELECT grp AS "group", gene_id, CASE WHEN k / n > 0.02 AND (tk - k) / (n_all - n) < 0.5 AND {LFC.format(a="s1 / n", b="(t1 - s1) / (n_all - n)")} > 0.3 THEN gene_id ELSE -1 END AS name FROM adj JOIN (SELECT grp, gene_id, k, n, tk, n_all, s1, t1 FROM mo) USING (grp, gene_id)""".replace("FROM adj JOIN", "FROM (SELECT grp, gene_id FROM adj) JOIN")))
def filter_rank_genes_own_folds(spark, d):
    ds = logged(src.wide_dataset(spark, d))
    scores = de.wilcoxon(ds, "grp").select("group", "gene_id", "score")  # a table without fold changes
    return de.filter_rank_genes_groups(ds, scores, "grp", 0.02, 0.5, 0.3, own_folds=True).select("group", "gene_id", F.coalesce("name", F.lit(-1)).alias("name"))


@query(
    with_(
        *WILCOXON,
        """top AS (SELECT grp, gene_id FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY score DESC, gene_id) AS place FROM adj) WHERE place <= 100),
rf AS (SELECT p_brand AS set_name, gene_id FROM var), a AS (SELECT grp, count(*) AS a FROM top GROUP BY 1), b AS (SELECT set_name, count(*) AS b FROM rf GROUP BY 1),
ov AS (SELECT set_name, grp, count(*) AS k FROM top JOIN rf USING (gene_id) GROUP BY 1, 2)""",
        f'SELECT set_name, grp AS "group", coalesce(k, 0) AS overlap_count, {rs("coalesce(k, 0) / greatest(least(a, b), 1)", "overlap_coef")}, {rs("coalesce(k, 0) / (a + b - coalesce(k, 0))", "jaccard")} FROM b CROSS JOIN a LEFT JOIN ov USING (set_name, grp)',
    )
)
def marker_overlap(spark, d):
    ds = logged(src.wide_dataset(spark, d))
    sets = ds.var.select(F.col("p_brand").alias("set_name"), "gene_id")
    return de.marker_gene_overlap(de.rank_genes_groups(ds, "grp"), sets).select("set_name", "group", "overlap_count", r("overlap_coef"), r("jaccard"))


P = "pv AS (SELECT p_type AS grp, p_partkey AS id, (p_partkey * 37 % 1009 + 1) / 5000.0 AS pval FROM part)"


def _pvals(spark, d):
    return src.table(spark, d, "part").select(F.col("p_type").alias("grp"), F.col("p_partkey").alias("id"), ((F.col("p_partkey") * 37 % 1009 + 1) / 5000.0).alias("pval"))


@query(with_(P, _bh("pv"), f"SELECT grp, id, {rs('pval_adj', 'pval_adj', 9)} FROM adj"))
def bh_adjust(spark, d):
    return bh(_pvals(spark, d), "pval", ["grp"]).select("grp", "id", r("pval_adj", 9))


@query(with_(P, f"SELECT grp, id, {rs('least(1.0, pval * count(*) OVER (PARTITION BY grp))', 'pval_adj', 9)} FROM pv"))
def bonferroni_adjust(spark, d):
    return bonferroni(_pvals(spark, d), "pval", ["grp"]).select("grp", "id", r("pval_adj", 9))


def _scores(*sets: tuple[str, str]) -> str:
    out = ["""gmean AS (SELECT gene_id, coalesce(sum(value), 0) / max(n) AS m FROM var CROSS JOIN nc LEFT JOIN lx USING (gene_id) GROUP BY 1),
gn AS (SELECT count(*) AS g FROM var), bins AS (SELECT gene_id, rank() OVER (ORDER BY m) // CAST(round_even(g / 24.0, 0) AS BIGINT) AS bin FROM gmean CROSS JOIN gn)"""]
    for name, cond in sets:
        out.append(
            f"""{name}_set AS (SELECT gene_id FROM var WHERE {cond}),
{name}_ctl AS (SELECT gene_id FROM bins WHERE bin IN (SELECT bin FROM bins JOIN {name}_set USING (gene_id)) AND gene_id NOT IN (SELECT gene_id FROM {name}_set)),
{name}_sc AS (SELECT cell_id, coalesce(sum(value) FILTER (WHERE gene_id IN (SELECT gene_id FROM {name}_set)), 0) / (SELECT count(*) FROM {name}_set)
  - coalesce(sum(value) FILTER (WHERE gene_id IN (SELECT gene_id FROM {name}_ctl)), 0) / (SELECT count(*) FROM {name}_ctl) AS score FROM obs LEFT JOIN lx USING (cell_id) GROUP BY 1)"""
        )
    return ",\n".join(out)


@query(with_(WIDE, NORMED, _scores(("s", "p_brand = 'Brand#3' AND p_size <= 20")), f"SELECT cell_id, {rs('score', 'score')} FROM s_sc"))
def score_genes(spark, d):
    ds = logged(src.wide_dataset(spark, d))
    genes = [x[0] for x in ds.var.where("p_brand = 'Brand#3' and p_size <= 20").select("gene_id").collect()]
    return score.score_genes(ds, genes, ctrl_size=100_000).select("cell_id", r("score"))


@query(
    with_(
        WIDE,
        NORMED,
        _scores(("s", "p_brand = 'Brand#3' AND p_size <= 20"), ("g", "p_brand = 'Brand#4' AND p_size <= 20")),
        f"SELECT cell_id, {rs('s_sc.score', 's_score')}, {rs('g_sc.score', 'g2m_score')}, CASE WHEN s_sc.score < 0 AND g_sc.score < 0 THEN 'G1' WHEN g_sc.score > s_sc.score THEN 'G2M' ELSE 'S' END AS phase FROM s_sc JOIN g_sc USING (cell_id)",
    )
)
def score_cell_cycle(spark, d):
    ds = logged(src.wide_dataset(spark, d))
    sets = [[x[0] for x in ds.var.where(f"p_brand = '{b}' and p_size <= 20").select("gene_id").collect()] for b in ("Brand#3", "Brand#4")]
    return score.score_genes_cell_cycle(ds, *sets, ctrl_size=100_000).select("cell_id", r("s_score"), r("g2m_score"), "phase")
