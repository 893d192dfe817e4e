"""Queries of the filters, metrics, transforms, variable genes and samples."""

from pyspark.sql import functions as F

from ..operators import prep
from ..sources import tables as src
from .registry import COMPACT, NORMED, WIDE, query, r, rs, with_

MOMENTS = """
gm AS (SELECT gene_id, coalesce(k, 0) * coalesce(m, 0) / n AS mean,
  (coalesce(k * s, 0) + coalesce(m * m * k * (n - k), 0) / n) / (n - 1) AS var
  FROM var LEFT JOIN (SELECT gene_id, count(*) AS k, avg(value) AS m, var_pop(value) AS s FROM {x} GROUP BY 1) USING (gene_id) CROSS JOIN nc)"""


def logged(ds):
    return prep.log1p(prep.normalize_total(ds))


@query(with_(WIDE, "SELECT cell_id FROM obs LEFT JOIN x USING (cell_id) GROUP BY 1 HAVING count(*) FILTER (WHERE value > 0) >= 40"))
def filter_cells_min_genes(spark, d):
    return prep.filter_cells(src.wide_dataset(spark, d), min_genes=40).obs.select("cell_id")


@query(with_(WIDE, "SELECT cell_id, coalesce(sum(value), 0) >= 1000 AS keep FROM obs LEFT JOIN x USING (cell_id) GROUP BY 1"))
def filter_cells_min_counts(spark, d):
    return prep.cell_mask(src.wide_dataset(spark, d), min_counts=1000)


@query(with_(WIDE, "SELECT gene_id FROM var LEFT JOIN x USING (gene_id) GROUP BY 1 HAVING count(*) FILTER (WHERE value > 0) >= 30"))
def filter_genes_min_cells(spark, d):
    return prep.filter_genes(src.wide_dataset(spark, d), min_cells=30).var.select("gene_id")


@query(with_(WIDE, "SELECT gene_id, coalesce(sum(value), 0) >= 800 AS keep FROM var LEFT JOIN x USING (gene_id) GROUP BY 1"))
def filter_genes_min_counts(spark, d):
    return prep.gene_mask(src.wide_dataset(spark, d), min_counts=800)


@query(with_(WIDE, "tot AS (SELECT cell_id, sum(value) AS total FROM x GROUP BY 1)", f"SELECT cell_id, gene_id, {rs('value * 10000.0 / total', 'value')} FROM x JOIN tot USING (cell_id)"))
def normalize_total_target(spark, d):
    return prep.normalize_total(src.wide_dataset(spark, d), 10000.0).X.select("cell_id", "gene_id", r("value"))


@query(with_(WIDE, NORMED, f"SELECT cell_id, gene_id, {rs('value', 'value')} FROM norm"))
def normalize_total_median(spark, d):
    return prep.normalize_total(src.wide_dataset(spark, d)).X.select("cell_id", "gene_id", r("value"))


@query(with_(WIDE, f"SELECT cell_id, gene_id, {rs('ln(1 + value)', 'value')} FROM x"))
def log1p(spark, d):
    return prep.log1p(src.wide_dataset(spark, d)).X.select("cell_id", "gene_id", r("value"))


@query(with_(WIDE, f"SELECT cell_id, gene_id, {rs('sqrt(value)', 'value')} FROM x"))
def sqrt(spark, d):
    return prep.sqrt(src.wide_dataset(spark, d)).X.select("cell_id", "gene_id", r("value"))


@query(
    with_(
        WIDE,
        "tot AS (SELECT cell_id, coalesce(sum(value), 0) AS total FROM obs LEFT JOIN x USING (cell_id) GROUP BY 1 HAVING coalesce(sum(value), 0) >= 1)",
        "tgt AS (SELECT quantile_cont(total, 0.5) AS target FROM tot)",
        f"SELECT cell_id, gene_id, {rs('value * target / total', 'value')}, {rs('total', 'n_counts')} FROM x JOIN tot USING (cell_id) CROSS JOIN tgt",
    )
)
def normalize_per_cell(spark, d):
    out = prep.normalize_per_cell(src.wide_dataset(spark, d))
    return out.X.join(out.obs.select("cell_id", "n_counts"), "cell_id").select("cell_id", "gene_id", r("value"), r("n_counts"))


def _top(k):
    return f"sum(value) FILTER (WHERE rn <= {k})"


@query(
    with_(
        WIDE,
        "rk AS (SELECT x.*, flagged, row_number() OVER (PARTITION BY cell_id ORDER BY value DESC) AS rn FROM x JOIN var USING (gene_id))",
        f"""SELECT cell_id, count(*) FILTER (WHERE value <> 0) AS n_genes_by_counts, {rs("ln(1 + count(*) FILTER (WHERE value <> 0))", "log1p_n_genes_by_counts")},
 {rs("sum(value)", "total_counts")}, {rs("ln(1 + sum(value))", "log1p_total_counts")},
 {rs(f"100.0 * {_top(5)} / sum(value)", "pct_counts_in_top_5_genes")}, {rs(f"100.0 * {_top(20)} / sum(value)", "pct_counts_in_top_20_genes")},
 {rs("coalesce(sum(value) FILTER (WHERE flagged), 0)", "total_counts_flagged")}, {rs("ln(1 + coalesce(sum(value) FILTER (WHERE flagged), 0))", "log1p_total_counts_flagged")},
 {rs("100.0 * coalesce(sum(value) FILTER (WHERE flagged), 0) / sum(value)", "pct_counts_flagged")} FROM rk GROUP BY cell_id""",
    )
)
def qc_cell_metrics(spark, d):
    got = prep.qc_cells(src.wide_dataset(spark, d), ["flagged"], [5, 20])
    return got.select("cell_id", "n_genes_by_counts", *(r(c) for c in got.columns[2:]))


@query(
    with_(
        WIDE,
        f"""SELECT gene_id, count(*) FILTER (WHERE value <> 0) AS n_cells_by_counts, {rs("sum(value) / max(n)", "mean_counts")},
 {rs("100.0 * (1 - count(*) FILTER (WHERE value <> 0) / max(n))", "pct_dropout_by_counts")}, {rs("sum(value)", "total_counts")},
 {rs("ln(1 + sum(value) / max(n))", "log1p_mean_counts")}, {rs("ln(1 + sum(value))", "log1p_total_counts")} FROM x CROSS JOIN nc GROUP BY gene_id""",
    )
)
def qc_gene_metrics(spark, d):
    got = prep.qc_genes(src.wide_dataset(spark, d))
    return got.select("gene_id", "n_cells_by_counts", *(r(c) for c in got.columns[2:]))


SEURAT = [
    WIDE,
    NORMED,
    "ex AS (SELECT cell_id, gene_id, exp(value) - 1 AS value FROM lx)",
    MOMENTS.format(x="ex"),
    """st AS (SELECT gene_id, ln(1 + CASE WHEN mean = 0 THEN 1e-12 ELSE mean END) AS means, CASE WHEN var = 0 THEN NULL ELSE ln(var / CASE WHEN mean = 0 THEN 1e-12 ELSE mean END) END AS disp FROM gm),
bn AS (SELECT *, greatest(1, least(20, CAST(ceil((means - lo) / (hi - lo) * 20 - 1e-12) AS INTEGER))) AS bin FROM st CROSS JOIN (SELECT min(means) AS lo, max(means) AS hi FROM st)),
bs AS (SELECT bin, avg(disp) AS m, stddev_samp(disp) AS s, count(disp) AS k FROM bn GROUP BY 1),
dn AS (SELECT gene_id, means, CASE WHEN disp IS NULL THEN NULL WHEN k = 1 THEN 1.0 ELSE (disp - m) / s END AS norm FROM bn JOIN bs USING (bin))""",
]
RANGER = [
    WIDE,
    NORMED,
    MOMENTS.format(x="norm"),
    """st AS (SELECT gene_id, CASE WHEN mean = 0 THEN 1e-12 ELSE mean END AS means, var / CASE WHEN mean = 0 THEN 1e-12 ELSE mean END AS disp FROM gm),
ed AS (SELECT quantile_cont(means, [0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95, 1.0]) AS edges FROM st),
bn AS (SELECT gene_id, means, disp, len(list_filter(edges, lambda e: e < means)) AS bin FROM st CROSS JOIN ed),
md AS (SELECT bin, quantile_cont(disp, 0.5) AS med FROM bn GROUP BY 1),
ma AS (SELECT bin, quantile_cont(abs(disp - med), 0.5) / 0.6744897501960817 AS mad FROM bn JOIN md USING (bin) GROUP BY 1),
dn AS (SELECT gene_id, means, (disp - med) / mad AS norm FROM bn JOIN md USING (bin) JOIN ma USING (bin))""",
]
TOP = f"""SELECT gene_id, {rs("means", "means")}, {rs("norm", "dispersions_norm")}, norm IS NOT NULL AND rank() OVER (ORDER BY norm DESC NULLS LAST) <= 200 AS highly_variable FROM dn"""


@query(with_(*SEURAT, TOP))
def hvg_seurat(spark, d):
    return prep.highly_variable_genes(logged(src.wide_dataset(spark, d)), 200).select("gene_id", r("means"), r("dispersions_norm"), "highly_variable")


@query(with_(*RANGER, TOP))
def hvg_cell_ranger(spark, d):
    return prep.highly_variable_genes(prep.normalize_total(src.wide_dataset(spark, d)), 200, "cell_ranger").select("gene_id", r("means"), r("dispersions_norm"), "highly_variable")


@query(with_(*SEURAT, f"SELECT gene_id, {rs('means', 'means')}, {rs('norm', 'dispersions_norm')}, means > 0.0125 AND means < 3 AND coalesce(norm, 0) > 0.5 AS highly_variable FROM dn"))
def genes_dispersion(spark, d):
    return prep.filter_genes_dispersion(logged(src.wide_dataset(spark, d))).select("gene_id", r("means"), r("dispersions_norm"), "highly_variable")


SCALED = [COMPACT, MOMENTS.format(x="x"), "sc AS (SELECT gene_id, mean, CASE WHEN var = 0 THEN 1.0 ELSE sqrt(var) END AS sd FROM gm)"]


@query(with_(*SCALED, f"SELECT cell_id, gene_id, {rs('greatest(-2.0, least(2.0, (coalesce(value, 0) - mean) / sd))', 'value')} FROM obs CROSS JOIN sc LEFT JOIN x USING (cell_id, gene_id)"))
def scale_centered(spark, d):
    return prep.scale(src.compact_dataset(spark, d), max_value=2.0).X.select("cell_id", "gene_id", r("value"))


@query(with_(*SCALED, f"SELECT cell_id, gene_id, {rs('least(2.0, value / sd)', 'value')} FROM x JOIN sc USING (gene_id)"))
def scale_uncentered(spark, d):
    return prep.scale(src.compact_dataset(spark, d), zero_center=False, max_value=2.0).X.select("cell_id", "gene_id", r("value"))


CLIPPED = "greatest(-2.0, least(2.0, ({} - mean) / sd))"


@query(with_(*SCALED, f"SELECT cell_id, gene_id, {rs(CLIPPED.format('value'), 'value')}, {rs(CLIPPED.format('0'), 'offset')} FROM x JOIN sc USING (gene_id)"))
def scale_implicit(spark, d):
    got = prep.scale_sparse(src.compact_dataset(spark, d), 2.0)
    return got.X.join(got.var, "gene_id").select("cell_id", "gene_id", (F.col("value") + F.col("offset")).alias("value"), "offset").select("cell_id", "gene_id", r("value"), r("offset"))


@query(with_(WIDE, "SELECT cell_id FROM obs ORDER BY md5('3-' || cell_id), cell_id LIMIT (SELECT CAST(floor(n * 0.3) AS BIGINT) FROM nc)"))
def subsample(spark, d):
    return prep.subsample(src.wide_dataset(spark, d), fraction=0.3, seed=3).obs.select("cell_id")


@query(
    with_(
        WIDE,
        "pk AS (SELECT i AS draw, CAST('0x' || substr(md5('3-' || i), 1, 8) AS BIGINT) % n AS pos FROM range(100) t(i) CROSS JOIN nc), rk AS (SELECT cell_id, row_number() OVER (ORDER BY cell_id) - 1 AS pos FROM obs)",
        "SELECT draw, cell_id FROM pk JOIN rk USING (pos)",
    )
)
def sample_replace(spark, d):
    return prep.sample(src.wide_dataset(spark, d), 100, replace=True, seed=3)


def _thin(part, target, keep):
    return with_(
        WIDE,
        f"sm AS (SELECT *, sum(value) OVER ({part}) AS t FROM x), sl AS (SELECT cell_id, gene_id, unnest(range(1, CAST(value AS BIGINT) + 1)) AS j FROM sm WHERE t > {target}), rk AS (SELECT *, row_number() OVER ({part} ORDER BY md5('5-' || cell_id || '-' || gene_id || '-' || j), cell_id, gene_id, j) AS rn FROM sl)",
        f"SELECT cell_id, gene_id, CAST(count(*) AS DOUBLE) AS value FROM rk WHERE rn <= {target} GROUP BY 1, 2 UNION ALL SELECT cell_id, gene_id, value FROM sm WHERE t <= {target} AND value <> 0",
    )


@query(_thin("PARTITION BY cell_id", 300, True))
def downsample_cell(spark, d):
    return prep.downsample_counts(src.wide_dataset(spark, d), counts_per_cell=300, seed=5).X


@query(
    with_(
        WIDE,
        "en AS (SELECT cell_id, gene_id, value, sum(value) OVER (PARTITION BY cell_id ORDER BY gene_id) - value AS lo, sum(value) OVER (PARTITION BY cell_id) AS total FROM x)",
        "pk AS (SELECT cell_id, CAST('0x' || substr(md5('5-' || cell_id || '-' || j), 1, 12) AS BIGINT) / 281474976710656.0 * total AS u FROM (SELECT DISTINCT cell_id, total FROM en WHERE total > 300), range(1, 301) t(j))",
        "SELECT cell_id, gene_id, CAST(count(*) AS DOUBLE) AS value FROM en JOIN pk USING (cell_id) WHERE u >= lo AND u < lo + value GROUP BY 1, 2 UNION ALL SELECT cell_id, gene_id, value FROM en WHERE total <= 300 AND value <> 0",
    )
)
def downsample_with_replacement(spark, d):
    return prep.downsample_counts(src.wide_dataset(spark, d), counts_per_cell=300, seed=5, replace=True).X


@query(_thin("", 20000, True))
def downsample_total(spark, d):
    return prep.downsample_counts(src.wide_dataset(spark, d), total_counts=20000, seed=5).X


@query(
    with_(WIDE, "rk AS (SELECT cell_id, row_number() OVER (ORDER BY cell_id) - 1 AS pos FROM obs), k AS (SELECT cell_id, count(*) AS k FROM x GROUP BY 1)", "SELECT pos // 128 AS block, min(pos) AS start, count(*) AS n_rows, CAST(coalesce(sum(k), 0) AS BIGINT) AS n_stored FROM rk LEFT JOIN k USING (cell_id) GROUP BY 1")
)
def row_blocks(spark, d):
    return src.row_blocks(src.wide_dataset(spark, d), 128)


@query(with_(WIDE, f"SELECT cell_id, {rs('coalesce(sum(value), 0)', 'total')} FROM obs LEFT JOIN x USING (cell_id) GROUP BY 1"))
def cell_totals(spark, d):
    return prep.cell_totals(src.wide_dataset(spark, d)).select("cell_id", r("total"))


@query(with_(WIDE, MOMENTS.format(x="x"), f"SELECT gene_id, {rs('mean', 'mean')}, {rs('var', 'var')} FROM gm"))
def gene_moments(spark, d):
    from ..operators.stats import gene_moments as moments

    ds = src.wide_dataset(spark, d)
    return moments(ds.X, ds.obs, ds.var).select("gene_id", r("mean"), r("var"))


@query(with_(WIDE, "SELECT cell_id, gene_id, value FROM x WHERE cell_id IN (SELECT cell_id FROM obs WHERE grp = 'BUILDING') AND gene_id IN (SELECT gene_id FROM var WHERE p_size <= 10)"))
def subset(spark, d):
    ds = src.wide_dataset(spark, d)
    return ds.subset(ds.obs.where("grp = 'BUILDING'"), ds.var.where("p_size <= 10")).X


@query(with_(WIDE, f"SELECT {rs('(SELECT count(*) FROM x) / ((SELECT n FROM nc) * (SELECT count(*) FROM var))', 'density', 9)}"))
def density(spark, d):
    ds = src.wide_dataset(spark, d)
    return spark.createDataFrame([(ds.density(),)], "density double").select(r("density", 9))


@query("SELECT * FROM (VALUES ('repeated entry', CAST(0 AS BIGINT)), ('unknown cell', CAST(0 AS BIGINT)), ('unknown gene', CAST(0 AS BIGINT))) t(problem, n)")
def integrity_problems(spark, d):
    return src.wide_dataset(spark, d).problems()
