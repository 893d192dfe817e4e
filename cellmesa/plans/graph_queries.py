"""Queries of neighbour graphs, groups, accessors, linear algebra and batch methods."""

from pyspark.sql import functions as F

from ..operators import access, batch, graph, kernels, linalg, prep
from ..sources import tables as src
from .prep_queries import MOMENTS, logged
from .registry import COMPACT, NORMED, WIDE, query, r, rs, with_

E = "e AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v, CAST(label AS VARCHAR) AS label FROM embeddings)"
KNN = "kn AS (SELECT * FROM (SELECT a.id AS src, b.id AS dst, list_distance(a.v, b.v) AS dist, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.v, b.v), b.id) AS rank FROM e a JOIN e b ON a.id <> b.id) WHERE rank <= 14)"
FUZZY = """rw AS (SELECT src, list(dist ORDER BY dist) AS d, sum(dist) / 15 AS mrow FROM kn GROUP BY 1), mall AS (SELECT avg(mrow) AS mall FROM rw),
rh AS (SELECT *, coalesce(list_min(list_filter(d, lambda x: x > 0)), 0) AS rho FROM rw),
it(src, d, rho, mrow, n, lo, hi, mid, done) AS (
  SELECT src, d, rho, mrow, 0, CAST(0 AS DOUBLE), CAST('inf' AS DOUBLE), CAST(1 AS DOUBLE), false FROM rh
  UNION ALL
  SELECT src, d, rho, mrow, n + 1, CASE WHEN ok OR p > log2(15) THEN lo ELSE mid END, CASE WHEN ok OR p <= log2(15) THEN hi ELSE mid END,
    CASE WHEN ok THEN mid WHEN p > log2(15) THEN (lo + mid) / 2 WHEN hi = CAST('inf' AS DOUBLE) THEN mid * 2 ELSE (mid + hi) / 2 END, ok
  FROM (SELECT *, done OR abs(p - log2(15)) < 1e-5 AS ok FROM (SELECT *, list_sum(list_transform(d, lambda x: exp(-greatest(x - rho, 0) / mid))) AS p FROM it WHERE n < 64))
),
sg AS (SELECT src, rho, greatest(mid, 1e-3 * CASE WHEN rho > 0 THEN mrow ELSE mall END) AS sigma FROM it CROSS JOIN mall WHERE n = 64),
mb AS (SELECT src, dst, CASE WHEN dist <= rho OR sigma = 0 THEN 1.0 ELSE exp(-(dist - rho) / sigma) END AS w FROM kn JOIN sg USING (src)),
bo AS (SELECT src, dst, w FROM mb WHERE w > 0 UNION ALL SELECT dst, src, w FROM mb WHERE w > 0),
g AS (SELECT src, dst, CASE WHEN count(*) = 1 THEN max(w) ELSE max(w) + min(w) - max(w) * min(w) END AS weight FROM bo GROUP BY 1, 2)"""
GRAPH = [E, KNN, FUZZY]
PAGA = """ct AS (SELECT a.label AS g1, b.label AS g2, count(*) AS c FROM kn JOIN e a ON a.id = src JOIN e b ON b.id = dst GROUP BY 1, 2),
eg AS (SELECT g1 AS label, sum(c) AS e FROM ct GROUP BY 1), ns AS (SELECT label, count(*) AS n FROM e GROUP BY 1), tt AS (SELECT count(*) AS t FROM e),
ob AS (SELECT g1, g2, sum(c) AS seen FROM (SELECT g1, g2, c FROM ct UNION ALL SELECT g2, g1, c FROM ct) WHERE g1 <> g2 GROUP BY 1, 2)"""


def points(spark, d):
    return src.embedding_obs(spark, d)


def fuzzy(spark, d):
    return graph.connectivities(graph.knn(points(spark, d)))


def labels(spark, d):
    return points(spark, d).select("cell_id", "label")


@query(with_(E, KNN, f"SELECT src, CAST(rank AS INTEGER) AS rank, dst, {rs('dist', 'dist')} FROM kn"))
def knn_distances(spark, d):
    return graph.knn(points(spark, d)).select("src", "rank", "dst", r("dist"))


@query(with_(*GRAPH, f"SELECT src, dst, {rs('weight', 'weight', 5)} FROM g", recursive=True))
def fuzzy_connectivities(spark, d):
    return fuzzy(spark, d).select("src", "dst", r("weight", 5))


@query(
    with_(
        *GRAPH,
        "s AS (SELECT src, dst, sum(weight) / 2 AS w FROM (SELECT src, dst, weight FROM g UNION ALL SELECT dst, src, weight FROM g) GROUP BY 1, 2), k AS (SELECT label, sum(w) AS k FROM s JOIN e ON id = src GROUP BY 1)",
        "i AS (SELECT sum(w) AS w FROM s JOIN e a ON a.id = src JOIN e b ON b.id = dst WHERE a.label = b.label), m AS (SELECT sum(w) AS m2 FROM s)",
        f"SELECT {rs('max(i.w) / max(m2) - sum(k * k) / max(m2) / max(m2)', 'modularity')} FROM k CROSS JOIN i CROSS JOIN m",
        recursive=True,
    )
)
def modularity(spark, d):
    return graph.modularity(graph.symmetrised(fuzzy(spark, d)), labels(spark, d)).select(r("modularity"))


@query(
    with_(
        E,
        KNN,
        PAGA,
        f"""SELECT g1, g2, {rs("least(1.0, seen / ((ei.e * nj.n + ej.e * ni.n) / (t - 1)))", "connectivity")} FROM ob JOIN eg ei ON ei.label = g1 JOIN eg ej ON ej.label = g2
 JOIN ns ni ON ni.label = g1 JOIN ns nj ON nj.label = g2 CROSS JOIN tt""",
    )
)
def paga_connectivities(spark, d):
    return graph.paga(graph.knn(points(spark, d)).select("src", "dst", F.col("dist").alias("weight")), labels(spark, d)).select("g1", "g2", r("connectivity"))


@query(
    with_(
        E,
        KNN,
        PAGA,
        """cn AS (SELECT g1, g2, least(1.0, seen / ((ei.e * nj.n + ej.e * ni.n) / (t - 1))) AS connectivity FROM ob JOIN eg ei ON ei.label = g1 JOIN eg ej ON ej.label = g2
  JOIN ns ni ON ni.label = g1 JOIN ns nj ON nj.label = g2 CROSS JOIN tt),
un AS (SELECT *, row_number() OVER (ORDER BY connectivity DESC, g1, g2) AS r FROM cn WHERE g1 < g2),
reach(r, node) AS (SELECT r, g1 FROM un UNION SELECT reach.r, CASE WHEN u.g1 = node THEN u.g2 ELSE u.g1 END FROM reach JOIN un u ON u.r < reach.r AND (u.g1 = node OR u.g2 = node))""",
        f"SELECT g1, g2, {rs('connectivity', 'connectivity')} FROM un WHERE NOT EXISTS (SELECT 1 FROM reach WHERE reach.r = un.r AND node = un.g2)",
        recursive=True,
    )
)
def paga_tree(spark, d):
    tree = graph.spanning_forest(graph.paga(graph.knn(points(spark, d)).select("src", "dst", F.col("dist").alias("weight")), labels(spark, d)))
    return tree.select("g1", "g2", r("connectivity"))


AUTO = """x AS (SELECT id AS cell_id, CAST(unnest(range(len(v))) AS BIGINT) AS gene_id, unnest(v) AS value FROM e),
st AS (SELECT gene_id, count(*) AS n, avg(value) AS m, sum(value * value) - count(*) * avg(value) * avg(value) AS zz FROM x GROUP BY 1), tw AS (SELECT sum(weight) AS w FROM g)"""


def _features(spark, d):
    return points(spark, d).select("cell_id", F.posexplode("vec").alias("gene_id", "value")).withColumn("gene_id", F.col("gene_id").cast("long"))


@query(with_(*GRAPH, AUTO, f"SELECT gene_id, {rs('max(n) / max(w) * sum(weight * (a.value - m) * (b.value - m)) / max(zz)', 'morans_i')} FROM g JOIN x a ON a.cell_id = src JOIN x b ON b.cell_id = dst AND b.gene_id = a.gene_id JOIN st USING (gene_id) CROSS JOIN tw GROUP BY gene_id", recursive=True).replace("JOIN st USING (gene_id)", "JOIN st ON st.gene_id = a.gene_id").replace("SELECT gene_id, CASE", "SELECT a.gene_id AS gene_id, CASE").replace("GROUP BY gene_id", "GROUP BY a.gene_id"))
def morans_i(spark, d):
    return graph.morans_i(fuzzy(spark, d), _features(spark, d), labels(spark, d)).select("gene_id", r("morans_i"))


@query(with_(*GRAPH, AUTO, f"SELECT a.gene_id AS gene_id, {rs('(max(n) - 1) * sum(weight * (a.value - b.value) * (a.value - b.value)) / (2 * max(w) * max(zz))', 'gearys_c')} FROM g JOIN x a ON a.cell_id = src JOIN x b ON b.cell_id = dst AND b.gene_id = a.gene_id JOIN st ON st.gene_id = a.gene_id CROSS JOIN tw GROUP BY a.gene_id", recursive=True))
def gearys_c(spark, d):
    return graph.gearys_c(fuzzy(spark, d), _features(spark, d), labels(spark, d)).select("gene_id", r("gearys_c"))


@query(
    with_(
        *GRAPH,
        "q AS (SELECT dst AS id, sum(weight) AS q FROM g GROUP BY 1), k AS (SELECT src, dst, weight / a.q / b.q AS k FROM g JOIN q a ON a.id = src JOIN q b ON b.id = dst), z AS (SELECT dst AS id, sqrt(sum(k)) AS z FROM k GROUP BY 1)",
        f"SELECT src, dst, {rs('k / a.z / b.z', 'weight')} FROM k JOIN z a ON a.id = src JOIN z b ON b.id = dst",
        recursive=True,
    )
)
def transition_operator(spark, d):
    return graph.transitions(fuzzy(spark, d)).select("src", "dst", r("weight"))


@query()
def diffmap(spark, d):
    return graph.diffmap(fuzzy(spark, d), 15)


@query("SELECT CAST(i AS INTEGER) AS component, true AS solves, true AS of_unit_length FROM range(15) t(i)")
def diffmap_equations(spark, d):
    """Whether each component is an eigenvector of the transition operator for its eigenvalue."""
    return _solved(fuzzy(spark, d), 15)


def _solved(edges, n, **options):
    found, t = graph.diffmap(edges, n, **options), graph.transitions(edges)
    long = found.select("cell_id", F.posexplode(F.arrays_zip("vec", "evals")).alias("component", "z")).select("cell_id", "component", F.col("z.vec").alias("v"), F.col("z.evals").alias("l"))
    times = t.join(long.select(F.col("cell_id").alias("dst"), "component", "v"), "dst").groupBy(F.col("src").alias("cell_id"), "component").agg(F.sum(F.col("weight") * F.col("v")).alias("tv"))
    met = long.join(times, ["cell_id", "component"]).groupBy("component")
    return met.agg((F.max(F.abs(F.col("tv") - F.col("l") * F.col("v"))) < 1e-7).alias("solves"), (F.abs(F.sum(F.col("v") * F.col("v")) - 1) < 1e-7).alias("of_unit_length"))


@query("SELECT CAST(i AS INTEGER) AS component, true AS solves, true AS of_unit_length FROM range(8) t(i)")
def diffmap_by_products(spark, d):
    """The same for the form that large graphs take, which only forms products with the operator."""
    return _solved(fuzzy(spark, d), 8, dense=0)


@query("SELECT count(*) AS n_cells, true AS starts_at_root, true AS ends_at_one FROM embeddings")
def dpt_range(spark, d):
    found = graph.dpt(graph.diffmap(fuzzy(spark, d), 15), 0)
    return found.agg(F.count("*").alias("n_cells"), (F.max(F.when(F.col("cell_id") == 0, F.col("pseudotime"))) == 0).alias("starts_at_root"), (F.abs(F.max("pseudotime") - 1) < 1e-12).alias("ends_at_one"))


@query()
def dpt_pseudotime(spark, d):
    return graph.dpt(graph.diffmap(fuzzy(spark, d), 15), 0)


@query()
def dpt_groups(spark, d):
    return kernels.dpt_groups(graph.diffmap(fuzzy(spark, d), 15), 0, n_branchings=1)


@query()
def leiden(spark, d):
    return kernels.leiden(fuzzy(spark, d))


@query()
def louvain(spark, d):
    return kernels.louvain(fuzzy(spark, d))


def _quality(edges, found, names):
    """Cells, whether labels are numbered by size, and whether the partition beats the given labels' modularity."""
    sizes = found.groupBy("label").agg(F.count("*").alias("n")).agg(F.array_sort(F.collect_list(F.struct(F.col("label").cast("int").alias("l"), "n"))).alias("s"))
    falls = sizes.select(F.forall(F.sequence(F.lit(1), F.size("s")), lambda i: F.coalesce(F.get("s", i)["n"] <= F.get("s", i - 1)["n"], F.lit(True)) & (F.get("s", i - 1)["l"] == i - 1)).alias("by_size"))
    both = [graph.modularity(graph.symmetrised(edges), x).select(F.col("modularity").alias(n)) for x, n in ((found, "a"), (names, "b"))]
    return found.agg(F.count("*").alias("n_cells")).crossJoin(falls).crossJoin(both[0]).crossJoin(both[1]).select("n_cells", "by_size", (F.col("a") >= F.col("b")).alias("no_worse_than_labels"))


PARTITION = "SELECT count(*) AS n_cells, true AS by_size, true AS no_worse_than_labels FROM embeddings"


@query(PARTITION)
def leiden_quality(spark, d):
    return _quality(fuzzy(spark, d), kernels.leiden(fuzzy(spark, d)), labels(spark, d))


@query(PARTITION)
def louvain_quality(spark, d):
    return _quality(fuzzy(spark, d), kernels.louvain(fuzzy(spark, d)), labels(spark, d))


TWO = "p AS (SELECT id, label, v[1] AS x, v[2] AS y FROM e)"


def _density(group: str) -> str:
    return f"""cv AS (SELECT {group} AS grp, count(*) AS n, covar_samp(x, x) * pow(count(*), -1.0 / 3) AS a, covar_samp(x, y) * pow(count(*), -1.0 / 3) AS b, covar_samp(y, y) * pow(count(*), -1.0 / 3) AS c FROM p GROUP BY 1),
kd AS (SELECT s.id, grp, sum(exp(-0.5 * (c * (s.x - t.x) * (s.x - t.x) - 2 * b * (s.x - t.x) * (s.y - t.y) + a * (s.y - t.y) * (s.y - t.y)) / (a * c - b * b))) AS k
  FROM (SELECT *, {group} AS gs FROM p) s JOIN (SELECT *, {group} AS gt FROM p) t ON gs = gt JOIN cv ON grp = gs GROUP BY 1, 2)
SELECT id AS cell_id, {rs("(k - min(k) OVER (PARTITION BY grp)) / (max(k) OVER (PARTITION BY grp) - min(k) OVER (PARTITION BY grp))", "density")} FROM kd"""


def _plane(spark, d):
    return points(spark, d).withColumn("vec", F.slice("vec", 1, 2))


@query(with_(E, TWO, _density("''")).replace(")\ncv AS", "),\ncv AS"))
def embedding_density(spark, d):
    return graph.embedding_density(_plane(spark, d)).select("cell_id", r("density"))


@query(with_(E, TWO, _density("label")).replace(")\ncv AS", "),\ncv AS"))
def density_by_group(spark, d):
    return graph.embedding_density(_plane(spark, d), "label").select("cell_id", r("density"))


CENT = 'ce AS (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(range(50)) AS i, unnest(v[1:50]) AS x FROM e) GROUP BY 1, 2)'


@query(with_(E, CENT, f'SELECT label AS "group", CAST(i AS INTEGER) AS dim, {rs("m", "mean")} FROM ce'))
def dendrogram_centroids(spark, d):
    return graph.centroids(points(spark, d), "label").select("group", "dim", r("mean"))


@query(with_(E, CENT, f"SELECT a.label AS g1, b.label AS g2, {rs('corr(a.m, b.m)', 'correlation')} FROM ce a JOIN ce b USING (i) GROUP BY 1, 2"))
def dendrogram_correlation(spark, d):
    return graph.centroid_correlation(points(spark, d), "label").select("g1", "g2", r("correlation"))


@query()
def dendrogram_linkage(spark, d):
    return graph.dendrogram(points(spark, d), "label")[0]


@query(
    with_(
        "p AS (SELECT CAST(p_size % 5 AS VARCHAR) AS a, CAST(p_partkey % 4 AS VARCHAR) AS b FROM part), l AS (SELECT a AS l FROM p UNION SELECT b FROM p), c AS (SELECT a, b, count(*) AS c FROM p GROUP BY 1, 2)",
        'g AS (SELECT x.l AS "row", y.l AS "column", coalesce(c, 0) AS c FROM l x CROSS JOIN l y LEFT JOIN c ON a = x.l AND b = y.l)',
        f'SELECT "row", "column", {rs("CASE WHEN sum(c) OVER w > 0 THEN c / sum(c) OVER w ELSE c END", "value")} FROM g WINDOW w AS (PARTITION BY "row")',
    )
)
def confusion_matrix(spark, d):
    cells = src.table(spark, d, "part").select((F.col("p_size") % 5).alias("a"), (F.col("p_partkey") % 4).alias("b"))
    return graph.confusion_matrix(cells, "a", "b").select("row", "column", r("value"))


# --- accessors


@query(with_(COMPACT, f"SELECT cell_id, grp, {rs('coalesce(sum(value) FILTER (WHERE gene_id = 7), 0)', 'a')}, {rs('coalesce(sum(value) FILTER (WHERE gene_id = 3), 0)', 'b')}, {rs('cov', 'cov')} FROM obs LEFT JOIN x USING (cell_id) GROUP BY cell_id, grp, cov"))
def obs_df(spark, d):
    got = access.obs_df(src.compact_dataset(spark, d), ["grp", "Brand#7", "Brand#3", "cov"])
    return got.toDF("cell_id", "grp", "a", "b", "cov").select("cell_id", "grp", r("a"), r("b"), r("cov"))


@query(with_(COMPACT, f"SELECT gene_id, var_name, {rs('coalesce(sum(value) FILTER (WHERE cell_id = 1), 0)', 'a')}, {rs('coalesce(sum(value) FILTER (WHERE cell_id = 2), 0)', 'b')} FROM var LEFT JOIN x USING (gene_id) GROUP BY 1, 2"))
def var_df(spark, d):
    got = access.var_df(src.compact_dataset(spark, d), ["var_name", "1", "2"])
    return got.toDF("gene_id", "var_name", "a", "b").select("gene_id", "var_name", r("a"), r("b"))


AGG = """sz AS (SELECT grp, count(*) AS n FROM obs GROUP BY 1),
full_ AS (SELECT grp, gene_id, cell_id, coalesce(value, 0) AS value FROM obs CROSS JOIN var LEFT JOIN x USING (cell_id, gene_id))"""
for _name, _expr in {"count_nonzero": "count(*) FILTER (WHERE value <> 0)", "mean": "avg(value)", "sum": "sum(value)", "var": "var_samp(value)", "median": "quantile_cont(value, 0.5)"}.items():
    _sql = with_(COMPACT, AGG, f'SELECT grp AS "group", gene_id, count(*) AS n_obs_aggregated, {rs(_expr, _name)} FROM full_ GROUP BY 1, 2')

    def _aggregate(spark, d, f=_name):
        return access.aggregate(src.compact_dataset(spark, d), "grp", f).select("group", "gene_id", "n_obs_aggregated", F.round(F.col(f).cast("double"), 6).alias(f))

    query(_sql, f"aggregate_{_name}")(_aggregate)


@query(with_(COMPACT, "full_ AS (SELECT grp || '_' || batch AS grp, gene_id, coalesce(value, 0) AS value FROM obs CROSS JOIN var LEFT JOIN x USING (cell_id, gene_id))", f'SELECT grp AS "group", gene_id, count(*) AS n_obs_aggregated, {rs("sum(value)", "sum")}, {rs("var_samp(value)", "var")} FROM full_ GROUP BY 1, 2'))
def aggregate_by_two_columns(spark, d):
    got = access.aggregate(src.compact_dataset(spark, d), ["grp", "batch"], ["sum", "var"])
    return got.select("group", "gene_id", "n_obs_aggregated", r("sum"), r("var"))


@query(with_(WIDE, "lg AS (SELECT cell_id, gene_id, ln(1 + value) AS value FROM x), gs AS (SELECT p_brand, count(*) AS n FROM var GROUP BY 1), s AS (SELECT p_brand, cell_id, sum(value) AS s, count(*) AS k FROM lg JOIN var USING (gene_id) GROUP BY 1, 2)", f'SELECT p_brand AS "group", cell_id, n AS n_obs_aggregated, {rs("coalesce(s, 0) / n", "mean")}, coalesce(k, 0) AS count_nonzero FROM gs CROSS JOIN obs LEFT JOIN s USING (p_brand, cell_id)'))
def aggregate_genes_of_a_layer(spark, d):
    ds = src.wide_dataset(spark, d)
    ds = ds.with_(layers={"logged": prep.log1p(ds).X})
    got = access.aggregate(ds, "p_brand", ["mean", "count_nonzero"], axis=1, layer="logged")
    return got.select("group", "cell_id", "n_obs_aggregated", r("mean"), "count_nonzero")


# --- linear algebra and batches


@query(with_(COMPACT, NORMED, AGG.replace("LEFT JOIN x USING", "LEFT JOIN lx USING"), f"SELECT a.gene_id AS g1, b.gene_id AS g2, {rs('covar_samp(a.value, b.value)', 'covariance')} FROM full_ a JOIN full_ b USING (cell_id) GROUP BY 1, 2"))
def pca_covariance(spark, d):
    return linalg.covariance(logged(src.compact_dataset(spark, d))).select("g1", "g2", r("covariance"))


@query()
def pca_scores(spark, d):
    return linalg.pca(logged(src.compact_dataset(spark, d)), 10)[0]


CENTRED = "full_ AS (SELECT cell_id, gene_id, coalesce(value, 0) AS value FROM obs CROSS JOIN var LEFT JOIN lx USING (cell_id, gene_id)), ct AS (SELECT cell_id, gene_id, value - avg(value) OVER (PARTITION BY gene_id) AS value FROM full_)"


@query(with_(COMPACT, NORMED, CENTRED, f"SELECT cell_id, {rs('sum(value * value)', 'squared_length')} FROM ct GROUP BY 1"))
def pca_lengths(spark, d):
    """With as many components as genes, a cell's scores are as long as its centred values."""
    ds = logged(src.compact_dataset(spark, d))
    scores = linalg.pca(ds, ds.var.count())[0]
    return scores.select("cell_id", F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x).alias("squared_length")).select("cell_id", r("squared_length"))


@query(with_(COMPACT, NORMED, CENTRED, "cv AS (SELECT a.gene_id AS g1, b.gene_id AS g2, sum(a.value * b.value) / (max(n) - 1) AS c FROM ct a JOIN ct b USING (cell_id) CROSS JOIN nc GROUP BY 1, 2)", f"SELECT {rs('sum(c) FILTER (WHERE g1 = g2)', 'sum_of_variances')}, {rs('sum(c * c)', 'sum_of_squares', 5)} FROM cv"))
def pca_spectrum(spark, d):
    """The variances add up to the covariance's trace, and their squares to those of its entries."""
    ds = logged(src.compact_dataset(spark, d))
    found = linalg.pca(ds, ds.var.count())[2]["variance"]
    return spark.createDataFrame([(sum(found), sum(v * v for v in found))], "sum_of_variances double, sum_of_squares double").select(r("sum_of_variances"), r("sum_of_squares", 5))


@query("SELECT CAST(i AS INTEGER) AS component, true AS same_variance FROM range(5) t(i)")
def pca_by_products(spark, d):
    """The form for many genes, which only forms products with the covariance, finds what its decomposition does."""
    ds = logged(src.wide_dataset(spark, d))
    ds = ds.subset(var=ds.var.where("p_size <= 8"))
    whole, products = (linalg.pca(ds, 5, most_genes=most)[2]["variance"] for most in (linalg.MOST_GENES, 0))
    return spark.createDataFrame([(i, abs(a - b) <= 1e-9 * a) for i, (a, b) in enumerate(zip(whole, products, strict=True))], "component int, same_variance boolean")


@query()
def pca_variance_ratio(spark, d):
    info = linalg.pca(logged(src.compact_dataset(spark, d)), 10)[2]
    return spark.createDataFrame([(i, v, p) for i, (v, p) in enumerate(zip(info["variance"], info["variance_ratio"], strict=True))], "component int, variance double, variance_ratio double")


@query(with_(COMPACT, AGG.replace("SELECT grp, gene_id, cell_id,", "SELECT cov, gene_id, cell_id,"), "fit AS (SELECT gene_id, regr_slope(value, cov) AS b, regr_intercept(value, cov) AS a FROM full_ GROUP BY 1)", f"SELECT cell_id, gene_id, {rs('value - a - b * cov', 'value', 5)} FROM full_ JOIN fit USING (gene_id)"))
def regress_out(spark, d):
    return linalg.regress_out(src.compact_dataset(spark, d), ["cov"]).X.select("cell_id", "gene_id", r("value", 5))


@query()
def combat(spark, d):
    ds = logged(src.compact_dataset(spark, d))
    return batch.combat(ds.with_(obs=ds.obs.withColumn("part", F.col("batch") % 5)), "part").X.select("cell_id", "gene_id", r("value", 4))


@query()
def harmony_integrate(spark, d):
    return batch.harmony_integrate(points(spark, d), "batch")


FACTORS = """x2 AS (SELECT cell_id, gene_id, coalesce(value, 0) + 1 AS value FROM obs CROSS JOIN var LEFT JOIN x USING (cell_id, gene_id)),
lg AS (SELECT gene_id, avg(ln(value)) AS m FROM x2 GROUP BY 1), fr AS (SELECT cell_id, quantile_cont(ln(value) - m, 0.5) AS f FROM x2 JOIN lg USING (gene_id) GROUP BY 1),
sf AS (SELECT cell_id, exp(f - (SELECT avg(f) FROM fr)) AS size_factor FROM fr)"""


def _shifted(spark, d):
    """The compact counts plus one, so that every gene is present in every cell."""
    ds = src.compact_dataset(spark, d)
    dense = ds.obs.select("cell_id").crossJoin(F.broadcast(ds.var.select("gene_id"))).join(ds.X, ["cell_id", "gene_id"], "left")
    return ds.with_(X=dense.select("cell_id", "gene_id", (F.coalesce("value", F.lit(0.0)) + 1).alias("value")))


@query(with_(COMPACT, FACTORS, f"SELECT cell_id, {rs('size_factor', 'size_factor')} FROM sf"))
def size_factors(spark, d):
    return linalg.size_factors(_shifted(spark, d)).select("cell_id", r("size_factor"))


@query(
    with_(
        COMPACT,
        FACTORS,
        """y AS (SELECT gene_id, value / size_factor AS y, size_factor FROM x2 JOIN sf USING (cell_id)),
st AS (SELECT gene_id, avg(y) AS mean, greatest(1e-8, least(1e3, (var_samp(y) - avg(y) * avg(1 / size_factor)) / (avg(y) * avg(y)))) AS disp FROM y GROUP BY 1),
ln_ AS (SELECT regr_slope(ln(disp), ln(mean)) AS b, regr_intercept(ln(disp), ln(mean)) AS a FROM st)""",
        f"SELECT gene_id, {rs('mean', 'mean')}, {rs('disp', 'dispersion')}, {rs('exp(a + b * ln(mean))', 'trend', 5)}, {rs('sqrt(disp * exp(a + b * ln(mean)))', 'shrunk', 5)} FROM st CROSS JOIN ln_",
    )
)
def nb_dispersions(spark, d):
    ds = _shifted(spark, d)
    return linalg.nb_dispersions(ds, linalg.size_factors(ds)).select("gene_id", r("mean"), r("dispersion"), r("trend", 5), r("shrunk", 5))


@query()
def nb_glm_wald(spark, d):
    ds = _shifted(spark, d)
    ds = ds.with_(obs=ds.obs.withColumn("scaled", F.col("cov") / 10000.0))
    factors = linalg.size_factors(ds)
    got = linalg.nb_glm(ds, ["scaled"], factors, linalg.nb_dispersions(ds, factors), [0.0, 1.0])
    return got.select("gene_id", "converged", r("estimate", 5), r("se", 5), r("z", 4), r("pval"))


# --- layouts


@query()
def umap(spark, d):
    return kernels.umap(fuzzy(spark, d))


@query()
def tsne(spark, d):
    return kernels.tsne(points(spark, d))


@query()
def draw_graph(spark, d):
    return kernels.draw_graph(fuzzy(spark, d))


# --- streams


@query("SELECT user_id AS cell_id, CAST(count(*) AS DOUBLE) AS total FROM events GROUP BY 1")
def stream_cell_totals(spark, d):
    from ..streaming import incremental

    return incremental.drained(incremental.cell_totals(incremental.event_stream(spark, d)), "cell_totals").select("cell_id", "total")


@query(f"SELECT event_type AS gene, count(*) AS n, {rs('avg(value)', 'mean')}, {rs('var_samp(value)', 'var')} FROM events GROUP BY 1")
def stream_gene_moments(spark, d):
    from ..streaming import incremental

    return incremental.drained(incremental.gene_moments(incremental.event_stream(spark, d)), "gene_moments").select("gene", "n", r("mean"), r("var"))


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type AS gene, count(*) AS n FROM events GROUP BY 1, 2")
def stream_windowed_totals(spark, d):
    from ..streaming import incremental

    got = incremental.drained(incremental.windowed_totals(incremental.event_stream(spark, d)), "windowed_totals")
    return got.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "gene", "n")
