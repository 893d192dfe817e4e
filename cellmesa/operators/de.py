"""Differential tests between groups of cells, their tables, and marker overlap."""

from __future__ import annotations

import math
import warnings
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..functions.special import normal_p, t_two_sided
from ..model import CellDataset
from .stats import bh, group_moments, scalar

#: Genes times groups of a logistic regression.
MOST_COEFFICIENTS = 5_000_000
METHODS = ("wilcoxon", "t-test", "t-test_overestim_var", "logreg")


def _labels(ds: CellDataset, groupby: str, groups: Sequence[str] | None, reference: str) -> DataFrame:
    """``(cell_id, group)`` of the cells that take part."""
    labels = ds.obs.where(F.col(groupby).isNotNull()).select("cell_id", F.col(groupby).cast("string").alias("group"))
    if groups is not None:
        names = [*groups, *([reference] if reference != "rest" else [])]
        labels = labels.where(F.col("group").isin(names))
    return labels


def fold_change(mean: Column, other: Column) -> Column:
    """log2 of the ratio of means that were averaged as natural logarithms."""
    return F.log2((F.expm1(mean) + 1e-9) / (F.expm1(other) + 1e-9))


def _value_counts(ds: CellDataset, labels: DataFrame) -> DataFrame:
    """``(gene_id, value, group, c)``: how many cells of a group store a value that is not zero."""
    return ds.X.where(F.col("value") != 0).join(labels, "cell_id").groupBy("gene_id", "value", "group").agg(F.count("*").alias("c"))


def _ranked(counts: DataFrame, by: list[str], more: dict[str, Column]) -> DataFrame:
    """Per ``by`` and group: ``k`` entries, their rank sum among all entries ``r``, those above and below zero, the tie terms
    ``t`` (t^3 - t of a value, shared out over the t entries that have it) and ``more`` sums."""
    upto = Window.partitionBy(*by).orderBy("value").rangeBetween(Window.unboundedPreceding, 0)
    tied = F.sum("c").over(Window.partitionBy(*by, "value"))
    c, t = F.col("c"), F.col("_t").cast("double")
    ranked = counts.withColumn("_t", tied).withColumn("_r", F.sum("c").over(upto) - (F.col("_t") - 1) / 2.0)
    return ranked.groupBy(*by, "group").agg(
        F.sum("c").alias("k"), F.sum(c * F.col("_r")).alias("r"), F.sum(F.when(F.col("value") > 0, c).otherwise(0)).alias("above"), F.sum(F.when(F.col("value") < 0, c).otherwise(0)).alias("below"),
        F.sum(c * (t * t - 1)).alias("t"), *(F.sum(x).alias(k) for k, x in more.items()),
    )


def _with_zeros(rows: DataFrame, by: list[str], total: Column) -> DataFrame:
    """Adds ``rank_sum`` and ``ties`` to rows per ``by`` and group (``n`` cells of ``total``): all zeros are one tied block."""
    all_ = Window.partitionBy(*by)
    zeros = total - F.sum("k").over(all_)
    middle = F.sum("below").over(all_) + (zeros + 1) / 2.0
    z = zeros.cast("double")
    return rows.withColumns({"rank_sum": F.col("r") + F.col("above") * zeros + (F.col("n") - F.col("k")) * middle, "ties": F.sum("t").over(all_) + z * (z * z - 1)})


def _ranks_and_means(ds: CellDataset, labels: DataFrame) -> DataFrame:
    """``(group, gene_id, n, n_all, rank_sum, ties, mean, other)`` against the rest, from one pass over the matrix.

    Entries are first counted by (gene, value, group), so a gene's ranks need one sorted pass over its distinct values however
    many cells it has, and its zeros are no rows at all.
    """
    per = _ranked(_value_counts(ds, labels), ["gene_id"], {"s": F.col("c") * F.col("value")})
    sizes = labels.groupBy("group").agg(F.count("*").alias("n"))
    sizes = sizes.crossJoin(scalar(sizes.agg(F.sum("n").alias("n_all"))))
    grid = ds.var.select("gene_id").crossJoin(sizes).join(per, ["gene_id", "group"], "left").na.fill(0, ["k", "r", "above", "below", "t", "s"])
    out = _with_zeros(grid, ["gene_id"], F.col("n_all")).withColumn("all_s", F.sum("s").over(Window.partitionBy("gene_id")))
    return out.select("group", "gene_id", "n", "n_all", "rank_sum", "ties", (F.col("s") / F.col("n")).alias("mean"), F.try_divide(F.col("all_s") - F.col("s"), F.col("n_all") - F.col("n")).alias("other"))


def _ranks_against(ds: CellDataset, labels: DataFrame, reference: str) -> DataFrame:
    """The same of each group against a reference: each is ranked with it alone. Rows of the reference are left out."""
    counts, sizes = _value_counts(ds, labels), labels.groupBy("group").agg(F.count("*").alias("n"))
    others = sizes.where(F.col("group") != reference)
    names = scalar(others.agg(F.collect_list("group").alias("names")))  # one name per group
    mine = F.when(F.col("group") == reference, F.col("names")).otherwise(F.array("group"))
    paired = counts.crossJoin(names).withColumn("pair", F.explode(mine)).drop("names")
    per = _ranked(paired, ["pair", "gene_id"], {"s": F.col("c") * F.col("value")})
    own = others.select(F.col("group").alias("pair"), "group", "n").unionByName(sizes.where(F.col("group") == reference).crossJoin(others.select(F.col("group").alias("pair"))).select("pair", "group", "n"))
    grid = ds.var.select("gene_id").crossJoin(own).join(per, ["pair", "gene_id", "group"], "left").na.fill(0, ["k", "r", "above", "below", "t", "s"])
    pair = Window.partitionBy("pair", "gene_id")
    both = grid.withColumns({"n_all": F.sum("n").over(pair), "all_s": F.sum("s").over(pair)})
    out = _with_zeros(both, ["pair", "gene_id"], F.col("n_all")).where(F.col("group") != reference)
    return out.select("group", "gene_id", "n", "n_all", "rank_sum", "ties", (F.col("s") / F.col("n")).alias("mean"), F.try_divide(F.col("all_s") - F.col("s"), F.col("n_all") - F.col("n")).alias("other"))


def rank_sums(ds: CellDataset, labels: DataFrame, reference: str = "rest") -> DataFrame:
    """``(group, gene_id, n, n_all, rank_sum, ties)`` with average ranks and all zeros as one tied block."""
    got = _ranks_and_means(ds, labels) if reference == "rest" else _ranks_against(ds, labels, reference)
    return got.drop("mean", "other")


def wilcoxon(ds: CellDataset, groupby: str, groups: Sequence[str] | None = None, reference: str = "rest", tie_correct: bool = False) -> DataFrame:
    labels = _labels(ds, groupby, groups, reference)
    ranks = _ranks_and_means(ds, labels) if reference == "rest" else _ranks_against(ds, labels, reference)
    n, N = F.col("n").cast("double"), F.col("n_all").cast("double")
    c = 1 - F.coalesce(F.try_divide(F.col("ties"), N * N * N - N), F.lit(0.0)) if tie_correct else F.lit(1.0)
    spread = F.sqrt(c * n * (N - n) * (N + 1) / 12.0)
    score = F.when(spread > 0, (F.col("rank_sum") - n * (N + 1) / 2.0) / spread).otherwise(F.lit(0.0))
    got = ranks.select("group", "gene_id", score.alias("score"), fold_change(F.col("mean"), F.col("other")).alias("logfoldchange")).withColumn("pval", normal_p("score"))
    return bh(got.select("group", "gene_id", "score", "logfoldchange", "pval"), "pval", ["group"])


def _moment(s1: Column, s2: Column, n: Column) -> Column:
    m = s1 / n
    return F.when(n > 1, F.greatest(F.lit(0.0), (s2 - n * m * m) / (n - 1))).otherwise(F.lit(0.0))


def t_scores(ds: CellDataset, labels: DataFrame, reference: str = "rest", overestimate: bool = False) -> DataFrame:
    """``(group, gene_id, score, df, logfoldchange)`` of Welch's test; undefined scores are 0 and undefined df 1."""
    m = group_moments(ds.X, labels, ds.var, "group")
    if reference != "rest":
        ref = m.where(F.col("group") == reference).select("gene_id", F.col("n").alias("n2"), F.col("s1").alias("r1"), F.col("s2").alias("r2"))
        m = m.where(F.col("group") != reference).join(ref, "gene_id")
    else:
        m = m.select("*", (F.col("n_all") - F.col("n")).alias("n2"), (F.col("t1") - F.col("s1")).alias("r1"), (F.col("t2") - F.col("s2")).alias("r2"))
    n1, n2 = F.col("n").cast("double"), F.col("n2").cast("double")
    v1, v2 = _moment(F.col("s1"), F.col("s2"), n1), _moment(F.col("r1"), F.col("r2"), n2)
    m = m.select("group", "gene_id", (F.col("s1") / n1).alias("m1"), F.try_divide(F.col("r1"), n2).alias("m2"), n1.alias("n1"), (n1 if overestimate else n2).alias("k2"), v1.alias("v1"), v2.alias("v2"))
    a, b = F.col("v1") / F.col("n1"), F.coalesce(F.try_divide("v2", "k2"), F.lit(0.0))
    below = F.try_divide(a * a, F.col("n1") - 1) + F.try_divide(b * b, F.col("k2") - 1)
    df = F.when((a + b > 0) & (below > 0), (a + b) * (a + b) / below).otherwise(F.lit(1.0))
    t = F.when(a + b > 0, (F.col("m1") - F.col("m2")) / F.sqrt(a + b)).otherwise(F.lit(0.0))
    return m.select("group", "gene_id", t.alias("score"), df.alias("df"), fold_change(F.col("m1"), F.col("m2")).alias("logfoldchange"))


def t_test(ds: CellDataset, groupby: str, groups: Sequence[str] | None = None, reference: str = "rest", overestimate: bool = False) -> DataFrame:
    got = t_scores(ds, _labels(ds, groupby, groups, reference), reference, overestimate)
    got = got.withColumn("pval", F.when(F.col("score") == 0, F.lit(1.0)).otherwise(t_two_sided("score", "df")))
    return bh(got.select("group", "gene_id", "score", "logfoldchange", "pval"), "pval", ["group"])


def logreg(ds: CellDataset, groupby: str, groups: Sequence[str] | None = None, reference: str = "rest") -> DataFrame:
    """``(group, gene_id, score)``: coefficients of a ridge-penalised multinomial fit; two groups share one vector.

    The genes of ``var`` are the columns of a sparse design. The driver holds the coefficients, and more than
    ``MOST_COEFFICIENTS`` are an error.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.linalg import VectorUDT

    labels = _labels(ds, groupby, groups, reference)
    names = [r[0] for r in labels.select("group").distinct().orderBy("group").collect()]
    genes = sorted(ds.var.select("gene_id").toPandas()["gene_id"].tolist())
    if len(genes) * len(names) > MOST_COEFFICIENTS:
        raise ValueError(f"more than {MOST_COEFFICIENTS} coefficients; select variable genes first")
    spark = ds.X.sparkSession
    places = spark.createDataFrame(list(zip(genes, range(len(genes)), strict=True)), "gene_id long, i int")
    entries = F.sort_array(F.collect_list(F.struct("i", "value")))
    held = ds.X.where("value <> 0").join(places, "gene_id").groupBy("cell_id").agg(entries.alias("e"))
    none = F.array().cast("array<struct<i:int,value:double>>")
    met = labels.join(held, "cell_id", "left").withColumn("e", F.coalesce("e", none))
    # a sparse vector is a struct of a kind, a size, places and values; JSON is how a struct of columns becomes one
    vector = F.struct(F.lit(0).alias("type"), F.lit(len(genes)).alias("size"), F.col("e.i").alias("indices"), F.col("e.value").alias("values"))
    made = F.from_json(F.to_json(F.struct(vector.alias("f"))), StructType([StructField("f", VectorUDT())]))["f"]
    rows = met.select((F.array_position(F.array(*map(F.lit, names)), F.col("group")) - 1).cast("double").alias("label"), made.alias("features"))
    n = labels.count()
    learner = LogisticRegression(family="multinomial" if len(names) > 2 else "binomial", regParam=1.0 / n, elasticNetParam=0.0, standardization=False, maxIter=100, tol=1e-9)
    matrix = learner.fit(rows).coefficientMatrix.toArray()
    out = [(g, genes[j], float(matrix[i if len(matrix) > 1 else 0, j])) for i, g in enumerate(names) for j in range(len(genes))]
    return spark.createDataFrame(out, "group string, gene_id long, score double")


def rank_genes_groups(ds: CellDataset, groupby: str, groups: Sequence[str] | None = None, reference: str = "rest", method: str = "wilcoxon") -> DataFrame:
    """``(group, rank, gene_id, score[, logfoldchange, pval, pval_adj])`` of all genes; ties of score by gene."""
    if method not in METHODS:
        raise ValueError(f"method has to be one of {METHODS}")
    if method == "logreg":
        got = logreg(ds, groupby, groups, reference)
    elif method == "wilcoxon":
        got = wilcoxon(ds, groupby, groups, reference)
    else:
        got = t_test(ds, groupby, groups, reference, method != "t-test")
    if groups is not None:
        got = got.where(F.col("group").isin(list(groups)))
        if reference != "rest" and reference in groups and method != "logreg":
            neutral = ds.var.select(F.lit(reference).alias("group"), "gene_id", F.lit(0.0).alias("score"), F.lit(0.0).alias("logfoldchange"), F.lit(1.0).alias("pval"), F.lit(1.0).alias("pval_adj"))
            got = got.where(F.col("group") != reference).unionByName(neutral)
    return got.withColumn("rank", F.row_number().over(Window.partitionBy("group").orderBy(F.desc("score"), "gene_id")) - 1)


def rank_genes_groups_df(table: DataFrame, group: str | Sequence[str] | None = None, pval_cutoff: float | None = None, log2fc_min: float | None = None, log2fc_max: float | None = None) -> DataFrame:
    """The rows of some groups within strict cut-offs, by rank; a single group leaves out its name. Scores alone have no cut-offs."""
    if group is not None:
        table = table.where(F.col("group").isin([group] if isinstance(group, str) else list(group)))
    if "pval_adj" in table.columns:
        for test in (F.col("pval_adj") < pval_cutoff if pval_cutoff is not None else None, F.col("logfoldchange") > log2fc_min if log2fc_min is not None else None, F.col("logfoldchange") < log2fc_max if log2fc_max is not None else None):
            table = table.where(test) if test is not None else table
    return table.drop("group") if isinstance(group, str) else table


def expressed_fractions(ds: CellDataset, groupby: str) -> DataFrame:
    """``(group, gene_id, inside, outside)``: shares of cells with a stored entry, in the group and in all others."""
    ones = ds.with_(X=ds.X.withColumn("value", F.lit(1.0)))
    m = group_moments(ones.X, ds.obs, ds.var, groupby)
    return m.select("group", "gene_id", (F.col("s1") / F.col("n")).alias("inside"), F.try_divide(F.col("t1") - F.col("s1"), F.col("n_all") - F.col("n")).alias("outside"))


def mean_folds(ds: CellDataset, groupby: str) -> DataFrame:
    """``(group, gene_id, fold)``: log2 ratios of the means in a group and in all other cells, whatever base their logarithms
    have (``uns["log1p"]["base"]``, natural if it is not told)."""
    base = (ds.uns.get("log1p") or {}).get("base")
    grow = lambda m: F.expm1(m * math.log(base) if base else m) + 1e-9
    m = group_moments(ds.X, ds.obs, ds.var, groupby)
    other = F.try_divide(F.col("t1") - F.col("s1"), F.col("n_all") - F.col("n"))
    return m.select("group", "gene_id", F.log2(grow(F.col("s1") / F.col("n")) / grow(other)).alias("fold"))


def filter_rank_genes_groups(ds: CellDataset, table: DataFrame, groupby: str, min_in: float = 0.25, max_out: float = 0.5, min_fold: float = 2.0, own_folds: bool = False) -> DataFrame:
    """The table with ``name``, its ``gene_id`` or null where a gene is too rare inside, too common outside or too little changed.

    The table's fold changes count, unless ``own_folds`` asks for those of ``groupby`` against the rest: a table of another
    grouping, against a reference, or without fold changes has none that fit.
    """
    met, fold = table.join(expressed_fractions(ds, groupby), ["group", "gene_id"]), "logfoldchange"
    if own_folds or fold not in table.columns:
        met, fold = met.join(mean_folds(ds, groupby), ["group", "gene_id"]), "fold"
    keep = (F.col("inside") > min_in) & (F.col("outside") < max_out) & (F.col(fold) > min_fold)
    return met.withColumn("name", F.when(keep, F.col("gene_id"))).select(*table.columns, "name")


MEASURES = ("overlap_count", "overlap_coef", "jaccard")


def marker_gene_overlap(table: DataFrame, reference: Mapping[str, Sequence[int]] | DataFrame, top_n: int = 100) -> DataFrame:
    """``(set_name, group, overlap_count, overlap_coef, jaccard)`` of each group's first genes and each reference set."""
    if top_n < 1:
        warnings.warn("top_n has to be 1 or more; the first gene is taken", stacklevel=2)
        top_n = 1
    if not isinstance(reference, DataFrame):
        reference = table.sparkSession.createDataFrame([(k, g) for k, v in reference.items() for g in v], "set_name string, gene_id long")
    reference = reference.select("set_name", "gene_id").distinct()
    called = table.where(F.col("rank") < top_n).select("group", "gene_id").distinct()
    a, b = called.groupBy("group").agg(F.count("*").alias("a")), reference.groupBy("set_name").agg(F.count("*").alias("b"))
    both = called.join(reference, "gene_id").groupBy("set_name", "group").agg(F.count("*").alias("k"))
    k = F.coalesce("k", F.lit(0))
    met = b.crossJoin(a).join(both, ["set_name", "group"], "left")
    return met.select("set_name", "group", k.cast("long").alias("overlap_count"), (k / F.greatest(F.least("a", "b"), F.lit(1))).alias("overlap_coef"), (k / F.greatest(F.col("a") + F.col("b") - k, F.lit(1))).alias("jaccard"))
