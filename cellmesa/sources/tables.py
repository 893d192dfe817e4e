"""Annotated matrices from a star schema of orders, and from triples and files."""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import CellDataset
from ..settings import settings


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("cell_id"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("gene_id"), "l_quantity")
    return lines.join(orders, "k").select("cell_id", "gene_id", "l_quantity")


def _obs(spark: SparkSession, sf_dir: str, x: DataFrame) -> DataFrame:
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cell_id"), F.col("c_mktsegment").alias("grp"), F.col("c_nationkey").alias("batch"), F.col("c_acctbal").alias("cov"))
    return customer.join(x.select("cell_id").distinct(), "cell_id", "left_semi")


def wide_dataset(spark: SparkSession, sf_dir: str) -> CellDataset:
    """Customers with orders as cells, their parts as genes, summed quantities as counts."""
    x = _quantities(spark, sf_dir).groupBy("cell_id", "gene_id").agg(F.sum("l_quantity").alias("value"))
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("gene_id"), "p_brand", "p_type", "p_size")
    var = part.join(x.select("gene_id").distinct(), "gene_id", "left_semi").withColumn("flagged", F.col("p_type") == "PROMO")
    return CellDataset(x, _obs(spark, sf_dir, x), var)


def compact_dataset(spark: SparkSession, sf_dir: str) -> CellDataset:
    """The same cells with brands as genes: a matrix narrow enough to be made dense."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("gene_id"), F.expr("cast(substr(p_brand, 7) as bigint)").alias("brand"))
    x = _quantities(spark, sf_dir).join(part, "gene_id").groupBy("cell_id", F.col("brand").alias("gene_id")).agg(F.sum("l_quantity").alias("value"))
    var = x.select("gene_id").distinct().withColumn("var_name", F.concat(F.lit("Brand#"), F.col("gene_id").cast("string")))
    return CellDataset(x, _obs(spark, sf_dir, x), var)


def embedding_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(cell_id, vec, label, batch)`` of the embeddings."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("cell_id"), F.col("embedding").cast("array<double>").alias("vec"), F.col("label").cast("string").alias("label"), (F.col("vec_id") % 2).cast("string").alias("batch"))


def events_dataset(spark: SparkSession, sf_dir: str) -> CellDataset:
    """Users as cells, event types as genes (numbered in order), their counts as values."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("cell_id"), "event_type")
    names = events.select("event_type").distinct()
    from pyspark.sql import Window

    var = names.select(F.dense_rank().over(Window.orderBy("event_type")).cast("long").alias("gene_id"), F.col("event_type").alias("var_name"))
    x = events.join(F.broadcast(var), F.col("event_type") == F.col("var_name")).groupBy("cell_id", "gene_id").agg(F.count("*").cast("double").alias("value"))
    return CellDataset(x, events.select("cell_id").distinct(), var)


def from_triples(x: DataFrame, obs: DataFrame | None = None, var: DataFrame | None = None, cell: str = "cell_id", gene: str = "gene_id", value: str = "value") -> CellDataset:
    """A dataset from a table of stored entries; without annotations, the ids that it names."""
    entries = x.select(F.col(cell).cast("long").alias("cell_id"), F.col(gene).cast("long").alias("gene_id"), F.col(value).cast("double").alias("value"))
    return CellDataset(entries, obs if obs is not None else entries.select("cell_id").distinct(), var if var is not None else entries.select("gene_id").distinct())


def open_backed(spark: SparkSession, path: str) -> CellDataset:
    """A dataset written by ``CellDataset.write`` with all its slots; rows are read by whoever scans it, never by the driver."""
    if path.rstrip("/").endswith((".csv", ".h5ad", ".txt")):
        raise ValueError("a backed dataset is a folder of Parquet tables")
    fs, at = _files(spark, path)
    if not fs.exists(at("X")) and fs.exists(at("X.old")):  # a rewriting that was cut off
        fs.rename(at("X.old"), at("X"))
    slots = {}
    for slot in ("obsm", "varm", "obsp", "layers"):
        if fs.exists(at(slot)) and (names := sorted(s.getPath().getName() for s in fs.listStatus(at(slot)))):
            slots[slot] = tuple(names)
    return CellDataset.read(spark, path, **slots)


def block_size_for(n_vars: int, density: float = 1.0, max_memory_gb: float = 4.0, chunk_size: int = 0) -> int:
    """Rows of a block that fits in memory: a dense single-precision row with its stored entries. ``chunk_size`` wins if set."""
    if chunk_size > 0:
        return chunk_size
    row = 4 * n_vars + 8 * math.ceil(density * n_vars) + 4
    return max(1, int(max_memory_gb * 2**30) // row)


def _placed(ds: CellDataset, block_size: int) -> DataFrame:
    """``(cell_id, at, block)`` of every cell, by consecutive blocks in id order."""
    from ..operators.prep import numbered

    if block_size < 1:
        raise ValueError("a block has one row or more")
    return numbered(ds.obs.select("cell_id"), "cell_id").withColumn("block", F.expr(f"at div {int(block_size)}"))


def row_blocks(ds: CellDataset, block_size: int) -> DataFrame:
    """``(block, start, n_rows, n_stored)`` of consecutive blocks of cells in id order, the last one short."""
    stored = ds.X.groupBy("cell_id").agg(F.count("*").alias("k"))
    return _placed(ds, block_size).join(stored, "cell_id", "left").groupBy("block").agg(F.min("at").alias("start"), F.count("*").alias("n_rows"), F.coalesce(F.sum("k"), F.lit(0)).alias("n_stored"))


def blocks(ds: CellDataset, block_size: int | None = None) -> Iterator[tuple[int, int, CellDataset]]:
    """``(start, stop, dataset of those rows)`` of consecutive blocks of cells in id order, as a reader out of memory takes them.

    Without a size, blocks are as large as ``settings.max_memory_gb`` allows, or ``settings.chunk_size`` where it is set.
    """
    if block_size is None:
        n_vars = ds.var.count()
        block_size = block_size_for(n_vars, ds.density(), settings.max_memory_gb, settings.chunk_size)
    placed, n = _placed(ds, block_size), ds.obs.count()
    for block in range(-(-n // block_size)):
        yield block * block_size, min(n, (block + 1) * block_size), ds.subset(obs=placed.where(F.col("block") == block))


def rewrite_matrix(spark: SparkSession, path: str, change) -> CellDataset:
    """Replace the matrix of a dataset on disk by ``change(dataset).X``, cluster-side and without holding it anywhere.

    The new version is written beside the old one; then the old one is set aside, the new one takes its place, and the old one
    is deleted. At every moment a whole version is there: ``open_backed`` takes back one that was set aside and not replaced.
    The pattern of stored entries has to stay: another number of entries is an error.
    """
    old = open_backed(spark, path)
    change(old).X.write.mode("overwrite").parquet(f"{path}/X.new")
    if spark.read.parquet(f"{path}/X.new").count() != old.X.count():
        raise ValueError("the number of stored entries has changed")
    fs, at = _files(spark, path)
    fs.delete(at("X.old"), True)
    for one, other in (("X", "X.old"), ("X.new", "X")):
        if not fs.rename(at(one), at(other)):
            raise OSError(f"{path}/{one} could not be renamed")
    fs.delete(at("X.old"), True)
    return open_backed(spark, path)


def _files(spark: SparkSession, path: str):
    """The file system of a folder, and paths below it."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    return jvm.org.apache.hadoop.fs.Path(path).getFileSystem(conf), lambda name: jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
