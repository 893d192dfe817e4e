"""Shared pieces of the corpus operators: shared-folder tables, Arrow map helpers and connected components."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words, as a character class body of Java and DuckDB patterns.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"
#: So many edges (16 bytes each) one task holds at once when it contracts them.
EDGES_AT_ONCE = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``. Only a local master may leave it unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.cellmesa.shared.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints", uuid.uuid4().hex)
        spark.conf.set("spark.cellmesa.shared.dir", found)
    at = spark._jvm.org.apache.hadoop.fs.Path(found)
    whole = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()
    return re.sub("^file:/(?!/)", "file:///", whole).rstrip("/")


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/cellmesa/{spark.sparkContext.applicationId}"


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below this application's part of the shared folder."""
    return f"{_own_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends here and survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables of ``stored`` that no later step reads."""
    for table in tables:
        _delete(table.sparkSession, table.stored_at)


def release(spark: SparkSession) -> None:
    """Delete what the corpus operators of this application have written. Results not yet written elsewhere are lost."""
    _delete(spark, _own_dir(spark))


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def small_batches(spark: SparkSession) -> None:
    """Bound what passes between the JVM and Python at once: texts are long, and both sides hold a batch more than once."""
    for key, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", "2000"), ("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))):
        spark.conf.set(key, value)


def slices(batches: Iterator[pa.RecordBatch], column: int, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of rows whose values in ``column`` hold about ``most`` bytes; a longer value stands alone."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = total = 0
        for i, size in enumerate(sizes):
            if i > start and total + size > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size
        if start < len(sizes):
            yield batch.slice(start)


def joined_by_class(rows: DataFrame, classes: DataFrame, on: list[str], copies: str) -> DataFrame:
    """``rows`` with the columns of their class, from a stored table with one row and the number of rows for each.

    Classes so large that one would stand out in its task, of which there are at most four for each shuffle partition, are
    broadcast, so their rows stay where they are; all others are joined by key.
    """
    parts = 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = classes.agg(F.sum(copies)).first()[0] or 0
    hot = classes.where(F.col(copies) > max(100, total // parts))
    here = rows.join(F.broadcast(hot), on)
    rest = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(classes.hint("merge"), on)
    return here.unionByName(rest)


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The runs of rows that agree in the first ``keys`` columns, in the order of sorted batches; one run is held at a time."""
    held, now = [], None
    for batch in batches:
        start = 0
        for i, key in enumerate(zip(*(batch.column(k).to_pylist() for k in range(keys)), strict=True)):
            if key == now:
                continue
            if i > start:
                held.append(batch.slice(start, i - start))
            if held:
                yield pa.Table.from_batches(held)
            held, start, now = [], i, key
        if start < batch.num_rows:
            held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) for each node of the edges that is not the smallest itself."""
    ids, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    root = np.arange(len(ids))
    while True:
        x, y = root[i], root[j]
        open_ = x != y
        if not open_.any():
            break
        i, j, x, y = i[open_], j[open_], x[open_], y[open_]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))  # hook the larger root below the smaller
        while (root[root] != root).any():
            root = root[root]
    hit = np.flatnonzero(root != np.arange(len(ids)))
    return ids[hit], ids[root[hit]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges ``(u, v)`` as stars around the smallest node of what they connect, run by run of bounded size."""

    def told(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        u, v = forest(table.column(0).to_numpy(), table.column(1).to_numpy())
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= EDGES_AT_ONCE:
            yield told(held)
            held, n = [], 0
    if n:
        yield told(held)


def contracted(edges: DataFrame, tasks: int) -> tuple[DataFrame, int]:
    """A stored table of edges ``(u, v)``, ``u > v``, with the same components, contracted in so many tasks, and its size."""
    out = stored(edges.repartition(tasks).mapInArrow(_contract, "u long, v long"), "edges")
    return out, out.count()


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the undirected edges ``(a, b)``.

    Returns ``(id, component)`` for each id that has an edge to another id; the component is its smallest id. Nulls and
    loops are ignored. Edges are dealt to a sixteenth of the shuffle partitions, each of which contracts its own to stars, a
    bounded number at a time. While more are left than one task holds at once, they are brought nearer to their components by
    the alternating large-star and small-star steps of Kiveris et al. (2014), each a grouped minimum (combined before the
    shuffle, so that a hub costs one row per task) and a join that Spark may split by skew; when they fit one task, or settle
    before, they are done. Each step's edges are a table in the shared folder, and the one before it is deleted.
    """
    some = max(1, int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 16)
    a, b = F.col("a").cast("long"), F.col("b").cast("long")
    now, n = contracted(edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")), some)
    before = None
    while n > EDGES_AT_ONCE:
        small = contracted(now, max(some, -(-n // EDGES_AT_ONCE)))
        dropped(now)
        both = small[0].select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(small[0].select(F.col("v").alias("x"), F.col("u").alias("y")))
        low = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = stored(both.where("y > x").join(low, "x").where("y <> m").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct(), "edges")
        dropped(small[0])
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        tails = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = stored(tails.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        dropped(large)
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003), F.sum(F.xxhash64("v", "u") % 998_244_353)).first()
        if mark == before:
            break
        before, n = mark, mark[0]
    else:
        done, _ = contracted(now, 1)
        dropped(now)
        now = done
    roots = now.select(F.col("v").alias("id")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots.select("id", F.col("id").alias("component")))
