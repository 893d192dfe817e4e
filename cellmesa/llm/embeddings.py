"""Near-duplicate embeddings by counting collisions on one-dimensional projections.

Unit vectors are projected on random orthonormal directions. Each projection of a group of vectors is sorted, every vector's
window around itself is counted pair by pair, and pairs that collide at least as often as the calibrated count are verified by
cosine in double precision. The count is set so that a pair at the threshold itself misses it with probability ``MISS`` over
the choice of directions (closer pairs more rarely).

A label with few vectors is one group. One with more is dealt to cells by the signs of further projections, several to a cell,
and that again in so many independent tables that a pair at the threshold shares no cell of any with probability ``MISS``; a
pair that shares several is counted in the first. The signs taken grow with the logarithm of the label's vectors, so that cells
stay small, and the tables far more slowly. Cells that are still large (vectors of a narrow cone), and labels for which tables
would be more work, are cut into blocks, each pair of which is one group.

Equal vectors of a label are one class with a weight, so copies cost nothing and are not paired among themselves; a task sends
link counts and edges of local components, never pairs. Classes are told apart by 128-bit hashes. Vectors that are null or zero,
or hold null or non-finite components, those without a label and those without an id link with nothing. Vectors of different
lengths do not link. Rows are vectors: rows that share an id, or agree in all columns, count as others of each other.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, forest, joined_by_class, runs, small_batches, stored

#: Vectors of a group, and projections that are counted.
BLOCK, COUNTED = 2048, 17
#: Signs by which cells are smaller than a group.
SMALLER = 3
#: How often a pair at the threshold may be missed, by the count and by the tables each.
MISS = 1e-7


def directions(dim: int, seed: int = 11) -> np.ndarray:
    """Orthonormal directions as columns: all of a space of few dimensions, else those counted."""
    q, r = np.linalg.qr(np.random.RandomState(seed).normal(size=(dim, dim)))
    return (q * np.sign(np.diag(r)))[:, :COUNTED]


def radius(cosine: float) -> float:
    return math.sqrt(max(0.0, 2 - 2 * cosine)) + 1e-9


def calibrated(dim: int, cosine: float, recall: float = 1 - MISS) -> tuple[float, int]:
    """(half width of a window, collisions that a pair needs). The projections of a pair's difference are close to normal in
    many dimensions; in few, the window is the whole radius and linked pairs collide always."""
    m = min(dim, COUNTED)
    if dim < 2 * COUNTED:
        return radius(cosine), m
    sigma, z = radius(cosine) / math.sqrt(dim), 2.5
    hit, tail, count = math.erf(z / math.sqrt(2)), 0.0, 0
    while count < m:
        tail += math.comb(m, count) * hit**count * (1 - hit) ** (m - count)
        if tail > 1 - recall:
            break
        count += 1
    return z * sigma, count


def dealing(n: int, cosine: float) -> tuple[int, int]:
    """(signs, tables) by which ``n`` vectors of a label are dealt; no signs where they fit a group, or tables cost more."""
    if n <= BLOCK:
        return 0, 1
    signs = math.ceil(math.log2(n / BLOCK)) + SMALLER
    kept = (1 - math.acos(max(-1.0, min(1.0, cosine))) / math.pi) ** signs
    tables = math.ceil(math.log(MISS) / math.log1p(-kept)) if 0 < kept < 1 else 1
    return (signs, tables) if 2 * tables <= 2**signs else (0, 1)


def unit(values: list | None) -> np.ndarray | None:
    if not values or None in values:
        return None
    v = np.array(values, np.float64)
    most = np.abs(v).max()
    if not np.isfinite(most) or most == 0:
        return None
    v = v / most + 0.0
    return v / math.sqrt(float(v @ v))


def colliding(a: np.ndarray, b: np.ndarray, width: float, least: int) -> np.ndarray:
    """(i, j) rows of projections ``a`` and ``b`` that lie within ``width`` on at least ``least`` of the columns."""
    found, step = [], max(1, 2_000_000 // max(1, len(b)))
    order = np.argsort(b, axis=0, kind="stable")
    places = np.argsort(order, axis=0, kind="stable")
    for at in range(0, len(a), step):
        part = a[at : at + step]
        counts = np.zeros((len(part), len(b)), np.int8)
        rows = np.arange(len(part))
        for k in range(a.shape[1]):
            line = b[order[:, k], k]
            window = np.zeros((len(part), len(b) + 1), np.int8)
            window[rows, np.searchsorted(line, part[:, k] - width, "left")] = 1
            window[rows, np.searchsorted(line, part[:, k] + width, "right")] -= 1  # an empty window opens and closes at one place
            np.cumsum(window, axis=1, dtype=np.int8, out=window)
            counts += window[:, places[:, k]]
        i, j = np.nonzero(counts >= least)
        found.append(np.stack([i + at, j], 1))
    return np.concatenate(found) if found else np.empty((0, 2), np.int64)


def linked(a: np.ndarray, b: np.ndarray, cosine: float, same: bool) -> np.ndarray:
    """Verified pairs of rows of ``a`` and ``b``; of one block with itself, each pair once."""
    d = directions(a.shape[1])
    width, least = calibrated(a.shape[1], cosine)
    pairs = colliding(a @ d, b @ d, width, least)
    if same:
        pairs = pairs[pairs[:, 0] < pairs[:, 1]]
    kept = [pairs[at : at + 200_000][np.einsum("ij,ij->i", a[pairs[at : at + 200_000, 0]], b[pairs[at : at + 200_000, 1]]) >= cosine] for at in range(0, len(pairs), 200_000)]
    return np.concatenate(kept) if kept else pairs


def _unit_rows(rows: DataFrame) -> DataFrame:
    """``(id, label, hi, lo, dim, vec)`` of every row; all but the id are null where it cannot link."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row_id, vec, label in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                u = unit(vec)
                if u is None or row_id is None or label is None:
                    out.append((row_id, None, None, None, None, None))
                    continue
                raw = u.tobytes()
                d = hashlib.blake2b(label.encode() + b"\0" + raw, digest_size=16).digest()
                out.append((row_id, label, int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True), len(u), raw))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], names=["id", "label", "hi", "lo", "dim", "vec"])

    return rows.select("id", "vec", "label").mapInArrow(work, "id long, label string, hi long, lo long, dim int, vec binary")


def _dealt(classes: DataFrame, cosine: float) -> DataFrame:
    """Adds ``cells``, the cell of each class in each table of its label, to ``(label, dim, node, weight, vec, n)``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[tuple[int, int, int], np.ndarray] = {}
        for batch in batches:
            cells: list[list[int]] = []
            for dim, vec, n in zip(*(batch.column(c).to_pylist() for c in ("dim", "vec", "n")), strict=True):
                signs, tables = dealing(n, cosine)
                if not signs:
                    cells.append([0])
                    continue
                key = (dim, signs, tables)
                if key not in planes:
                    planes[key] = np.random.RandomState(23).normal(size=(dim, signs * tables))
                bits = (np.frombuffer(vec, np.float64) @ planes[key] >= 0).reshape(tables, signs)
                cells.append((bits @ (1 << np.arange(signs))).tolist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.list_(pa.int64()))], names=[*batch.schema.names, "cells"])

    return classes.mapInArrow(work, "label string, dim int, node long, weight long, vec binary, n long, cells array<long>")


def _group_links(cosine: float):
    """For ``mapInArrow`` over rows sorted by group ``(label, dim, turn, cell, x, y)``: ``(node, links, root)`` of each group."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, 6):
            dim, turn, same = table.column("dim")[0].as_py(), table.column("turn")[0].as_py(), table.column("x")[0] == table.column("y")[0]
            if table.num_rows < 2:
                continue
            node, weight = table.column("node").to_numpy(), table.column("weight").to_numpy()
            vec = np.frombuffer(b"".join(table.column("vec").to_pylist()), np.float64).reshape(-1, dim)
            left = np.array(table.column("left").to_pylist(), bool)
            a = np.flatnonzero(left)
            b = a if same else np.flatnonzero(~left)
            pairs = linked(vec[a], vec[b], cosine, same)
            i, j = a[pairs[:, 0]], b[pairs[:, 1]]
            if turn and len(i):  # a pair that has shared a cell of an earlier table was counted there
                earlier = np.array(table.column("cells").to_pylist(), np.int64)[:, :turn]
                new = np.concatenate([~(earlier[i[k : k + 200_000]] == earlier[j[k : k + 200_000]]).any(axis=1) for k in range(0, len(i), 200_000)])
                i, j = i[new], j[new]
            links = np.zeros(len(node), np.int64)
            np.add.at(links, i, weight[j])
            np.add.at(links, j, weight[i])
            hit = np.flatnonzero(links)
            root = dict(zip(*(x.tolist() for x in forest(node[i], node[j])), strict=True))
            own = node[hit].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(links[hit]), pa.array([root.get(x, x) for x in own], pa.int64())], names=["node", "links", "root"])

    return work


def near_duplicates(vectors: DataFrame, cosine: float = 0.98, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``(id, n_links, component_id, kept)`` for every row; see the module's text."""
    small_batches(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"), F.col(label_col).cast("string").alias("label"))
    units = stored(_unit_rows(rows), "units")
    first = [F.first(c).alias(c) for c in ("label", "dim", "vec")]
    grouped = units.where("hi is not null").groupBy("hi", "lo").agg(F.min("id").alias("rep"), F.count("*").alias("weight"), *first)
    classes = stored(grouped.withColumn("node", F.monotonically_increasing_id()), "classes")
    sizes = stored(classes.groupBy("label", "dim").agg(F.count("*").alias("n")), "sizes")
    named = joined_by_class(classes, sizes, ["label", "dim"], "n").select("label", "dim", "node", "weight", "vec", "n")
    dealt = stored(_dealt(named, cosine), "cells")
    each = dealt.select("label", "dim", "node", "weight", "vec", "cells", F.posexplode("cells").alias("turn", "cell"))
    cell = ["label", "dim", "turn", "cell"]
    wide = each.groupBy(*cell).agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).select(*cell, F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    if wide.isEmpty():
        paired = each.withColumns({"x": F.lit(0), "y": F.lit(0), "left": F.lit(True)})
    else:
        own = each.join(wide, cell, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
        other = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        paired = other.withColumns({"x": F.least("own", "other"), "y": F.greatest("own", "other"), "left": F.col("own") <= F.col("other")})
    groups = [*cell, "x", "y"]
    by_group = paired.select(*groups, "left", "node", "weight", "vec", "cells").repartition(*groups).sortWithinPartitions(*groups)
    found = stored(by_group.mapInArrow(_group_links(cosine), "node long, links long, root long"), "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    parts = components(found.select(F.col("node").alias("a"), F.col("root").alias("b"))).withColumnRenamed("id", "node")
    least = classes.select("hi", "lo", "node", "rep", "weight").join(parts, "node", "left").join(links, "node", "left").withColumn("component", F.coalesce("component", "node"))
    names = least.groupBy("component").agg(F.min("rep").alias("component_id"))
    told = least.join(names, "component").select("hi", "lo", "component_id", F.col("weight").alias("copies"), (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    known = joined_by_class(units.where("hi is not null").select("id", "hi", "lo"), stored(told, "told"), ["hi", "lo"], "copies")
    alone = units.where("hi is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    whole = known.select("id", "n_links", "component_id").unionByName(alone)
    return whole.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
