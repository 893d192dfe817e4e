"""The annotated matrix: stored entries in long form with annotations of its rows (cells) and columns (genes)."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class CellDataset:
    """``X(cell_id, gene_id, value)`` holds stored entries only; absent pairs are zeros.

    ``obs(cell_id, ...)`` and ``var(gene_id, ...)`` name all cells and genes, also those without a stored entry. ``obsm`` and
    ``varm`` hold arrays by id (``vec``), ``obsp`` graphs ``(src, dst, weight)``, ``layers`` other matrices of the same shape.
    Operators return a new dataset or a table; nothing is changed in place.
    """

    X: DataFrame
    obs: DataFrame
    var: DataFrame
    obsm: dict[str, DataFrame] = field(default_factory=dict)
    varm: dict[str, DataFrame] = field(default_factory=dict)
    obsp: dict[str, DataFrame] = field(default_factory=dict)
    layers: dict[str, DataFrame] = field(default_factory=dict)
    uns: dict[str, object] = field(default_factory=dict)

    def with_(self, **changes: object) -> CellDataset:
        return replace(self, **changes)

    def subset(self, obs: DataFrame | None = None, var: DataFrame | None = None) -> CellDataset:
        """Only the cells and genes that ``obs`` and ``var`` name; ids stay as they are."""
        out = self
        for ids, key in ((obs, "cell_id"), (var, "gene_id")):
            if ids is None:
                continue
            keep = ids.select(key)
            side = "obs" if key == "cell_id" else "var"
            m = "obsm" if side == "obs" else "varm"
            changes: dict[str, object] = {
                "X": out.X.join(keep, key, "left_semi"),
                side: getattr(out, side).join(keep, key, "left_semi"),
                m: {k: v.join(keep, key, "left_semi") for k, v in getattr(out, m).items()},
                "layers": {k: v.join(keep, key, "left_semi") for k, v in out.layers.items()},
            }
            if side == "obs":
                changes["obsp"] = {k: g.join(keep.select(F.col(key).alias("src")), "src", "left_semi").join(keep.select(F.col(key).alias("dst")), "dst", "left_semi").select(g.columns) for k, g in out.obsp.items()}
            out = out.with_(**changes)
        return out

    def problems(self) -> DataFrame:
        """``(problem, n)``: entries of unknown cells or genes, and (cell, gene) pairs stored more than once."""
        checks = [
            self.X.join(self.obs, "cell_id", "left_anti").agg(F.lit("unknown cell").alias("problem"), F.count("*").alias("n")),
            self.X.join(self.var, "gene_id", "left_anti").agg(F.lit("unknown gene").alias("problem"), F.count("*").alias("n")),
            self.X.groupBy("cell_id", "gene_id").count().where("count > 1").agg(F.lit("repeated entry").alias("problem"), F.count("*").alias("n")),
        ]
        return checks[0].unionByName(checks[1]).unionByName(checks[2])

    def density(self) -> float:
        n, m, stored = self.obs.count(), self.var.count(), self.X.count()
        return stored / (n * m) if n and m else 1.0

    def write(self, path: str, cell_buckets: int | None = None) -> None:
        """One Parquet folder per slot; ``X`` is clustered by cell, so that readers of some cells skip the rest. What ``uns`` holds
        besides tables is kept as JSON, and anything that JSON cannot say is an error."""
        x = self.X.repartitionByRange(cell_buckets, "cell_id") if cell_buckets else self.X.repartitionByRange("cell_id")
        x.sortWithinPartitions("cell_id", "gene_id").write.mode("overwrite").parquet(f"{path}/X")
        for side in ("obs", "var"):
            getattr(self, side).write.mode("overwrite").parquet(f"{path}/{side}")
        for slot in ("obsm", "varm", "obsp", "layers"):
            for name, df in getattr(self, slot).items():
                df.write.mode("overwrite").parquet(f"{path}/{slot}/{name}")
        plain, tables = {}, {}
        for key, value in self.uns.items():
            plain[key] = _plain(value, key, tables)
        spark = self.X.sparkSession
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{path}/uns_tables/{name}")
        spark.createDataFrame([(json.dumps(plain),)], "told string").coalesce(1).write.mode("overwrite").parquet(f"{path}/uns")

    @staticmethod
    def read(spark: SparkSession, path: str, **slots: tuple[str, ...]) -> CellDataset:
        """``slots``: names to read of each optional slot, as in ``obsm=("X_pca",)``."""
        read = spark.read.parquet
        more = {slot: {n: read(f"{path}/{slot}/{n}") for n in names} for slot, names in slots.items()}
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/uns")
        uns = {}
        if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            uns = _with_tables(json.loads(read(f"{path}/uns").first()[0]), lambda name: read(f"{path}/uns_tables/{name}"))
        return CellDataset(read(f"{path}/X"), read(f"{path}/obs"), read(f"{path}/var"), uns=uns, **more)


def _plain(value: object, name: str, tables: dict[str, DataFrame]) -> object:
    """``value`` with its tables taken out into ``tables`` and named instead."""
    if isinstance(value, DataFrame):
        tables[name] = value
        return {"__table__": name}
    if isinstance(value, dict):
        return {k: _plain(v, f"{name}.{k}", tables) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [_plain(v, f"{name}.{i}", tables) for i, v in enumerate(value)]
    return value


def _with_tables(value: object, read) -> object:
    if isinstance(value, dict):
        return read(value["__table__"]) if set(value) == {"__table__"} else {k: _with_tables(v, read) for k, v in value.items()}
    return [_with_tables(v, read) for v in value] if isinstance(value, list) else value


def require(slot: dict[str, DataFrame], key: str, what: str) -> DataFrame:
    if key not in slot:
        raise KeyError(f"{what} has no {key!r}")
    return slot[key]
