import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, ".")
entry = pytest.importorskip("__spark_entry__")


def test_registry():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) >= 70


def test_streams(spark, tmp_path):
    from cellmesa.streaming import incremental as inc

    rows = [(i, i % 3, "a" if i % 2 else "b", float(i)) for i in range(50)]
    for k in range(5):
        part = spark.createDataFrame(rows[k::5], "event_id long, user_id long, event_type string, value double")
        part.select("event_id", F.timestamp_seconds(F.col("event_id") * 600).cast("timestamp_ntz").alias("ts"), "user_id", "event_type", "value", F.lit("{}").alias("props")).coalesce(1).write.parquet(f"file://{tmp_path}/e{k}/events.parquet")
    def stream():
        return spark.readStream.schema(inc.EVENTS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"file://{tmp_path}")

    got = {r.gene: r for r in inc.drained(inc.gene_moments(stream()), "m").collect()}
    assert got["a"].n == 25 and got["a"].mean == 25.0 and abs(got["a"]["var"] - 216.6666667) < 1e-6
    assert {r.cell_id: r.total for r in inc.drained(inc.cell_totals(stream()), "t").collect()} == {0: 17.0, 1: 17.0, 2: 16.0}
    assert sum(r.n for r in inc.drained(inc.windowed_totals(stream(), late="100 hours"), "w").collect()) == 50
