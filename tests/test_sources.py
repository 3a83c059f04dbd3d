import json
import os

import pytest
from pyspark.sql import functions as F

from axonframe.sources import checks, files
from axonframe.streaming import windows


def test_areas(spark, tmp_path):
    (tmp_path / "areas.json").write_text(json.dumps({"V1": "visual", "M1": "motor"}))
    assert {tuple(r) for r in files.read_areas(spark, str(tmp_path / "areas.json")).collect()} == {("v1", "visual"), ("m1", "motor")}


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 0.5)], "n long, s string, x double")
    files.write_csv(df, str(tmp_path / "c"))
    assert files.read_csv(spark, str(tmp_path / "c"), "n long, s string, x double").collect() == df.collect()


def test_raw_trials(spark, tmp_path):
    import pandas as pd

    for k in range(3):
        (tmp_path / f"trial{k}.bin").write_bytes(bytes([k, k + 1]))

    def kernel(path, content):
        import pandas as pd

        return pd.DataFrame({"trial": [int(path[-5])] * len(content), "t_idx": range(len(content)), "value": [float(b) for b in content]})

    rows = files.raw_trials(spark, str(tmp_path), kernel, "trial long, t_idx long, value double").collect()
    assert {(r.trial, r.t_idx, r.value) for r in rows} == {(k, i, float(k + i)) for k in range(3) for i in range(2)}
    assert pd is not None


def streamed(spark, tmp_path, build, name):
    path = os.path.join(tmp_path, name)
    spark.sql("SELECT timestamp_seconds(id * 30) AS ts, id % 2 AS node, CAST(CASE WHEN id % 7 = 0 THEN 0 ELSE 1 END AS DOUBLE) AS value FROM range(60)").coalesce(1).write.parquet(path)
    stream = spark.readStream.schema("ts timestamp, node long, value double").parquet(path)
    query = build(stream).writeStream.format("memory").queryName(name).outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    return spark.table(name)


def test_tumbling_stream(spark, tmp_path):
    out = streamed(spark, tmp_path, lambda s: windows.tumbling_any(s, "5 minutes", "1 minute"), "tumbling")
    assert out.filter(F.col("n") == 5).count() == out.count() >= 8


def test_session_stream(spark, tmp_path):
    out = streamed(spark, tmp_path, lambda s: windows.bursts(s.filter("value > 0"), "70 seconds", "1 minute"), "bursts")
    assert out.count() > 4 and out.agg(F.max("n")).first()[0] <= 7


def test_stateful_runs(spark, tmp_path):
    rows = streamed(spark, tmp_path, windows.running_lengths, "running").collect()
    for node in (0, 1):
        length = 0
        for r in sorted((r for r in rows if r.node == node), key=lambda r: r.ts):
            k = int(r.ts.timestamp() // 30)
            length = length + 1 if k % 7 else 0
            assert r.length == length


def test_values_in_their_domain():
    checks.check_values(None, [1, 2, 3])
    checks.check_values([1, 3], [1, 2, 3])
    checks.check_values([float("nan"), 0], [None, 0, 1])
    with pytest.raises(checks.InvalidInput):
        checks.check_values([1, 4], [1, 2, 3], "trial_type")


def test_edge_lists_are_checked(spark):
    e = spark.createDataFrame([(0, 1, 2, 0.5)], "f long, src long, dst long, weight double")
    assert checks.check_edges(e, ["f"], weighted=True) is e
    for bad, weighted in ((e.drop("dst"), False), (e.drop("weight"), True), (e.withColumn("weight", F.lit("x")), True)):
        with pytest.raises(checks.InvalidInput):
            checks.check_edges(bad, ["f"], weighted)


def test_columns_that_share_a_name(spark):
    df = spark.sql("SELECT 1 AS a, 2 AS b, 3 AS a")
    assert [tuple(r) for r in checks.unique_columns(df).collect()] == [(1, 2)] and checks.unique_columns(df).columns == ["a", "b"]
