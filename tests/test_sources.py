import json

from pyspark.sql import functions as F

from tallyforge.operators import export as X
from tallyforge.sources import masters, sinks
from tallyforge.streaming import intake


def test_master(spark, tmp_path):
    (tmp_path / "m.csv").write_text("RMS Item ID,Description,Supplier ID,UOM,Unit Cost,Extra\nR1,Soap,S,EA,\"1,200.5\",x\nR1,Soap,s,ea,7,x\nR2,,S,EA,-1,x\n")
    rows = masters.read_master(spark, str(tmp_path / "m.csv")).collect()
    assert len(rows) == 3 and len({r.item_key for r in rows}) == 3
    assert sorted(r.occurrence for r in rows if r.rms_item_id == "R1") == [1, 2]
    assert {r.rms_item_id: list(r.faults) for r in rows}["R2"] == ["description", "negative_cost"]
    assert sorted(float(r.cost) for r in rows) == [-1.0, 7.0, 1200.5]


def test_aliases(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"aliases": [{"supplier_id": "S", "description": "Old Soap!", "rms_item_id": "R1", "uom": "pcs"}, {"supplier_id": "S", "description": "x", "rms_item_id": "R2"}, {"supplier_id": "T", "description": "x", "rms_item_id": "R1"}]}))
    items = spark.createDataFrame([("s ", "R1", "k1"), ("S", "R2", "k2"), ("S", "R2", "k3")], "supplier_id string, rms_item_id string, item_key string")
    good, bad = masters.read_aliases(spark, str(tmp_path / "a.json"), items)
    assert [(r.norm, r.uom, r.item_key) for r in good.collect()] == [("old soap", "EACH", "k1")]
    assert sorted((r.rms_item_id, r.targets) for r in bad.collect()) == [("R1", 0), ("R2", 2)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("1", "=A1", 2), ("2", "ok", 3)], "transaction string, comment string, n int")
    sinks.write_export(df, df, df, str(tmp_path / "x"))
    assert spark.read.parquet(str(tmp_path / "x/Details")).count() == 2
    sinks.write_exceptions(df, str(tmp_path / "e"))
    data = b"".join(p.read_bytes() for p in sorted((tmp_path / "e").glob("*.csv")))
    assert b"'=A1" in data and b"\r\n" in data
    sinks.write_receipt(df.agg(F.sum("n").alias("total")), str(tmp_path / "r"))
    assert json.loads("".join(p.read_text() for p in (tmp_path / "r").glob("*.txt"))) == {"total": 5}


def test_snapshots(spark):
    old = spark.createDataFrame([(1, "2020-01-01", "a"), (2, "2020-01-01", "b")], "k int, created_at string, v string")
    new = spark.createDataFrame([(2, "2021-01-01", "c"), (3, "2021-01-01", "d")], "k int, created_at string, v string")
    assert sorted(map(tuple, X.upsert(old, new, "k").collect())) == [(1, "2020-01-01", "a"), (2, "2020-01-01", "c"), (3, "2021-01-01", "d")]


def test_stream_goes_on_where_it_was(spark, tmp_path):
    def put(name, rows):
        spark.createDataFrame(rows, "text string").coalesce(1).write.parquet(str(tmp_path / "in" / name))

    def run():
        stream = spark.readStream.schema("text string").parquet(f"{tmp_path}/in/*")
        intake.run(intake.fresh(stream, "text").select("text"), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
        return sorted(r.text for r in spark.read.parquet(f"{tmp_path}/out").collect())

    put("a", [("x",), ("y",), ("x",)])
    assert run() == ["x", "y"]
    put("b", [("y",), ("z",)])
    assert run() == ["x", "y", "z"]


def test_windows_of_events(spark, tmp_path):
    spark.createDataFrame([("2024-01-01 00:10:00", "view"), ("2024-01-01 00:20:00", "view"), ("2024-01-01 05:00:00", "view")], "t string, event_type string").select(F.to_timestamp("t").alias("ts"), "event_type").write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("ts timestamp, event_type string").parquet(str(tmp_path / "e"))
    q = intake.queue_depth(stream, "ts").writeStream.format("memory").queryName("depths").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.n for r in spark.table("depths").collect()) == [1, 2]
