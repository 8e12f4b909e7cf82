"""Sources, the workbench and sinks."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from plumbline.functions import cells, text
from plumbline.sources import readers, sinks, workbench


def test_warehouse_options() -> None:
    plain = readers.source_options("postgresql", "jdbc:postgresql://h/db", query="SELECT 1")
    assert plain["query"] == "SELECT 1" and "READ ONLY" in plain["sessionInitStatement"]
    split = readers.source_options("mysql", "jdbc:mysql://h/db", query="SELECT * FROM t", split=readers.Partitioning("id", "0", "100", 4))
    assert split["dbtable"] == "(SELECT * FROM t) q" and split["numPartitions"] == "4" and "query" not in split
    assert "driver" not in readers.source_options("snowflake", "u", table="t")
    for bad in ({}, {"table": "a", "query": "b"}):
        with pytest.raises(ValueError):
            readers.source_options("sqlite", "u", **bad)
    with pytest.raises(ValueError):
        readers.source_options("punch_cards", "u", table="t")


def test_embedded_database_round_trip(spark: SparkSession) -> None:
    url = "jdbc:derby:memory:roundtrip;create=true"
    rows = spark.range(100).select(F.col("id").alias("ID"), (F.col("id") * 2).alias("TWICE"))
    rows.write.format("jdbc").options(**readers.source_options("derby", url, table="NUMBERS")).save()
    back = readers.read_source(spark, "derby", url, table="NUMBERS", split=readers.Partitioning("ID", "0", "100", 4))
    assert back.filter("ID >= 50").agg(F.sum("TWICE")).first()[0] == sum(2 * i for i in range(50, 100))
    assert back.rdd.getNumPartitions() == 4


def test_files(spark: SparkSession, tmp_path: Path) -> None:
    for i in (1, 2):
        spark.range(i * 10).write.parquet(str(tmp_path / f"m{i}.parquet"))
    assert readers.scan_files(spark, [str(tmp_path / "m1.parquet"), str(tmp_path / "m2.parquet")]).count() == 30
    assert readers.scan(spark, str(tmp_path / "m1.parquet")).count() == 10
    spark.range(3).createOrReplaceTempView("three")
    assert readers.scan(spark, "three").count() == 3


def test_workbench_reads_only(spark: SparkSession) -> None:
    spark.range(50).createOrReplaceTempView("fifty")
    assert workbench.run_select(spark, "SELECT id FROM fifty WHERE id < :top;", {"top": 20}, limit=5).count() == 5
    cut = workbench.run_select(spark, "SELECT id FROM fifty ORDER BY id DESC", limit=5).collect()
    assert [r["id"] for r in cut] == [49, 48, 47, 46, 45] and all(r["truncated"] for r in cut)
    assert not any(r["truncated"] for r in workbench.run_select(spark, "SELECT id FROM fifty", limit=50).collect())
    assert workbench.run_select(spark, "WITH a AS (SELECT 1 AS x) SELECT x FROM a -- done").first()["x"] == 1
    for statement in ("DROP VIEW fifty", "INSERT INTO fifty VALUES (1)", "CREATE TABLE t (a INT)", "SELECT 1; SELECT 2"):
        with pytest.raises(PySparkException):
            workbench.run_select(spark, statement)
    assert spark.table("fifty").count() == 50


def test_panels_isolate_errors(spark: SparkSession) -> None:
    spark.range(3).createOrReplaceTempView("three")
    panels = [workbench.Panel("ok", "SELECT id FROM three"), workbench.Panel("bad name", "SELECT nope FROM three"), workbench.Panel("bad run", "SELECT 1 / (id - id) AS x FROM three")]
    rows = workbench.run_panels(spark, panels, limit=2).collect()
    assert [r["row"] for r in rows if r["panel"] == 0] == ['{"id":0}', '{"id":1}']
    assert {r["panel"] for r in rows if r["error"]} == {1, 2}


def test_spreadsheet_guard(spark: SparkSession) -> None:
    raw = ["=1+1", "+1", "-1", "@a", "\tx", "\rx", "plain", "a=b", None]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, raw string")
    made = [r["s"] for r in df.orderBy("i").select(cells.spreadsheet_safe(F.col("raw")).alias("s")).collect()]
    assert made == ["'=1+1", "'+1", "'-1", "'@a", "'\tx", "'\rx", "plain", "a=b", ""]


def test_exports(spark: SparkSession, tmp_path: Path) -> None:
    df = spark.createDataFrame([(1, "=x"), (2, "a\tb\nc")], "id int, note string")
    sinks.export_csv(df, str(tmp_path / "c"), ["id"])
    assert "'=x" in "".join(p.read_text() for p in (tmp_path / "c").glob("*.csv"))
    sinks.export_json(df.select("id", "note", F.col("id").alias("id")), str(tmp_path / "j"))
    assert '"id_2":1' in "".join(p.read_text() for p in (tmp_path / "j").glob("*.json"))
    sinks.export_tsv(df, str(tmp_path / "t"))
    assert "2\ta b c" in "".join(p.read_text() for p in (tmp_path / "t").glob("*.csv"))
    assert cells.unique_names(["id", "x", "id", "id"]) == ["id", "x", "id_2", "id_3"]


def test_upsert_and_day_partitions(spark: SparkSession, tmp_path: Path) -> None:
    old = spark.createDataFrame([("a", 1, "old"), ("b", 1, "old")], "k string, day int, v string")
    new = spark.createDataFrame([("b", 1, "new"), ("c", 2, "new")], "k string, day int, v string")
    sinks.upsert(old, new, ["k", "day"], str(tmp_path / "v2"))
    assert {(r["k"], r["v"]) for r in spark.read.parquet(str(tmp_path / "v2")).collect()} == {("a", "old"), ("b", "new"), ("c", "new")}
    sinks.append(old, str(tmp_path / "days"), ["day"])
    sinks.replace_days(new.filter("day = 2"), str(tmp_path / "days"), "day")
    assert spark.read.parquet(str(tmp_path / "days")).count() == 3


def test_text_functions(spark: SparkSession) -> None:
    df = spark.createDataFrame([("PT12H", 12.0), ("P2D", 48.0), ("p1.5d", 36.0), ("7", 7.0), ("soon", None), (None, None)], "raw string, hours double")
    assert [r for r in df.select(text.duration_hours(F.col("raw")).alias("h"), "hours").collect() if r["h"] != r["hours"]] == []
    row = spark.range(1).select(text.slug(F.lit(" Héllo, World! ")).alias("a"), text.slug(F.lit("--"), F.lit("x")).alias("b"), text.type_name(F.lit(" Big  INT ")).alias("c")).first()
    assert (row["a"], row["b"], row["c"]) == ("h-llo-world", "x", "big int")


def test_an_upsert_touches_the_buckets_of_its_rows(spark: SparkSession, tmp_path: Path) -> None:
    path = str(tmp_path / "state")
    sinks.upsert_buckets(path, spark.range(1000).select("id", F.lit("old").alias("v")), ["id"], 8)
    files = lambda: {p.relative_to(path): p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}
    before = files()
    few = spark.createDataFrame([(3, "new"), (5000, "new")], "id long, v string")
    touched = {r["b"] for r in few.select(sinks.bucket_of(["id"], 8).alias("b")).collect()}
    sinks.upsert_buckets(path, few, ["id"], 8)
    after = files()
    assert {f for f in before if after.get(f) == before[f]} == {f for f in before if int(f.parts[0].split("=")[1]) not in touched}
    rows = {r["id"]: r["v"] for r in spark.read.parquet(path).collect()}
    assert len(rows) == 1001 and rows[3] == rows[5000] == "new" and rows[4] == "old"
    sinks.upsert_buckets(path, few.limit(0), ["id"], 8)
    assert spark.read.parquet(path).count() == 1001
