"""Readers and writers: round trips and the options of each."""

import datetime
import json as js
import sqlite3

import pytest
from pyspark.sql import functions as F

from orrery import Frame, SQLContext
from orrery.sources import csv, database, excel, json, memory, parquet
from orrery.streaming import windows


def write(tmp_path, name, text):
    (tmp_path / name).write_text(text, encoding="utf-8")
    return str(tmp_path / name)


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_csv_types_and_nulls(spark, tmp_path):
    path = write(tmp_path, "a.csv", 'i,d,s,b,z,n\n7,1.5,"a, ""b""",true,0,NA\n,2,NULL,false,1,\n')
    df = csv.read_csv(spark, path)
    assert [t for _, t in df.dtypes] == ["bigint", "double", "string", "boolean", "boolean", "string"]
    assert rows(df) == [(7, 1.5, 'a, "b"', True, False, None), (None, 2.0, None, False, True, None)]


def test_csv_options(spark, tmp_path):
    path = write(tmp_path, "b.csv", "junk\na;b\nunits;x\n1;x\n# no\n2;-\n3;z\n")
    df = csv.read_csv(spark, path, sep=";", skip_rows=1, skip_rows_after_header=1, comment="#", null_values=("-",))
    assert rows(df) == [(1, "x"), (2, None), (3, "z")] and df.columns == ["a", "b"]
    path = write(tmp_path, "c.csv", "1,2\n3,4\n")
    df = csv.read_csv(spark, path, header=False, columns=["column_1"], dtypes={"column_1": "double"}, n_rows=1)
    assert rows(df) == [(2.0,)]
    with pytest.raises(ValueError, match="no such column"):
        csv.read_csv(spark, path, columns=["x"])
    path = write(tmp_path, "d.csv", "a\n1\n2\nx\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        csv.read_csv(spark, path, infer_length=2).collect()
    assert rows(csv.read_csv(spark, path, infer_length=0)) == [("1",), ("2",), ("x",)]


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'q"x', None, 0.5), (2, "a,b", "", 1e20)], "i long, s string, n string, d double")
    path = str(tmp_path / "out.csv")
    csv.write_csv(df, path, sep="\t", null_value="NULL", single=True)
    assert (tmp_path / "out.csv").is_file()
    assert rows(csv.read_csv(spark, path, sep="\t", null_values=("NULL",))) == [(1, 'q"x', None, 0.5), (2, "a,b", "", 1e20)]


def test_json(spark, tmp_path):
    path = write(tmp_path, "a.json", '[{"x": 1, "y": "h", "o": {"k": [1]}}, {"x": null, "y": "w"}, {"x": 2.5, "a": true, "e": null}]')
    df = json.read_json(spark, path)
    assert df.columns == ["x", "y", "o", "a", "e"] and dict(df.dtypes)["x"] == "double" and dict(df.dtypes)["e"] == "string"
    assert rows(df) == [(1.0, "h", '{"k": [1]}', None, None), (None, "w", None, None, None), (2.5, None, None, True, None)]
    path = write(tmp_path, "a.ndjson", '{"b": 1, "a": [2]}\n{"b": 2}\n')
    assert rows(json.read_ndjson(spark, path)) == [(1, "[2]"), (2, None)]
    assert dict(json.read_ndjson(spark, path, nested=True).dtypes)["a"] == "array<bigint>"


def test_json_values(spark, tmp_path):
    df = spark.createDataFrame([(float("nan"), datetime.date(2024, 1, 2), datetime.datetime(2024, 1, 2, 3, 4, 5, 6), None)], "d double, t date, s timestamp_ntz, n string")
    df = df.withColumn("dur", memory.duration_micros(F.lit(1_500_000)))
    path = str(tmp_path / "v.json")
    json.write_json(df, path)
    assert js.loads((tmp_path / "v.json").read_text()) == [{"t": "2024-01-02", "d": None, "s": "2024-01-02T03:04:05.000006", "n": None, "dur": "1500000us"}]
    json.write_ndjson(df, str(tmp_path / "v.ndjson"), single=True)
    assert js.loads((tmp_path / "v.ndjson").read_text())["n"] is None
    json.write_json(df.limit(0), path)
    assert js.loads((tmp_path / "v.json").read_text()) == []
    clock = spark.range(1).select(json.time_text(F.lit(3_723_000_000_000)), json.time_text(F.lit(5))).first()
    assert tuple(clock) == ("01:02:03", "00:00:00.000000005")


@pytest.mark.parametrize("codec", ["none", "snappy", "zstd"])
def test_parquet(spark, tmp_path, codec):
    df = spark.createDataFrame([(1, None, True), (None, "x", None)], "i long, s string, b boolean")
    path = str(tmp_path / "p.parquet")
    parquet.write_parquet(df, path, codec, single=True)
    assert sorted(rows(parquet.read_parquet(spark, path)), key=str) == sorted(rows(df), key=str)
    plan = parquet.scan_parquet(spark, path).filter("i > 0").select("s")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(i), GreaterThan(i,0)]" in plan and "ReadSchema: struct<i:bigint,s:string>" in plan


def test_excel(spark, tmp_path):
    df = spark.createDataFrame([("A & <b>", 1, 0.5, True), (None, None, None, None), (" é\n", 3, 2.0, False)], "n string, i long, d double, b boolean")
    path = str(tmp_path / "t.xlsx")
    excel.write_excel(df, path)
    back = excel.read_excel(spark, path)
    assert back.dtypes == df.dtypes and rows(back) == rows(df)
    excel.write_excel(df.limit(0), path)
    assert excel.read_excel(spark, path).count() == 0


def test_database(spark, tmp_path):
    path = str(tmp_path / "t.db")
    db = sqlite3.connect(path)
    db.execute("CREATE TABLE t (a INTEGER, b REAL, c TEXT)")
    db.executemany("INSERT INTO t VALUES (?, ?, ?)", [(1, None, "x"), (2, 2.5, None)])
    db.commit()
    df = database.read_sql(spark, lambda: sqlite3.connect(path), "SELECT * FROM t WHERE a >= ?", (1,))
    assert df.dtypes == [("a", "bigint"), ("b", "double"), ("c", "string")] and rows(df) == [(1, None, "x"), (2, 2.5, None)]
    both = database.read_sql_parallel(spark, lambda: sqlite3.connect(path), "SELECT a, c FROM t WHERE a = ?", [(1,), (2,)], "a long, c string")
    assert sorted(rows(both)) == [(1, "x"), (2, None)]


def test_sql_context_is_its_own(spark):
    users = Frame.create(spark, {"id": ("int64", [1, 2, 3, 4]), "score": ("float64", [88.5, 92.3, 76.1, 95.0]), "dept": ("string", ["eng", "eng", "sales", "sales"])})
    a, b = SQLContext(spark), SQLContext(spark)
    a.register("users", users)
    assert a.tables() == ["users"] and b.tables() == []
    out = a.execute("SELECT dept, max(score) AS top FROM users WHERE id > 1 GROUP BY dept ORDER BY dept;")
    assert rows(out) == [("eng", 92.3), ("sales", 95.0)]
    with pytest.raises(Exception, match="TABLE_OR_VIEW_NOT_FOUND"):
        b.execute("SELECT * FROM users")
    a.unregister("users")
    assert a.tables() == []


def test_stream_of_files(spark, tmp_path):
    schema = "k long, ts timestamp_ntz"
    df = spark.createDataFrame([(1, datetime.datetime(2024, 1, 1, 0, m)) for m in range(10)], schema)
    df.write.parquet(str(tmp_path / "in"))
    stream = windows.read_stream(spark, str(tmp_path / "in"), df.schema)
    counts = windows.tumbling(stream, "ts", "5 minutes", ["k"], F.count(F.lit(1)).alias("n"), late="1 minute")
    windows.run_once(counts, str(tmp_path / "out"), str(tmp_path / "check"))
    # The last window is still open, as nothing later has come.
    assert [r["n"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [5]
    static = windows.sessions(df, "ts", "2 minutes", ["k"], F.count(F.lit(1)).alias("n"))
    assert [r["n"] for r in static.collect()] == [10]


def test_json_array_of_many_parts(spark, tmp_path):
    path = str(tmp_path / "many.json")
    df = spark.range(0, 1000, 1, 7).selectExpr("id", "concat('a,\\n[', id) as s")
    json.write_json(df, path)
    import json as plain

    assert plain.load(open(path)) == [{"id": i, "s": f"a,\n[{i}"} for i in range(1000)]
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["many.json"]
