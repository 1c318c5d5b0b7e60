"""Frame verbs on small literal frames, with the edge cases of each."""

import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from orrery import Frame
from orrery.functions import expr as E
from orrery.functions.expr import col
from orrery.operators import joins, relational
from orrery.operators.ordered import bucket_of, evaluate, number_rows
from orrery.plans import inspect


@pytest.fixture
def people(spark):
    return Frame.create(spark, {"age": ("int64", [25, 30, 35, 40]), "name": ("string", ["Alice", "Bob", "Charlie", "Diana"]), "score": ("float64", [88.5, 92.3, 76.1, 95.0])})


@pytest.fixture
def nulls(spark):
    return Frame.create(spark, {"a": ("int64", [1, None, 3]), "b": ("string", ["x", "y", "z"])})


def test_creation_checks_lengths_and_names(spark):
    with pytest.raises(ValueError, match="length"):
        Frame.create(spark, {"a": ("int64", [1]), "b": ("int64", [1, 2])})
    with pytest.raises(ValueError, match="twice"):
        Frame(spark.range(1).select(F.lit(1).alias("a"), F.lit(2).alias("a")))


def test_shape_and_access(people):
    assert people.shape == (4, 3) and people.columns == ["age", "name", "score"] and not people.is_empty()
    assert people.row(2)["name"] == "Charlie" and people.column_by_index(1).to_dict() == {"name": ["Alice", "Bob", "Charlie", "Diana"]}
    with pytest.raises(IndexError):
        people.row(4)
    assert people.equals(people.clone())
    assert "age <bigint> 25, 30" in people.glimpse(2)


def test_typed_and_temporal_columns(spark):
    f = Frame.create(spark, {"u": ("uint64", [2**64 - 1]), "d": ("date", [datetime.date(1969, 12, 31)]), "t": ("datetime", [datetime.datetime(2024, 3, 15, 12, 30)]), "b": ("boolean", [None]), "f": ("float32", [1])})
    row = f.row(0)
    assert int(row["u"]) == 2**64 - 1 and row["d"] == datetime.date(1969, 12, 31) and row["b"] is None and row["f"] == 1.0


def test_columns(people):
    assert people.select("name").columns == ["name"]
    with pytest.raises(ValueError, match="no such column: x"):
        people.select("x")
    with pytest.raises(ValueError, match="no such column"):
        people.drop("x")
    with pytest.raises(ValueError, match="exists"):
        people.rename("age", "name")
    out = people.with_columns({"age": E.add(col("age"), 1), "old": col("age")})
    assert out.to_dict()["age"] == [26, 31, 36, 41] and out.to_dict()["old"] == [25, 30, 35, 40] and out.columns == ["age", "name", "score", "old"]
    assert people.rename_each(lambda c: "p_" + c).columns == ["p_age", "p_name", "p_score"]


def test_filter_drops_null_masks(nulls):
    assert nulls.filter(E.gt(col("a"), 0)).to_dict()["b"] == ["x", "z"]
    assert nulls.drop_nulls().height == 2 and nulls.fill_null({"a": 7}).to_dict()["a"] == [1, 7, 3]
    assert nulls.null_counts()["a"] == 1


def test_sort_is_stable_with_nulls_last(spark):
    f = Frame.create(spark, {"k": ("int64", [2, None, 1, 2, 1]), "v": ("string", list("abcde"))})
    assert f.sort("k").to_dict() == f.to_dict()  # to_dict() goes by the order key
    assert [r["v"] for r in f.sort("k").df.collect()] == ["c", "e", "a", "d", "b"]
    assert [r["v"] for r in f.sort("k", True).df.collect()] == ["a", "d", "c", "e", "b"]
    with pytest.raises(ValueError, match="directions"):
        f.sort(["k", "v"], [True])


def test_head_tail_slice_gather(people):
    assert people.head(2).to_dict()["name"] == ["Alice", "Bob"] and people.head(-1).height == 0 and people.head(9).height == 4
    assert people.tail(2).to_dict()["name"] == ["Charlie", "Diana"] and people.tail(0).height == 0
    assert people.slice(-5, 2).height == 2 and people.slice(3, 99).height == 1 and people.slice(3, 1).height == 0
    assert [r["name"] for r in people.gather([3, 0, 3]).df.collect()] == ["Diana", "Alice", "Diana"]
    with pytest.raises(IndexError):
        people.gather([4])


def test_order_is_asked_for(spark):
    with pytest.raises(ValueError, match="order key"):
        Frame(spark.range(3)).head(1)


def test_samples(people):
    assert people.sample(3, 1).height == 3 and people.sample_fraction(0.5).height == 2
    with pytest.raises(ValueError, match="larger"):
        people.sample(5)
    with pytest.raises(ValueError, match="between 0 and 1"):
        people.sample_fraction(1.5)


def test_samples_are_drawn_where_rows_are(spark):
    shuffled = spark.range(0, 3000, 1, 7).selectExpr("id % 1000 AS k", "id").groupBy("k").agg(F.sum("id").alias("s"), F.collect_list("id").alias("ids"))
    for df in (spark.range(0, 1000, 1, 5).withColumnRenamed("id", "k"), shuffled, Frame(shuffled, "k").sort("k").df):
        for n in (0, 1, 437, 1000):
            out = relational.sample(df, n, 5)
            # The same number of rows, whatever columns are read.
            assert out.count() == n and out.select("k").distinct().count() == n and len(out.collect()) == n
            assert not {"TakeOrderedAndProject", "CollectLimit", "GlobalLimit"} & set(inspect.operators(out))
    assert relational.sample_fraction(shuffled, 0.1, 2).count() == 100
    few = [frozenset(r["k"] for r in relational.sample(shuffled, 20, seed).collect()) for seed in range(4)]
    assert len(set(few)) == 4
    assert relational.sample_fraction(spark.range(0), 0.5).count() == 0


def test_unique_keeps_the_first(spark):
    f = Frame.create(spark, {"a": ("int64", [1, 2, 1, None, None]), "b": ("string", ["first", "only", "again", "n", "m"])})
    assert sorted(f.unique("a").df.collect(), key=str) == sorted([(1, "first"), (2, "only"), (None, "n")], key=str)
    assert [r["a"] for r in f.unique_values("a").df.collect()] == [1, 2, None]
    assert f.is_duplicated("a").to_dict()["is_duplicated"] == [True, False, True, True, True]


def test_concat(people, nulls):
    assert people.concat(people).height == 8
    with pytest.raises(ValueError, match="frame 2"):
        people.concat(nulls)
    wide = nulls.concat_horizontal(nulls.rename("a", "c").rename("b", "d"))
    assert sorted(map(tuple, wide.df.collect()), key=str) == sorted([(1, "x", 1, "x"), (None, "y", None, "y"), (3, "z", 3, "z")], key=str)
    with pytest.raises(ValueError, match="height"):
        nulls.concat_horizontal(people)


@pytest.fixture
def sides(spark):
    left = Frame.create(spark, {"id": ("int64", [1, 2, 3, None]), "v": ("string", list("abcn"))})
    right = Frame.create(spark, {"id": ("int64", [1, 3, 4, None]), "v": ("string", list("xyzm"))})
    return left, right


@pytest.mark.parametrize(
    ("how", "rows"),
    [
        ("inner", {(1, "a", "x"), (3, "c", "y"), (None, "n", "m")}),
        ("left", {(1, "a", "x"), (2, "b", None), (3, "c", "y"), (None, "n", "m")}),
        ("right", {(1, "a", "x"), (3, "c", "y"), (4, None, "z"), (None, "n", "m")}),
        ("full", {(1, "a", "x"), (2, "b", None), (3, "c", "y"), (4, None, "z"), (None, "n", "m")}),
        ("semi", {(1, "a"), (3, "c"), (None, "n")}),
        ("anti", {(2, "b")}),
    ],
)
def test_joins_match_null_keys(sides, how, rows):
    out = sides[0].join(sides[1], "id", how)
    assert {tuple(r) for r in out.df.collect()} == rows
    assert how in ("semi", "anti") or out.columns == ["id", "v", "v_right"]
    assert not inspect.has_cartesian(out.df)


def test_join_errors_and_cross(sides):
    left, right = sides
    with pytest.raises(ValueError, match="unknown join"):
        left.join(right, "id", "outer")
    with pytest.raises(ValueError, match="left keys"):
        left.join(right, how="inner")
    assert left.join(right, how="cross").columns == ["id", "v", "id_right", "v_right"] and left.join(right, how="cross").height == 16
    assert left.join(right, "id", null_equal=False).height == 2
    salted = joins.salted_join(left.df, right.df.withColumnRenamed("v", "w"), ["id"], 3, "left")
    assert salted.count() == 4


def test_a_salted_join_broadcasts_nothing(spark, tmp_path):
    spark.range(1000).selectExpr("id AS k", "id AS w").write.parquet(f"{tmp_path}/right")
    left = spark.range(50).selectExpr("id % 5 AS k", "id AS v")
    for how in ("inner", "left"):
        out = joins.salted_join(left, spark.read.parquet(f"{tmp_path}/right"), ["k"], 4, how)
        assert sorted(map(tuple, out.collect())) == sorted((i % 5, i, i % 5) for i in range(50))
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan and "SortMergeJoin" in plan


def test_group_by(spark):
    f = Frame.create(spark, {"g": ("string", ["x", "x", None, "y", None]), "v": ("int64", [30, 10, 1, None, 2]), "d": ("date", [datetime.date(2024, 1, d) for d in (5, 4, 3, 2, 1)])})
    out = {r["g"]: (r["v"], r["d"]) for r in f.group_by("g").agg({"v": "sum", "d": "max"}).collect()}
    assert out == {"x": (40.0, datetime.date(2024, 1, 5)), None: (3.0, datetime.date(2024, 1, 3)), "y": (None, datetime.date(2024, 1, 2))}
    first = {r["g"]: r["v"] for r in f.group_by("g").agg({"v": "first"}).collect()}
    assert first == {"x": 30, None: 1, "y": None}
    with pytest.raises(ValueError, match="no number"):
        f.group_by("v").agg({"g": "sum"})
    with pytest.raises(ValueError, match="unknown aggregate"):
        f.group_by("g").agg({"v": "mode"})


def test_describe(people):
    out = {r["statistic"]: (r["age"], round(r["score"], 3)) for r in people.describe().df.collect()}
    assert out["count"] == (4.0, 4.0) and out["mean"] == (32.5, 87.975) and out["min"] == (25.0, 76.1) and people.describe().columns == ["statistic", "age", "score"]
    with pytest.raises(ValueError, match="no numeric"):
        people.select("name").describe()


def test_reshape(spark):
    f = Frame.create(spark, {"n": ("string", ["Alice", "Alice", "Bob", "Bob", "Alice"]), "s": ("string", ["math", "art", "math", None, "math"]), "v": ("int64", [90, 85, 70, 95, 1])})
    out = f.pivot("n", "s", "v")
    assert out.columns == ["n", "math", "art", "null"] and {tuple(r) for r in out.df.collect()} == {("Alice", 90, 85, None), ("Bob", 70, None, 95)}
    wide = Frame.create(spark, {"a": ("int64", [1, 2]), "b": ("float64", [0.5, None])})
    assert [tuple(r) for r in wide.transpose().df.collect()] == [("a", 1.0, 2.0), ("b", 0.5, None)]
    assert wide.unpivot([], ["a", "b"]).height == 4
    with pytest.raises(ValueError, match="transposed"):
        f.transpose()
    text = Frame.create(spark, {"k": ("int64", [1, 2, 3]), "t": ("string", ["a, b,,c", None, ""])})
    assert [tuple(r) for r in text.explode("t").df.orderBy("k").collect()] == [(1, "a"), (1, "b"), (1, ""), (1, "c"), (2, None), (3, "")]


def test_user_functions(nulls):
    out = nulls.map_rows("n", lambda r: len(r["b"]) if r["a"] is None else int(r["a"]) * 10, "long")
    assert out.to_dict()["n"] == [10, 1, 30]
    assert nulls.map_batches("u", lambda b: b.str.upper(), "string", "b").to_dict()["u"] == ["X", "Y", "Z"]


def test_zero_rows_everywhere(spark, people):
    none = people.filter(F.lit(False))
    assert none.is_empty() and none.head(3).to_dicts() == [] and none.unique("age").height == 0 and none.sort("age").height == 0
    assert none.join(people, "age", "full").height == 4 and none.pivot("name", "age", "score").height == 0
    assert none.with_column("c", E.cum_sum(col("age"))).height == 0 and none.with_column("r", E.rank(col("age"))).height == 0
    assert [r["age"] for r in none.describe().df.collect()] == [0.0, None, None, None, None]
    assert Frame.zeros(spark, people.schema, 2).to_dicts() == [{"age": 0, "name": "", "score": 0.0}] * 2
    assert Frame.zeros(spark, StructType([])).height == 0


GAPS = [None, 1, None, None, 4, 2, None]


@pytest.fixture
def gaps(spark):
    return Frame.create(spark, {"x": ("int64", GAPS)})


@pytest.mark.parametrize("one_task", [False, True])
@pytest.mark.parametrize(
    ("make", "expected"),
    [
        (lambda: E.shift(col("x"), 1), [None, None, 1, None, None, 4, 2]),
        (lambda: E.shift(col("x"), -2), [None, None, 4, 2, None, None, None]),
        (lambda: E.shift(col("x"), 0), GAPS),
        (lambda: E.diff(col("x"), 0), [None, None, None, None, None, -2, None]),
        (lambda: E.pct_change(col("x")), [None, None, None, None, None, -0.5, None]),
        (lambda: E.cum_sum(col("x")), [None, 1, None, None, 5, 7, None]),
        (lambda: E.cum_prod(col("x")), [None, 1.0, None, None, 4.0, 8.0, None]),
        (lambda: E.cum_min(col("x")), [None, 1, None, None, 1, 1, None]),
        (lambda: E.cum_max(col("x")), [None, 1, None, None, 4, 4, None]),
        (lambda: E.rolling_sum(col("x"), 2), [None, None, None, None, None, 6.0, None]),
        (lambda: E.rolling_std(col("x"), 1), [None, 0.0, None, None, 0.0, 0.0, None]),
        (lambda: E.rank(col("x")), [None, 1.0, None, None, 3.0, 2.0, None]),
        (lambda: E.interpolate(col("x")), [None, 1.0, 2.0, 3.0, 4.0, 2.0, None]),
        (lambda: E.interpolate(col("x"), "ffill"), [None, 1, 1, 1, 4, 2, 2]),
        (lambda: E.interpolate(col("x"), "bfill"), [1, 1, 4, 4, 4, 2, None]),
    ],
)
def test_row_order_expressions(gaps, make, expected, one_task):
    assert gaps.with_columns({"y": make()}, one_task).to_dict()["y"] == expected


def test_row_order_expressions_across_small_chunks(spark):
    values = [None if i % 7 == 0 else (i * 37) % 11 for i in range(200)]
    df = Frame.create(spark, {"x": ("int64", values)})
    exprs = {"s": E.shift(col("x"), 3), "b": E.shift(col("x"), -5), "c": E.cum_sum(col("x")), "r": E.rolling_sum(col("x"), 4), "f": E.interpolate(col("x"), "ffill"), "l": E.interpolate(col("x"))}
    one = df.with_columns(exprs, one_task=True).df.orderBy(*exprs).collect()
    many = evaluate(df._df, [col("__rid")], exprs, chunk=8).select("x", *exprs).orderBy(*exprs).collect()
    assert sorted(map(str, one)) == sorted(map(str, many))


@pytest.mark.parametrize("method", ["ffill", "bfill"])
@pytest.mark.parametrize("partition", [(), ("g",)])
def test_fills_go_through_a_window_once(spark, method, partition):
    values = [None if i % 3 else i for i in range(50)]
    f = Frame.create(spark, {"x": ("int64", values), "g": ("int64", [0] * 50)}).with_column("y", E.interpolate(col("x"), method).over(*partition))
    # A frame up to the last row is read anew for each row: 100,000 rows took minutes.
    assert "unboundedfollowing" not in f.df._jdf.queryExecution().toString().lower()
    assert f.to_dict()["y"] == [i // 3 * 3 if method == "ffill" or i % 3 == 0 else i // 3 * 3 + 3 if i < 48 else None for i in range(50)]


@pytest.mark.parametrize("partition", [(), ("g",)])
def test_interpolation_goes_through_a_window_once(spark, partition):
    values = [None if i % 4 else i for i in range(42)]
    f = Frame.create(spark, {"x": ("int64", values), "g": ("int64", [0] * 42)}).with_column("y", E.interpolate(col("x")).over(*partition))
    assert "unboundedfollowing" not in f.df._jdf.queryExecution().toString().lower()
    assert f.to_dict()["y"] == [float(i) if i <= 40 else None for i in range(42)]


def test_carried_expressions_share_a_pass(spark):
    df = Frame.create(spark, {"x": ("int64", GAPS)})
    scans = lambda n: evaluate(df._df, [col("__rid")], {f"y{i}": E.interpolate(col("x"), "ffill") for i in range(n)})._jdf.queryExecution().optimizedPlan().toString().count("__rid")
    assert scans(4) == scans(1)


def test_buckets_count_the_bounds(spark):
    for bounds in ([3], [1, 4], [1, 4, 4, 9, 12, 13, 20]):
        got = spark.range(-1, 25).select("id", bucket_of(col("id"), bounds, LongType()).alias("b")).collect()
        assert [r["b"] for r in got] == [sum(b <= i for b in bounds) for i in range(-1, 25)]


def test_ranks_with_ties(spark):
    f = Frame.create(spark, {"x": ("int64", [3, 1, 3, None, 2, 3])})
    out = f.with_columns({m: E.rank(col("x"), m) for m in ("average", "min", "max", "dense", "ordinal")}).to_dict()
    assert out["average"] == [4.0, 1.0, 4.0, None, 2.0, 4.0] and out["min"] == [3.0, 1.0, 3.0, None, 2.0, 3.0]
    assert out["max"] == [5.0, 1.0, 5.0, None, 2.0, 5.0] and out["dense"] == [3.0, 1.0, 3.0, None, 2.0, 3.0] and out["ordinal"] == [3.0, 1.0, 4.0, None, 2.0, 5.0]
    with pytest.raises(ValueError):
        E.rank(col("x"), "mean")


def test_numbers_of_hot_and_null_keys(spark):
    df = spark.createDataFrame([(k, i) for i, k in enumerate([5] * 50 + [None] * 3 + list(range(20)))], "k long, i long")
    out = number_rows(df, [col("k")], buckets=8).orderBy("__rn").collect()
    assert [r["__rn"] for r in out] == list(range(1, 74)) and [r["k"] for r in out] == sorted([5] * 50 + list(range(20))) + [None] * 3


def test_numbers_of_keys_with_nan(spark):
    df = spark.createDataFrame([(float("nan") if i % 3 else float(i * 37 % 101),) for i in range(300)], "k double")
    out = number_rows(df, [col("k")], buckets=16).orderBy("__rn").collect()
    assert [r["__rn"] for r in out] == list(range(1, 301)) and [r["k"] for r in out[:100]] == sorted(float(i * 37 % 101) for i in range(0, 300, 3))


def test_plans(spark, people):
    top = relational.top_k(people.df, "score", 2)
    assert "TakeOrderedAndProject" in inspect.operators(top)
    assert "HashAggregate" in people.group_by("name").agg({"age": "sum"})._jdf.queryExecution().toString()


def test_interrupted_by_tag(people):
    assert len(people.collect("some-tag")) == 4


def test_map_rows_tells_nan_from_null(spark):
    df = spark.createDataFrame([(1, float("nan"), None), (2, None, 7), (3, 1.5, 8)], "id long, x double, n long")
    out = Frame(df, "id").map_rows("kind", lambda r: "null" if r["x"] is None else "nan" if r["x"] != r["x"] else "number", "string")
    assert [r["kind"] for r in out.rows()] == ["nan", "null", "number"]
    out = Frame(df, "id").map_rows("y", lambda r: r["x"], "double").map_rows("n", lambda r: None if r["n"] is None else r["n"] + 1, "long")
    rows = out.to_dicts()
    assert rows[0]["y"] != rows[0]["y"] and rows[1]["y"] is None and [r["n"] for r in rows] == [None, 8, 9] and out.columns == ["id", "x", "y", "n"]


def test_equals_by_order_and_values(spark):
    make = lambda xs: Frame.create(spark, {"x": ("double", xs), "s": ("string", ["a"] * len(xs))})
    nan = float("nan")
    assert make([1.0, nan, None]).equals(make([1.0, nan, None]))
    assert not make([1.0, 2.0]).equals(make([2.0, 1.0])) and not make([1.0, 1.0]).equals(make([1.0]))
    plain = lambda xs: Frame(spark.createDataFrame([(x,) for x in xs], "x long"))
    assert plain([1, 2, 2]).equals(plain([2, 1, 2])) and not plain([1, 2, 2]).equals(plain([1, 1, 2]))
    assert Frame(plain([3, 1]).df, "x").equals(Frame(plain([1, 3]).df, "x"))


def test_table_as_text(spark):
    few = Frame.create(spark, {"n": ("long", [1, None]), "ok": ("boolean", [True, False])})
    assert str(few).splitlines() == ["shape: (2, 2)", "+--------+---------+", "| n      | ok      |", "| bigint | boolean |", "+--------+---------+", "| 1      | true    |", "| null   | false   |", "+--------+---------+"]
    many = Frame(spark.range(100).toDF("i"), "i").to_string().splitlines()
    assert [x.strip("| ") for x in many[5:-1]] == ["0", "1", "2", "3", "4", "...", "95", "96", "97", "98", "99"]


def test_used_columns(spark):
    df = spark.createDataFrame([(1, 2, "x")], "a long, `b.c` long, s string")
    x = col("a") + col("b.c") * 2
    assert E.used_columns(df, x) == ["a", "b.c"] and not E.is_constant(df, x)
    assert E.used_columns(df, E.lit(5)) == [] and E.is_constant(df, E.lit(5))
    with pytest.raises(Exception, match="nothing"):
        E.used_columns(df, col("nothing"))
