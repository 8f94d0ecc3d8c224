"""Interval algebra, coverage, keys and history on the small fixtures of each area."""

from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemark.functions import period as P
from tidemark.functions.aggregates import first_non_null
from tidemark.operators import coverage, intervals, keys, versioning, views
from tidemark.operators.ordering import global_rank

D = date.fromisoformat
PAIRS = [
    ("precedes", 10, 20, 30, 40), ("meets", 10, 20, 20, 30), ("overlaps", 10, 30, 20, 40), ("starts", 10, 20, 10, 30), ("during", 20, 30, 10, 40), ("finishes", 20, 30, 10, 30), ("equals", 10, 20, 10, 20),
    ("preceded_by", 30, 40, 10, 20), ("met_by", 20, 30, 10, 20), ("overlapped_by", 20, 40, 10, 30), ("started_by", 10, 30, 10, 20), ("contains", 10, 40, 20, 30), ("finished_by", 10, 30, 20, 30),
]


def test_allen_relations_and_their_inverses(spark):
    rows = spark.createDataFrame(PAIRS + [(None, 1, None, 2, 3)], "want string, xf int, xu int, yf int, yu int")
    got = rows.select("want", P.allen(F.col("xf"), F.col("xu"), F.col("yf"), F.col("yu")).alias("got"), P.allen(F.col("yf"), F.col("yu"), F.col("xf"), F.col("xu")).alias("back")).collect()
    assert all(r["got"] == r["want"] for r in got)
    inverse = dict(zip(P.ALLEN_RELATIONS[:6], P.ALLEN_RELATIONS[7:], strict=True))
    inverse |= {v: k for k, v in inverse.items()} | {"equals": "equals", None: None}
    assert all(r["back"] == inverse[r["want"]] for r in got)


def shifts(spark, rows, kind="int"):
    return spark.createDataFrame(rows, f"job int, valid_from {kind}, valid_until {kind}").withColumns({"tf": F.lit(rows[0][1]).cast(kind), "tu": F.lit(rows[0][2]).cast(kind)})


@pytest.mark.parametrize("rows,want", [
    ([(6, 12), (12, 17)], True), ([(6, 12), (13, 17)], False), ([(0, 12), (12, 17)], True), ([(6, 12), (12, 99)], True), ([(7, 17)], False), ([(0, 5), (6, 17)], False), ([(6, 17), (90, 95)], True),
    ([(None, 3), (6, 17)], True), ([(6, 6)], None),
])
def test_covers_without_gaps(spark, rows, want):
    df = spark.createDataFrame([(1, a, b, 6, 17) for a, b in rows], "job int, valid_from int, valid_until int, tf int, tu int")
    assert coverage.covers_without_gaps(df, ["job"], "tf", "tu").first()["covered"] is want


@pytest.mark.parametrize("first,second,want", [("[)", "[)", True), ("(]", "(]", True), ("[)", "()", False), ("()", "()", False), ("[]", "(]", True)])
def test_exclusive_bounds_of_continuous_types(spark, first, second, want):
    df = spark.createDataFrame([(1, Decimal(10), Decimal(12), first), (1, Decimal(12), Decimal(14), second)], "k int, valid_from decimal(9,2), valid_until decimal(9,2), b string")
    df = df.withColumns({"tf": F.lit(10.5).cast("decimal(9,2)"), "tu": F.lit(13).cast("decimal(9,2)")})
    assert coverage.covers_without_gaps(df, ["k"], "tf", "tu", bounds="b").first()["covered"] is want


def test_coverage_targets(spark):
    df = spark.createDataFrame([(1, 1, 5, None, 9), (2, 1, 5, 4, 4), (3, 1, 5, 1, 4)], "k int, valid_from int, valid_until int, tf int, tu int")
    assert {r["k"]: r["covered"] for r in coverage.covers_without_gaps(df, ["k"], "tf", "tu").collect()} == {1: None, 2: True, 3: True}
    with pytest.raises(Exception, match="the same in all rows"):
        coverage.covers_without_gaps(df.withColumn("k", F.lit(1)).where("tf is not null"), ["k"], "tf", "tu").collect()


def test_canonical_bounds(spark):
    df = spark.createDataFrame([(1, 5, "(]"), (1, 5, "[)"), (1, 5, "[]"), (1, 5, "()")], "f int, u int, b string")
    f, u = P.canonical(F.col("f"), F.col("u"), F.col("b"), df.schema["f"].dataType)
    assert [tuple(r) for r in df.select(f, u).collect()] == [(2, 6), (1, 5), (1, 6), (2, 5)]


def test_islands_gaps_coalescing(spark):
    df = spark.createDataFrame([("a", 1, 3, "x"), ("a", 3, 5, "x"), ("a", 7, 9, None), ("a", 9, 10, None), ("a", 10, 12, "y"), ("b", 1, 9, "x")], "k string, valid_from int, valid_until int, v string")
    rows = lambda d: sorted(tuple(r) for r in d.collect())
    assert rows(coverage.merge_islands(df, ["k"])) == [("a", 1, 5), ("a", 7, 12), ("b", 1, 9)]
    assert rows(coverage.gaps(df, ["k"])) == [("a", 5, 7)]
    assert sorted(((r["k"], r["v"], r["valid_from"], r["valid_until"]) for r in coverage.coalesce_periods(df, ["k"], ["v"]).collect()), key=str) == sorted([("a", "x", 1, 5), ("a", None, 7, 10), ("a", "y", 10, 12), ("b", "x", 1, 9)], key=str)


def test_first_non_null(spark):
    df = spark.createDataFrame([("alpha", 3, "third"), ("alpha", 0, None), ("alpha", 1, "first"), ("beta", 2, "two"), ("beta", 1, "one"), ("gamma", 1, None)], "grp string, k int, val string")
    assert {r[0]: r[1] for r in df.groupBy("grp").agg(first_non_null(F.col("val"), F.col("k"))).collect()} == {"alpha": "first", "beta": "one", "gamma": None}


def test_normalize_period(spark):
    df = spark.createDataFrame([(1, D("2024-01-01"), None, D("2024-01-31")), (2, D("2024-01-01"), D("2024-02-01"), None), (3, D("2024-01-01"), None, None), (4, D("2024-01-01"), D("2024-03-01"), D("2024-01-31")), (5, None, D("2024-03-01"), None), (6, D("2024-01-01"), D("2024-01-01"), None)], "i int, valid_from date, valid_until date, valid_to date")
    got = {r["i"]: r for r in P.normalize_period(df).collect()}
    assert (got[1]["valid_until"], got[2]["valid_to"], got[3]["valid_until"], got[3]["valid_to"]) == (D("2024-02-01"), D("2024-01-31"), D("9999-12-31"), D("9999-12-31"))
    assert [got[i]["period_error"] is None for i in range(1, 7)] == [True, True, True, False, False, False]


@pytest.mark.parametrize("kind", ["string", "double", "boolean"])
def test_other_types_have_no_periods(spark, kind):
    with pytest.raises(TypeError, match="Unsupported range type"):
        P.boundary_type(spark.range(1).select(F.lit(None).cast(kind).alias("f")), "f")


def test_range_queries(spark):
    df = spark.createDataFrame([(1, 0, 10), (2, 10, 20), (3, 20, 30)], "i int, valid_from int, valid_until int")
    ids = lambda d: sorted(r["i"] for r in d.collect())
    assert ids(intervals.as_of(df, 10)) == [2] and ids(intervals.between(df, 5, 10)) == [1, 2] and ids(intervals.between_symmetric(df, 10, 5)) == [1, 2]
    assert ids(intervals.from_to(df, 5, 10)) == [1] and ids(intervals.from_to(df, 5, 5)) == []
    with pytest.raises(ValueError, match="range lower bound"):
        intervals.between(df, 10, 5)


def test_joins(spark):
    a = spark.createDataFrame([(1, 0, 10, "a"), (1, 10, 20, "b"), (2, 0, 5, "c"), (None, 0, 5, "n")], "k int, valid_from int, valid_until int, v string")
    b = spark.createDataFrame([(1, 5, 15, "x"), (3, 0, 9, "y"), (None, 1, 2, "z")], "k int, valid_from int, valid_until int, w string")
    assert sorted(tuple(r) for r in intervals.temporal_join(a, b, ["k"]).select("v", "w", "valid_from", "valid_until").collect()) == [("a", "x", 5, 10), ("b", "x", 10, 15), ("n", "z", 1, 2)]
    assert intervals.temporal_join(a, b, ["k"], how="left").count() == 4
    pairs = intervals.overlap_join(a, b, 4).select("v", "right_w").collect()
    assert sorted(map(tuple, pairs)) == sorted((x["v"], y["w"]) for x in a.collect() for y in b.collect() if x["valid_from"] < y["valid_until"] and y["valid_from"] < x["valid_until"])
    asked = spark.createDataFrame([(1, 10), (1, 25), (2, 3), (9, 1)], "k int, at int")
    assert sorted(((r["k"], r["at"], r["v"]) for r in intervals.as_of_join(asked, a, ["k"], "at", ["v"], u="valid_until").collect()), key=str) == sorted([(1, 10, "b"), (1, 25, None), (2, 3, "c"), (9, 1, None)], key=str)


def test_unique_keys(spark):
    df = spark.createDataFrame([(1, "Bob", 1, 5), (2, "Bob", 4, 9), (3, "Al", 1, 5), (4, "Al", 5, 9), (5, None, 1, 5), (6, None, 2, 3)], "i int, name string, valid_from int, valid_until int")
    ids = lambda d: sorted(r["i"] for r in d.collect())
    assert ids(keys.unique_key_violations(df, ["name"])) == [2]
    assert ids(keys.unique_key_violations(df, ["name"], "primary")) == [2, 5, 6]
    assert ids(keys.unique_key_violations(df, ["name"], "exclusive")) == [2, 6]
    assert ids(keys.unique_key_violations(df, ["name"], "predicated", "i > 2")) == []
    assert keys.pk_consistency_violations(df, ["name"], ["i"]).count() == 2


def test_foreign_keys(spark):
    houses = spark.createDataFrame([(1, D("2015-01-01"), D("2016-01-01")), (1, D("2016-01-01"), D("2017-01-01")), (3, D("2014-01-01"), D("9999-12-31"))], "id int, valid_from date, valid_until date")
    rooms = spark.createDataFrame([(1, None, D("2015-01-01"), D("2016-01-01")), (2, 1, D("2015-01-01"), D("2016-01-01")), (3, 1, D("2015-01-01"), D("2016-06-01")), (4, 1, D("2010-01-01"), D("2011-01-01")), (5, 1, D("2015-01-01"), D("2018-01-01")), (6, 9, D("2015-01-01"), D("2016-01-01"))], "i int, house int, valid_from date, valid_until date")
    ids = lambda d: sorted(r["i"] for r in d.collect())
    assert ids(keys.temporal_fk_violations(rooms, houses, ["house"], ["id"])) == [4, 5, 6]
    assert ids(keys.regular_fk_violations(rooms, houses, ["house"], ["id"])) == [6]
    gone = houses.where("valid_from = date'2016-01-01'")
    assert ids(keys.parent_delete_violations(rooms, houses, gone, ["house"], ["id"])) == [3, 4, 5, 6]
    assert ids(keys.parent_delete_violations(rooms, houses, gone, ["house"], ["id"], temporal=False)) == [2, 3, 4, 5]
    longer = gone.withColumn("valid_until", F.lit("2019-01-01").cast("date"))
    assert ids(keys.parent_update_violations(rooms, houses, gone, longer, ["house"], ["id"])) == [4, 6]
    with pytest.raises(ValueError, match="partial"):
        keys.regular_fk_violations(rooms, houses, ["house"], ["id"], match="partial")


def test_system_versioning(spark):
    t = lambda d: datetime(2024, 1, d)
    state = lambda v, flap="a": spark.createDataFrame([(1, v, flap)], "id int, value int, flap string")
    now, history = versioning.stamp(state(100), t(1)), None
    for day, after in ((2, state(200)), (3, state(300)), (4, state(300, "b")), (5, state(0).limit(0))):
        now, old = versioning.record_change(now, after, ["id"], t(day), excluded=("flap",))
        history = old if history is None else history.unionByName(old)
    both = versioning.with_history(now, history)
    spans = sorted((r["value"], r["system_valid_from"].day, r["system_valid_until"].day) for r in history.collect())
    assert spans == [(100, 1, 2), (200, 2, 3), (300, 3, 5)] and now.count() == 0
    values = lambda d: sorted(r["value"] for r in d.collect())
    assert values(versioning.state_as_of(both, t(2))) == [200] and values(versioning.states_between(both, t(2), t(3))) == [200, 300]
    assert values(versioning.states_between_symmetric(both, t(3), t(2))) == [200, 300] and values(versioning.states_from_to(both, t(2), t(3))) == [200] and values(versioning.states_from_to(both, t(2), t(2))) == []
    same, none = versioning.record_change(versioning.stamp(state(1), t(6)), state(2), ["id"], t(6))
    assert none.count() == 0 and same.count() == 1


def test_views(spark):
    df = spark.createDataFrame([(1, "Alice", "Eng", D("2023-01-01"), D("2024-01-01")), (1, "Alice", "R&D", D("2024-01-01"), D("9999-12-31")), (2, "Bob", "Sales", D("2023-05-01"), D("9999-12-31"))], "id int, name string, dept string, valid_from date, valid_until date")
    rows = lambda d: sorted((r["id"], r["dept"], str(r["valid_from"]), str(r["valid_until"])) for r in d.collect())
    assert rows(views.current_rows(df, F.lit("2023-06-01").cast("date"))) == [(1, "Eng", "2023-01-01", "2024-01-01"), (2, "Sales", "2023-05-01", "9999-12-31")]
    after = views.current_update(df, {"dept": "Ops"}, F.col("id") == 2, "2024-06-01")
    assert [r for r in rows(after) if r[0] == 2] == [(2, "Ops", "2024-06-01", "9999-12-31"), (2, "Sales", "2023-05-01", "2024-06-01")]
    assert [r for r in rows(views.current_delete(df, F.col("id") == 2, "2024-06-01")) if r[0] == 2] == [(2, "Sales", "2023-05-01", "2024-06-01")]
    assert [r for r in rows(views.current_delete(df, F.col("id") == 2, "2023-05-01")) if r[0] == 2] == []
    with pytest.raises(ValueError, match="not allowed"):
        views.current_delete(df, F.col("id") == 2, "2024-06-01", "delete_as_documented_ending")
    new = spark.createDataFrame([(1, None, "Carl", "Eng"), (2, None, "Dora", "Eng")], "row_id int, id int, name string, dept string")
    merged = views.current_insert(df, new, ["id"], "2024-06-01", generated_identity="id").target_after
    assert {r["id"] for r in merged.where("name in ('Carl', 'Dora')").collect()} == {3, 4}
    part = views.update_portion(df, ["id"], {"dept": "Temp"}, "2023-06-01", "2024-06-01", F.col("id") == 1).target_after
    assert [r for r in rows(part) if r[0] == 1] == [(1, "Eng", "2023-01-01", "2023-06-01"), (1, "R&D", "2024-06-01", "9999-12-31"), (1, "Temp", "2023-06-01", "2024-06-01")]


def test_global_rank(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("v"))
    assert all(r["v"] == r["n"] for r in global_rank(df, [F.col("v")], "n").collect())


def test_open_ends_and_bounds_as_text(spark):
    t = lambda x: f"2024-{x:02d}-01 00:00:00"
    left = spark.createDataFrame([(1, t(1), "9999-12-31 23:59:59"), (2, t(3), t(4))], "id int, f string, u string").selectExpr("id", "cast(f as timestamp_ntz) as valid_from", "cast(u as timestamp_ntz) as valid_until")
    right = left.selectExpr("id + 10 as id", "valid_from", "valid_until")
    pairs = intervals.overlap_join(left, right, 86400)
    assert sorted((r["id"], r["right_id"]) for r in pairs.collect()) == [(1, 11), (1, 12), (2, 11), (2, 12)]
    both = left.withColumnsRenamed({"valid_from": "system_valid_from", "valid_until": "system_valid_until"})
    assert versioning.states_between(both, "2024-9-1", "2024-10-1").count() == 1
    with pytest.raises(Exception, match="lower bound"):
        versioning.states_between(both, "2024-10-01", "2024-9-1").collect()
