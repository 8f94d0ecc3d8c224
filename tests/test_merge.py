"""Merge outcomes on the tariffs of a few stations: modes, deletions and identities."""

import time
from datetime import date

import pytest

from tidemark.operators.merge import temporal_merge

D = date.fromisoformat
TARGET = "id int, tariff string, remark string, valid_from date, valid_until date"
SOURCE = "row_id int, " + TARGET
LOW, HIGH, LATE, FLAT = (
    (4, "low", "opening", "2019-03-04", "2019-06-11"), (4, "high", None, "2019-06-11", "2019-11-20"),
    (4, "late", "after works", "2020-02-02", "2020-08-30"), (9, "flat", "contract", "2018-05-05", "2022-05-05"),
)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple(str(x) for x in r))


def dated(*made):
    return sorted(((*r[:-2], D(r[-2]), D(r[-1])) for r in made), key=lambda r: tuple(str(x) for x in r))


def run(spark, mode, source, schema=SOURCE, **spec):
    t, s = spark.createDataFrame(dated(LOW, HIGH, LATE, FLAT), TARGET), spark.createDataFrame(dated(*source), schema)
    return temporal_merge(t, s, identity=["id"], mode=mode, ephemeral=["remark"], **spec)


def told(merge):
    return {r["source_row_id"]: r["status"] for r in merge.feedback.collect()}


HIGH1, HIGH2 = (4, "high", None, "2019-06-11", "2019-08-01"), (4, "high", None, "2019-09-15", "2019-11-20")
FAIR = (4, "fair", "trade fair", "2019-08-01", "2019-09-15")


def test_patch_splits_fills_a_gap_and_founds(spark):
    merge = run(spark, "MERGE_ENTITY_PATCH", [(11, *FAIR), (12, 4, "works", "closed hall", "2019-11-20", "2020-02-02"), (13, 5, "trial", None, "2021-01-10", "2021-07-10")])
    assert rows(merge.target_after) == dated(LOW, HIGH1, FAIR, HIGH2, (4, "works", "closed hall", "2019-11-20", "2020-02-02"), LATE, FLAT, (5, "trial", None, "2021-01-10", "2021-07-10"))
    assert told(merge) == {11: "APPLIED", 12: "APPLIED", 13: "APPLIED"}
    ops = [(r["operation"], r["update_effect"], r["id"], str(r["new_valid_from"])) for r in merge.ordered_plan().collect()]
    assert ops[0] == ("UPDATE", "SHRINK", 4, "2019-06-11") and sorted(ops[1:]) == sorted([("INSERT", None, 4, x) for x in ("2019-08-01", "2019-09-15", "2019-11-20")] + [("INSERT", None, 5, "2021-01-10")])
    assert sorted((str(r["new_valid_from"]), r["row_ids"]) for r in merge.plan.where("id = 4").collect()) == [("2019-06-11", [11]), ("2019-08-01", [11]), ("2019-09-15", [11]), ("2019-11-20", [12])]


def test_replace_writes_nulls_and_patch_does_not(spark):
    source = [(21, 4, None, "unknown", "2020-03-01", "2020-04-01"), (22, *FAIR)]
    cut = [(4, "late", "after works", "2020-02-02", "2020-03-01"), (4, None, "unknown", "2020-03-01", "2020-04-01"), (4, "late", "after works", "2020-04-01", "2020-08-30")]
    assert rows(run(spark, "MERGE_ENTITY_REPLACE", source).target_after) == dated(LOW, HIGH1, FAIR, HIGH2, *cut, FLAT)
    patched = rows(run(spark, "MERGE_ENTITY_PATCH", source).target_after)
    assert (4, "late", "after works", D("2020-02-02"), D("2020-08-30")) in patched


@pytest.mark.parametrize("mode", ["PATCH_FOR_PORTION_OF", "UPDATE_FOR_PORTION_OF", "REPLACE_FOR_PORTION_OF"])
def test_portions_touch_only_what_is_there(spark, mode):
    merge = run(spark, mode, [(31, *FAIR), (32, 5, "trial", None, "2021-01-10", "2021-07-10"), (33, 9, "raised", "index", "2022-01-01", "2023-01-01")])
    assert rows(merge.target_after) == dated(LOW, HIGH1, FAIR, HIGH2, LATE, (9, "flat", "contract", "2018-05-05", "2022-01-01"), (9, "raised", "index", "2022-01-01", "2022-05-05"))
    assert told(merge) == {31: "APPLIED", 32: "SKIPPED_NO_TARGET", 33: "APPLIED"}


def test_delete_portion(spark):
    merge = run(spark, "DELETE_FOR_PORTION_OF", [(41, 4, None, None, "2019-08-01", "2019-09-15"), (42, 5, None, None, "2021-01-10", "2021-07-10"), (43, 4, None, None, "2020-02-02", "2020-08-30")])
    assert rows(merge.target_after) == dated(LOW, HIGH1, HIGH2, FLAT)
    assert told(merge) == {41: "APPLIED", 42: "SKIPPED_NO_TARGET", 43: "APPLIED"}


def test_insert_new_entities_only(spark):
    merge = run(spark, "INSERT_NEW_ENTITIES", [(51, *FAIR), (52, 5, "trial", None, "2021-01-10", "2021-07-10")])
    assert rows(merge.target_after) == dated(LOW, HIGH, LATE, FLAT, (5, "trial", None, "2021-01-10", "2021-07-10"))
    assert told(merge) == {51: "SKIPPED_FILTERED", 52: "APPLIED"}


@pytest.mark.parametrize("mode", ["MERGE_ENTITY_REPLACE", "UPDATE_FOR_PORTION_OF"])
def test_absent_column_is_inherited(spark, mode):
    merge = run(spark, mode, [(61, 4, "night", "2020-05-01", "2020-06-01")], schema="row_id int, id int, tariff string, valid_from date, valid_until date")
    assert (4, "night", "after works", D("2020-05-01"), D("2020-06-01")) in rows(merge.target_after)


def test_identical_and_ephemeral(spark):
    merge = run(spark, "MERGE_ENTITY_UPSERT", [(71, *LOW), (72, 9, "flat", "renewed", "2018-05-05", "2022-05-05")])
    assert told(merge) == {71: "SKIPPED_IDENTICAL", 72: "APPLIED"}
    assert rows(merge.target_after) == dated(LOW, HIGH, LATE, (9, "flat", "renewed", "2018-05-05", "2022-05-05"))


@pytest.mark.parametrize("mode,left", [("DELETE_MISSING_TIMELINE", {4, 9}), ("DELETE_MISSING_ENTITIES", {4}), ("DELETE_MISSING_TIMELINE_AND_ENTITIES", {4})])
def test_delete_modes(spark, mode, left):
    after = rows(run(spark, "MERGE_ENTITY_PATCH", [(81, *HIGH)], delete_mode=mode).target_after)
    assert {r[0] for r in after} == left
    assert len([r for r in after if r[0] == 4]) == (1 if "TIMELINE" in mode else 3)


def test_later_row_wins_and_zero_length_rows_fail(spark):
    merge = run(spark, "MERGE_ENTITY_PATCH", [(1, 9, "spring", "a", "2019-03-01", "2019-06-01"), (2, 9, None, "b", "2019-05-01", "2019-07-01"), (3, 9, "none", "c", "2019-05-05", "2019-05-05")])
    # the second row patches its remark alone; pieces of equal data coalesce with the latest remark
    assert (9, "spring", "b", D("2019-03-01"), D("2019-06-01")) in rows(merge.target_after)
    failed = {r["source_row_id"]: (r["status"], r["error_message"]) for r in merge.feedback.collect()}
    assert failed[3] == ("ERROR", "Planner failed to generate a plan for this source row.")


@pytest.mark.parametrize("persist", [False, "memory", "settled"])
def test_results_do_not_depend_on_what_is_kept(spark, persist):
    merge = run(spark, "MERGE_ENTITY_PATCH", [(11, *FAIR)], persist=persist)
    assert rows(merge.target_after) == dated(LOW, HIGH1, FAIR, HIGH2, LATE, FLAT) and told(merge) == {11: "APPLIED"}
    merge.release()


def test_an_entity_with_many_overlapping_rows(spark):
    """100,000 source rows of one entity, each overlapping thousands of others, in about n log n."""
    n = 100_000
    target = spark.createDataFrame([(1, "old", None, D("2000-01-01"), D("2100-01-01")), (2, "other", None, D("2000-01-01"), D("2001-01-01"))], TARGET).selectExpr("id", "tariff", "unix_date(valid_from) as f", "unix_date(valid_until) as u")
    source = spark.range(n).selectExpr("cast(id as int) as row_id", "1 as id", "concat('t', id % 7) as tariff", "cast(20000 + id as int) as f", "cast(20000 + id + 5000 - id % 13 as int) as u")
    began = time.time()
    after = temporal_merge(target.selectExpr("*"), source, identity=["id"], mode="MERGE_ENTITY_PATCH", f="f", u="u", persist=False).target_after.collect()
    assert time.time() - began < 60
    by_start = {r["f"]: r["tariff"] for r in after if r["id"] == 1}
    assert by_start[10957] == "old" and all(by_start[20000 + i] == f"t{i % 7}" for i in range(0, n, 997)) and [r["tariff"] for r in after if r["id"] == 2] == ["other"]


def test_a_small_source_does_not_shuffle_the_target(spark, tmp_path):
    spark.range(200_000).selectExpr("cast(id as int) as id", "'x' as tariff", "'' as remark", "date'2020-01-01' as valid_from", "date'2021-01-01' as valid_until").write.parquet(f"{tmp_path}/t")
    target = spark.read.parquet(f"{tmp_path}/t")
    source = spark.createDataFrame(dated((1, 4, "y", None, "2020-02-01", "2020-03-01")), SOURCE)
    merge = temporal_merge(target, source, identity=["id"], persist=False)
    merge.target_after.write.format("noop").mode("overwrite").save()
    plan = merge.target_after._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and merge.target_after.count() == 200_002


PERSON = "id int, ssn string, employee_nr string, email string, full_name string, valid_from date, valid_until date"


def people(spark, source, **spec):
    target = spark.createDataFrame([
        (1, "111", "E101", "a@x", "Alice", D("2023-01-01"), D("2024-01-01")), (2, "222", "E202", "b@x", "Bob", D("2023-01-01"), D("2024-01-01"))], PERSON)
    return temporal_merge(target, spark.createDataFrame(source, "row_id int, " + PERSON), identity=["id"], natural_keys=[["ssn"], ["employee_nr"], ["email"]], generated_identity="id", **spec)


def test_natural_keys_find_identity_and_ambiguity(spark):
    merge = people(spark, [
        (1, None, "111", None, None, "Alice B", D("2023-06-01"), D("2024-01-01")),
        (2, None, "222", "E101", None, "Who", D("2023-06-01"), D("2024-01-01")),
        (3, None, None, None, None, "Nobody", D("2023-06-01"), D("2024-01-01")),
        (4, None, "333", None, None, "Carol", D("2023-01-01"), D("2023-06-01")),
        (5, None, "333", "E303", None, "Carol", D("2023-06-01"), D("2024-01-01")),
        (6, None, None, "E303", None, "Carol C", D("2024-01-01"), D("2025-01-01"))])
    told = {r["source_row_id"]: (r["status"], r["error_message"]) for r in merge.feedback.collect()}
    assert told[1] == ("APPLIED", None)
    assert told[2] == ("ERROR", 'Source row is ambiguous. It matches multiple distinct target entities: [{"id":1}, {"id":2}]')
    assert told[3][1] == "Source row is unidentifiable. It has NULL for all stable identity columns {id} and all natural keys [[ssn], [employee_nr], [email]]"
    after = rows(merge.target_after)
    assert (1, "111", "E101", "a@x", "Alice B", D("2023-06-01"), D("2024-01-01")) in after
    carol = [r for r in after if r[4].startswith("Carol")]
    assert {r[0] for r in carol} == {3}  # rows linked by a shared key are one entity
    ids = {r["row_id"]: r["id"] for r in merge.source_with_identity.collect()}
    assert ids[4] == ids[5] == ids[6] == 3


def test_eclipsed_rows(spark):
    merge = people(spark, [
        (1, None, "111", None, None, "old", D("2023-02-01"), D("2023-04-01")), (2, None, "111", None, None, "n1", D("2023-01-01"), D("2023-03-01")), (3, None, "111", None, None, "n2", D("2023-03-01"), D("2023-05-01"))])
    assert {r["source_row_id"]: r["status"] for r in merge.feedback.collect()} == {1: "SKIPPED_ECLIPSED", 2: "APPLIED", 3: "APPLIED"}


def test_founding_ids_and_required_columns(spark):
    target = spark.createDataFrame([(7, "a", "x", D("2020-01-01"), D("2021-01-01"))], "id int, name string, status string, valid_from date, valid_until date")
    source = spark.createDataFrame([(1, 10, None, "n1", None, D("2020-01-01"), D("2021-01-01")), (2, 10, None, "n2", None, D("2021-01-01"), D("2022-01-01")), (3, 11, None, "m", None, D("2020-01-01"), D("2022-01-01")), (4, 12, 7, None, None, D("2020-03-01"), D("2020-04-01"))],
                                   "row_id int, founding int, id int, name string, status string, valid_from date, valid_until date")
    merge = temporal_merge(target, source, identity=["id"], founding_id="founding", mode="MERGE_ENTITY_UPSERT", required=["status"], defaults={"status": "new"}, generated_identity="id")
    after = rows(merge.target_after)
    assert {(r[0], r[1], r[2]) for r in after if r[0] != 7} == {(8, "n1", "new"), (8, "n2", "new"), (9, "m", "new")}
    assert (7, None, "x", D("2020-03-01"), D("2020-04-01")) in after
