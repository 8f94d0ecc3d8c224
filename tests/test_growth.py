"""What the steps of a query make on the way, which must not grow faster than its input."""

from datetime import date

from pyspark.sql import functions as F

from tidemark.operators import views
from tidemark.operators.merge import temporal_merge

D = date.fromisoformat


def most_rows(df):
    """The most rows that any node of the plan made, once df has run."""
    nodes, most = [df._jdf.queryExecution().executedPlan()], 0
    while nodes:
        node = nodes.pop()
        kind = node.getClass().getSimpleName()
        inner = node.executedPlan() if kind == "AdaptiveSparkPlanExec" else node.plan() if kind.endswith("QueryStageExec") else None
        nodes.extend([inner] if inner is not None else [node.children().apply(i) for i in range(node.children().size())])
        made = node.metrics().get("numOutputRows")
        most = max(most, made.get().value()) if made.isDefined() else most
    return most


def test_a_natural_key_of_many_entities_is_not_paired_with_its_rows(spark):
    dates = {"valid_from": F.lit("2020-01-01").cast("date"), "valid_until": F.lit("2021-01-01").cast("date")}
    crowd = spark.range(500).selectExpr("id", "'many' as club")
    few = spark.range(11).selectExpr("1000 + id as id", "'eleven' as club").unionByName(spark.range(10).selectExpr("2000 + id as id", "'ten' as club")).unionByName(spark.range(1).selectExpr("3000 + id as id", "'one' as club"))
    source = spark.range(500).selectExpr("id as row_id", "cast(null as long) as id", "case id when 7 then 'eleven' when 8 then 'ten' when 9 then 'one' else 'many' end as club")
    merge = temporal_merge(crowd.unionByName(few).withColumns(dates), source.withColumns(dates), identity=["id"], natural_keys=[["club"]], persist=False)
    judged = merge.judged.select("_rid", "_error")
    told = {r["_rid"]: r["_error"] for r in judged.collect()}
    text = lambda first, n, more="": "Source row is ambiguous. It matches multiple distinct target entities: [" + ", ".join(f'{{"id":{first + i}}}' for i in range(n)) + more + "]"
    assert len(told) == 500 and told[0] == told[499] == text(0, 10, ", ...")
    assert (told[7], told[8], told[9]) == (text(1000, 10, ", ..."), text(2000, 10), None)
    assert most_rows(judged) < 5_000


def test_a_current_update_reads_its_table_once(spark):
    df = spark.range(8).selectExpr("id", "concat('d', id % 2) as dept", "date_add(date'2024-01-01', cast(id as int)) as valid_from", "if(id = 4, date'2024-02-01', date'9999-12-31') as valid_until").repartition(2)
    after = views.current_update(df, {"dept": F.concat("dept", F.lit("+"), F.col("valid_from").cast("string"))}, F.col("id") % 2 == 0, "2024-01-07")
    end, now = D("9999-12-31"), D("2024-01-07")
    kept = [(i, "d1", D(f"2024-01-0{i + 1}"), end) for i in (1, 3, 5, 7)] + [(4, "d0", D("2024-01-05"), D("2024-02-01"))]
    want = kept + [(i, "d0", D(f"2024-01-0{i + 1}"), now) for i in (0, 2)] + [(i, "d0+2024-01-07", now, end) for i in (0, 2, 6)]
    assert sorted(tuple(r) for r in after.collect()) == sorted(want)
    assert after._jdf.queryExecution().optimizedPlan().toString().count("Range (") == 1


def test_a_plan_joins_blocks_once_and_groups_none(spark):
    dates = {"valid_from": F.lit("2020-01-01").cast("date"), "valid_until": F.lit("2021-01-01").cast("date")}
    target = spark.range(20).selectExpr("id", "concat('t', id) as tariff").withColumns(dates)
    source = spark.range(10, 30).selectExpr("id as row_id", "id", "concat('t', id - id % 2) as tariff").withColumns(dates)
    merge = temporal_merge(target, source, identity=["id"], mode="MERGE_ENTITY_UPSERT", persist="settled")
    plan = merge.plan.select("id", "operation")
    assert sorted(tuple(r) for r in plan.collect()) == [(i, "UPDATE" if i < 20 and i % 2 else "SKIP_IDENTICAL" if i < 20 else "INSERT") for i in range(10, 30)]
    steps = plan._jdf.queryExecution().optimizedPlan().toString()
    assert steps.count("Join ") == 1 and "FullOuter" not in steps
    assert "Aggregate" not in merge._resolved(True)._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[0]


def test_a_snapshot_sorts_its_pieces_once(spark):
    target = spark.createDataFrame([(1, "a", "x", "t1", D("2020-01-01"), D("2020-03-01")), (1, "a", "x", "t2", D("2020-03-01"), D("2020-05-01")), (1, "b", "x", "t3", D("2020-05-01"), D("9999-12-31"))],
                                   "id int, tariff string, zone string, note string, valid_from date, valid_until date")
    source = spark.createDataFrame([(1, 1, "a", "s1", D("2020-02-01"), D("2020-04-01")), (2, 1, None, "s2", D("2020-06-01"), D("2020-07-01")), (3, 2, "c", "s3", D("2020-01-01"), D("2020-02-01")), (4, 2, "c", "s4", D("2020-02-01"), D("2020-03-01")), (5, 2, "c", "s5", D("2020-04-01"), D("2020-05-01"))],
                                   "row_id int, id int, tariff string, note string, valid_from date, valid_until date")
    merge = temporal_merge(target, source, identity=["id"], ephemeral=["note"], defaults={"zone": "new"}, delete_mode="DELETE_MISSING_ENTITIES", persist=False)
    want = [(1, "a", "x", "t2", D("2020-01-01"), D("2020-05-01")), (1, "b", "x", "t3", D("2020-05-01"), D("9999-12-31")), (2, "c", "new", "s4", D("2020-01-01"), D("2020-03-01")), (2, "c", "new", "s5", D("2020-04-01"), D("2020-05-01"))]
    assert sorted(tuple(r) for r in merge.target_after.collect()) == want
    steps = merge.target_after._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0]
    assert steps.count("Sort [") == 1 and "REPARTITION_BY_NUM" in steps
    # what the source names is looked up by its keys alone: no row is joined to tell which entities stay as they are
    merge = temporal_merge(target, source, identity=["id"], ephemeral=["note"], persist=False)
    assert merge._of_touched("left_anti")._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    nameless = target.unionByName(target.limit(1).withColumn("id", F.lit(None).cast("int")))
    after = temporal_merge(nameless, source.unionByName(source.limit(1).withColumns({"id": F.lit(None).cast("int"), "row_id": F.lit(6)})), identity=["id"], ephemeral=["note"], persist=False).target_after
    assert sorted((r["id"] is None, r["note"]) for r in after.collect()) == [(False, "s4"), (False, "s5"), (False, "t2"), (False, "t3"), (True, "s1"), (True, "t1")]


def test_what_became_of_rows_that_take_no_part_is_told_without_a_sweep(spark):
    target = spark.createDataFrame([(1, "k1", "x", D("2020-01-01"), D("2021-01-01")), (2, "twice", "x", D("2020-01-01"), D("2021-01-01")), (3, "twice", "x", D("2020-01-01"), D("2021-01-01")), (4, "k4", "y", D("2020-01-01"), D("2021-01-01"))], "id int, code string, tariff string, valid_from date, valid_until date")
    source = spark.createDataFrame([
        (1, "k1", "a", D("2020-02-01"), D("2020-04-01")), (2, "k1", "b", D("2020-01-01"), D("2020-03-01")), (3, "k1", "c", D("2020-03-01"), D("2020-05-01")), (4, "k1", "d", D("2020-06-01"), D("2020-06-01")),
        (5, "twice", "a", D("2020-01-01"), D("2020-02-01")), (6, "twice", "b", D("2020-01-01"), D("2020-02-01")), (7, "new", "n", D("2020-01-01"), D("2020-02-01")), (8, "new", "n", D("2020-01-01"), D("2020-02-01")), (9, "k4", "y", D("2020-08-01"), D("2020-09-01")),
    ], "row_id int, code string, tariff string, valid_from date, valid_until date").withColumn("id", F.lit(None).cast("int"))
    spec = {"identity": ["id"], "natural_keys": [["code"]], "mode": "MERGE_ENTITY_UPSERT", "persist": False}
    feedback = temporal_merge(target, source, **spec).feedback
    both = 'Source row is ambiguous. It matches multiple distinct target entities: [{"id":2}, {"id":3}]'
    eclipsed, applied, ambiguous = ("SKIPPED_ECLIPSED", None), ("APPLIED", None), ("ERROR", both)
    told = {r["source_row_id"]: r for r in feedback.collect()}
    assert {i: (r["status"], r["error_message"]) for i, r in told.items()} == {1: eclipsed, 2: applied, 3: applied, 4: ("ERROR", "Planner failed to generate a plan for this source row."), 5: ambiguous, 6: ambiguous, 7: eclipsed, 8: applied, 9: ("SKIPPED_IDENTICAL", None)}
    assert [told[i]["target_entity_keys"] for i in (1, 2, 4, 5, 7)] == [['{"id":1}'], ['{"id":1}'], [], ['{"id":2}'], ["{}"]]
    gone = feedback.where("status = 'SKIPPED_ECLIPSED'").select("source_row_id")
    assert sorted(r[0] for r in gone.collect()) == [1, 7]
    assert gone._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    skipped = temporal_merge(target, source.withColumn("id", F.lit(9)), identity=["id"], mode="PATCH_FOR_PORTION_OF", persist=False).feedback
    assert {r["status"] for r in skipped.collect()} == {"SKIPPED_NO_TARGET"}
