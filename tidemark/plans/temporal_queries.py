"""Queries over the driver's tables: histories are derived from events and orders, whole tables each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import period as P
from tidemark.functions.aggregates import first_non_null
from tidemark.operators import coverage, intervals, keys, versioning, views
from tidemark.operators.merge import TemporalMerge, temporal_merge
from tidemark.plans.registry import query

END = "9999-12-31 23:59:59.999999"
VALID, SYSTEM = ("valid_from", "valid_until"), ("system_valid_from", "system_valid_until")
AT, LATER = "2024-01-15 12:00:00", "2024-01-20 00:00:00"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _time(text: str):
    return F.lit(text).cast("timestamp_ntz")


# -- histories ------------------------------------------------------------------------------------------------------


def events_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.slices(_read(spark, sf_dir, "events"), ["user_id"], "ts", ["event_type"], ["event_id"])


def events_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.coalesce_periods(events_history(spark, sf_dir), ["user_id"], ["event_type"])


def order_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ninety days from each order on."""
    rows = _read(spark, sf_dir, "orders")
    return rows.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", F.col("o_orderdate").alias("valid_from"), (F.col("o_orderdate") + F.expr("interval 90 days")).alias("valid_until"))


HISTORY = f"""SELECT user_id, event_type, ts AS valid_from,
    coalesce(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), TIMESTAMP '{END}') AS valid_until FROM events"""
HISTORY = f"SELECT * FROM ({HISTORY}) WHERE valid_from < valid_until"
STATES = f"""SELECT user_id, any_value(event_type) AS event_type, min(valid_from) AS valid_from, max(valid_until) AS valid_until FROM (
    SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY valid_from) AS block FROM (
        SELECT *, CASE WHEN lag(valid_until) OVER w = valid_from AND lag(event_type) OVER w IS NOT DISTINCT FROM event_type THEN 0 ELSE 1 END AS fresh
        FROM ({HISTORY}) WINDOW w AS (PARTITION BY user_id ORDER BY valid_from))) GROUP BY user_id, block"""
PERIODS = "SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, o_orderdate AS valid_from, o_orderdate + INTERVAL 90 DAY AS valid_until FROM orders"
BLOCKS = """SELECT o_custkey, min(valid_from) AS valid_from, max(valid_until) AS valid_until FROM (
    SELECT *, sum(fresh) OVER (PARTITION BY o_custkey ORDER BY valid_from, valid_until, o_orderkey) AS block FROM (
        SELECT *, CASE WHEN valid_from <= max(valid_until) OVER (PARTITION BY o_custkey ORDER BY valid_from, valid_until, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh
        FROM ({periods}))) GROUP BY o_custkey, block""".format(periods=PERIODS)

query("events_state_history", HISTORY, VALID)(events_history)
query("events_coalesced", STATES, VALID)(events_states)


@query("events_as_of", f"SELECT user_id, event_type FROM ({STATES}) WHERE valid_from <= TIMESTAMP '{AT}' AND TIMESTAMP '{AT}' < valid_until")
def events_as_of(spark, sf_dir):
    return intervals.as_of(events_states(spark, sf_dir), _time(AT)).select("user_id", "event_type")


@query("events_between", f"SELECT * FROM ({STATES}) WHERE valid_from <= TIMESTAMP '{LATER}' AND valid_until > TIMESTAMP '{AT}'", VALID)
def events_between(spark, sf_dir):
    return intervals.between(events_states(spark, sf_dir), _time(AT), _time(LATER))


@query("events_between_symmetric", f"SELECT * FROM ({STATES}) WHERE valid_from <= TIMESTAMP '{LATER}' AND valid_until > TIMESTAMP '{AT}'", VALID)
def events_between_symmetric(spark, sf_dir):
    return intervals.between_symmetric(events_states(spark, sf_dir), _time(LATER), _time(AT))


@query("events_from_to", f"SELECT * FROM ({STATES}) WHERE valid_from < TIMESTAMP '{LATER}' AND valid_until > TIMESTAMP '{AT}'", VALID)
def events_from_to(spark, sf_dir):
    return intervals.from_to(events_states(spark, sf_dir), _time(AT), _time(LATER))


# -- relations and joins --------------------------------------------------------------------------------------------

ALLEN_SQL = """CASE WHEN a.valid_until < b.valid_from THEN 'precedes' WHEN a.valid_until = b.valid_from THEN 'meets'
    WHEN a.valid_from < b.valid_from AND a.valid_until < b.valid_until THEN 'overlaps' WHEN a.valid_from = b.valid_from AND a.valid_until < b.valid_until THEN 'starts'
    WHEN a.valid_from > b.valid_from AND a.valid_until < b.valid_until THEN 'during' WHEN a.valid_from > b.valid_from AND a.valid_until = b.valid_until THEN 'finishes'
    WHEN a.valid_from = b.valid_from AND a.valid_until = b.valid_until THEN 'equals' WHEN b.valid_until < a.valid_from THEN 'preceded_by' WHEN b.valid_until = a.valid_from THEN 'met_by'
    WHEN b.valid_from < a.valid_from AND b.valid_until < a.valid_until THEN 'overlapped_by' WHEN a.valid_from = b.valid_from THEN 'started_by'
    WHEN a.valid_until > b.valid_until THEN 'contains' ELSE 'finished_by' END"""


# one to three months of thirty days from the order's thirty days on, so that all thirteen relations occur
MONTHS = """SELECT o_orderkey, o_custkey, 30 * (datediff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) // 30) AS valid_from,
    30 * (datediff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) // 30 + 1 + o_orderkey % 3) AS valid_until FROM orders"""


def order_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    slot = F.floor(F.unix_date(F.to_date("o_orderdate")) / 30)
    return _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", (30 * slot).alias("valid_from"), (30 * (slot + 1 + F.col("o_orderkey") % 3)).alias("valid_until"))


@query("allen_relation_matrix", f"""SELECT relation, count(*) AS pairs FROM (SELECT {ALLEN_SQL} AS relation FROM ({MONTHS}) a JOIN ({MONTHS}) b
    ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey) GROUP BY relation""")
def allen_relation_matrix(spark, sf_dir):
    pairs = intervals.allen_pairs(order_months(spark, sf_dir), ["o_custkey"], "o_orderkey")
    return pairs.groupBy("relation").agg(F.count("*").alias("pairs"))


@query("interval_overlap_join", f"""SELECT a.o_orderkey, b.o_orderkey AS right_o_orderkey FROM ({PERIODS}) a JOIN ({PERIODS}) b
    ON a.o_custkey = b.o_custkey AND a.valid_from < b.valid_until AND b.valid_from < a.valid_until WHERE a.o_orderkey < b.o_orderkey""")
def interval_overlap_join(spark, sf_dir):
    rows = order_periods(spark, sf_dir).select("o_custkey", "o_orderkey", "valid_from", "valid_until")
    return intervals.temporal_join(rows, rows, ["o_custkey"]).where("o_orderkey < right_o_orderkey").select("o_orderkey", "right_o_orderkey")


@query("interval_intersection", f"""SELECT a.o_orderkey, b.o_orderkey AS right_o_orderkey, greatest(a.valid_from, b.valid_from) AS valid_from, least(a.valid_until, b.valid_until) AS valid_until
    FROM ({PERIODS}) a JOIN ({PERIODS}) b ON a.o_custkey = b.o_custkey AND a.valid_from < b.valid_until AND b.valid_from < a.valid_until WHERE a.o_orderkey < b.o_orderkey""", VALID)
def interval_intersection(spark, sf_dir):
    rows = order_periods(spark, sf_dir).select("o_custkey", "o_orderkey", "valid_from", "valid_until")
    return intervals.temporal_join(rows, rows, ["o_custkey"]).where("o_orderkey < right_o_orderkey").drop("o_custkey")


SUPPLIER_DAYS = """SELECT l_suppkey, l_shipdate AS valid_from, l_shipdate + INTERVAL 1 DAY AS valid_until, count(*) AS n FROM lineitem GROUP BY ALL"""


@query("keyless_overlap_join", f"""SELECT a.l_suppkey, count(*) AS pairs FROM ({SUPPLIER_DAYS}) a JOIN (SELECT DISTINCT date_trunc('month', o_orderdate) AS valid_from,
    date_trunc('month', o_orderdate) + INTERVAL 20 DAY AS valid_until FROM orders) b ON a.valid_from < b.valid_until AND b.valid_from < a.valid_until GROUP BY a.l_suppkey""")
def keyless_overlap_join(spark, sf_dir):
    days = _read(spark, sf_dir, "lineitem").groupBy("l_suppkey", F.col("l_shipdate").alias("valid_from")).agg(F.count("*").alias("n"))
    days = days.withColumn("valid_until", F.col("valid_from") + F.expr("interval 1 day"))
    months = _read(spark, sf_dir, "orders").select(F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("valid_from")).distinct()
    months = months.withColumn("valid_until", F.col("valid_from") + F.expr("interval 20 days"))
    return intervals.overlap_join(days, months, 20 * 86400).groupBy("l_suppkey").agg(F.count("*").alias("pairs"))


@query("as_of_join", f"""SELECT e.event_id, s.event_type AS state FROM events e LEFT JOIN ({HISTORY}) s ON e.user_id = s.user_id AND s.valid_from <= e.ts - INTERVAL 1 HOUR AND e.ts - INTERVAL 1 HOUR < s.valid_until""")
def as_of_join(spark, sf_dir):
    asked = _read(spark, sf_dir, "events").select("event_id", "user_id", (F.col("ts") - F.expr("interval 1 hour")).alias("at"))
    states = events_history(spark, sf_dir).withColumnRenamed("event_type", "state")
    return intervals.as_of_join(asked, states, ["user_id"], "at", ["state"], u="valid_until").select("event_id", "state")


# -- coverage -------------------------------------------------------------------------------------------------------

query("merge_islands", BLOCKS, VALID)(lambda spark, sf_dir: coverage.merge_islands(order_periods(spark, sf_dir), ["o_custkey"]))
query("gaps", f"""SELECT o_custkey, valid_until AS valid_from, following AS valid_until FROM (SELECT *, lead(valid_from) OVER (PARTITION BY o_custkey ORDER BY valid_from) AS following FROM ({BLOCKS})) WHERE following IS NOT NULL""", VALID)(
    lambda spark, sf_dir: coverage.gaps(order_periods(spark, sf_dir), ["o_custkey"]))


# a target for each customer: from the first order on, ninety days or more; none for some, and one from the day before for others
COVER_TARGET = """SELECT *, CASE WHEN o_custkey % 10 <> 7 THEN min(valid_from) OVER w - INTERVAL 1 DAY * CAST(o_custkey % 10 = 3 AS INT) END AS tf,
    CASE WHEN o_custkey % 10 <> 7 THEN min(valid_from) OVER w + INTERVAL 90 DAY + INTERVAL 1 DAY * (40 * (o_custkey % 4)) END AS tu FROM ({periods}) WINDOW w AS (PARTITION BY o_custkey)"""


def cover_targets(rows: DataFrame) -> DataFrame:
    first = F.min("valid_from").over(Window.partitionBy("o_custkey"))
    known = F.col("o_custkey") % 10 != 7
    days = lambda n: F.make_dt_interval(n)
    early = days((F.col("o_custkey") % 10 == 3).cast("int"))
    return rows.withColumns({"tf": F.when(known, first - early), "tu": F.when(known, first + days((90 + 40 * (F.col("o_custkey") % 4)).cast("int")))})


@query("covers_without_gaps", f"""SELECT o_custkey, CASE WHEN bool_or(tf IS NULL) THEN NULL ELSE bool_or(first_start <= tf) AND bool_or(valid_until >= tu) AND NOT bool_or(coalesce(valid_from > reached AND reached < tu, false)) END AS covered FROM (
    SELECT *, min(valid_from) OVER (PARTITION BY o_custkey) AS first_start,
    max(valid_until) OVER (PARTITION BY o_custkey ORDER BY valid_from, valid_until, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM ({COVER_TARGET.format(periods=PERIODS)})) GROUP BY o_custkey""")
def covers_without_gaps(spark, sf_dir):
    return coverage.covers_without_gaps(cover_targets(order_periods(spark, sf_dir)), ["o_custkey"], "tf", "tu")


# every other order leaves both its bounds out: where it meets another such one, a moment is not covered
@query("covers_with_bounds", f"""WITH t AS (SELECT *, o_orderkey % 2 AS open FROM ({COVER_TARGET.format(periods=MONTHS.replace("valid_from", "f0").replace("valid_until", "u0").join(["SELECT o_orderkey, o_custkey, TIMESTAMP '1970-01-01' + INTERVAL 1 DAY * f0 AS valid_from, TIMESTAMP '1970-01-01' + INTERVAL 1 DAY * u0 AS valid_until FROM (", ")"]))}))
    SELECT o_custkey, CASE WHEN bool_or(tf IS NULL) THEN NULL
        ELSE bool_or(valid_from < tf OR valid_from = tf AND open = 0) AND bool_or(valid_until >= tu) AND NOT bool_or(coalesce((valid_from > ru OR valid_from = ru AND open = 1 AND rc = 0) AND ru < tu, false)) END AS covered
    FROM (SELECT *, reached.u AS ru, reached.c AS rc FROM (SELECT *, max({{'u': valid_until, 'c': 0}}) OVER (PARTITION BY o_custkey ORDER BY valid_from, open, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM t)) GROUP BY o_custkey""")
def covers_with_bounds(spark, sf_dir):
    start = F.lit("1970-01-01").cast("timestamp_ntz")
    rows = order_months(spark, sf_dir).withColumns({c: start + F.make_dt_interval(F.col(c).cast("int")) for c in VALID})
    rows = cover_targets(rows).withColumn("bounds", F.when(F.col("o_orderkey") % 2 == 1, "()").otherwise("[)"))
    return coverage.covers_without_gaps(rows, ["o_custkey"], "tf", "tu", bounds="bounds")


@query("canonical_bounds", """SELECT o_orderkey, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 4 >= 2 AS INT) AS valid_from, CAST(o_orderdate AS DATE) + 30 + CAST(o_orderkey % 2 = 1 AS INT) AS valid_until FROM orders""", VALID)
def canonical_bounds(spark, sf_dir):
    rows = _read(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("f"), F.date_add(F.to_date("o_orderdate"), 30).alias("u"), F.element_at(F.array(*map(F.lit, ("[)", "[]", "()", "(]"))), (F.col("o_orderkey") % 4 + 1).cast("int")).alias("bounds"))
    f, u = P.canonical(F.col("f"), F.col("u"), F.col("bounds"), rows.schema["f"].dataType)
    return rows.select("o_orderkey", f.alias("valid_from"), u.alias("valid_until"))


@query("first_non_null", "SELECT user_id, arg_min(event_type, ts) FILTER (WHERE event_type <> 'view') AS first_type FROM events GROUP BY user_id")
def first_value(spark, sf_dir):
    kept = F.when(F.col("event_type") != "view", F.col("event_type"))
    return _read(spark, sf_dir, "events").groupBy("user_id").agg(first_non_null(kept, F.col("ts")).alias("first_type"))


@query("sync_valid_to", f"""SELECT o_orderkey, CAST(o_orderdate AS DATE) AS valid_from, CAST(o_orderdate AS DATE) + 30 AS valid_until, CAST(o_orderdate AS DATE) + 29 AS valid_to FROM orders""", (*VALID, "valid_to"))
def sync_valid_to(spark, sf_dir):
    rows = _read(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("valid_from"), F.date_add(F.to_date("o_orderdate"), 29).alias("valid_to"))
    return P.normalize_period(rows).select("o_orderkey", "valid_from", "valid_until", "valid_to")


# -- keys -----------------------------------------------------------------------------------------------------------


# equal periods of one key tie, so the violations are counted by key and period, which ties don't change
def _counted(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key, "valid_from").agg(F.count("*").alias("violations"))


def _counted_sql(rows: str, key: str) -> str:
    return f"""SELECT {key}, valid_from, count(*) AS violations FROM (SELECT *, max(valid_until) OVER (PARTITION BY {key} ORDER BY valid_from, valid_until ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached
        FROM ({rows})) WHERE valid_from < reached GROUP BY {key}, valid_from"""


query("unique_key_violations", _counted_sql(PERIODS, "o_custkey"), ("valid_from",))(
    lambda spark, sf_dir: _counted(keys.unique_key_violations(order_periods(spark, sf_dir), ["o_custkey"], "primary"), ["o_custkey"]))
query("predicated_key_violations", _counted_sql(f"SELECT * FROM ({PERIODS}) WHERE o_orderstatus = 'O'", "o_custkey"), ("valid_from",))(
    lambda spark, sf_dir: _counted(keys.unique_key_violations(order_periods(spark, sf_dir), ["o_custkey"], "predicated", "o_orderstatus = 'O'"), ["o_custkey"]))
XOR = f"SELECT *, CASE WHEN o_orderstatus = 'O' THEN o_custkey END AS open_cust, CASE WHEN o_orderstatus <> 'O' THEN o_custkey END AS other_cust FROM ({PERIODS})"


@query("xor_key_violations", _counted_sql(XOR, "open_cust, other_cust"), ("valid_from",))
def xor_key_violations(spark, sf_dir):
    rows = order_periods(spark, sf_dir).withColumns({"open_cust": F.expr("CASE WHEN o_orderstatus = 'O' THEN o_custkey END"), "other_cust": F.expr("CASE WHEN o_orderstatus <> 'O' THEN o_custkey END")})
    return _counted(keys.unique_key_violations(rows, ["open_cust", "other_cust"], "exclusive"), ["open_cust", "other_cust"])


KEYED = f"SELECT * REPLACE (CASE WHEN o_orderkey % 50 <> 0 THEN o_custkey END AS o_custkey) FROM ({PERIODS})"


@query("primary_key_violations", f"""SELECT o_custkey, valid_from, 'overlap' AS violation, violations FROM ({_counted_sql(f"SELECT * FROM ({KEYED}) WHERE o_custkey IS NOT NULL", "o_custkey")})
    UNION ALL SELECT o_custkey, valid_from, 'null', count(*) FROM ({KEYED}) WHERE o_custkey IS NULL GROUP BY ALL""", ("valid_from",))
def primary_key_violations(spark, sf_dir):
    rows = order_periods(spark, sf_dir).withColumn("o_custkey", F.when(F.col("o_orderkey") % 50 != 0, F.col("o_custkey")))
    return keys.unique_key_violations(rows, ["o_custkey"], "primary").groupBy("o_custkey", "valid_from", "violation").agg(F.count("*").alias("violations"))


@query("pk_consistency_violations", "SELECT l_partkey, l_suppkey, count(DISTINCT l_orderkey) AS owners FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_orderkey) > 1")
def pk_consistency_violations(spark, sf_dir):
    return keys.pk_consistency_violations(_read(spark, sf_dir, "lineitem"), ["l_partkey", "l_suppkey"], ["l_orderkey"])


SHIPMENTS = "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, o_custkey, l_shipdate AS valid_from, l_shipdate + INTERVAL 30 DAY AS valid_until FROM lineitem JOIN orders ON l_orderkey = o_orderkey"


def shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders = _read(spark, sf_dir, "lineitem"), _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "o_custkey", F.col("l_shipdate").alias("valid_from"), (F.col("l_shipdate") + F.expr("interval 30 days")).alias("valid_until"))


@query("temporal_fk_violations", f"""SELECT c.* FROM ({SHIPMENTS}) c WHERE NOT EXISTS (SELECT 1 FROM ({BLOCKS}) p WHERE p.o_custkey = c.o_custkey AND p.valid_from <= c.valid_from AND p.valid_until >= c.valid_until)""", VALID)
def temporal_fk_violations(spark, sf_dir):
    return keys.temporal_fk_violations(shipments(spark, sf_dir), order_periods(spark, sf_dir), ["o_custkey"])


@query("regular_fk_violations", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')")
def regular_fk_violations(spark, sf_dir):
    parent = _read(spark, sf_dir, "orders").where("o_orderstatus <> 'P'")
    return keys.regular_fk_violations(_read(spark, sf_dir, "lineitem"), parent, ["l_orderkey"], ["o_orderkey"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("full_match_violations", """SELECT l_orderkey, l_linenumber, part, supplier FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 > 0 THEN l_partkey END AS part, CASE WHEN l_linenumber % 4 > 0 THEN l_suppkey END AS supplier FROM lineitem)
    WHERE (part IS NULL) <> (supplier IS NULL) OR part IS NOT NULL AND supplier IS NOT NULL AND (part, supplier) NOT IN (SELECT (l_partkey, l_suppkey) FROM lineitem WHERE l_linenumber < 3)""")
def full_match_violations(spark, sf_dir):
    lines = _read(spark, sf_dir, "lineitem")
    child = lines.select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") % 3 > 0, F.col("l_partkey")).alias("part"), F.when(F.col("l_linenumber") % 4 > 0, F.col("l_suppkey")).alias("supplier"))
    return keys.regular_fk_violations(child, lines.where("l_linenumber < 3"), ["part", "supplier"], ["l_partkey", "l_suppkey"], match="full")


# the parent loses its open orders; children that were covered by them alone are left over
AFTER_BLOCKS = BLOCKS.replace(PERIODS, f"SELECT * FROM ({PERIODS}) WHERE o_orderstatus <> 'O'")


@query("parent_delete_violations", f"""SELECT c.* FROM ({SHIPMENTS}) c WHERE NOT EXISTS (SELECT 1 FROM ({AFTER_BLOCKS}) p WHERE p.o_custkey = c.o_custkey AND p.valid_from <= c.valid_from AND p.valid_until >= c.valid_until)""", VALID)
def parent_delete_violations(spark, sf_dir):
    parent = order_periods(spark, sf_dir)
    return keys.parent_delete_violations(shipments(spark, sf_dir), parent, parent.where("o_orderstatus = 'O'"), ["o_custkey"])


MOVED_BLOCKS = BLOCKS.replace(PERIODS, f"SELECT * REPLACE (CASE WHEN o_orderstatus = 'O' THEN valid_from + INTERVAL 60 DAY ELSE valid_from END AS valid_from) FROM ({PERIODS})")


@query("parent_update_violations", f"""SELECT c.* FROM ({SHIPMENTS}) c WHERE NOT EXISTS (SELECT 1 FROM ({MOVED_BLOCKS}) p WHERE p.o_custkey = c.o_custkey AND p.valid_from <= c.valid_from AND p.valid_until >= c.valid_until)""", VALID)
def parent_update_violations(spark, sf_dir):
    parent = order_periods(spark, sf_dir)
    old = parent.where("o_orderstatus = 'O'")
    return keys.parent_update_violations(shipments(spark, sf_dir), parent, old, old.withColumn("valid_from", F.col("valid_from") + F.expr("interval 60 days")), ["o_custkey"])


# -- merges ---------------------------------------------------------------------------------------------------------
# The target is each customer's history of order states; the source are the events of users, taken as corrections to the
# customers of the same number, or to new ones for errors, on forty-five days somewhere in the past.

TARGET = """SELECT * FROM (SELECT o_custkey AS id, o_orderstatus AS status, o_orderpriority AS priority, CAST(o_orderkey AS VARCHAR) AS note, CAST(o_orderdate AS DATE) AS valid_from,
    CAST(coalesce(lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), TIMESTAMP '9999-12-31') AS DATE) AS valid_until FROM orders) WHERE valid_from < valid_until"""
SOURCE = """SELECT event_id AS row_id, CASE WHEN event_type = 'error' THEN user_id + 1000000 ELSE user_id END AS id, CASE WHEN event_type = 'view' THEN NULL ELSE event_type END AS status,
    CASE WHEN value < 20 THEN NULL ELSE CAST(CAST(floor(value / 25) AS INT) AS VARCHAR) END AS priority, props AS note,
    CAST(ts AS DATE) - CAST(floor(value * 60) AS INT) AS valid_from, CAST(ts AS DATE) - CAST(floor(value * 60) AS INT) + 45 AS valid_until FROM events"""


def merge_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.col("o_orderkey").cast("string").alias("note"), F.to_date("o_orderdate").alias("day"), "o_orderkey")
    return views.slices(rows, ["id"], "day", ["status", "priority", "note"], ["o_orderkey"])


def merge_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.date_sub(F.to_date("ts"), F.floor(F.col("value") * 60).cast("int"))
    return _read(spark, sf_dir, "events").select(
        F.col("event_id").alias("row_id"), F.when(F.col("event_type") == "error", F.col("user_id") + 1000000).otherwise(F.col("user_id")).alias("id"),
        F.when(F.col("event_type") != "view", F.col("event_type")).alias("status"), F.when(F.col("value") >= 20, F.floor(F.col("value") / 25).cast("int").cast("string")).alias("priority"),
        F.col("props").alias("note"), start.alias("valid_from"), F.date_add(start, 45).alias("valid_until"))


def merge(spark: SparkSession, sf_dir: str, mode: str, delete_mode: str = "NONE", persist: bool | str = False) -> TemporalMerge:
    return temporal_merge(merge_target(spark, sf_dir), merge_source(spark, sf_dir), identity=["id"], mode=mode, delete_mode=delete_mode, ephemeral=["note"], persist=persist)


def merge_sql(mode: str, delete_mode: str = "NONE", source: str = SOURCE) -> str:
    """WITH clauses that end in `blocks`: the coalesced pieces of the merge, piece by piece as the contract words it."""
    portion, patch = mode.endswith("PORTION_OF"), "PATCH" in mode
    taking = "WHERE id IN (SELECT id FROM tgt)" if portion else "WHERE id NOT IN (SELECT id FROM tgt)" if mode == "INSERT_NEW_ENTITIES" else ""
    scope = "true" if delete_mode.endswith("ENTITIES") and mode in ("MERGE_ENTITY_PATCH", "MERGE_ENTITY_REPLACE") else "id IN (SELECT id FROM src)"
    keep = "tf IS NOT NULL" if portion else "(tf IS NOT NULL OR k > 0)"
    if mode == "DELETE_FOR_PORTION_OF":
        keep = "tf IS NOT NULL AND k = 0"
    if "TIMELINE" in delete_mode:
        keep += " AND (k > 0 OR id NOT IN (SELECT id FROM act))"
    if delete_mode.endswith("ENTITIES"):
        keep += " AND id IN (SELECT id FROM act)"
    new = lambda c: f"first(s.{c} ORDER BY s.row_id DESC)" + (f" FILTER (WHERE s.{c} IS NOT NULL)" if patch and c != "note" else " FILTER (WHERE s.row_id IS NOT NULL)")
    pick = lambda c: f"CASE WHEN k = 0 THEN t_{c} ELSE {f'coalesce(s_{c}, t_{c})' if patch else f's_{c}'} END AS {c}"
    return f"""WITH tgt AS ({TARGET}), src AS ({source}), act AS (SELECT * FROM src {taking}), sco AS (SELECT * FROM tgt WHERE {scope}),
    pts AS (SELECT DISTINCT id, unnest([valid_from, valid_until]) AS p FROM (SELECT id, valid_from, valid_until FROM act UNION ALL SELECT id, valid_from, valid_until FROM sco)),
    seg AS (SELECT * FROM (SELECT id, p, lead(p) OVER (PARTITION BY id ORDER BY p) AS n FROM pts) WHERE n IS NOT NULL),
    tgs AS (SELECT g.id, g.p, g.n, t.valid_from AS tf, t.valid_until AS tu, t.status AS t_status, t.priority AS t_priority, t.note AS t_note
        FROM seg g LEFT JOIN sco t ON t.id = g.id AND t.valid_from <= g.p AND t.valid_until >= g.n),
    srs AS (SELECT g.id, g.p, count(s.row_id) AS k, max(s.row_id) AS latest, {', '.join(f'{new(c)} AS s_{c}' for c in ('status', 'priority', 'note'))}
        FROM seg g LEFT JOIN act s ON s.id = g.id AND s.valid_from <= g.p AND s.valid_until >= g.n GROUP BY g.id, g.p),
    res AS (SELECT id, p, n, tf, k, {', '.join(pick(c) for c in ('status', 'priority', 'note'))} FROM tgs JOIN srs USING (id, p) WHERE {keep}),
    mar AS (SELECT *, CASE WHEN lag(n) OVER w = p AND lag(status) OVER w IS NOT DISTINCT FROM status AND lag(priority) OVER w IS NOT DISTINCT FROM priority THEN 0 ELSE 1 END AS fresh
        FROM res WINDOW w AS (PARTITION BY id ORDER BY p)),
    blk AS (SELECT *, sum(fresh) OVER (PARTITION BY id ORDER BY p) AS block FROM mar),
    blocks AS (SELECT id, any_value(status) AS status, any_value(priority) AS priority, last(note ORDER BY p) AS note, min(p) AS valid_from, max(n) AS valid_until,
        first(tf ORDER BY p) FILTER (WHERE tf IS NOT NULL) AS origin, sum(k) AS k FROM blk GROUP BY id, block)"""


def _after_sql(mode: str, delete_mode: str = "NONE") -> str:
    rest = "" if delete_mode.endswith("ENTITIES") and mode in ("MERGE_ENTITY_PATCH", "MERGE_ENTITY_REPLACE") else " UNION ALL SELECT id, status, priority, note, valid_from, valid_until FROM tgt WHERE id NOT IN (SELECT id FROM src)"
    return f"{merge_sql(mode, delete_mode)} SELECT id, status, priority, note, valid_from, valid_until FROM blocks{rest}"


for _name, _mode, _delete in (
    ("merge_patch", "MERGE_ENTITY_PATCH", "NONE"), ("merge_upsert", "MERGE_ENTITY_UPSERT", "NONE"), ("merge_replace", "MERGE_ENTITY_REPLACE", "NONE"), ("merge_insert_new", "INSERT_NEW_ENTITIES", "NONE"),
    ("patch_portion", "PATCH_FOR_PORTION_OF", "NONE"), ("update_portion", "UPDATE_FOR_PORTION_OF", "NONE"), ("replace_portion", "REPLACE_FOR_PORTION_OF", "NONE"), ("delete_portion", "DELETE_FOR_PORTION_OF", "NONE"),
    ("merge_delete_missing_timeline", "MERGE_ENTITY_PATCH", "DELETE_MISSING_TIMELINE"), ("merge_delete_missing_entities", "MERGE_ENTITY_PATCH", "DELETE_MISSING_ENTITIES"),
    ("merge_delete_both", "MERGE_ENTITY_REPLACE", "DELETE_MISSING_TIMELINE_AND_ENTITIES"),
):
    query(_name, _after_sql(_mode, _delete), VALID)(lambda spark, sf_dir, m=_mode, d=_delete: merge(spark, sf_dir, m, d).target_after)


OPS = """, dif AS (SELECT coalesce(b.id, t.id) AS id, b.valid_from AS nf, b.valid_until AS nu, t.valid_from AS of, t.valid_until AS ou, b.k,
        b.status IS NOT DISTINCT FROM t.status AND b.priority IS NOT DISTINCT FROM t.priority AS same, b.note IS NOT DISTINCT FROM t.note AS same_note
        FROM blocks b FULL JOIN sco t ON b.id = t.id AND b.origin = t.valid_from),
    ran AS (SELECT *, row_number() OVER (PARTITION BY id, of ORDER BY CASE WHEN nf = of THEN 0 ELSE 1 END, CASE WHEN same THEN 0 ELSE 1 END, nf, nu) AS rank FROM dif),
    ops AS (SELECT *, CASE WHEN nf IS NULL THEN 'DELETE' WHEN of IS NULL OR rank > 1 THEN 'INSERT' WHEN nf = of AND nu = ou AND same AND same_note THEN 'SKIP_IDENTICAL' ELSE 'UPDATE' END AS operation FROM ran)"""
OPERATIONS = """SELECT id, operation, CASE WHEN operation <> 'UPDATE' THEN NULL WHEN nf = of AND nu = ou THEN 'NONE' WHEN nf >= of AND nu <= ou THEN 'SHRINK' WHEN nf <= of AND nu >= ou THEN 'GROW' ELSE 'MOVE' END AS update_effect,
        of AS old_valid_from, ou AS old_valid_until, nf AS new_valid_from, nu AS new_valid_until FROM ops WHERE operation <> 'SKIP_IDENTICAL' OR k > 0"""
PLAN_TIMES = ("old_valid_from", "old_valid_until", "new_valid_from", "new_valid_until")


@query("merge_plan_ops", f"{merge_sql('MERGE_ENTITY_UPSERT')} {OPS} {OPERATIONS}", PLAN_TIMES)
def merge_plan_ops(spark, sf_dir):
    plan = merge(spark, sf_dir, "MERGE_ENTITY_UPSERT", persist="settled").plan
    return plan.select("id", "operation", "update_effect", "old_valid_from", "old_valid_until", "new_valid_from", "new_valid_until")


@query("merge_feedback", merge_sql("INSERT_NEW_ENTITIES") + """ SELECT row_id AS source_row_id, CASE WHEN id IN (SELECT id FROM tgt) THEN 'SKIPPED_FILTERED'
    WHEN row_id IN (SELECT latest FROM srs WHERE k > 0) THEN 'APPLIED' ELSE 'ERROR' END AS status FROM src""")
def merge_feedback(spark, sf_dir):
    return merge(spark, sf_dir, "INSERT_NEW_ENTITIES", persist="settled").feedback.select("source_row_id", "status")


# the target's own rows come again: as they are, with another note, with another status, or ten days later
AGAIN = f"""SELECT CAST(note AS BIGINT) AS row_id, id, CASE WHEN CAST(note AS BIGINT) % 4 = 2 THEN 'Z' ELSE status END AS status, priority, CASE WHEN CAST(note AS BIGINT) % 4 = 1 THEN note || 'x' ELSE note END AS note,
    CASE WHEN CAST(note AS BIGINT) % 4 = 3 THEN valid_from + 10 ELSE valid_from END AS valid_from, CASE WHEN CAST(note AS BIGINT) % 4 = 3 AND valid_until < DATE '9999-12-31' THEN valid_until + 10 ELSE valid_until END AS valid_until FROM ({TARGET})"""


def merge_again(spark: SparkSession, sf_dir: str) -> TemporalMerge:
    target = merge_target(spark, sf_dir)
    key = F.col("note").cast("long")
    turn = lambda k: key % 4 == k
    source = target.select(
        key.alias("row_id"), "id", F.when(turn(2), "Z").otherwise(F.col("status")).alias("status"), "priority", F.when(turn(1), F.concat("note", F.lit("x"))).otherwise(F.col("note")).alias("note"),
        F.when(turn(3), F.date_add("valid_from", 10)).otherwise(F.col("valid_from")).alias("valid_from"), F.when(turn(3) & (F.col("valid_until") < F.lit("9999-12-31").cast("date")), F.date_add("valid_until", 10)).otherwise(F.col("valid_until")).alias("valid_until"))
    return temporal_merge(target, source, identity=["id"], mode="MERGE_ENTITY_UPSERT", ephemeral=["note"], persist="settled")


@query("merge_plan_effects", f"{merge_sql('MERGE_ENTITY_UPSERT', source=AGAIN)} {OPS} {OPERATIONS}", PLAN_TIMES)
def merge_plan_effects(spark, sf_dir):
    return merge_again(spark, sf_dir).plan.select("id", "operation", "update_effect", *PLAN_TIMES)


# the source rows behind each block: those that cover a piece of it, or for a piece of the target alone one that touches it
BEHIND = """, near AS (SELECT g.id, g.p, min(s.row_id) AS beside FROM seg g JOIN act s ON s.id = g.id AND (s.valid_from = g.n OR s.valid_until = g.p) GROUP BY g.id, g.p),
    firsts AS (SELECT id, min(row_id) AS first FROM act GROUP BY id),
    behind AS (SELECT b.id, b.block, s.row_id FROM blk b JOIN act s ON s.id = b.id AND s.valid_from <= b.p AND s.valid_until >= b.n WHERE b.k > 0
        UNION SELECT b.id, b.block, coalesce(n.beside, f.first) FROM blk b LEFT JOIN near n ON n.id = b.id AND n.p = b.p LEFT JOIN firsts f ON f.id = b.id WHERE b.k = 0),
    starts AS (SELECT id, block, min(p) AS nf FROM blk GROUP BY id, block),
    named AS (SELECT o.id, o.operation, o.nf, o.of, r.row_id FROM ops o JOIN starts USING (id, nf) JOIN behind r ON r.id = o.id AND r.block = starts.block WHERE o.operation <> 'SKIP_IDENTICAL' OR o.k > 0
        UNION ALL SELECT o.id, o.operation, o.nf, o.of, s.row_id FROM ops o JOIN act s ON s.id = o.id AND s.valid_from < o.ou AND s.valid_until > o.of WHERE o.operation = 'DELETE')"""


@query("merge_plan_rows", f"{merge_sql('MERGE_ENTITY_UPSERT', source=AGAIN)} {OPS} {BEHIND} SELECT id, operation, nf AS new_valid_from, of AS old_valid_from, row_id FROM named", ("new_valid_from", "old_valid_from"))
def merge_plan_rows(spark, sf_dir):
    return merge_again(spark, sf_dir).plan.select("id", "operation", "new_valid_from", "old_valid_from", F.explode("row_ids").alias("row_id"))


@query("merge_feedback_effects", f"""{merge_sql('MERGE_ENTITY_UPSERT', source=AGAIN)} {OPS} {BEHIND} SELECT src.row_id, CASE WHEN bool_or(operation <> 'SKIP_IDENTICAL') THEN 'APPLIED' WHEN count(operation) > 0 THEN 'SKIPPED_IDENTICAL' ELSE 'ERROR' END AS merge_status
    FROM src LEFT JOIN named ON named.row_id = src.row_id GROUP BY src.row_id""")
def merge_feedback_effects(spark, sf_dir):
    return merge_again(spark, sf_dir).source_with_feedback().select("row_id", "merge_status")


@query("portion_feedback", f"""{merge_sql('DELETE_FOR_PORTION_OF')} SELECT row_id AS source_row_id, CASE WHEN id NOT IN (SELECT id FROM tgt) THEN 'SKIPPED_NO_TARGET'
    WHEN EXISTS (SELECT 1 FROM tgt t WHERE t.id = src.id AND t.valid_from < src.valid_until AND t.valid_until > src.valid_from) THEN 'APPLIED' ELSE 'ERROR' END AS status FROM src""")
def portion_feedback(spark, sf_dir):
    return merge(spark, sf_dir, "DELETE_FOR_PORTION_OF", persist="settled").feedback.select("source_row_id", "status")


# the same merge over whole numbers, decimals and instants
_DAY = "datediff('day', DATE '1970-01-01', {c})"
for _kind, _spark, _sql in (
    ("int", lambda c: F.unix_date(c), _DAY), ("decimal", lambda c: F.unix_date(c).cast("decimal(12,2)") / F.lit(2).cast("decimal(3,0)"), f"CAST({_DAY} AS DECIMAL(12,2)) / 2"), ("timestamp", lambda c: F.to_timestamp_ntz(F.date_format(c, "yyyy-MM-dd HH:mm:ss")), "CAST({c} AS TIMESTAMP)"),
):
    _shown = {"int": "{x}", "decimal": "CAST({x} AS DOUBLE)", "timestamp": "strftime({x}, '%Y-%m-%d %H:%M:%S')"}[_kind]
    _ends = ", ".join(f"{_shown.format(x=_sql.format(c=c))} AS {c}" for c in VALID)

    def _typed(spark, sf_dir, kind=_kind, of=_spark):
        made = lambda df: df.withColumns({c: of(c) for c in VALID})
        after = temporal_merge(made(merge_target(spark, sf_dir)), made(merge_source(spark, sf_dir)), identity=["id"], mode="MERGE_ENTITY_UPSERT", ephemeral=["note"], persist=False).target_after
        return after.withColumns({c: {"int": F.col(c), "decimal": F.col(c).cast("double"), "timestamp": F.date_format(c, "yyyy-MM-dd HH:mm:ss")}[kind] for c in VALID})

    query(f"merge_{_kind}_periods", f"SELECT id, status, priority, note, {_ends} FROM ({_after_sql('MERGE_ENTITY_UPSERT')})")(_typed)


# ... and where a struct holds the period
for _kind, _of, _ends in (("date", lambda c: F.col(c), ", ".join(f"strftime({c}, '%Y-%m-%d') AS {c}" for c in VALID)), ("int", lambda c: F.unix_date(c), ", ".join(f"{_DAY.format(c=c)} AS {c}" for c in VALID))):

    def _ranged(spark, sf_dir, of=_of):
        packed = lambda df: df.withColumn("period", F.struct(of("valid_from").alias("lower"), of("valid_until").alias("upper"))).drop(*VALID)
        after = temporal_merge(packed(merge_target(spark, sf_dir)), packed(merge_source(spark, sf_dir)), identity=["id"], mode="MERGE_ENTITY_PATCH", ephemeral=["note"], range_column="period", persist=False).target_after
        ends = {c: F.col("period")[k] for c, k in zip(VALID, ("lower", "upper"), strict=True)}
        return after.withColumns({c: F.date_format(e, "yyyy-MM-dd") if dict(after.dtypes)["period"].startswith("struct<lower:date") else e for c, e in ends.items()}).drop("period")

    query(f"merge_{_kind}_range", f"SELECT id, status, priority, note, {_ends} FROM ({_after_sql('MERGE_ENTITY_PATCH')})")(_ranged)


@query("merge_valid_to", f"SELECT id, status, priority, note, valid_from, valid_until, CASE WHEN valid_until = DATE '9999-12-31' THEN valid_until ELSE valid_until - 1 END AS valid_to FROM ({_after_sql('MERGE_ENTITY_PATCH')})", (*VALID, "valid_to"))
def merge_valid_to(spark, sf_dir):
    last = F.when(F.col("valid_until") == F.lit("9999-12-31").cast("date"), F.col("valid_until")).otherwise(F.date_sub("valid_until", 1))
    target, source = merge_target(spark, sf_dir).withColumn("valid_to", last), merge_source(spark, sf_dir).withColumn("valid_to", F.date_sub("valid_until", 1)).drop("valid_until")
    return temporal_merge(target, source, identity=["id"], mode="MERGE_ENTITY_PATCH", ephemeral=["note"], to="valid_to", persist=False).target_after


# founding ids: the events of a user's kind are one new entity, which gets the next number in the order of its first row
@query("founding_ids", """WITH f AS (SELECT user_id * 10 + length(event_type) AS founding, min(event_id) AS first FROM events GROUP BY ALL), n AS (SELECT founding, (SELECT max(c_custkey) FROM customer) + row_number() OVER (ORDER BY first) AS id FROM f)
    SELECT event_id AS row_id, id FROM events JOIN n ON founding = user_id * 10 + length(event_type)""")
def founding_ids(spark, sf_dir):
    target = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit("x").alias("status"), F.lit("2024-01-01").cast("date").alias("valid_from"), F.lit("9999-12-31").cast("date").alias("valid_until"))
    source = _read(spark, sf_dir, "events").select(F.col("event_id").alias("row_id"), (F.col("user_id") * 10 + F.length("event_type")).alias("founding"), F.lit(None).cast("long").alias("id"), F.col("event_type").alias("status"), F.date_add(F.lit("2000-01-01").cast("date"), F.col("event_id").cast("int")).alias("valid_from"), F.date_add(F.lit("2000-01-02").cast("date"), F.col("event_id").cast("int")).alias("valid_until"))
    return temporal_merge(target, source, identity=["id"], founding_id="founding", generated_identity="id", mode="MERGE_ENTITY_UPSERT", persist=False).source_with_identity.select("row_id", "id")


# orders hang together by two keys in turn, ten at a time: each ten is one new entity
@query("linked_natural_keys", """SELECT o_orderkey AS row_id, 1000 + dense_rank() OVER (ORDER BY o_orderkey // 10) AS id FROM orders""")
def linked_natural_keys(spark, sf_dir):
    dates = {"valid_from": F.lit("2024-01-01").cast("date"), "valid_until": F.lit("2025-01-01").cast("date")}
    target = spark.range(1).select(F.lit(1000).cast("long").alias("id"), F.lit("none").alias("pair"), F.lit("none").alias("next_pair"), F.lit(0).cast("long").alias("value")).withColumns(dates)
    k = F.col("o_orderkey")
    source = _read(spark, sf_dir, "orders").select(
        k.alias("row_id"), F.lit(None).cast("long").alias("id"), F.concat(F.lit("a"), F.floor(k / 2)).alias("pair"), F.when((k % 10 != 0) & (k % 10 != 9), F.concat(F.lit("b"), F.floor((k + 1) / 2))).alias("next_pair"), k.alias("value"),
        F.date_add(F.lit("2000-01-01").cast("date"), (k % 1000).cast("int")).alias("valid_from"), F.date_add(F.lit("2000-01-02").cast("date"), (k % 1000).cast("int")).alias("valid_until"))
    return temporal_merge(target, source, identity=["id"], natural_keys=[["pair"], ["next_pair"]], generated_identity="id", mode="MERGE_ENTITY_UPSERT", persist=False).source_with_identity.select("row_id", "id")


# nulls never overwrite a required column, and new rows without it get its default
@query("required_and_defaults", f"""{merge_sql('MERGE_ENTITY_REPLACE')} SELECT id, CASE WHEN origin IS NULL THEN coalesce(status, 'new') ELSE status END AS status, priority, valid_from, valid_until FROM blocks
    UNION ALL SELECT id, status, priority, valid_from, valid_until FROM tgt WHERE id NOT IN (SELECT id FROM src)""".replace("s_status END AS status", "coalesce(s_status, t_status) END AS status").replace("FILTER (WHERE s.row_id IS NOT NULL) AS s_status", "FILTER (WHERE s.status IS NOT NULL) AS s_status"), VALID)
def required_and_defaults(spark, sf_dir):
    held = temporal_merge(merge_target(spark, sf_dir), merge_source(spark, sf_dir), identity=["id"], mode="MERGE_ENTITY_REPLACE", ephemeral=["note"], required=["status"], defaults={"status": "new"}, persist=False)
    return held.target_after.drop("note")


def keyed_merge(spark: SparkSession, sf_dir: str, persist: bool | str = "settled") -> TemporalMerge:
    """Customers found by name and segment or by name and nation, corrected by events under the user's number."""
    customers = _read(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("code"), F.col("c_nationkey").cast("string").alias("status"), F.lit("2024-01-01").cast("date").alias("valid_from"), F.lit("9999-12-31").cast("date").alias("valid_until"))
    events = _read(spark, sf_dir, "events").select(
        F.col("event_id").alias("row_id"), F.lit(None).cast("long").alias("id"), F.format_string("Customer#%09d", "user_id").alias("name"), F.lit(None).cast("string").alias("code"),
        F.col("event_type").alias("status"), F.to_date("ts").alias("valid_from"), F.date_add(F.to_date("ts"), 2).alias("valid_until"))
    return temporal_merge(customers, events, identity=["id"], natural_keys=[["name"]], mode="MERGE_ENTITY_UPSERT", persist=persist)


COVERED = """WITH ev AS (SELECT event_id AS row_id, user_id AS id, event_type AS status, CAST(ts AS DATE) AS f, CAST(ts AS DATE) + 2 AS u FROM events),
    days AS (SELECT *, unnest([f, f + 1]) AS d FROM ev), latest AS (SELECT id, d, max(row_id) AS row_id FROM days GROUP BY id, d)"""


@query("eclipsed_rows", f"{COVERED} SELECT row_id AS source_row_id FROM ev WHERE row_id NOT IN (SELECT row_id FROM latest)")
def eclipsed_rows(spark, sf_dir):
    return keyed_merge(spark, sf_dir, persist=False).feedback.where("status = 'SKIPPED_ECLIPSED'").select("source_row_id")


@query("natural_key_lookup", "SELECT event_id AS row_id, c_custkey AS id FROM events JOIN customer ON c_name = format('Customer#{:09d}', user_id)")
def natural_key_lookup(spark, sf_dir):
    return keyed_merge(spark, sf_dir).source_with_identity.select("row_id", "id")


@query("ambiguous_rows", """SELECT p_partkey AS row_id FROM part WHERE (SELECT count(*) FROM supplier WHERE s_nationkey = p_size OR s_suppkey = p_partkey) > 1""")
def ambiguous_rows(spark, sf_dir):
    dates = {"valid_from": F.lit("2024-01-01").cast("date"), "valid_until": F.lit("2025-01-01").cast("date")}
    suppliers = _read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("number"), F.col("s_name").alias("name")).withColumns(dates)
    parts = _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("row_id"), F.lit(None).cast("long").alias("id"), F.col("p_size").alias("nation"), F.col("p_partkey").alias("number"), F.col("p_name").alias("name")).withColumns(dates)
    found = temporal_merge(suppliers, parts, identity=["id"], natural_keys=[["nation"], ["number"]], persist=False)
    return found.judged.where("_error like 'Source row is ambiguous%'").select(F.col("_rid").alias("row_id"))


# -- system time and views ------------------------------------------------------------------------------------------


def versioned(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders, closed where they were open, without those pending."""
    orders = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    after = orders.where("o_orderstatus <> 'P'").withColumn("o_orderstatus", F.lit("F"))
    return versioning.record_change(versioning.stamp(orders, "2024-01-01 00:00:00"), after, ["o_orderkey"], "2024-02-01 00:00:00")


OLD = "SELECT o_orderkey, o_custkey, o_orderstatus, TIMESTAMP '2024-01-01' AS system_valid_from, TIMESTAMP '2024-02-01' AS system_valid_until FROM orders WHERE o_orderstatus <> 'F'"
NOW = f"""SELECT o_orderkey, o_custkey, 'F' AS o_orderstatus, CASE WHEN o_orderstatus = 'F' THEN TIMESTAMP '2024-01-01' ELSE TIMESTAMP '2024-02-01' END AS system_valid_from, TIMESTAMP '{END}' AS system_valid_until
    FROM orders WHERE o_orderstatus <> 'P'"""
query("history_diff", OLD, SYSTEM)(lambda spark, sf_dir: versioned(spark, sf_dir)[1])
query("history_with_union", f"{OLD} UNION ALL {NOW}", SYSTEM)(lambda spark, sf_dir: versioning.with_history(*versioned(spark, sf_dir)))
query("history_as_of", f"SELECT * FROM ({OLD} UNION ALL {NOW}) WHERE system_valid_from <= TIMESTAMP '2024-02-15' AND TIMESTAMP '2024-02-15' < system_valid_until", SYSTEM)(
    lambda spark, sf_dir: versioning.state_as_of(versioning.with_history(*versioned(spark, sf_dir)), "2024-02-15 00:00:00"))
query("history_between", f"SELECT * FROM ({OLD} UNION ALL {NOW}) WHERE system_valid_from <= TIMESTAMP '2024-02-01' AND system_valid_until > TIMESTAMP '2024-01-15'", SYSTEM)(
    lambda spark, sf_dir: versioning.states_between(versioning.with_history(*versioned(spark, sf_dir)), "2024-1-15", "2024-02-01 00:00:00"))
query("history_between_symmetric", f"SELECT * FROM ({OLD} UNION ALL {NOW}) WHERE system_valid_from <= TIMESTAMP '2024-03-01' AND system_valid_until > TIMESTAMP '2024-02-01'", SYSTEM)(
    lambda spark, sf_dir: versioning.states_between_symmetric(versioning.with_history(*versioned(spark, sf_dir)), "2024-03-01 00:00:00", "2024-02-01 00:00:00"))


@query("history_excluded_columns", "SELECT o_orderkey, o_custkey, o_orderstatus, TIMESTAMP '2024-01-01' AS system_valid_from, TIMESTAMP '2024-02-01' AS system_valid_until FROM orders WHERE o_orderkey % 3 = 0", SYSTEM)
def history_excluded_columns(spark, sf_dir):
    orders = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    after = orders.withColumns({"o_custkey": F.when(F.col("o_orderkey") % 2 == 0, F.lit(-1)).otherwise(F.col("o_custkey")), "o_orderstatus": F.when(F.col("o_orderkey") % 3 == 0, "X").otherwise(F.col("o_orderstatus"))})
    return versioning.record_change(versioning.stamp(orders, "2024-01-01 00:00:00"), after, ["o_orderkey"], "2024-02-01 00:00:00", excluded=("o_custkey",))[1]

query("history_from_to", f"SELECT * FROM ({OLD} UNION ALL {NOW}) WHERE system_valid_from < TIMESTAMP '2024-02-01' AND system_valid_until > TIMESTAMP '2024-01-15'", SYSTEM)(
    lambda spark, sf_dir: versioning.states_from_to(versioning.with_history(*versioned(spark, sf_dir)), "2024-01-15 00:00:00", "2024-02-01 00:00:00"))

query("current_view", f"SELECT * FROM ({STATES}) WHERE valid_from <= TIMESTAMP '{LATER}' AND TIMESTAMP '{LATER}' < valid_until", VALID)(
    lambda spark, sf_dir: views.current_rows(events_states(spark, sf_dir), _time(LATER)))
OPEN = f"event_type = 'click' AND valid_until = TIMESTAMP '{END}'"
NOW_AT = "2024-03-01 00:00:00"


@query("scd2_update", f"""SELECT * FROM ({STATES}) WHERE NOT ({OPEN}) UNION ALL SELECT user_id, event_type, valid_from, TIMESTAMP '{NOW_AT}' FROM ({STATES}) WHERE {OPEN}
    UNION ALL SELECT user_id, 'idle', TIMESTAMP '{NOW_AT}', valid_until FROM ({STATES}) WHERE {OPEN}""", VALID)
def scd2_update(spark, sf_dir):
    return views.current_update(events_states(spark, sf_dir), {"event_type": "idle"}, F.col("event_type") == "click", _time(NOW_AT))


@query("soft_delete", f"SELECT * FROM ({STATES}) WHERE NOT ({OPEN}) UNION ALL SELECT user_id, event_type, valid_from, TIMESTAMP '{NOW_AT}' FROM ({STATES}) WHERE {OPEN}", VALID)
def soft_delete(spark, sf_dir):
    return views.current_delete(events_states(spark, sf_dir), F.col("event_type") == "click", _time(NOW_AT))


@query("soft_delete_with_values", f"SELECT * FROM ({STATES}) WHERE NOT ({OPEN}) UNION ALL SELECT user_id, 'closed', valid_from, TIMESTAMP '{NOW_AT}' FROM ({STATES}) WHERE {OPEN}", VALID)
def soft_delete_with_values(spark, sf_dir):
    return views.current_end(events_states(spark, sf_dir), F.col("event_type") == "click", _time(NOW_AT), {"event_type": "closed"})


@query("current_insert", f"SELECT * FROM ({TARGET}) UNION ALL SELECT 5000000 + s_suppkey, 'S', s_name, NULL, DATE '2024-03-01', DATE '9999-12-31' FROM supplier", VALID)
def current_insert(spark, sf_dir):
    new = _read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("row_id"), (F.col("s_suppkey") + 5000000).alias("id"), F.lit("S").alias("status"), F.col("s_name").alias("priority"), F.lit(None).cast("string").alias("note"))
    return views.current_insert(merge_target(spark, sf_dir), new, ["id"], "2024-03-01", persist=False).target_after


_IN = "status = 'O' AND valid_from < DATE '1999-01-01' AND valid_until > DATE '1997-01-01'"


@query("for_portion_of_view", f"""WITH raw AS (SELECT * FROM ({TARGET}) WHERE NOT ({_IN})
    UNION ALL SELECT id, status, priority, note, valid_from, DATE '1997-01-01' FROM ({TARGET}) WHERE {_IN} AND valid_from < DATE '1997-01-01'
    UNION ALL SELECT id, status, 'HELD', note, greatest(valid_from, DATE '1997-01-01'), least(valid_until, DATE '1999-01-01') FROM ({TARGET}) WHERE {_IN}
    UNION ALL SELECT id, status, priority, note, DATE '1999-01-01', valid_until FROM ({TARGET}) WHERE {_IN} AND valid_until > DATE '1999-01-01'),
    touched AS (SELECT DISTINCT id FROM ({TARGET}) WHERE {_IN}),
    mar AS (SELECT *, CASE WHEN lag(valid_until) OVER w = valid_from AND lag(status) OVER w IS NOT DISTINCT FROM status AND lag(priority) OVER w IS NOT DISTINCT FROM priority AND lag(note) OVER w IS NOT DISTINCT FROM note THEN 0 ELSE 1 END AS fresh
        FROM raw WINDOW w AS (PARTITION BY id ORDER BY valid_from)),
    blk AS (SELECT *, sum(fresh) OVER (PARTITION BY id ORDER BY valid_from) AS block FROM mar)
    SELECT id, any_value(status) AS status, any_value(priority) AS priority, any_value(note) AS note, min(valid_from) AS valid_from, max(valid_until) AS valid_until FROM blk GROUP BY id, block""", VALID)
def for_portion_of_view(spark, sf_dir):
    return views.update_portion(merge_target(spark, sf_dir), ["id"], {"priority": "HELD"}, "1997-01-01", "1999-01-01", F.col("status") == "O").target_after
