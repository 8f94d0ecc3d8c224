import hashlib
from collections import defaultdict

import duckdb
from tests.llm.helpers import docs

from tidemark.llm.common import table
from tidemark.llm.line_dedup import LineRuns, _sorted_scans, dedup_lines, line_keys
from tidemark.llm.registry import op1_line_dedup, oracle_sql

SPACE = " \t\n\x0b\x0c\r"
LONG = "this line is long enough to count as boilerplate"


def brute(rows, min_docs=5, min_chars=40):
    def key(line):
        return line.strip(SPACE).translate({i: i + 32 for i in range(65, 91)})

    held = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            held[key(line)].add(i)
    out = {}
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= min_chars and len(held[key(x)]) >= min_docs and max(held[key(x)]) != i)]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def test_query_matches_brute_force(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, sf_dir, "documents").collect()]
    want = {i: (n, d, hashlib.sha256(t.encode()).hexdigest()) for i, (n, d, t) in brute(rows).items()}
    assert {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in op1_line_dedup(spark, sf_dir).collect()} == want


def test_edges(spark):
    rows = [(i, f"{LONG}\nunique {i}\n  {LONG.upper()}\t") for i in range(6)]
    rows += [(10, None), (11, ""), (12, "\n\n"), (13, "é" * 40), (14, "É" * 40), (15, "\n".join([LONG] * 3)), (16, "x" * 300_000 + "\n" + LONG)]
    found = dedup_lines(docs(spark, rows, extra=True), batches=3)
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["text"]) for r in found.collect()}
    assert got == brute(rows)
    assert got[16][1] == 0 and got[15] == (3, 3, "") and got[0] == (3, 2, "unique 0")
    assert set(docs(spark, rows, extra=True).columns) <= set(found.columns)


def test_repeated_ids_and_nulls_are_those_of_the_statement(spark, tmp_path):
    rows = [(1, LONG)] * 3 + [(2, LONG), (3, LONG), (None, LONG), (None, None), (4, LONG + "\n" + LONG), (4, "other\n" + LONG), (5, "x\n" + LONG), (7, LONG + " twice"), (7, LONG + " twice")]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in op1_line_dedup(spark, str(tmp_path)).collect()), key=str)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(db.execute(oracle_sql()["op1_line_dedup"]).fetchall(), key=str)
    assert [r[2] for r in got if r[0] == 3] == [1] and [r[2] for r in got if r[0] is None] == [0, 0] and [r[2] for r in got if r[0] == 7] == [0, 0]
    fewer = [r for r in rows if r[0] not in (4, 5)]  # three ids, five rows
    assert all(r["n_dropped"] == 0 for r in dedup_lines(docs(spark, fewer)).collect())
    assert dedup_lines(docs(spark, [])).count() == 0


def _nodes(df):
    def walk(plan):
        children = plan.children()
        return [plan.nodeName(), *(x for i in range(children.size()) for x in walk(children.apply(i)))]

    return walk(df._jdf.queryExecution().executedPlan().initialPlan())


def test_runs_are_compacted_and_anti_joined(spark):
    runs = LineRuns(spark, fanout=2)
    for k in range(4):
        batch = line_keys(docs(spark, [(9 - k, LONG + "\n" + LONG + str(k))]))
        assert runs.fresh(batch).count() == (2 if k == 0 else 1)
        assert runs.marked(batch).where("keeper is not null").count() == (2 if k == 0 else 1)
        runs.add(batch)
    assert [len(level) for level in runs.levels] == [0, 0, 1]
    entries = sorted((r["n_docs"], r["keeper"]) for r in runs.entries().collect())
    assert entries == [(1, 6), (1, 7), (1, 8), (1, 9), (4, 9)]
    runs.release()
    assert runs.entries().count() == 5 and not [t for t in spark.catalog.listTables() if t.name.startswith("lines_")]


def test_no_run_is_shuffled_or_sorted_again(spark):
    runs = LineRuns(spark)
    batch = line_keys(docs(spark, [(i, f"{LONG} {i % 50}") for i in range(400)]))
    runs.add(batch.where("doc >= 200"))
    with _sorted_scans(spark):
        added, table = _nodes(runs.marked(batch.where("doc < 200"))), spark.table(runs._runs()[0][0])
        merged = _nodes(runs._merged(table, table))
    join = added.index("SortMergeJoin")  # the batch is its first child, the run its second, which comes last
    assert added.count("SortMergeJoin") == 1 and added[:join].count("Exchange") == 0 and added.count("Exchange") == 2
    run = added[len(added) - 1 - added[::-1].index("Exchange") :]
    assert added[-1].startswith("Scan parquet") and "lines_" in added[-1] and "Sort" not in run[2:]
    assert "SortMergeJoin" in merged and not {"Exchange", "Sort"} & set(merged)
    runs.release()
