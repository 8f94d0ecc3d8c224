import numpy as np
import pytest
from tests.llm.helpers import docs, prose

from tidemark.llm.common import table
from tidemark.llm.mixing import attach_copies, mix_sources, sized, tilts
from tidemark.llm.registry import op3_mixing_sources

WEIGHTS = (5, 2, 1)


def brute_targets(sizes):
    """Targets by source (None last), by filling up from the level at which none is over its limit."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: WEIGHTS[i % 3] for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in full)
        free = [s for s in order if s not in full]
        level = rest / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if weight[s] * level > 3 * sizes[s] + 1e-9}
        if not over:
            return {s: 3 * sizes[s] if s in full else weight[s] * level for s in order}
        full |= over


def check(rows, tolerance):
    sizes = {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
    want = brute_targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and 0 <= r["taken"] <= 3 * r["size"]
        np.testing.assert_allclose(r["target"], want[r["source"]], rtol=1e-9)
        taken[r["source"]] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= tolerance * max(1, want[s]) + 40, s


def test_query_meets_targets_and_repeats(spark, sf_dir):
    rows = op3_mixing_sources(spark, sf_dir).collect()
    texts = {r["doc_id"]: r["text"] for r in table(spark, sf_dir, "documents").collect()}
    assert {r["doc_id"]: r["size"] for r in rows} == {i: len((t or "").encode().split()) for i, t in texts.items()}
    check(rows, 0.02)
    assert sorted((r["doc_id"], r["taken"]) for r in rows) == sorted((r["doc_id"], r["taken"]) for r in op3_mixing_sources(spark, sf_dir).collect())


def test_rates_against_a_plain_solution(spark, sf_dir):
    """The rate of every document, each source's tilt being found by bisection."""
    own = {}
    for r in op3_mixing_sources(spark, sf_dir).collect():
        own.setdefault(r["source"], []).append(r)
    for rows in own.values():
        sizes = np.array([r["size"] for r in rows], float)
        mean, target, low, high = sizes[sizes > 0].mean(), rows[0]["target"], -1e4, 1e4
        for _ in range(200):
            tilt = (low + high) / 2
            with np.errstate(over="ignore"):
                rates = np.minimum(3, np.exp(tilt * sizes / mean))
            low, high = (tilt, high) if (sizes * rates).sum() < target else (low, tilt)
        np.testing.assert_allclose([r["rate"] for r in rows if r["size"]], rates[sizes > 0], rtol=1e-4)


def test_no_silent_failure_to_converge(spark):
    rows = [(i, prose(i, 5 + i % 90), "en", f"s{i % 2}") for i in range(60)]
    units = sized(docs(spark, rows)).groupBy("source", "size").count().withColumnRenamed("count", "n")
    sources = units.selectExpr("source", "size * n as t").groupBy("source").agg({"t": "sum"}).withColumnRenamed("sum(t)", "source_size").selectExpr("*", "source_size * if(source = 's0', 1.5, 0.5) as target")
    with pytest.raises(RuntimeError, match="did not settle in 1 steps"):
        tilts(units, sources, max_steps=1)


def test_capped_and_null_sources(spark):
    rows = [(i, prose(i, 5 + i % 90), "en", "tiny" if i < 4 else None if i < 60 else f"z{i % 5}") for i in range(400)]
    mixed = mix_sources(docs(spark, rows, extra=True)).collect()
    check([r.asDict() | {"taken": r["copies"] * r["size"]} for r in mixed], 0.03)


def test_edges(spark):
    rows = [(1, "a b c", "en", "x")] * 3 + [(2, None, "en", "x"), (3, "", "en", "y"), (None, "d e", "en", "x"), (4, "w " * 50_000, "en", None)]
    df = docs(spark, rows, extra=True)
    mixed = mix_sources(df)
    got = attach_copies(df, mixed)
    assert got.count() == len(rows)
    assert len({r["copies"] for r in got.where("doc_id = 1").collect()}) == 1
    assert [r["taken"] for r in got.where("doc_id in (2, 3)").collect()] == [0, 0]
    assert mix_sources(docs(spark, [])).count() == 0
    only_empty = mix_sources(docs(spark, [(1, None), (2, "")])).collect()
    assert [(r["size"], r["target"]) for r in only_empty] == [(0, 0.0)] * 2
