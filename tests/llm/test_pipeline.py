"""Each stage against brute force on its own input, as no SQL can express the whole."""

from collections import defaultdict

import corpus_pipeline
from tests.llm.helpers import docs, prose
from tests.llm.test_line_dedup import brute as brute_lines
from tests.llm.test_mixing import brute_targets

from tidemark.llm.common import stored, table
from tidemark.llm.decontaminate import normal

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near_pairs(rows, least):
    held, sets = defaultdict(list), {i: shingles(t) for i, t in rows}
    for i, s in sets.items():
        for g in s:
            held[g].append(i)
    shared = defaultdict(int)
    for ids in held.values():
        for k, a in enumerate(ids):
            for b in ids[:k]:
                shared[b, a] += 1
    return {p for p, n in shared.items() if n / len(sets[p[0]] | sets[p[1]]) >= least}


def test_stages_do_their_part(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.01")
    labels = {r["doc_id"]: r["quality"] for r in table(spark, sf, "labels").collect()}
    now = table(spark, sf, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "line dedup", "near dedup", "decontamination", "mixing"]
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in now.collect()}
        now = stored(stage(spark, now, sf))
        after = {r["doc_id"]: r for r in now.collect()}
        gone = set(before) - set(after)
        assert now.columns[:5] == COLUMNS and set(after) <= set(before)
        if name == "quality classifier":
            bad = {i for i in before if labels.get(i) == 0}
            good = {i for i in before if labels.get(i) == 1}
            assert len(gone & bad) >= 0.95 * len(bad) and len(gone & good) <= 0.02 * len(good)
        elif name == "line dedup":
            want = brute_lines([(i, r["text"]) for i, r in before.items()])
            assert {i: r["text"] for i, r in after.items()} == {i: w[2] for i, w in want.items()}
            assert all(r["n_chars"] == len(r["text"]) for r in after.values())
        elif name == "near dedup":
            rows = [(i, r["text"]) for i, r in before.items()]
            close = near_pairs(rows, 0.8)
            blank = sorted(i for i, t in rows if not (t or "").split())
            close |= {(blank[0], i) for i in blank[1:]}
            assert gone <= {i for p in close for i in p}  # nothing goes that has no partner at 0.8
            assert sum(a in after and b in after for a, b in close) <= 0.01 * len(close)
            assert not set(blank[1:]) & set(after)
        elif name == "decontamination":
            items = [normal(r["text"]) for r in table(spark, sf, "benchmark").collect()]
            assert gone == {i for i, r in before.items() if any(x in normal(r["text"]) for x in items)}
        else:
            assert now.columns == [*COLUMNS, "size", "copies", "taken"]
            sizes = defaultdict(int)
            for r in before.values():
                sizes[r["source"]] += len(r["text"].encode().split())
            want, taken = brute_targets(dict(sizes)), defaultdict(int)
            for r in after.values():
                assert r["copies"] in (1, 2, 3) and r["taken"] == r["copies"] * r["size"]
                taken[r["source"]] += r["taken"]
            assert all(abs(taken[s] - t) <= 0.03 * t + 40 for s, t in want.items())


def test_empty_table_and_odd_rows(spark, tmp_path):
    def write(rows):
        path = f"{tmp_path}/{len(rows)}"
        docs(spark, rows).write.parquet(f"{path}/documents.parquet")
        spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
        spark.createDataFrame([(1, prose(77, 30))], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
        return path

    assert corpus_pipeline.run(spark, write([])).count() == 0
    rows = [(1, prose(1)), (2, None), (2, ""), (3, prose(1)), (4, prose(4) + " " + prose(77, 30)), (None, prose(5)), (6, "w " * 20_000)]
    ids = {r["doc_id"] for r in corpus_pipeline.run(spark, write(rows)).collect()}
    assert 3 not in ids and 4 not in ids


def test_of_copies_emptied_by_lines_one_is_left(spark, tmp_path):
    text = "\n".join(prose(k, 20) for k in range(8))
    spark.createDataFrame([(1, prose(77, 30))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = docs(spark, [(i, text) for i in range(10, 17)] + [(i, prose(i)) for i in range(3)])
    for _, stage in corpus_pipeline.STAGES[1:]:
        now = stored(stage(spark, now, str(tmp_path)))
    assert sorted(r["doc_id"] for r in now.collect() if not r["text"]) == [10]
