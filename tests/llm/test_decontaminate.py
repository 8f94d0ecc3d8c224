import random

from tests.llm.helpers import docs, prose

from tidemark.llm.common import table
from tidemark.llm.decontaminate import Matcher, budget, chosen_pieces, contaminated, drop_contaminated, myers, normal, pattern_bits, pieces
from tidemark.llm.registry import op9_benchmark_decontamination


def distance_within(item, text):
    """Smallest edit distance of the item to any stretch of text, by the plain table."""
    row = list(range(len(item) + 1))
    best = row[-1]
    for c in text:
        prev, row[0] = row[0], 0
        for i, x in enumerate(item, 1):
            prev, row[i] = row[i], min(row[i] + 1, row[i - 1] + 1, prev + (x != c))
        best = min(best, row[-1])
    return best


def test_myers_matches_the_table():
    r = random.Random(0)
    for _ in range(300):
        item = "".join(r.choice("abc ") for _ in range(r.randint(1, 80)))
        text = "".join(r.choice("abc ") for _ in range(r.randint(0, 60))) + item[r.randint(0, len(item)) :]
        want = distance_within(item, text)
        got, _ = myers(pattern_bits(item), len(item), text, len(item))
        assert got == want


def test_matcher_finds_all_within_budget():
    r = random.Random(1)
    items = [(i, normal(prose(100 + i, 20))) for i in range(8)]
    matcher = Matcher(items, 0.08)
    for k in range(120):
        item_id, item = r.choice(items)
        chars = list(item)
        for _ in range(r.randint(0, budget(len(item), 0.08) + 3)):
            at = r.randrange(len(chars))
            chars[at : at + 1] = r.choice(([], ["q"], [chars[at], "q"]))
        text = prose(k, 60) + " " + "".join(chars) + " " + prose(k + 500, 60)
        got = {(h[0], h[1]) for h in matcher.find(text)}
        want = {(i, d) for i, x in items if (d := distance_within(x, normal(text))) <= budget(len(x), 0.08)}
        assert got == want
    assert [p for _, p in pieces("abcdefgh", 2)] == ["ab", "cde", "fgh"]


def test_items_of_one_template_are_cut_into_rarer_pieces():
    r = random.Random(2)
    items = [(i, normal("which of the following statements is right: " + prose(300 + i, 12))) for i in range(40)]
    budgets = [(x, budget(len(x), 0.05)) for _, x in items]
    chosen = chosen_pieces(budgets)
    assert not any("which of the" in p for own in chosen for _, p in own) and all(own for own in chosen)
    matcher = Matcher(items, 0.05)
    for k in range(60):
        item = list(r.choice(items)[1])
        for _ in range(r.randint(0, budget(len(item), 0.05) + 2)):
            at = r.randrange(len(item))
            item[at : at + 1] = r.choice(([], ["q"], [item[at], "q"]))
        text = prose(k, 20) + " " + "".join(item) + " which of the following statements is right: " + prose(k + 500, 20)
        want = {(i, d) for i, x in items if (d := distance_within(x, normal(text))) <= budget(len(x), 0.05)}
        assert {(h[0], h[1]) for h in matcher.find(text)} == want


def test_no_pair_of_the_tables_is_missed(spark, sf_dir):
    """Every document against every item, by Myers' distance over the whole text."""
    items = {r["item_id"]: normal(r["text"]) for r in table(spark, sf_dir, "benchmark").collect()}
    texts = {r["doc_id"]: normal(r["text"] or "") for r in table(spark, sf_dir, "documents").collect()}
    texts = {d: t for d, t in texts.items() if len(t) < 6000}
    bits = {i: pattern_bits(x) for i, x in items.items()}
    want = {(d, i) for d, t in texts.items() for i, x in items.items() if myers(bits[i], len(x), t, budget(len(x), 0.08))[0] <= budget(len(x), 0.08)}
    assert want == {(r["doc_id"], r["item_id"]) for r in op9_benchmark_decontamination(spark, sf_dir).collect() if r["doc_id"] in texts}


def test_query_finds_the_planted_passages(spark, sf_dir):
    items = {r["item_id"]: normal(r["text"]) for r in table(spark, sf_dir, "benchmark").collect()}
    texts = {r["doc_id"]: normal(r["text"] or "") for r in table(spark, sf_dir, "documents").collect()}
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in op9_benchmark_decontamination(spark, sf_dir).collect()}
    exact = {(d, i) for d, t in texts.items() for i, x in items.items() if x in t}
    assert exact and exact == {k for k, v in got.items() if v == 0}
    for (d, i), v in got.items():
        assert v == distance_within(items[i], texts[d])


def test_edges(spark, monkeypatch):
    item = "a benchmark question that nobody should train on, twice"
    rows = [(1, None), (2, ""), (3, "x " * 60_000 + item.upper().replace(" ", "\n")), (4, item), (4, item), (None, item), (5, "cleaner text"), (6, "a Short  one!"), (7, "short ones")]
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "short one"), (1, item), (5, prose(3, 30)), (None, "clean")], "item_id long, text string").selectExpr("*", "1 as doc_id", "2 as end")
    df = docs(spark, rows, extra=True)
    got = sorted(((r["doc_id"], r["item_id"], r["distance"]) for r in contaminated(df, bench).collect()), key=str)
    assert got == sorted([(3, 1, 0), (4, 1, 0), (4, 1, 0), (None, 1, 0), (6, 4, 0)], key=str)
    odd = contaminated(docs(spark, [(8, "all clean here")]), bench).collect()
    assert [(r["doc_id"], r["item_id"], r["distance"], r["end"]) for r in odd] == [(8, None, 0, 9)]
    kept = drop_contaminated(df, bench)
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 5, 7] and kept.columns == df.columns
    assert contaminated(docs(spark, []), bench).count() == 0 and contaminated(df, bench.limit(0)).count() == 0
    from tidemark.llm import decontaminate

    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 60)
    assert sorted(((r["doc_id"], r["item_id"], r["distance"]) for r in contaminated(df, bench).distinct().collect()), key=str) == sorted({*got}, key=str)
