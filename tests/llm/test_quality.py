import math
import zlib

import numpy as np
import pytest
from tests.llm.helpers import docs, prose

from tidemark.llm.common import table
from tidemark.llm.quality import FEATURES, Trees, fit, keep_quality, quality_score, statistics, train
from tidemark.llm.registry import op5_quality_classifier


def test_held_out_accuracy(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.01")
    labels = {r["doc_id"]: r["quality"] for r in table(spark, sf, "labels").collect()}
    rows = op5_quality_classifier(spark, sf).collect()
    assert len(rows) == table(spark, sf, "documents").count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    held = [(r["score"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    good, bad = [s for s, y in held if y], [s for s, y in held if not y]
    assert np.mean([a > b for a in good for b in bad]) > 0.97


def test_trees_match_a_walk():
    r = np.random.default_rng(0)
    x = r.normal(size=(500, len(FEATURES)))
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    trees = fit(x, y, trees=20, depth=3)

    def walk(row):
        odds = trees.base
        for t in range(len(trees.leaf)):
            node = 0
            for _ in range(3):
                node = 2 * node + 1 + (row[trees.feature[t, node]] > trees.threshold[t, node])
            odds += trees.leaf[t, node - 7]
        return 1 / (1 + np.exp(-odds))

    np.testing.assert_allclose(trees.score(x), [walk(v) for v in x])
    assert np.mean((trees.score(x) > 0.5) == y) > 0.95


def test_query_against_a_plain_walk(spark, sf_dir):
    """Every document's score by the trees that the query trains, node by node."""
    docs_, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").collect()
    learned = {r["doc_id"] for r in labels if zlib.crc32(str(r["doc_id"]).encode()) % 5}
    trees = train(docs_, spark.createDataFrame([r for r in labels if r["doc_id"] in learned], "doc_id long, quality int, toxic int"))
    texts = {r["doc_id"]: r["text"] for r in docs_.collect()}
    for r in op5_quality_classifier(spark, sf_dir).collect():
        x, odds = statistics(texts[r["doc_id"]]), trees.base
        for feature, threshold, leaf in zip(trees.feature, trees.threshold, trees.leaf, strict=True):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if x[feature[node]] > threshold[node] else 1)
            odds += leaf[node - len(feature)]
        assert abs(r["score"] - 1 / (1 + math.exp(-odds))) < 1e-9


@pytest.mark.parametrize("text", [None, "", " \n", "a", "é" * 10_000, "word " * 50_000, "|||| ###"])
def test_statistics_of_odd_texts(text):
    assert len(statistics(text)) == len(FEATURES) and np.isfinite(statistics(text)).all()


def test_edges(spark):
    rows = [(i, prose(i) if i % 2 else "### *** " * 40) for i in range(40)] + [(None, None), (3, prose(3)), (50, "")]
    df = docs(spark, rows, extra=True)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(None, 1, 0), (1, None, 0), (999, 1, 0)], "doc_id long, quality int, toxic int")
    trees = train(df, labels)
    scored = df.select("doc_id", quality_score(trees, df["text"], df).alias("s")).collect()
    assert len(scored) == len(rows) and all(0 <= r["s"] <= 1 for r in scored)
    assert {r["doc_id"] for r in keep_quality(df, labels).collect()} >= set(range(1, 40, 2))
    none = train(df, labels.limit(0))
    assert isinstance(none, Trees) and none.score(np.zeros((2, len(FEATURES)))).tolist() == [0.5, 0.5]
    assert keep_quality(docs(spark, []), labels).count() == 0
