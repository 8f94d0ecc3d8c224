"""Quality classifier: histogram gradient-boosted trees over document statistics.

The trees are grown on binned statistics of a bounded sample of labelled rows. Each tree is complete to its depth and lies
in flat arrays (feature, threshold, leaf value), so scoring is a numpy traversal of all trees for a batch of documents.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import columns_apart

#: Labelled rows that a model is fitted on at most.
SAMPLE_ROWS = 20_000
FEATURES = (
    "log_chars", "log_words", "word_chars", "upper_share", "digit_share", "symbol_share", "odd_symbol_share", "symbol_end_share", "symbol_word_share",
    "distinct_share", "commonest_share", "repeat_share", "distinct_line_share", "line_words", "long_word_share", "space_share", "entropy", "rare_letter_share",
)
PROSE = frozenset(".,;:'\"-()?")


def statistics(text: str | None) -> list[float]:
    """The FEATURES of a text; all zero for a null text or one without words."""
    text = text or ""
    words = text.split()
    if not words:
        return [0.0] * len(FEATURES)
    n, chars = len(words), len(text)
    letters = sum(map(len, words))
    by_char = Counter(text)
    upper = sum(v for c, v in by_char.items() if c.isupper())
    lower = sum(v for c, v in by_char.items() if c.islower())
    digits = sum(v for c, v in by_char.items() if c.isdigit())
    symbols = sum(v for c, v in by_char.items() if not c.isalnum() and not c.isspace())
    prose = sum(v for c, v in by_char.items() if c in PROSE)
    counts = Counter(words)
    lines = text.split("\n")
    ends = sum(1 for w in words if not w[-1].isalnum() and w[-1] not in PROSE)
    alone = sum(v for w, v in counts.items() if len(w) <= 3 and not any(c.isalnum() for c in w))
    entropy = -sum(v / n * math.log(v / n) for v in counts.values())
    return [
        math.log1p(chars), math.log1p(n), letters / n, upper / max(1, upper + lower), digits / chars, symbols / chars, (symbols - prose) / chars, ends / n, alone / n,
        len(counts) / n, max(counts.values()) / n, sum(a == b for a, b in zip(words, words[1:], strict=False)) / n, len(set(lines)) / len(lines), n / len(lines), sum(v for w, v in counts.items() if len(w) > 14) / n,
        (chars - letters) / chars, entropy / math.log(n + 1), sum(v for c, v in by_char.items() if ord(c) > 0x24F) / chars,
    ]


@dataclass(frozen=True)
class Trees:
    """base + the sum over trees is the log odds. feature, threshold: trees by inner nodes; leaf: trees by leaves; the
    children of node k are 2k + 1 and 2k + 2, the second for values above the threshold."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        trees, inner = self.feature.shape
        odds = np.full(len(x), self.base)
        row = np.arange(len(x))
        for t in range(trees):
            node = np.zeros(len(x), np.int64)
            for _ in range((inner + 1).bit_length() - 1):
                node = 2 * node + 1 + (x[row, self.feature[t, node]] > self.threshold[t, node])
            odds += self.leaf[t, node - inner]
        return 1 / (1 + np.exp(-odds))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 2.0, least_weight: float = 1.0) -> Trees:
    """Boost log loss; y is 0 or 1. Rows of one class, or none, give their share as a constant score."""
    inner, leaves = 2**depth - 1, 2**depth
    share = (y.sum() + 1) / (len(y) + 2)
    base = math.log(share / (1 - share))
    if len(np.unique(y)) < 2:
        return Trees(base, np.zeros((1, inner), np.int64), np.full((1, inner), np.inf), np.zeros((1, leaves)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1)  # bin b: values up to edge b
    feature, threshold, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    odds = np.full(len(y), base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-odds))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            local = node - first
            best = np.zeros(width)
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                size = len(e) + 1
                at = local * size + binned[:, f]
                gs = np.bincount(at, g, width * size).reshape(width, size).cumsum(1)
                hs = np.bincount(at, h, width * size).reshape(width, size).cumsum(1)
                gl, hl, ga, ha = gs[:, :-1], hs[:, :-1], gs[:, -1:], hs[:, -1:]
                gain = gl**2 / (hl + ridge) + (ga - gl) ** 2 / (ha - hl + ridge) - ga**2 / (ha + ridge)
                gain[(hl < least_weight) | (ha - hl < least_weight)] = 0
                at_best = gain.argmax(1)
                found = gain[np.arange(width), at_best]
                better = found > best + 1e-9
                best[better] = found[better]
                feature[t, first : first + width][better] = f
                threshold[t, first : first + width][better] = e[at_best[better]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[t, node]] > threshold[t, node])
        end = node - inner
        leaf[t] = -rate * np.bincount(end, g, leaves) / (np.bincount(end, h, leaves) + ridge)
        odds += leaf[t, end]
    return Trees(base, feature, threshold, leaf)


def _statistics(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield batch[["doc", "label"]].assign(x=[statistics(t) for t in batch["text"]])


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Trees:
    """Fit on the labelled documents: the sample_rows of them that come first by a hash of the id, all if there are fewer.

    Rows without an id, a label or a document don't count. Only the sample's ids are broadcast and only its statistics
    reach the driver. Reruns give the same trees: of equal gains the first feature and the lowest threshold count. An id that
    repeats in either table counts once for each pair of its rows. Without labelled documents every score is 0.5.
    """
    marked = columns_apart(labels, id_col, label_col).toDF("doc", "label").select(F.col("doc").cast("long"), F.col("label").cast("int")).where("doc is not null and label is not null")
    chosen = marked.orderBy(F.xxhash64("doc"), "doc", "label").limit(sample_rows)
    rows = columns_apart(docs, id_col, text_col).toDF("doc", "text").withColumn("doc", F.col("doc").cast("long"))
    sample = rows.join(F.broadcast(chosen), "doc").mapInPandas(_statistics, "doc long, label int, x array<double>")
    sample = sample.orderBy(F.xxhash64("doc"), "doc", "label", "x").limit(sample_rows).toPandas()
    x = np.array(sample["x"].tolist(), dtype=np.float64).reshape(-1, len(FEATURES))
    return fit(x, sample["label"].to_numpy(np.float64))


def quality_score(trees: Trees, text: Column, docs: DataFrame) -> Column:
    """The score, 0 to 1, of a text column of docs; a null or empty text is scored by its statistics like any other, and a text
    of any length by those of the whole."""
    model = docs.sparkSession.sparkContext.broadcast(trees)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(model.value.score(np.array([statistics(t) for t in batch], dtype=np.float64).reshape(-1, len(FEATURES))))

    return score(text)


def keep_quality(docs: DataFrame, labels: DataFrame, least: float = 0.3, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with a score of `least` or more, under a model fitted on those of them that have labels. Their columns."""
    trees = train(docs, labels, sample_rows, id_col, text_col)
    return docs.where(quality_score(trees, F.col(f"`{text_col}`"), docs) >= least)
