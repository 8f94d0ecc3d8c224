import hashlib
import math
import random
import struct
from collections import Counter

import xxhash
from tests.llm.helpers import docs, prose

from tidemark.llm.common import table
from tidemark.llm.imatch import FAMILIES, IDF_BAND, LEVELS, fingerprint_with_edits, with_next
from tidemark.llm.imatch import lexicon as lexicon_of
from tidemark.llm.registry import op7_document_fingerprints


def changed(texts):
    out = []
    for i, x in enumerate(texts):
        k = len(x) // 4
        out.append(x[: len(x) - k] + texts[(i + 1) % len(texts)][:k])
    return out


def test_query_edits_and_likeness(spark, sf_dir):
    want = sorted((r["doc_id"], r["text"] or "") for r in table(spark, sf_dir, "documents").collect())
    rows = sorted(op7_document_fingerprints(spark, sf_dir).collect(), key=lambda r: r["doc_id"])
    texts = [t for _, t in want]
    assert [(r["doc_id"], r["n_chars"]) for r in rows] == [(i, len(t)) for i, t in want]
    assert [r["edited_sha256"] for r in rows] == [hashlib.sha256(e.encode()).hexdigest() for e in changed(texts)]
    by_text = {}
    for r, t in zip(rows, texts, strict=True):
        assert by_text.setdefault(t, r["fingerprint"]) == r["fingerprint"]
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    # likeness of a text with itself is 1, so equal neighbours must have it
    for i, r in enumerate(rows):
        if texts[i] == texts[(i + 1) % len(texts)]:
            assert r["near_next"] == 1
    assert sum(r["near_edited"] for r in rows) / len(rows) > 0.4 > 0.05 > sum(r["near_next"] for r in rows) / len(rows)


def xx(values):
    """Spark's xxhash64 of an array of longs, unsigned."""
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(struct.pack("<q", v), h)
    return h


def signed(h):
    return h - 2**64 if h >> 63 else h


def words(text):
    w = (text or "").lower().encode().split()
    return sorted({signed(xxhash.xxh64_intdigest(x, 42)) for x in w})


def brute_print(text, lexicon):
    own = [t for t in words(text) if t in lexicon]
    again = [signed(xx([t])) for t in own]
    subsets = []
    for level in range(1, LEVELS + 1):
        for k in range(FAMILIES):
            mask = ((1 << level) - 1) << (LEVELS * (k % 4))
            subsets.append(xx([t for t in (own if k < 4 else again) if not t & mask]) >> 32)
    return len(own), xx(own), subsets


def told(p):
    return f"{p[0]}:{p[1]:016x}:" + "".join(f"{h:08x}" for h in p[2]).rstrip("0")


def brute_likeness(a, b):
    if a[:2] == b[:2]:
        return 1.0
    same = [x for x, y in zip(a[2], b[2], strict=True) if x == y]
    differ = (2 ** (LEVELS - len(same) / FAMILIES) - 1) * 2**-0.333
    return max(0.0, 1 - 2 * differ / (a[0] + b[0] + differ)) if any(same) else 0.0


def test_query_against_brute_force(spark, sf_dir):
    """Lexicon, fingerprints and likeness of the whole table, in plain Python."""
    want = sorted((r["doc_id"], r["text"] or "") for r in table(spark, sf_dir, "documents").collect())
    texts = [t for _, t in want]
    docs_with = Counter(t for x in texts for t in words(x))
    lexicon = {t for t, n in docs_with.items() if (math.log(len(texts) / n) >= IDF_BAND[0] or n == 1) and math.log(len(texts) / n) <= IDF_BAND[1]}
    assert 0 < len(lexicon) < len(docs_with)
    prints, after = [brute_print(t, lexicon) for t in texts], [brute_print(t, lexicon) for t in changed(texts)]
    rows = sorted(op7_document_fingerprints(spark, sf_dir).collect(), key=lambda r: r["doc_id"])
    for i, r in enumerate(rows):
        assert r["fingerprint"] == told(prints[i]) and r["edited_fingerprint"] == told(after[i])
        assert abs(r["near_edited"] - brute_likeness(prints[i], after[i])) < 1e-9
        assert abs(r["near_next"] - brute_likeness(prints[i], prints[(i + 1) % len(rows)])) < 1e-9


def test_likeness_follows_the_shared_terms():
    """The estimate against the true share of kept terms, for texts of 20 to 5,000 terms."""
    r, off = random.Random(4), []
    for n in (20, 100, 800, 5000):
        for share in (0.9, 0.6, 0.3):
            for _ in range(6):
                both = r.sample(range(10**12), 2 * n)
                d = round(n * (1 - share) / (1 + share))
                a, b = both[:n], both[d : n + d]
                texts = [" ".join(f"w{x}" for x in t) for t in (a, b)]
                lexicon = set(words(texts[0])) | set(words(texts[1]))
                off.append(abs(brute_likeness(*[brute_print(t, lexicon) for t in texts]) - (n - d) / (n + d)))
    assert sum(off) / len(off) < 0.12 and sorted(off)[int(len(off) * 0.95)] < 0.35


def test_lexicon_is_a_band(spark):
    texts = [" ".join(["all", f"own{i}"] + ["some"] * (i < 4) + ["half"] * (i % 2)) for i in range(100)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    found = {r["term"] for r in lexicon_of(df, (3.0, 4.0)).collect()}
    assert found == set(words("some"))
    assert {r["term"] for r in lexicon_of(df, (3.0, 9.2)).collect()} == set(words("some")) | {t for i in range(100) for t in words(f"own{i}")}
    assert lexicon_of(df.limit(0)).count() == 0


def test_order_across_parts(spark):
    rows = [(i * 7 % 101, f"text {i * 7 % 101}") for i in range(101)] + [(5, "text 5b"), (None, "nothing")]
    df = docs(spark, rows).select("doc_id", "text").toDF("doc", "text")
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, signed(xxhash.xxh64_intdigest(r[1].encode(), 42))))
    want = {(r[0], r[1]): order[(k + 1) % len(order)][1] for k, r in enumerate(order)}
    for parts in (1, 7, 40):
        found = with_next(df, parts).where("not guest").collect()
        assert {(r["doc"], r["text"]): r["next_text"] for r in found} == want


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, prose(1, 50)), (5, prose(1, 50)), (6, "𝄞é" * 30_000 + " x"), (None, "z z z"), (7, "word%d " * 10)]
    rows = sorted(fingerprint_with_edits(docs(spark, rows, extra=True)).collect(), key=lambda r: (r["doc"] is not None, r["doc"] or 0, r["n_chars"]))
    assert [r["n_chars"] for r in rows] == [5, 0, 0, 2, 3, len(prose(1, 50)), len(prose(1, 50)), 60_002, 70]
    assert rows[1]["near_edited"] == 1 and rows[1]["near_next"] == 1 and rows[5]["near_next"] == 1
    assert rows[1]["print"] == rows[2]["print"] == rows[3]["print"]
    single = fingerprint_with_edits(docs(spark, [(1, "a b c d e f g h")])).collect()
    assert single[0]["near_next"] == 1 and single[0]["edited"] == "a b c d e f a b"
    assert fingerprint_with_edits(docs(spark, [])).count() == 0
