import zlib
from collections import Counter

import numpy as np
from tests.llm.helpers import docs

from tidemark.llm.common import table
from tidemark.llm.language import DIMENSIONS, bundled, identify, letter_vector, letters_only, prototypes
from tidemark.llm.registry import op6_language_id


def test_held_out_accuracy(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.01")
    langs = {r["doc_id"]: r["lang"] for r in table(spark, sf, "documents").collect()}
    rows = op6_language_id(spark, sf).collect()
    assert len(rows) == len(langs)
    held = [r["lang_pred"] == langs[r["doc_id"]] for r in rows if r["held_out"] and langs[r["doc_id"]]]
    assert len(held) > 200 and np.mean(held) > 0.97


def test_bundle_is_the_sum_of_bound_letters():
    text = "Das Übel, naïve 42 x"
    codes = letters_only(text)
    assert "".join(map(chr, codes)) == " das übel naïve x "
    want = np.zeros(DIMENSIONS)
    for a, b, c in zip(codes, codes[1:], codes[2:], strict=False):
        want += np.roll(letter_vector(int(a)), 2) * np.roll(letter_vector(int(b)), 1) * letter_vector(int(c))
    np.testing.assert_allclose(bundled([codes], np.array([0]), 1)[0], want)


def test_query_against_plain_cosines(spark, sf_dir):
    """Prototypes and predictions of the whole table, trigram by trigram."""
    rows = table(spark, sf_dir, "documents").collect()
    bound = {}

    def vector(text):
        codes = letters_only(text).tolist()
        out = np.zeros(DIMENSIONS)
        for g, n in Counter(zip(codes, codes[1:], codes[2:], strict=False)).items():
            if g not in bound:
                bound[g] = np.roll(letter_vector(g[0]), 2).astype(float) * np.roll(letter_vector(g[1]), 1) * letter_vector(g[2])
            out += n * bound[g]
        return out

    vectors = {r["doc_id"]: vector(r["text"]) for r in rows}
    sums = {}
    for r in rows:
        if zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1 and r["lang"] and r["text"]:
            sums[r["lang"]] = sums.get(r["lang"], 0) + vectors[r["doc_id"]]
    for r in op6_language_id(spark, sf_dir).collect():
        v = vectors[r["doc_id"]]
        cosines = {k: v @ s / np.linalg.norm(s) / np.linalg.norm(v) for k, s in sums.items()} if v.any() else {"und": 0.0}
        best = max(sorted(cosines), key=cosines.get)
        assert abs(r["score"] - max(0, cosines[best])) < 1e-5 and (r["lang_pred"] == best or abs(cosines[r["lang_pred"]] - cosines[best]) < 1e-6)


def test_a_long_text_of_many_trigrams():
    r = np.random.default_rng(3)
    wide = ["".join(map(chr, r.integers(0x4E00, 0x9FFF, 60_000)))] + ["kurz und gut"] * 5
    codes = [letters_only(t) for t in wide]
    together = bundled(codes, np.arange(6), 6)
    for i, c in enumerate(codes):
        np.testing.assert_allclose(together[i], bundled([c], np.array([0]), 1)[0], atol=1e-3)


def test_edges(spark):
    rows = [(1, "the cat and the dog " * 20, "en"), (2, "der hund und die katze " * 20, "de"), (3, None, "en"), (4, "123 !?", "en"), (5, "the dog", None), (6, "x", "en"), (None, "und die", "de"), (2, "und die katze", "de"), (7, "语言 " * 40_000, "zh"), (8, "퟿\U0001F600 ", "en")]
    df = docs(spark, rows, extra=True)
    model = prototypes(df)
    assert model[0] == ["de", "en", "zh"]
    got = sorted(((r["doc"], r["lang_pred"]) for r in identify(df, model).collect()), key=str)
    assert got == sorted([(1, "en"), (2, "de"), (3, "und"), (4, "und"), (5, "en"), (6, got[[g[0] for g in got].index(6)][1]), (None, "de"), (2, "de"), (7, "zh"), (8, got[[g[0] for g in got].index(8)][1])], key=str)
    nothing = prototypes(docs(spark, []))
    assert nothing[0] == [] and {r["lang_pred"] for r in identify(df, nothing).collect()} == {"und"}
    assert identify(docs(spark, []), model).count() == 0
