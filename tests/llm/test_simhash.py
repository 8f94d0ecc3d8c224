import random

import numpy as np
import xxhash
from tests.llm.helpers import docs, prose

from tidemark.llm.common import table
from tidemark.llm.registry import op2_simhash_near_dedup
from tidemark.llm.simhash import components, descend, drop_near_duplicates, fingerprint, fingerprints, gray_rank, linked_parts, near_duplicates, segments, shingle_set, sketch_parts, word_hashes


def plain(text, words=4):
    w = (text or "").translate({i: i + 32 for i in range(65, 91)}).encode().split()
    shingles = [b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_parts(prints, distance):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= distance:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_query_matches_brute_force(spark, sf_dir):
    rows = sorted((r["doc_id"], r["text"]) for r in table(spark, sf_dir, "documents").collect())
    prints = [plain(t) for _, t in rows]
    parts = brute_parts(prints, 4)
    want = {i: (f"{p:016x}", rows[k][0]) for (i, _), p, k in zip(rows, prints, parts, strict=True)}
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in op2_simhash_near_dedup(spark, sf_dir).collect()} == want


def test_gray_order_and_index():
    codes = np.array([i ^ i >> 1 for i in range(200)], np.uint64)
    assert gray_rank(codes).tolist() == list(range(200))
    r = random.Random(1)
    prints = [r.getrandbits(64) for _ in range(150)]
    prints += [p ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 5))) for p in prints for _ in range(3)]
    assert linked_parts(np.array(prints, np.uint64), 4).tolist() == brute_parts(prints, 4)
    assert linked_parts(np.array(prints[:20], np.uint64), 4).tolist() == brute_parts(prints[:20], 4)
    dense = [prints[0] ^ sum(1 << b for b in r.sample(range(20), r.randint(0, 6))) for _ in range(1500)]
    assert linked_parts(np.array(dense, np.uint64), 4).tolist() == brute_parts(dense, 4)
    for segment in segments(4):
        own = [sum(1 << b for b in range(segment[0], sum(segment))) & p for p in prints]
        found = linked_parts(np.array(prints, np.uint64), 4, segment)
        assert all(own[i] == own[k] for i, k in enumerate(found))


def test_every_link_of_a_table_comes_from_the_descent(spark, sf_dir):
    """All pairs within the distance, counted by brute force, are what the descents of the turned indexes give."""
    sf = sf_dir.replace("sf0.001", "sf0.01")
    prints = np.array(sorted({plain(r["text"]) for r in table(spark, sf, "documents").collect()}), np.uint64)
    apart = np.bitwise_count(prints[:, None] ^ prints[None, :])
    for distance, least in ((4, 2), (12, 20)):
        u, v = np.nonzero(np.triu(apart <= distance, 1))
        want = {tuple(sorted(x)) for x in zip(prints[u].tolist(), prints[v].tolist(), strict=True)}
        got = set()
        for low, bits in segments(distance):
            up = (64 - low - bits) % 64
            p = prints[np.argsort(gray_rank(prints << np.uint64(up) | prints >> np.uint64(64 - up) if up else prints))]
            for a, b in descend(p, distance, sum(1 << b for b in range(low, low + bits))):
                got |= {tuple(sorted(x)) for x in zip(p[a].tolist(), p[b].tolist(), strict=True)}
        assert len(want) >= least and got == want


def test_segments_leave_out_no_link():
    r = random.Random(2)
    for distance in (3, 4, 7):
        masks = [sum(1 << b for b in range(low, low + bits)) for low, bits in segments(distance)]
        assert len(masks) == distance + 1 and sum(masks) == 2**64 - 1
        for _ in range(200):
            changed = sum(1 << b for b in r.sample(range(64), distance))
            assert any(not changed & m for m in masks)


def test_large_top_nodes_are_dealt_into_pages(spark, monkeypatch):
    from tidemark.llm import simhash

    monkeypatch.setattr(simhash, "PAGE", 8)
    r = random.Random(3)
    base, sign = r.getrandbits(64), 1 << 63
    prints = [base ^ sum(1 << b for b in r.sample(range(24), r.randint(0, 6))) for _ in range(60)] + [r.getrandbits(64) for _ in range(20)]
    prints += [(base ^ sign) ^ sum(1 << b for b in r.sample(range(40, 64), r.randint(0, 6))) for _ in range(40)]
    rows = [(i, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(prints)]
    found = near_duplicates(spark.createDataFrame(rows, "doc long, print long"), 4)
    assert [r["component"] for r in found.orderBy("doc").collect()] == brute_parts(prints, 4)


def test_features_of_texts():
    text = prose(7, 60).encode()
    w = text.split()
    assert len(word_hashes(text)) == 60 and word_hashes(b" \t").tolist() == []
    assert len(shingle_set(word_hashes(text), 5)) == len({tuple(w[i : i + 5]) for i in range(56)})
    assert len(shingle_set(word_hashes(b"one two"), 5)) == 1 and shingle_set(word_hashes(b"One two"), 5) == shingle_set(word_hashes(b"one  TWO"), 5)
    wide = np.random.default_rng(1).integers(0, 2**63, (6, 4)).astype(np.uint64)
    wide[4], wide[5] = wide[1], wide[2]
    wide[5, 0] ^= np.uint64(7)
    assert sketch_parts(wide, 3).tolist() == [0, 1, 2, 3, 1, 2]


def test_edges(spark):
    rows = [(5, None), (3, ""), (4, " \n"), (8, "one two"), (9, "ONE two"), (10, "one two"), (10, "one two"), (None, "one two"), (None, "alone here now again"), (7, "word " * 60_000)]
    prints = fingerprints(docs(spark, rows, extra=True))
    got = sorted(((r["doc"], r["component"]) for r in near_duplicates(prints, 4).collect()), key=str)
    assert got == sorted([(5, 3), (3, 3), (4, 3), (8, 8), (9, 8), (10, 8), (10, 8), (None, 8), (None, None), (7, 7)], key=str)
    assert fingerprint("One Two", 4) == fingerprint("one two", 4) != 0 == fingerprint(None, 4)
    assert near_duplicates(fingerprints(docs(spark, [])), 4).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 30)] + [(100, 101), (103, 101), (50, 50)], "a long, b long")
    found = {r["node"]: r["root"] for r in components(edges).collect()}
    assert found == {**{i: 0 for i in range(1, 31)}, 101: 100, 103: 100}
    assert components(edges.limit(0)).count() == 0


def test_one_of_each_group_stays(spark):
    base = prose(1, 300).split()
    near = list(base)
    near[150] = "changed"
    rows = [(4, " ".join(base)), (2, " ".join(near)), (9, " ".join(base)), (1, prose(2, 300)), (1, prose(2, 300)), (6, None), (7, None), (None, " ".join(base))]
    kept = drop_near_duplicates(docs(spark, rows, extra=True))
    assert sorted((str(r["doc_id"]) for r in kept.collect())) == ["1", "2", "6", "None"]
    assert kept.columns == docs(spark, rows, extra=True).columns
    assert drop_near_duplicates(docs(spark, [])).count() == 0


def test_one_text_without_words_stays(spark):
    rows = [(5, ""), (3, None), (3, " \n"), (4, "\t"), (None, ""), (1, "one"), (2, "two")]
    kept = drop_near_duplicates(docs(spark, rows, extra=True))
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "3", "None"]
    assert kept.columns == docs(spark, rows, extra=True).columns


def test_cut_and_extended_copies_are_linked_by_exact_similarity(spark, monkeypatch):
    from tidemark.llm import simhash

    r, rows, want = random.Random(5), [], set()
    for k in range(60):  # alike over 0.8, or just under it
        base = prose(100 + k, r.randint(70, 250)).split()
        n, other = len(base), prose(900 + k, 400).split()
        for j, text in enumerate((base, base[: n - n // 8], base + other[: n // 6], base[n // 4 :], base + other[: n // 2])):
            rows.append((10 * k + j, " ".join(text)))
        want |= {10 * k, 10 * k + 3, 10 * k + 4}
    monkeypatch.setattr(simhash, "TEXTS", 2)
    assert {x["doc_id"] for x in drop_near_duplicates(docs(spark, rows)).collect()} == want


def test_rows_that_share_an_id_go_by_their_texts(spark):
    a, b, c = prose(21, 200), prose(22, 200), prose(23, 200)
    rows = [(1, a), (5, a + " more"), (5, b), (5, c), (5, c), (7, b), (7, b + " more"), (8, None), (8, a)]
    kept = [(r["doc_id"], r["text"]) for r in drop_near_duplicates(docs(spark, rows, extra=True)).collect()]
    assert sorted(kept, key=str) == sorted([(1, a), (5, b), (5, c), (8, None)], key=str)
