import hashlib
import re

import pytest
from tests.llm.helpers import docs

from tidemark.llm.common import table
from tidemark.llm.registry import op10_secret_scans
from tidemark.llm.secrets import RULES, Rule, Segment, find_secrets, trigram_query, trigrams

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base(text):
    found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(k, a, b) for a, _, k, b in sorted(found)]


def joined(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def test_query_matches_brute_force(spark, sf_dir):
    for sf in (sf_dir, sf_dir.replace("sf0.001", "sf0.01")):
        texts = {r["doc_id"]: r["text"] or "" for r in table(spark, sf, "documents").collect()}
        rows = op10_secret_scans(spark, sf).collect()
        assert len(rows) == len(texts)
        for r in rows:
            want = base(texts[r["doc_id"]])
            assert r["base_sha256"] == hashlib.sha256(joined(want).encode()).hexdigest()
            assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == x for k, _, _ in want) for x in ("assign", "access", "hex")]
            every = sorted((m.start(), n, rule.kind, m.end()) for n, rule in enumerate(RULES) for m in re.finditer(rule.pattern, texts[r["doc_id"]], rule.flags) if rule.keep is None or rule.keep(m))
            assert r["spans"] == joined((k, a, b) for a, _, k, b in every)
            assert joined(s for s in want) == ",".join(s for s in r["spans"].split(",") if s.split(":")[0] in ("assign", "access", "hex"))


def test_queries_of_patterns():
    assert trigram_query(r"AKIA[A-Z0-9]+") == ("and", ("aki", "kia"))
    assert trigram_query(r"[0-9a-f]{24,}") is None
    assert trigram_query(r"ab|abcd") is None and trigram_query(r"abc|bcde") == ("or", ("abc", ("and", ("bcd", "cde"))))
    assert trigram_query(r"x(abc)?y") is None and trigram_query(r"gh[pq]_\w+") == ("or", (("and", ("ghp", "hp_")), ("and", ("ghq", "hq_"))))
    assert trigram_query("x([ab][ab][ab][ab][ab][ab][ab]c)") is None or not {"xac", "xbc"} & trigrams(trigram_query("x([ab][ab][ab][ab][ab][ab][ab]c)"))
    rule = Rule("many", "x([ab][ab][ab][ab][ab][ab][ab]c)")
    held = Segment([b"xaaaaaaac", b"xbc"], sorted(trigrams(trigram_query(rule.pattern)))).candidates(trigram_query(rule.pattern))
    assert 0 in held.tolist()
    assert trigrams(trigram_query(r"foo.*bar")) == {"foo", "bar"}


@pytest.mark.parametrize("rule", RULES, ids=lambda r: r.kind)
def test_candidates_hold_all_matches(rule):
    texts = ["", "API_KEY = 'abcdef123'", "passwd:xxxxxxx", "AKIA" + "A" * 16, "f" * 24, "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a" * 36, "xoxb-" + "1" * 12, "AIza" + "b" * 35,
             "eyJhbGciOiJI.eyJzdWIiOiIx.abcdefghij", "nothing", "SECRET=\"Abc.def/12\" é token: zzzzzz"]
    query = trigram_query(rule.pattern, rule.flags)
    found = set(Segment([t.encode() for t in texts], sorted(trigrams(query))).candidates(query).tolist())
    assert {i for i, t in enumerate(texts) if rule.spans(t)} <= found and any(rule.spans(t) for t in texts)


def test_edges(spark):
    text = "𝄞é password: \"abc123\" AKIA" + "B" * 16 + " " + "0" * 30 + " secret=short token=tooool api_key='x' ghp_" + "Q" * 36
    rows = [(1, None), (2, ""), (3, text), (3, text), (None, text), (4, "a" * 200_000 + " " + text)]
    got = sorted(((r["doc"], joined((s["kind"], s["start"], s["stop"]) for s in r["spans"])) for r in find_secrets(docs(spark, rows, extra=True)).collect()), key=str)
    extra = [("forge", m.start(), m.end()) for m in re.finditer("ghp_Q+", text)]
    one = joined(sorted(base(text) + extra, key=lambda s: s[1]))
    assert [g for g in got if g[0] == 3] == [(3, one)] * 2 and (None, one) in got and (1, "") in got and (2, "") in got
    long = rows[-1][1]
    assert (4, joined(sorted(base(long) + [("forge", a + 200_001, b + 200_001) for _, a, b in extra], key=lambda s: s[1]))) in got
    assert find_secrets(docs(spark, [])).count() == 0
    assert find_secrets(docs(spark, [(1, "xyz")]), (Rule("z", "z"),)).first()["spans"][0]["start"] == 2
