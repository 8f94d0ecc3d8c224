import hashlib
import math
import re
from collections import Counter

import numpy as np

from tidemark.llm.common import table
from tidemark.llm.registry import op8_url_filters
from tidemark.llm.url_filter import CHARACTERS, ORDER, RULES, judge_urls

LOWER = {i: i + 32 for i in range(65, 91)}


def parts(url):
    m = re.match(r"(?s)\A.*?://([^/?#]*)([^?#]*)", url or "")
    return (m[1].translate(LOWER), m[2]) if m else ("", "")


def rule_of(host, path):
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.name)) if fits else None


def marked(url):
    body = re.sub(r"(?s)\A.*?://", "", (url or "").translate(LOWER), count=1)
    return "\x02" + re.sub("[1-9]", "0", body) + "\x03"


def model(urls):
    """The probability of a string's last character after the others."""
    n, follow = Counter(), {}
    for t in map(marked, urls):
        for i in range(1, len(t)):
            for size in range(1, min(ORDER + 1, i + 1) + 1):
                g = t[i - size + 1 : i + 1]
                n[g] += 1
                follow.setdefault(g[:-1], Counter())[g[-1]] += 1
    total = sum(v for g, v in n.items() if len(g) == 1)

    def p(g):
        if len(g) == 1:
            return (n[g] + 1) / (total + CHARACTERS)
        after = follow.get(g[:-1])
        return (n[g] + len(after) * p(g[1:])) / (sum(after.values()) + len(after)) if after else p(g[1:])

    return p


def held_back(url):
    return hashlib.md5((url or "").encode()).hexdigest() < "33"


def test_query_matches_brute_force(spark, sf_dir):
    urls = {r["page_id"]: r["url"] for r in table(spark, sf_dir, "pages").collect()}
    rules = {i: rule_of(*parts(u)) for i, u in urls.items()}
    fitted = [i for i in urls if rules[i] and not held_back(urls[i])]
    good, bad = (model([urls[i] for i in fitted if rules[i].verdict == v]) for v in ("allow", "block"))
    rows = op8_url_filters(spark, sf_dir).collect()
    assert len(rows) == len(urls)
    for r in rows:
        url, rule = urls[r["page_id"]], rules[r["page_id"]]
        assert (r["host"], r["path"]) == parts(url) and r["rule"] == (rule and rule.name)
        t = marked(url)
        held = [t[max(0, i - ORDER) : i + 1] for i in range(1, len(t))]
        assert abs(sum(math.log(good(g)) - math.log(bad(g)) for g in held) / len(held) - r["score"]) < 1e-6
        assert r["verdict"] in ("allow", "block") and (not rule or r["verdict"] == rule.verdict)
    free = [(r["score"], r["verdict"]) for r in rows if r["rule"] is None]
    assert max((s for s, v in free if v == "block"), default=-99) < min((s for s, v in free if v == "allow"), default=99)


def test_held_out_ruled_urls(spark, sf_dir):
    """Without its rules, the method tells the held-back URLs apart."""
    rows = op8_url_filters(spark, sf_dir.replace("sf0.001", "sf0.1")).collect()
    urls = {r["page_id"]: r["url"] for r in table(spark, sf_dir.replace("sf0.001", "sf0.1"), "pages").collect()}
    held = [r for r in rows if r["rule"] and held_back(urls[r["page_id"]])]
    good, bad = [r["score"] for r in held if r["verdict"] == "allow"], [r["score"] for r in held if r["verdict"] == "block"]
    assert np.mean([a > b for a in good for b in bad]) > 0.9


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "no scheme"), (4, "HTTP://WWW.Example.COM/en/1?x"), (5, "http://example.com"), (6, "a://b.example.com/EN/"), (7, "a://example.com/en/x#y"), (8, "http://x.net/es/"), (8, "http://x.net/es/"),
            (None, "http://com/"), (9, "http://u@com:80/"), (10, "http://é\n.net/fr/" + "z" * 100_000)]
    df = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "1 as host", "2 as path", "3 as rule", "4 as score", "5 as page", "6 as _ruled")
    got = sorted(((r["page"], r["host"], r["path"], r["rule"]) for r in judge_urls(df).collect()), key=str)
    want = [(i, *parts(u), rule_of(*parts(u)) and rule_of(*parts(u)).name) for i, u in rows]
    assert got == sorted(want, key=str)
    assert judge_urls(df.limit(0)).count() == 0
    unruled = judge_urls(df.where("page_id in (1, 2, 3)")).collect()
    assert {(r["verdict"], r["score"]) for r in unruled} == {("allow", 0.0)}
