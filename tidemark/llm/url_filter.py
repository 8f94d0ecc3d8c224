"""URL filters: allow and block rules by host and path, and a ratio of character language models for all other URLs.

Two Markov models of variable order are counted over the URLs that the rules accept and reject: a character follows contexts
of up to ORDER characters, and where a context is rare the next shorter one takes over (Witten-Bell). The strings of up to
ORDER + 1 characters and their counts are rows, as many as the URLs hold; probabilities are worked out for each distinct
string, from the shortest on, and joined to the URLs' positions. A URL's score is the difference of its log-likelihoods by
its length; the threshold is the one that best tells apart the fifth of the ruled URLs that was held back. DataFrame
functions alone.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import lower_ascii, stored

#: Characters of the longest contexts.
ORDER = 5
#: Stand for the ends of a URL.
START, END = "\x02", "\x03"
#: Characters that a URL may hold as far as the models know: what a context of no characters spreads its doubt over.
CHARACTERS = 256
#: Strings, and URLs, with more than this share of all rows are at most as many as its inverse; they are joined by broadcast.
HOT_SHARE = 1e-4


@dataclass(frozen=True)
class Rule:
    """Fits a host and all its subdomains where the path starts with `path`; name is host and path as written."""

    verdict: str
    name: str

    @property
    def host(self) -> str:
        return self.name.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.name.partition("/")[2]


#: The rules of the contract, in its order.
RULES = (Rule("allow", "com/"), Rule("block", "example.com/en/"), Rule("allow", "www.example.com/en/"), Rule("block", "net/es/"), Rule("block", "net/fr/"))

_PARTS = r"(?s)\A.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """What stands between the first :// and the next of / ? #, A-Z lower-cased; empty for a null or no ://."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host up to ? or #; empty for a null or no ://."""
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def ruled(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits; nulls if none does. Of rules of one length the first counts."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.name)):  # longer ones are put on top; the sort is stable
        shadowed = any(o.name == rule.name for o in rules[: rules.index(rule)])
        if shadowed:
            continue
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))
        name, verdict = F.when(fits, rule.name).otherwise(name), F.when(fits, rule.verdict).otherwise(verdict)
    return F.struct(name.alias("rule"), verdict.alias("verdict"))


def held_back(url: Column) -> Column:
    """A fifth of the URLs, by their MD5."""
    return F.md5(url.cast("binary")) < "33"


def marked(url: Column) -> Column:
    """The URL after its scheme, lower-cased, with all digits as 0, between START and END."""
    body = F.regexp_replace(lower_ascii(F.coalesce(url, F.lit(""))), r"(?s)\A.*?://", "")
    return F.concat(F.lit(START), F.translate(body, "123456789", "000000000"), F.lit(END))


def strings(text: str) -> Column:
    """All strings of one to ORDER + 1 characters that end at a character of column `text` after its first."""
    return F.expr(f"flatten(transform(sequence(2, length(`{text}`)), i -> transform(sequence(1, least({ORDER + 1}, i)), n -> substring(`{text}`, i - n + 1, n))))")


def longest(text: str) -> Column:
    """For each character of column `text` after its first the longest of its strings."""
    return F.expr(f"transform(sequence(2, length(`{text}`)), i -> substring(`{text}`, greatest(1, i - {ORDER}), least({ORDER + 1}, i)))")


def _joined(rows: DataFrame, facts: DataFrame, key: str, how: str) -> DataFrame:
    """rows with the one row of facts of their key. Keys with over HOT_SHARE of the rows, at most its inverse in number, are
    joined by broadcast; in the join of the others no key is large."""
    counts = stored(rows.groupBy(key).agg(F.count("*").alias("_n")), "key-counts")
    least = int((counts.agg(F.sum("_n")).first()[0] or 0) * HOT_SHARE) + 1
    hot = counts.where(F.col("_n") > least).select(key)
    common = rows.join(F.broadcast(facts.join(F.broadcast(hot), key)), key)
    return common.unionByName(rows.join(F.broadcast(hot), key, "left_anti").join(facts, key, how))


def log_ratios(known: DataFrame, urls: DataFrame) -> DataFrame:
    """For each of the longest strings of the urls (text): string and ratio, the log probability of its last character after
    the others among accepted URLs less that among rejected ones. known: text, accepted."""
    seen = known.select("accepted", F.explode(strings("text")).alias("string")).groupBy("string").agg(F.count_if("accepted").alias("n1"), F.count_if(~F.col("accepted")).alias("n0"))
    seen = stored(seen, "url-strings")
    before = F.expr("substring(string, 1, length(string) - 1)").alias("before")
    stats = seen.where("length(string) > 1").groupBy(before).agg(
        *[F.sum(f"n{k}").alias(f"m{k}") for k in "10"], *[F.count_if(F.col(f"n{k}") > 0).alias(f"t{k}") for k in "10"])
    totals = seen.where("length(string) = 1").agg(*[F.coalesce(F.sum(f"n{k}"), F.lit(0)).alias(f"a{k}") for k in "10"])
    asked = urls.select(F.explode(strings("text")).alias("string")).distinct()
    facts = asked.join(seen, "string", "left").withColumn("before", before).join(stats, "before", "left").crossJoin(F.broadcast(totals))
    facts = stored(facts.select("string", F.length("string").alias("size"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n1", "n0", "m1", "m0", "t1", "t0")], "a1", "a0"), "url-facts")
    shorter = stored(facts.where("size = 1").select("string", *[((F.col(f"n{k}") + 1) / (F.col(f"a{k}") + CHARACTERS)).alias(f"p{k}") for k in "10"]), "url-odds")
    found = []
    for size in range(2, ORDER + 2):
        rest = shorter.select(F.col("string").alias("after"), F.col("p1").alias("q1"), F.col("p0").alias("q0"))
        own = facts.where(F.col("size") == size).withColumn("after", F.expr("substring(string, 2)")).join(rest, "after")
        # a context that was never seen says nothing
        odds = [F.when(F.col(f"m{k}") > 0, (F.col(f"n{k}") + F.col(f"t{k}") * F.col(f"q{k}")) / (F.col(f"m{k}") + F.col(f"t{k}"))).otherwise(F.col(f"q{k}")).alias(f"p{k}") for k in "10"]
        shorter = stored(own.select("string", *odds), "url-odds")
        found.append(shorter if size > ORDER else shorter.where(F.startswith("string", F.lit(START))))
    ratio = (F.log("p1") - F.log("p0")).alias("ratio")
    return reduce(DataFrame.unionByName, [f.select("string", ratio) for f in found])


def scored(urls: DataFrame, ratios: DataFrame) -> DataFrame:
    """url and score, the log-likelihood difference by the number of characters, the end counting as one. urls: url (distinct), text."""
    positions = urls.select("url", F.explode(longest("text")).alias("string"))
    return _joined(positions, ratios, "string", "inner").groupBy("url").agg((F.sum("ratio") / F.count("*")).alias("score"))


def threshold(scored: DataFrame) -> float:
    """The score from which a URL is accepted: that with the best mean of the two rates of right verdicts, the nearest to 0
    of equal ones; 0 unless both kinds are there. scored: score, accepted. Scores are compared to two places."""
    bins = scored.groupBy(F.round("score", 2).alias("bin")).agg(F.count_if("accepted").alias("yes"), F.count_if(~F.col("accepted")).alias("no"))
    below = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # a row for each hundredth of a score
    every = Window.partitionBy()
    share = lambda c: F.try_divide(F.coalesce(F.sum(c).over(below), F.lit(0)), F.sum(c).over(every))
    rates = bins.select("bin", (1 - share("yes")).alias("kept"), share("no").alias("cut"))
    best = rates.where("kept is not null and cut is not null").orderBy((-(F.col("kept") + F.col("cut"))), F.abs("bin"), "bin").first()
    return float(best["bin"]) - 0.005 if best else 0.0


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page, url, host, path, rule, verdict (allow or block) and score of every row.

    The verdict is that of the longest rule that fits, else allow if the score reaches the threshold. A null URL is an
    empty one; its score is that of an empty URL. Without ruled URLs of both kinds the threshold is 0, without any all
    scores are 0 and URLs that no rule fits are allowed. Every row with a ruled URL counts for the models, repeats included.
    URLs of any length are scored whole, other columns are ignored whatever their names, rows that repeat give a row each,
    and an empty table none.
    """
    rows = pages.select(F.col(f"`{id_col}`").alias("page"), F.coalesce(F.col(f"`{url_col}`"), F.lit("")).alias("url"), F.col(f"`{url_col}`").isNull().alias("_null"))
    rows = rows.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rows = rows.withColumn("_ruled", ruled(F.col("host"), F.col("path"), rules))
    urls = stored(rows.select("url").distinct().withColumn("text", marked(F.col("url"))), "urls")
    known = rows.where("_ruled.verdict is not null").select("url", marked(F.col("url")).alias("text"), (F.col("_ruled.verdict") == "allow").alias("accepted"))
    ratios = stored(log_ratios(known.where(~held_back(F.col("url"))), urls), "url-ratios")
    scores = stored(scored(urls, ratios), "url-scores")
    told = _joined(rows, scores, "url", "left")
    tried = told.where(F.col("_ruled.verdict").isNotNull() & held_back(F.col("url")))
    cut = threshold(tried.select((F.col("_ruled.verdict") == "allow").alias("accepted"), "score"))
    verdict = F.coalesce(F.col("_ruled.verdict"), F.when(F.col("score") >= cut, "allow").otherwise("block"))
    return told.select("page", F.when(~F.col("_null"), F.col("url")).alias("url"), "host", "path", F.col("_ruled.rule").alias("rule"), verdict.alias("verdict"), "score")
