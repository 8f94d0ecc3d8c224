"""The named queries of this package: each applies an operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import new_path, stored, table
from tidemark.llm.decontaminate import contaminated
from tidemark.llm.imatch import as_string, fingerprint_with_edits
from tidemark.llm.language import identify, prototypes
from tidemark.llm.line_dedup import dedup_lines
from tidemark.llm.mixing import mix_sources
from tidemark.llm.quality import quality_score, train
from tidemark.llm.secrets import find_secrets
from tidemark.llm.simhash import fingerprints, near_duplicates
from tidemark.llm.url_filter import CHARACTERS, ORDER, RULES, judge_urls
from tidemark.llm.warc import page_of, read_warc, write_warc


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup_lines(table(spark, sf_dir, "documents"), min_docs=5, min_chars=40)
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH lines AS (
  SELECT rid, doc_id, pos, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT rid, doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
        FROM (SELECT *, row_number() OVER () AS rid FROM documents))),
keys AS (
  SELECT k, max(doc_id) AS keeper FROM lines WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT l.rid, l.doc_id, l.pos, l.line, coalesce(k.keeper <> l.doc_id, false) AS gone FROM lines l LEFT JOIN keys k ON l.k = k.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY rid, doc_id
"""


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = stored(fingerprints(table(spark, sf_dir, "documents"), words=4), "prints")
    found = near_duplicates(prints, distance=4)
    return found.select(F.col("doc").alias("doc_id"), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op3_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents"), weights=(5, 2, 1), most=3)
    each = mixed.withColumn("_row", F.explode(F.array_repeat(F.lit(0), F.col("rows").cast("int"))))
    return each.select(F.col("doc").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "rate", "source")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path, least_bytes=1000)
    found = read_warc(spark, path)
    sound = F.when(F.col("error").isNotNull(), F.raise_error(F.concat(F.lit("unreadable capture "), "record_id", F.lit(": "), "error"))).otherwise(F.col("record_type"))
    return found.select(page_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", sound.alias("record_type"), page_of("refers_to").alias("refers_to"))


OP4_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS n FROM pages),
q AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS leader FROM p)
SELECT page_id, n AS payload_bytes, sha1(h) AS payload_digest,
       CASE WHEN n >= 1000 AND page_id < leader THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id < leader THEN leader END AS refers_to
FROM q
"""


def _remainder(n: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    trees = train(docs, labels.where(_remainder(5) != 0))
    scored = docs.select("doc_id", (_remainder(5) == 0).alias("held_out"), quality_score(trees, F.col("text"), docs).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = prototypes(docs.where(_remainder(3) != 1))
    found = identify(docs, model).withColumnRenamed("doc", "doc_id")
    return found.select("doc_id", (_remainder(3) == 1).alias("held_out"), "lang_pred", "score")


def op7_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprint_with_edits(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("doc").alias("doc_id"), "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_string(F.col("print")).alias("fingerprint"), as_string(F.col("edited_print")).alias("edited_fingerprint"),
        "near_edited", "near_next")


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages")).withColumnRenamed("page", "page_id").drop("url").withColumn("score", F.round("score", 6))


def _op8_sql() -> str:
    """The rules, both models from the shortest strings on, and the threshold."""
    by_length = sorted(RULES, key=lambda r: -len(r.name))
    fits = [f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')" for r in by_length]
    rule = " ".join(f"WHEN {f} THEN '{r.name}'" for f, r in zip(fits, by_length, strict=True))
    said = " ".join(f"WHEN {f} THEN '{r.verdict}'" for f, r in zip(fits, by_length, strict=True))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    parts = r"'(?s)\A.*?://([^/?#]*)([^?#]*)'"
    odds = lambda k: f"CASE WHEN m{k} > 0 THEN (n{k} + t{k} * q{k}) / (m{k} + t{k}) ELSE q{k} END AS p{k}"
    levels = "".join(f""",
p{n} AS (SELECT string, {odds(1)}, {odds(0)} FROM (SELECT f.*, s.p1 AS q1, s.p0 AS q0 FROM facts f JOIN p{n - 1} s ON s.string = substr(f.string, 2) WHERE length(f.string) = {n}))""" for n in range(2, ORDER + 2))
    ends = " UNION ALL ".join(f"SELECT string, ln(p1) - ln(p0) AS ratio FROM p{n}" + (" WHERE starts_with(string, chr(2))" if n <= ORDER else "") for n in range(2, ORDER + 2))
    return f"""
WITH split AS (
  SELECT page_id, coalesce(url, '') AS url, translate(coalesce(regexp_extract(url, {parts}, 1), ''), '{upper}', '{lower}') AS host, coalesce(regexp_extract(url, {parts}, 2), '') AS path FROM pages),
told AS (
  SELECT *, CASE {rule} END AS rule, CASE {said} END AS said,
    chr(2) || translate(regexp_replace(translate(url, '{upper}', '{lower}'), '(?s)\\A.*?://', ''), '123456789', '000000000') || chr(3) AS text FROM split),
urls AS (SELECT DISTINCT url, text FROM told),
ends AS (SELECT url, text, unnest(range(2, length(text) + 1)) AS i FROM urls),
asked AS (SELECT DISTINCT substr(text, i - n + 1, n) AS string FROM (SELECT *, unnest(range(1, least({ORDER + 1}, i) + 1)) AS n FROM ends)),
taught AS (SELECT said, text, unnest(range(2, length(text) + 1)) AS i FROM told WHERE said IS NOT NULL AND md5(url) >= '33'),
seen AS (
  SELECT substr(text, i - n + 1, n) AS string, count(*) FILTER (WHERE said = 'allow') AS n1, count(*) FILTER (WHERE said = 'block') AS n0
  FROM (SELECT *, unnest(range(1, least({ORDER + 1}, i) + 1)) AS n FROM taught) GROUP BY 1),
stats AS (
  SELECT substr(string, 1, length(string) - 1) AS before, sum(n1) AS m1, sum(n0) AS m0, count(*) FILTER (WHERE n1 > 0) AS t1, count(*) FILTER (WHERE n0 > 0) AS t0
  FROM seen WHERE length(string) > 1 GROUP BY 1),
totals AS (SELECT coalesce(sum(n1), 0) AS a1, coalesce(sum(n0), 0) AS a0 FROM seen WHERE length(string) = 1),
facts AS (
  SELECT a.string, coalesce(n1, 0) AS n1, coalesce(n0, 0) AS n0, coalesce(m1, 0) AS m1, coalesce(m0, 0) AS m0, coalesce(t1, 0) AS t1, coalesce(t0, 0) AS t0, a1, a0
  FROM asked a LEFT JOIN seen s ON s.string = a.string LEFT JOIN stats x ON x.before = substr(a.string, 1, length(a.string) - 1), totals),
p1 AS (SELECT string, (n1 + 1) / (a1 + {CHARACTERS}) AS p1, (n0 + 1) / (a0 + {CHARACTERS}) AS p0 FROM facts WHERE length(string) = 1){levels},
ratios AS ({ends}),
scores AS (
  SELECT url, sum(ratio) / count(*) AS score FROM (SELECT url, substr(text, greatest(1, i - {ORDER}), least({ORDER + 1}, i)) AS string FROM ends) JOIN ratios USING (string) GROUP BY url),
bins AS (
  SELECT round(score, 2) AS bin, count(*) FILTER (WHERE said = 'allow') AS yes, count(*) FILTER (WHERE said = 'block') AS no
  FROM told JOIN scores USING (url) WHERE said IS NOT NULL AND md5(url) < '33' GROUP BY 1),
rates AS (
  SELECT bin, 1 - coalesce(sum(yes) OVER w, 0) / nullif(sum(yes) OVER (), 0) AS kept, coalesce(sum(no) OVER w, 0) / nullif(sum(no) OVER (), 0) AS cut
  FROM bins WINDOW w AS (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
best AS (SELECT coalesce((SELECT bin - 0.005 FROM rates WHERE kept IS NOT NULL AND cut IS NOT NULL ORDER BY -(kept + cut), abs(bin), bin LIMIT 1), 0) AS cut)
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN score >= best.cut THEN 'allow' ELSE 'block' END) AS verdict, round(score, 6) AS score
FROM told JOIN scores USING (url), best
"""


OP8_SQL = _op8_sql()


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")

    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    return found.select(F.col("doc").alias("doc_id"), count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def queries() -> dict:
    return {
        "op1_line_dedup": op1_line_dedup,
        "op2_simhash_near_dedup": op2_simhash_near_dedup,
        "op3_mixing_sources": op3_mixing_sources,
        "op4_warc": op4_warc,
        "op5_quality_classifier": op5_quality_classifier,
        "op6_language_id": op6_language_id,
        "op7_document_fingerprints": op7_document_fingerprints,
        "op8_url_filters": op8_url_filters,
        "op9_benchmark_decontamination": op9_benchmark_decontamination,
        "op10_secret_scans": op10_secret_scans,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_line_dedup": OP1_SQL,
        "op4_warc": OP4_SQL,
        "op8_url_filters": OP8_SQL,
    }
