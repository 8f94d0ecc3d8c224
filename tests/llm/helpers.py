"""Small documents with everything that a real table may hold."""

from __future__ import annotations

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows, extra: bool = False):
    """rows: (doc_id, text) or (doc_id, text, lang, source). extra: columns whose names operators use themselves."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s0", len(r[1] or "")) for r in rows]
    df = spark.createDataFrame(full, DOCS)
    if extra:
        from pyspark.sql import functions as F

        df = df.select("*", *[F.lit(7).alias(c) for c in ("doc", "position", "size", "copies", "rate", "score", "print", "part", "n_lines", "h1", "spans", "_doc", "rep", "group", "bucket", "label")])
    return df


WORDS = "time year people way day man thing woman life child world school state family student group country problem hand part place case week company system program question work government number night point home water room mother area money story fact month lot right study book eye job word business issue side kind head house service friend father power hour game line end member law car city community name".split()


def prose(seed: int, n: int = 120) -> str:
    import random

    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + (r.choice("abcdefgh") + r.choice("rstuvw") if r.random() < 0.5 else "") for _ in range(n))
