"""I-Match document fingerprints, in DataFrame functions alone.

The lexicon holds the terms whose inverse document frequency lies in a band: ln(documents / documents with the term). A
term of the band is in a fixed share of the documents at least, so the lexicon has at most (distinct words of a mean
document) * e ** (upper end) terms, whatever the number of documents, and is held exactly, dealt into short buckets.

A text's kept terms, distinct and sorted, are hashed as a whole and once for each of several randomised subsets of the
lexicon: FAMILIES of them at each of LEVELS rates, level l keeping each term with a chance of 2 ** -l. Two texts that differ
in d kept terms agree on a subset of level l with a chance of (1 - 2 ** -l) ** d, so the number of subsets on which they
agree tells d, and with both numbers of terms how alike they are, for short texts as for long ones.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import session_constant, stored

#: Terms in over 5 % of the documents, or in under one of 10,000, are not of the lexicon.
IDF_BAND = (3.0, 9.2)
FAMILIES, LEVELS = 8, 16
#: Terms of the lexicon in a bucket, on average.
BUCKET = 4
#: Code points of text in a part of the table, on average.
PART_CHARS = 128_000_000


def terms(text: Column) -> Column:
    """Hashes of the distinct lower-cased words of a text, sorted; words end at ASCII white space."""
    text = F.lower(F.coalesce(text, F.lit("")))
    for space in "\t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(space), F.lit(" "))
    hashes = F.array_distinct(F.transform(F.split(text, " "), lambda w: F.xxhash64(w)))
    return F.sort_array(F.array_remove(hashes, F.xxhash64(F.lit(""))))


def lexicon(texts: DataFrame, idf_band: tuple[float, float] = IDF_BAND) -> DataFrame:
    """term, for every term of the band. texts: text. Terms of a single document count as rare enough in any table, so
    that tables of few rows have a lexicon."""
    size = texts.agg(F.greatest(F.count("*"), F.lit(1)).alias("n"))
    counts = texts.select(F.explode(terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("docs"))
    idf = F.log(F.col("n") / F.col("docs"))
    return counts.crossJoin(F.broadcast(size)).where(((idf >= idf_band[0]) | (F.col("docs") == 1)) & (idf <= idf_band[1])).select("term")


def bucketed(found: DataFrame) -> DataFrame:
    """One row, one column: the terms as an array of buckets, a power of two of them; a term's bucket is its remainder."""
    size = 1 << max(0, math.ceil(math.log2(max(1, found.count() / BUCKET))))
    held = found.groupBy(F.pmod("term", F.lit(size)).cast("int").alias("bucket")).agg(F.collect_list("term").alias("terms"))
    every = found.sparkSession.range(size).select(F.col("id").cast("int").alias("bucket")).join(held, "bucket", "left")
    dense = every.select("bucket", F.coalesce("terms", F.array().cast("array<long>")).alias("terms"))
    return dense.agg(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "terms"))), lambda x: x["terms"]).alias("buckets"))


def kept(own: Column, buckets: Column) -> Column:
    """Those of the terms that the lexicon holds."""
    size = F.size(buckets).cast("long")
    return F.filter(own, lambda t: F.array_contains(F.get(buckets, F.pmod(t, size).cast("int")), t))


def _short(own: Column) -> Column:
    """32 bits of the hash of sorted terms; 0 if there are none."""
    return F.shiftrightunsigned(F.xxhash64(own), 32)


def with_print(df: DataFrame, text: str, buckets: Column, name: str) -> DataFrame:
    """df with the fingerprint of column text: struct(terms, whole, subsets): the number of kept terms, the hash of all of
    them, and the hashes of the subsets, level by level. The steps are columns of their own, so that each is worked out once."""
    columns = df.columns
    df = df.withColumn("_own", kept(terms(F.col(text)), buckets))
    df = df.withColumn("_again", F.transform("_own", lambda t: F.xxhash64(t)))

    def of(array: str, family: int, level: int) -> Column:
        bits = ((1 << level) - 1) << (LEVELS * (family % 4))
        return F.filter(array, lambda t: t.bitwiseAND(F.lit(bits - (1 << 64) if bits >> 63 else bits)) == 0)

    source = lambda family: "_own" if family < 4 else "_again"
    thin = 3  # subsets from this level on are taken from the one of this level
    df = df.withColumns({f"_thin{k}": of(source(k), k, thin) for k in range(FAMILIES)})
    cells = [_short(of(source(k) if level < thin else f"_thin{k}", k, level)) for level in range(1, LEVELS + 1) for k in range(FAMILIES)]
    return df.select(*columns, F.struct(F.size("_own").alias("terms"), F.xxhash64("_own").alias("whole"), F.array(*cells).alias("subsets")).alias(name))


def as_string(print_: Column) -> Column:
    """The number of terms, the hash of all as 16 hex digits, and those of the subsets as 8 each, without trailing zeros."""
    digits = F.array_join(F.transform(print_["subsets"], lambda h: F.lpad(F.lower(F.hex(h)), 8, "0")), "")
    return F.concat_ws(":", print_["terms"], F.lpad(F.lower(F.hex(print_["whole"])), 16, "0"), F.rtrim(digits, F.lit("0")))


def likeness(a: Column, b: Column) -> Column:
    """How much of the kept terms of both texts they share (Jaccard), 0 to 1, as told by the subsets on which they agree:
    1 if they agree on all terms (or have none), 0 if they agree on no subset that holds a term."""
    same = F.filter(F.zip_with(a["subsets"], b["subsets"], lambda x, y: F.when(x == y, x)), lambda x: x.isNotNull())
    left = F.lit(float(LEVELS)) - F.size(same) / F.lit(float(FAMILIES))
    # the sum over levels of 1 - exp(-d / 2 ** l) is log2(d) + 0.333 for large d; 0 for none, 1 for one
    differ = (F.pow(F.lit(2.0), left) - 1) * F.lit(2 ** -0.333)
    total = a["terms"] + b["terms"]
    share = F.greatest(F.lit(0.0), 1 - 2 * differ / (total + differ))
    return F.when((a["whole"] == b["whole"]) & (a["terms"] == b["terms"]), 1.0).when(F.exists(same, lambda x: x != 0), share).otherwise(0.0)


def _following():
    return Window.partitionBy("part").orderBy("guest", F.col("doc").asc_nulls_first(), "text_hash")


def with_next(docs: DataFrame, parts: int) -> DataFrame:
    """doc, text (null as empty), next_text and next_doc of the following row by ascending doc (ties by the text's hash); the last is
    followed by the first.

    The rows are dealt into parts by quantiles of doc, and each part also gets, as a guest, the first row of the next one,
    so texts are shuffled once and no task sees more than a part. Rows that share a doc, or have none, are of one part.
    """
    spread = docs.agg(F.percentile_approx("doc", [k / parts for k in range(1, parts)] or [0.5], 10 * parts).alias("cuts")).first()["cuts"] or []
    cuts = sorted(set(spread)) if parts > 1 else []
    side = max(1, int(len(cuts) ** 0.5))
    runs = [cuts[i : i + side] for i in range(0, len(cuts), side)]
    number = F.lit(0)
    if runs:  # the part is the number of cuts below the row, counted in two steps
        heads = F.array(*[F.lit(r[0]) for r in runs])
        table = F.array(*[F.array(*[F.lit(c) for c in r]) for r in runs])
        run = F.size(F.filter(heads, lambda c: c < F.col("doc")))
        number = F.when(run == 0, 0).otherwise((run - 1) * side + F.size(F.filter(F.get(table, run - 1), lambda c: c < F.col("doc"))))
    rows = docs.withColumn("part", F.coalesce(number, F.lit(0)).cast("int"))
    firsts = rows.groupBy("part").agg(F.min("doc").alias("doc")).collect()
    nulls = bool(firsts) and docs.where("doc is null").limit(1).count() > 0
    order = sorted((r["part"], r["doc"]) for r in firsts) if not any(r["doc"] is None for r in firsts) else sorted(((r["part"], r["doc"]) for r in firsts), key=lambda x: x[0])
    before = {order[i][0]: order[i - 1][0] for i in range(len(order))}
    starts = [(part, None if nulls and part == order[0][0] else doc, before[part]) for part, doc in order]
    guests = None
    if starts:
        known = docs.sparkSession.createDataFrame(starts, "_p int, _d " + dict(docs.dtypes)["doc"] + ", _to int")
        wanted = [d for _, d, _ in starts if d is not None]
        picked = rows.where(F.col("doc").isin(wanted) | (F.col("doc").isNull() if nulls else F.lit(False)))
        guests = picked.join(F.broadcast(known), (F.col("part") == F.col("_p")) & F.col("doc").eqNullSafe(F.col("_d"))).select("doc", "text", F.col("_to").alias("part"), F.lit(True).alias("guest"))
        guests = guests.groupBy("part", "doc", "guest").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("doc", "text", "part", "guest")
    rows = rows.select("doc", "text", "part", F.lit(False).alias("guest"))
    both = rows if guests is None else rows.unionByName(guests)
    own = _following()
    both = both.withColumn("text_hash", F.xxhash64("text"))
    return both.withColumns({"next_doc": F.lead("doc").over(own), "next_text": F.lead("text").over(own)})


def edited(text: Column, other: Column) -> Column:
    """The text with its last quarter of code points replaced by the first as many (or all) of the other text."""
    n = F.floor(F.length(text) / 4).cast("int")
    return F.concat(F.substr(text, F.lit(1), F.length(text) - n), F.substr(other, F.lit(1), n))


def fingerprint_with_edits(docs: DataFrame, idf_band: tuple[float, float] = IDF_BAND, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """doc, n_chars, edited (the text), print, edited_print, near_edited, near_next of every row.

    Null texts count as empty. Rows that repeat an id follow one another in the order of their texts' hashes; rows without
    an id come first. Texts without a term of the lexicon, such as empty ones, have equal fingerprints, which are alike. Equal
    texts have equal fingerprints. A single row is followed by itself. Texts are worked on whole, however long. Other columns
    are ignored, whatever their names. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").alias("doc"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    buckets = session_constant(bucketed(stored(lexicon(rows.select("text"), idf_band), "lexicon")))
    if parts is None:
        chars = rows.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(chars / PART_CHARS))
    paired = with_next(rows, parts)
    # what the guests are compared with is their own fingerprint alone
    changed = F.when(F.col("guest"), F.lit("")).otherwise(edited(F.col("text"), F.col("next_text")))
    paired = paired.withColumn("edited", changed).drop("next_text", "next_doc").withColumn("n_chars", F.length("text").cast("long"))
    printed = with_print(paired, "text", buckets, "print").drop("text")
    printed = with_print(printed, "edited", buckets, "edited_print")
    done = printed.withColumn("next_print", F.lead("print").over(_following())).where("not guest")
    return done.select("doc", "n_chars", "edited", "print", "edited_print", likeness(F.col("print"), F.col("edited_print")).alias("near_edited"), likeness(F.col("print"), F.col("next_print")).alias("near_next"))
