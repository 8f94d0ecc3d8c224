"""Mixing sources to target weights by entropy balancing.

Each source has a target of tokens. Among all document rates whose tokens meet the targets, those nearest to one copy of
each document in relative entropy are exponential tilts, rate = min(most, exp(tilt * size / mean size)), with one tilt for
each source: the solution of a convex dual, found here by Newton steps that each take one aggregation over the counts of
(source, size). The rates are then rounded to whole copies so that what one document rounds off the next makes up for.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import boxed, columns_apart, global_rank, stored, unboxed

#: Documents that are rounded one after another.
BLOCK = 500


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc, source, size in words, and the hash of the text, of every row."""
    rows = columns_apart(docs, id_col, text_col, source_col).toDF("doc", "text", "source")
    words = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))
    return rows.select("doc", "source", words.cast("long").alias("size"), F.xxhash64("text").alias("text_hash"))


def targets(sources: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: float = 3) -> DataFrame:
    """sources (source, source_size, documents) with target: a share of all sizes by weight, the weights repeating over the
    sources by code point, null last. A target stops at `most` times its source's size; the others share the excess."""
    ranked = global_rank(sources, [F.col("source").asc_nulls_last()], "rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = stored(ranked.withColumn("weight", weight).drop("rank"), "sources")
    limit = F.col("source_size") * F.lit(float(most))
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while total:
        full = limit < F.col("weight") * F.lit(level)
        held, weight_sum = ranked.agg(F.sum(F.when(full, limit).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        raised = (total - held) / weight_sum if weight_sum else level
        if raised <= level:
            break
        level = raised
    return ranked.withColumn("target", F.least(limit, F.col("weight") * F.lit(level)))


def tilts(counts: DataFrame, sources: DataFrame, most: float = 3, tolerance: float = 1e-7, max_steps: int = 60) -> DataFrame:
    """sources with tilt and mean: the tilt at which the rates give the source's target. Raises if that isn't reached.

    counts: source, size, n. Newton's method on the logarithm of the tokens, halving the step's bracket where a step would
    leave it (the limit on the rates can flatten the curve). One aggregation over counts for each step.
    """
    own = counts.where("size > 0").groupBy("source").agg(F.min("size").alias("smallest"), F.sum(F.col("size") * F.col("n")).alias("_s"), F.sum("n").alias("_n"))
    state = sources.join(own, sources["source"].eqNullSafe(own["source"]), "left").drop(own["source"])
    mean = F.col("_s") / F.col("_n")
    state = state.select(*sources.columns, mean.alias("mean"), F.lit(0.0).alias("tilt"), F.lit(-1e9).alias("low"), (F.lit(math.log(most)) * mean / F.col("smallest")).alias("high"))
    at_most = F.col("target") >= F.col("source_size") * F.lit(most * (1 - 1e-12))
    state = stored(state.withColumn("tilt", F.when(at_most, F.col("high")).otherwise(F.col("tilt"))), "tilts")
    keys = ["source", "mean", "tilt", "low", "high", "target", "source_size"]
    for _ in range(max_steps):
        s = state.select(*keys).withColumnRenamed("source", "_source")
        x = F.col("size") / F.col("mean")
        rate = F.least(F.lit(float(most)), F.exp(F.col("tilt") * x))
        tokens = F.col("n") * F.col("size") * rate
        sums = counts.where("size > 0").join(s, F.col("source").eqNullSafe(F.col("_source"))).groupBy("_source").agg(
            F.sum(tokens).alias("tokens"), F.sum(F.when(rate < most, tokens * x).otherwise(0.0)).alias("slope"))
        gap = F.log("tokens") - F.log("target")
        met = F.col("tokens").isNull() | (F.abs(gap) < tolerance) | (F.col("target") >= F.col("source_size") * F.lit(most * (1 - 1e-12))) | (F.col("target") <= 0)
        low, high = F.when(gap < 0, F.col("tilt")).otherwise(F.col("low")), F.when(gap > 0, F.col("tilt")).otherwise(F.col("high"))
        step = F.col("tilt") - gap * F.col("tokens") / F.col("slope")
        inside = (F.col("slope") > 0) & (step > F.col("low2")) & (step < F.col("high2"))
        moved = state.join(sums, state["source"].eqNullSafe(sums["_source"]), "left").withColumns({"met": met, "low2": low, "high2": high})
        moved = moved.withColumn("tilt2", F.when(F.col("met"), F.col("tilt")).when(inside, step).otherwise((F.greatest("low2", F.lit(-1e4)) + F.col("high2")) / 2))
        state = stored(moved.select(*sources.columns, "mean", F.col("tilt2").alias("tilt"), F.col("low2").alias("low"), F.col("high2").alias("high"), "met"), "tilts")
        open_ = state.where("not met").select("source").limit(3).collect()
        if not open_:
            break
        state = state.drop("met")
    else:
        raise RuntimeError(f"the tilts of {[r['source'] for r in open_]} did not settle in {max_steps} steps")
    return state.select(*sources.columns, "mean", "tilt")


def _copies(block: Column, most: int) -> Column:
    """Copies for the rows of a block, larger documents first: what one rounds off is carried to the next."""

    def follow(so_far: Column, x: Column) -> Column:
        step = (x["size"] * x["rows"]).cast("double")
        due = x["rate"] * step + so_far["behind"]
        copies = F.least(F.lit(most), F.greatest(F.lit(0), F.round(F.when(step > 0, due / step).otherwise(x["rate"])).cast("int")))
        return F.struct((due - copies * step).alias("behind"), F.concat(so_far["copies"], F.array(copies)).alias("copies"))

    start = F.struct(F.lit(0.0).alias("behind"), F.array().cast("array<int>").alias("copies"))
    return F.aggregate(block, start, follow, lambda x: x["copies"])


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """How often the mix takes each document: doc, source, size, text_hash, rows, source_size, target, rate, copies.

    A row stands for all input rows with that id, source and text (`rows` of them, each taken `copies` times), so rows that
    repeat share their copies. Sizes are words; null and empty texts have size 0 and count for nothing. A null source is
    a source, the last one. An empty table gives an empty table. Copies are whole and at most `most`. Of documents of one
    size in a block, which have one rate, those first by the hash of their text and then by id are rounded first. Texts are
    counted whole, however long. Other columns are ignored, whatever their names.
    """
    rows = sized(docs, id_col, text_col, source_col)
    units = stored(rows.groupBy("doc", "source", "size", "text_hash").agg(F.count("*").alias("rows")), "units")
    counts = stored(units.groupBy("source", "size").agg(F.sum("rows").alias("n"), F.count("*").alias("units")), "sizes")
    sources = counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("units").alias("documents"))
    tilted = tilts(counts, targets(sources, weights, most), most).withColumnRenamed("source", "_source")
    tilted = tilted.withColumn("blocks", F.ceil(F.col("documents") / F.lit(BLOCK)))
    joined = units.join(tilted, units["source"].eqNullSafe(tilted["_source"]))
    rate = F.when(F.col("size") == 0, 1.0).otherwise(F.least(F.lit(float(most)), F.exp(F.col("tilt") * F.col("size") / F.col("mean"))))
    dealt = joined.select("doc", "source", "size", "text_hash", "rows", rate.alias("rate"), F.pmod(F.xxhash64("doc", "text_hash"), F.col("blocks")).alias("block"))
    row = F.struct((-F.col("size")).alias("order"), "text_hash", "doc", "size", "rows", "rate")
    blocks = dealt.groupBy("source", "block").agg(F.sort_array(F.collect_list(row)).alias("block_rows"))
    taken = blocks.select("source", "block_rows", _copies(F.col("block_rows"), most).alias("copies")).select("source", F.explode(F.arrays_zip("block_rows", "copies")).alias("x"))
    taken = taken.select(*[F.col("x.block_rows")[c].alias(c) for c in ("doc", "size", "text_hash", "rows", "rate")], "source", F.col("x.copies").cast("long").alias("copies"))
    facts = tilted.select("_source", "source_size", "target")
    return taken.join(facts, taken["source"].eqNullSafe(facts["_source"])).drop("_source")


def attach_copies(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs with size, copies and taken (size times copies) from mix_sources(docs); input columns of these names are replaced."""
    columns = [c for c in docs.columns if c not in ("size", "copies", "taken")]
    facts = mixed.select("doc", "source", "text_hash", "size", "copies", (F.col("size") * F.col("copies")).alias("taken"))
    own = F.col("row").getField
    same = own(id_col).eqNullSafe(F.col("doc")) & own(source_col).eqNullSafe(F.col("source")) & (F.xxhash64(own(text_col)) == F.col("text_hash"))
    return boxed(docs).join(facts, same).select(*unboxed(columns), "size", "copies", "taken")
