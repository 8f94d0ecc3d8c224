"""SimHash near-dedup with a Gray-order hierarchical index.

The index is built over distance + 1 rotations of the fingerprints, each led by another of as many bit segments: two
fingerprints within the distance agree on one whole segment, so in that rotation they lie under one top node, which the
leading segment names. That number of rotations doesn't depend on how many fingerprints there are. Below the top nodes
the fingerprints of a page (a task's share of them, or a part of a top node that is too large for one task) are sorted by
Gray rank; runs of them are leaves, and each node above carries the bits that all fingerprints below it share (mask and
pattern). Pairs of nodes descend from the root: a pair whose shared bits differ in the leading segment, or in more than
`distance` places altogether, is pruned with all that is below it; the differences only add up on the way down, since a
child's mask holds its parent's. Pages of one top node are nodes themselves: their masks and patterns are joined first, and
only pages that survive meet. Only links that join two parts are returned, so groups of copies give as many rows as members.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import boxed, columns_apart, components, stored, unboxed

#: Fingerprints of a leaf, and children of a node.
LEAF, FAN = 16, 4
#: Fingerprints of a page, the part of the index that a task holds at once.
PAGE = 1 << 16
#: Pairs of nodes, and of leaves, that are looked at together.
NODE_PAIRS, LEAF_PAIRS = 1 << 13, 1 << 10
SEED = 42
#: Keys of MinHash that bring similar texts together: at a similarity of 0.8 all BANDS of BAND_ROWS miss one pair in 1,300.
BANDS, BAND_ROWS = 10, 3
#: Texts of a part in a block of a group, with their sketches or their shingles; a task holds two blocks at once.
SKETCHES, TEXTS = 2048, 512
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 of every shingle of the lower-cased text; fewer words make one shingle, none make none."""
    found = text.lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(found) - words + 1)
    hashed = xxhash.xxh64_intdigest
    last = ends[min(words, len(found)) - 1 :]
    return np.fromiter((hashed(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), last.tolist(), strict=True)), np.uint64, n)


class _WordHashes(dict):
    """XXH64 of words, remembered while there are not too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1 << 16:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word, SEED)
        return found


_words = _WordHashes()


def _scrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: bytes) -> np.ndarray:
    """XXH64 of every word of the lower-cased text."""
    found = text.lower().split()
    return np.fromiter(map(_words.__getitem__, found), np.uint64, len(found))


def shingle_set(hashes: np.ndarray, words: int) -> np.ndarray:
    """The distinct shingles of a text as hashes of its word hashes, sorted; fewer words make one shingle, none make none."""
    if not len(hashes):
        return hashes
    n, width = max(1, len(hashes) - words + 1), min(words, len(hashes))
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out = _scrambled(out * _MULTIPLIER + hashes[k : k + n])
    return np.unique(out)


def majority(hashes: np.ndarray) -> np.ndarray:
    """A bit for each bit of the hashes (n by k uint64): set in over half of them."""
    n, k = hashes.shape
    counts = np.zeros(64 * k, np.int64)
    for i in range(0, n, 8192):
        bits = np.unpackbits(np.ascontiguousarray(hashes[i : i + 8192]).view(np.uint8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.uint32)
    return np.packbits(2 * counts > n, bitorder="little").view(np.uint64)


def _mixed(hashes: np.ndarray) -> np.ndarray:
    """Four independent 64-bit hashes of each hash."""
    return np.stack([_scrambled(hashes + np.uint64((int(_MULTIPLIER) * k) % 2**64)) for k in range(1, 5)], axis=1)


def min_bands(hashes: np.ndarray) -> list[int]:
    """BANDS keys (signed), each of BAND_ROWS smallest values under hashes of the shingles; two texts agree in one of them with
    a chance of their similarity to the power of BAND_ROWS, whatever their lengths."""
    lows = np.empty(BANDS * BAND_ROWS, np.uint64)
    for k in range(len(lows)):
        x = (hashes ^ np.uint64(int(_MULTIPLIER) * (k + 1) % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
        lows[k] = ((x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)).min()
    return [int(np.int64(np.uint64(xxhash.xxh64_intdigest(row.tobytes(), SEED)).view(np.int64))) for row in lows.reshape(BANDS, BAND_ROWS)]


def fingerprint(text: str | None, words: int) -> int:
    """The SimHash of a text, unsigned; 0 if it has no words."""
    hashes = shingle_hashes((text or "").encode(), words)
    return int(majority(hashes[:, None])[0]) if len(hashes) else 0


def _signed(hashes: np.ndarray) -> int:
    return int(majority(hashes[:, None]).view(np.int64)[0]) if len(hashes) else 0


def fingerprints(docs: DataFrame, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc and print (a signed long with the 64 bits) of every row; a null text has no words and the print 0. A text of any
    length is worked through shingle by shingle. Ids must be whole numbers or casts of them; other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [_signed(shingle_hashes((text or "").encode(), words)) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())], ["doc", "print"])

    rows = columns_apart(docs, id_col, text_col).toDF("doc", "text").select(F.col("doc").cast("long"), "text")
    return rows.mapInArrow(run, "doc long, print long")


def sketches(docs: DataFrame, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row doc, text_hash, print (the SimHash of the distinct words), sketch (a 256-bit SimHash of the distinct
    shingles, binary) and bands (min_bands() of these; empty for a text without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, wide, keys = [], [], []
            for text in batch.column(2).to_pylist():
                own = word_hashes((text or "").encode())
                shingles = shingle_set(own, words)
                prints.append(_signed(np.unique(own)))
                wide.append(majority(_mixed(shingles)).tobytes() if len(own) else bytes(32))
                keys.append(min_bands(shingles) if len(own) else [])
            columns = [batch.column(0), batch.column(1), pa.array(prints, pa.int64()), pa.array(wide, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc", "text_hash", "print", "sketch", "bands"])

    rows = columns_apart(docs, id_col, text_col).toDF("doc", "text").select(F.col("doc").cast("long"), F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(run, "doc long, text_hash long, print long, sketch binary, bands array<long>")


# -- the index ----------------------------------------------------------------------------------------------------------


def gray_rank(prints: np.ndarray) -> np.ndarray:
    """The position of each code word in the reflected Gray code."""
    out = prints.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(shift)
    return out


def segments(distance: int) -> list[tuple[int, int]]:
    """(lowest bit, number of bits) of each of the distance + 1 segments."""
    cuts = [round(64 * k / (distance + 1)) for k in range(distance + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _mask(segment: tuple[int, int]) -> int:
    return ((1 << segment[1]) - 1) << segment[0]


class _Parts:
    """Labels of connected parts: the smallest member."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.of[a], self.of[b]
            low, high = np.minimum(x, y), np.maximum(x, y)
            apart = low < high
            if not apart.any():
                return
            a, b = a[apart], b[apart]
            np.minimum.at(self.of, high[apart], low[apart])
            while True:
                jumped = self.of[self.of]
                if (jumped == self.of).all():
                    break
                self.of = jumped


def _levels(prints: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(mask, pattern) of the nodes of each level, leaves first."""
    ones = np.bitwise_and.reduceat(prints, np.arange(0, len(prints), LEAF))
    zeros = np.bitwise_and.reduceat(~prints, np.arange(0, len(prints), LEAF))
    levels = [(ones | zeros, ones)]
    while len(ones) > 1:
        at = np.arange(0, len(ones), FAN)
        ones, zeros = np.bitwise_and.reduceat(ones, at), np.bitwise_and.reduceat(zeros, at)
        levels.append((ones | zeros, ones))
    return levels


def descend(p: np.ndarray, distance: int, lead: int, settled: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of positions u < v of fingerprints p (sorted by Gray rank) within the distance that agree in the bits of `lead`,
    found by descending the index from its root. settled: tells pairs of leaves that need not be compared any more."""
    n = len(p)
    levels, lead = _levels(p), np.uint64(lead)
    stack = [(len(levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    child = np.arange(FAN)
    member = np.arange(LEAF)
    while stack:
        depth, a, b = stack.pop()
        if len(a) > NODE_PAIRS:
            stack += [(depth, a[i : i + NODE_PAIRS], b[i : i + NODE_PAIRS]) for i in range(0, len(a), NODE_PAIRS)]
            continue
        mask, pattern = levels[depth]
        differ = (pattern[a] ^ pattern[b]) & mask[a] & mask[b]
        alive = (np.bitwise_count(differ) <= distance) & (differ & lead == 0)
        a, b = a[alive], b[alive]
        if not len(a):
            continue
        if depth:
            x, y = np.broadcast_arrays(a[:, None, None] * FAN + child[None, :, None], b[:, None, None] * FAN + child[None, None, :])
            x, y = x.ravel(), y.ravel()
            there = (x <= y) & (y < len(levels[depth - 1][0]))
            stack.append((depth - 1, x[there], y[there]))
            continue
        for i in range(0, len(a), LEAF_PAIRS):
            left, right = a[i : i + LEAF_PAIRS], b[i : i + LEAF_PAIRS]
            if settled is not None:
                open_ = ~settled(left, right)
                left, right = left[open_], right[open_]
            left, right = left[:, None] * LEAF + member, right[:, None] * LEAF + member
            x, y = p[np.minimum(left, n - 1)], p[np.minimum(right, n - 1)]
            differ = x[:, :, None] ^ y[:, None, :]
            k, u, v = np.nonzero((np.bitwise_count(differ) <= distance) & (differ & lead == 0))
            u, v = left[k, u], right[k, v]
            keep = (u < v) & (v < n)
            yield u[keep], v[keep]


def linked_parts(prints: np.ndarray, distance: int, segment: tuple[int, int] = (0, 0)) -> np.ndarray:
    """For each fingerprint of a page the index of the first one of its connected part, links being at most `distance` bits
    apart and equal in the segment."""
    n, low, high = len(prints), np.uint64((64 - sum(segment)) % 64), np.uint64(sum(segment) % 64)
    turned = prints << low | prints >> high if low else prints
    order = np.argsort(gray_rank(turned), kind="stable")
    p = prints[order]
    parts, starts = _Parts(n), np.arange(0, n, LEAF)

    def settled(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        least, most = np.minimum.reduceat(parts.of, starts), np.maximum.reduceat(parts.of, starts)
        return (least[a] == most[a]) & (least[b] == most[b]) & (least[a] == least[b])

    for u, v in descend(p, distance, _mask(segment), settled):
        parts.join(u, v)
    first = np.full(n, n)
    np.minimum.at(first, parts.of, order)
    out = np.empty(n, np.int64)
    out[order] = first[parts.of]
    return out


# -- searching groups in tasks --------------------------------------------------------------------------------------------


def _whole_groups(least: int, find: Callable[[pa.Table], tuple[np.ndarray, np.ndarray]]):
    """For mapInArrow over rows sorted by group: find(rows) for portions of whole groups with at least so many rows together;
    the links that it gives, a > b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def links(batch: pa.Table) -> Iterator[pa.RecordBatch]:
            a, b = find(batch) if batch.num_rows > 1 else (np.zeros(0, np.int64),) * 2
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["a", "b"])

        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows < least:
                continue
            whole = pa.Table.from_batches(held)
            group = whole.column("group").to_numpy()
            changed = np.nonzero(group[1:] != group[:-1])[0]
            done = int(changed[-1]) + 1 if len(changed) else 0
            if done:
                yield from links(whole.slice(0, done))
                held = whole.slice(done).combine_chunks().to_batches()
                rows -= done
        if rows:
            yield from links(pa.Table.from_batches(held))

    return run


def _by_index(distance: int):
    """Links by the Gray index, a page at a time."""
    cut = segments(distance)

    def find(batch: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        rows, found = {c: batch.column(c).to_numpy() for c in ("t", "print", "rep")}, []
        for t in np.unique(rows["t"]).tolist():
            own = rows["t"] == t
            root = linked_parts(rows["print"][own].view(np.uint64), distance, cut[t])
            moved = root != np.arange(len(root))
            found.append((rows["rep"][own][moved], rows["rep"][own][root[moved]]))
        a, b = (np.concatenate(x) for x in zip(*found, strict=True))
        return a, b

    return find


def _by_group(parts: Callable[[pa.Table], np.ndarray]):
    """Links within each group, by its parts."""

    def find(batch: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        group, reps = batch.column("group").to_numpy(), batch.column("rep").to_numpy()
        starts = np.concatenate(([0], np.nonzero(group[1:] != group[:-1])[0] + 1, [len(group)]))
        found = [(np.zeros(0, np.int64),) * 2]
        for i, j in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            if j - i > 1:
                root = parts(batch.slice(i, j - i))  # only this group's values become Python objects
                moved = root != np.arange(j - i)
                found.append((reps[i:j][moved], reps[i:j][root[moved]]))
        a, b = (np.concatenate(x) for x in zip(*found, strict=True))
        return a, b

    return find


def sketch_parts(wide: np.ndarray, most: int) -> np.ndarray:
    """For each 256-bit sketch (n by 4 uint64) the index of the first one of its connected part, links being at most `most`
    bits apart. Members that all later ones are already linked to need no comparison."""
    n = len(wide)
    parts = _Parts(n)
    for i in range(n - 1):
        rest = np.nonzero(parts.of[i + 1 :] != parts.of[i])[0] + i + 1
        if len(rest):
            close = rest[np.bitwise_count(wide[rest] ^ wide[i]).sum(axis=1, dtype=np.int64) <= most]
            parts.join(np.full(len(close), i), close)
    return parts.of


def similar_parts(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """For each set (distinct values) the index of the first one of its connected part, links being pairs whose exact
    Jaccard similarity is `similarity` or more."""
    n = len(sets)
    sizes = np.fromiter(map(len, sets), np.int64, n)
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    owners = np.repeat(np.arange(n), sizes)[np.argsort(codes, kind="stable")]
    starts = np.concatenate(([0], np.cumsum(np.bincount(codes))))
    ends = np.cumsum(sizes)
    parts = _Parts(n)
    for i in range(n):
        if (parts.of[i + 1 :] == parts.of[i]).all():
            continue
        own = codes[ends[i] - sizes[i] : ends[i]]
        held = starts[own + 1] - starts[own]
        at = np.repeat(starts[own] - np.cumsum(held) + held, held) + np.arange(held.sum())
        shared = np.bincount(owners[at], minlength=n)
        close = np.nonzero(shared >= similarity * (sizes[i] + sizes - shared) - 1e-9)[0]
        parts.join(np.full(len(close), i), close)
    return parts.of


def _in_blocks(keyed: DataFrame, carried: list[str], block: int, find) -> DataFrame:
    """The links a > b that find gives for the rows (carried, t, key) of each group (t, key); a group of more than `block`
    rows is searched by pairs of blocks."""
    large = keyed.groupBy("t", "key").agg(F.count("*").alias("size")).where(F.col("size") > block)
    large = large.select("t", "key", F.ceil(F.col("size") / F.lit(block)).cast("int").alias("blocks"))
    rows = keyed.join(large, ["t", "key"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    others = F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.array_remove(F.sequence(F.lit(0), F.col("blocks") - 1), F.col("own")))
    rows = rows.withColumn("own", own).select(*carried, "t", "key", "own", F.explode(others).alias("other"))
    # a 64-bit hash of the group: two groups under one hash would only be searched together
    rows = rows.select(*carried, F.xxhash64("t", "key", F.least("own", "other"), F.greatest("own", "other")).alias("group"))
    rows = rows.repartition("group").sortWithinPartitions("group").select("group", *carried)
    return rows.mapInArrow(_whole_groups(1, find), "a long, b long")


# -- links ----------------------------------------------------------------------------------------------------------------


def _gray(x: DataFrame, name: str, segment: Column) -> DataFrame:
    """x with rank: the Gray rank of column `name` turned so that the segment (struct low, bits) leads, as an ordered long."""
    turn = F.struct((64 - segment["low"] - segment["bits"]).alias("up"), (segment["low"] + segment["bits"]).alias("down"))
    x = x.withColumn("_turn", turn).withColumn("rank", F.expr(f"if(_turn.up = 0, {name}, shiftleft({name}, _turn.up) | shiftrightunsigned({name}, _turn.down))"))
    for shift in (1, 2, 4, 8, 16, 32):
        x = x.withColumn("rank", F.expr(f"rank ^ shiftrightunsigned(rank, {shift})"))
    return x.withColumn("rank", F.expr("rank ^ shiftleft(1L, 63)")).drop("_turn")


def _paged(keyed: DataFrame, distance: int, page: int) -> DataFrame:
    """keyed (print, rep, t, key) with a and b: rows of one (t, key, a, b) meet. Top nodes of up to `page` fingerprints are one
    page; larger ones are cut into pages by quantiles of the Gray rank, and a page meets itself and those pages of its top node
    whose shared bits differ from its own in no more than `distance` places."""
    large = keyed.groupBy("t", "key").agg(F.count("*").alias("size")).where(F.col("size") > page)
    large = stored(large.select("t", "key", F.ceil(F.col("size") / F.lit(page)).cast("int").alias("pages")), "top-nodes")
    most = large.agg(F.max("pages")).first()[0]
    if most is None:
        return keyed.withColumns({"a": F.lit(0), "b": F.lit(0)})
    cut = F.array(*[F.struct(F.lit(low).alias("low"), F.lit(bits).alias("bits")) for low, bits in segments(distance)])
    inside = _gray(keyed.join(large, ["t", "key"]).withColumn("_segment", F.get(cut, F.col("t"))), "print", F.col("_segment")).drop("_segment")
    cuts = inside.groupBy("t", "key", "pages").agg(F.percentile_approx("rank", [k / most for k in range(1, most)], 10 * most).alias("all"))
    chosen = F.filter("all", lambda x, i: F.floor((i + 1) * F.col("pages") / F.lit(most)) > F.floor(i * F.col("pages") / F.lit(most)))
    cuts = stored(cuts.select("t", "key", chosen.alias("cuts")), "pages")
    rows = inside.join(cuts, ["t", "key"]).select("print", "rep", "t", "key", F.size(F.filter("cuts", lambda c: c < F.col("rank"))).alias("page"))
    nodes = rows.groupBy("t", "key", "page").agg(F.bit_and("print").alias("ones"), F.bit_and(F.bitwise_not("print")).alias("zeros"))
    nodes = stored(nodes, "page-nodes")
    own = nodes.select("t", "key", F.col("page").alias("a"), F.col("ones").alias("a1"), (F.col("ones").bitwiseOR(F.col("zeros"))).alias("a0"))
    other = nodes.select("t", "key", F.col("page").alias("b"), F.col("ones").alias("b1"), (F.col("ones").bitwiseOR(F.col("zeros"))).alias("b0"))
    pairs = stored(own.join(other, ["t", "key"]).where(f"a <= b and bit_count((a1 ^ b1) & a0 & b0) <= {distance}").select("t", "key", "a", "b"), "page-pairs")
    meets = pairs.withColumn("page", F.col("a")).unionByName(pairs.where("a < b").withColumn("page", F.col("b")))
    small = keyed.join(large.select("t", "key"), ["t", "key"], "left_anti").withColumns({"a": F.lit(0), "b": F.lit(0)})
    return small.unionByName(rows.join(meets, ["t", "key", "page"]).drop("page"))


def links(nodes: DataFrame, distance: int) -> DataFrame:
    """Links a > b between the reps of nodes (distinct print, rep) that span every connected part of fingerprints within the
    distance of each other."""
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in map(_mask, segments(distance))]
    turns = F.array(*[F.struct(F.lit(i).alias("t"), F.col("print").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(signed)])
    keyed = nodes.select("print", "rep", F.explode(turns).alias("k")).select("print", "rep", "k.t", "k.key")
    rows = _paged(keyed, distance, PAGE).select("print", "rep", "t", F.xxhash64("t", "key", "a", "b").alias("group"))
    rows = rows.repartition("group").sortWithinPartitions("group").select("group", "t", "print", "rep")
    return rows.mapInArrow(_whole_groups(PAGE, _by_index(distance)), "a long, b long")


def band_links(nodes: DataFrame, most: int) -> DataFrame:
    """Links a > b between the reps of nodes (rep, sketch, bands) that agree in a band and whose sketches are at most `most`
    bits apart, spanning the parts of each band's groups."""
    keyed = nodes.select("rep", "sketch", F.posexplode("bands").alias("t", "key"))
    wide = lambda rows: sketch_parts(np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint64).reshape(-1, 4), most)
    return _in_blocks(keyed, ["rep", "sketch"], SKETCHES, _by_group(wide))


def exact_links(texts: DataFrame, similarity: float, words: int) -> DataFrame:
    """Links a > b that span the parts of texts (rep, key, text) whose exact similarity is enough, within each key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                sets = [shingle_set(word_hashes(x.encode()), words).tobytes() for x in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("rep"), pa.array(sets, pa.binary())], ["key", "rep", "shingles"])

    sets = stored(texts.select("key", "rep", "text").mapInArrow(run, "key long, rep long, shingles binary"), "shingles")
    alike = lambda rows: similar_parts([np.frombuffer(x, np.uint64) for x in rows.column("shingles").to_pylist()], similarity)
    return _in_blocks(sets.withColumn("t", F.lit(0)), ["rep", "shingles"], TEXTS, _by_group(alike))


def near_duplicates(prints: DataFrame, distance: int = 4) -> DataFrame:
    """doc, print and component (the smallest doc that links reach, itself included) for every row of fingerprints().

    Rows with one fingerprint are one node. Rows with a null doc get the component of their fingerprint, null if only
    such rows hold it. Columns other than doc and print are ignored. An empty table gives an empty table.
    """
    nodes = stored(prints.groupBy("print").agg(F.min("doc").alias("rep")).where("rep is not null"), "nodes")
    roots = components(links(nodes, distance))
    named = nodes.join(roots, nodes["rep"] == roots["node"], "left").select("print", F.coalesce("root", "rep").alias("component"))
    return prints.select("doc", "print").join(named, "print", "left").select("doc", "print", "component")


def drop_near_duplicates(docs: DataFrame, similarity: float = 0.8, words: int = 5, distance: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row left of each group of near-duplicates: that with the smallest id.

    Texts are linked if the exact similarity (Jaccard) of their sets of word shingles is `similarity` or more; what links
    reach is a group, and all texts without words (null, empty, white space) are one. Candidates are within `distance` bits of
    each other in the SimHash of distinct words, by the Gray index, or agree in a band of MinHash and have 256-bit SimHashes of
    shingles no more than five standard deviations beyond what the similarity gives. Candidates that hang together are compared
    exactly, each with all others that aren't linked yet. Rows go by id and text: of rows that repeat an id only equal or linked
    texts are reduced, to the first by the hash of the text and then of the row. Rows without an id stay. Columns of any name
    may be there; those of docs are returned. An empty table gives an empty table.
    """
    # for texts of other lengths the angle between the sets is smaller at the same similarity, so the limit holds for them too
    cosine = 2 * similarity / (1 + similarity)
    share = math.acos(cosine) / math.pi
    limit = math.floor(256 * share + 5 * math.sqrt(256 * share * (1 - share)))
    prints = stored(sketches(docs, words, id_col, text_col), "sketches")
    worded = F.size("bands") > 0
    named = prints.where("doc is not null").withColumn("rep", F.when(worded, F.xxhash64("print", "sketch")).otherwise(F.lit(0).cast("long")))
    first = F.min(F.struct("doc", "text_hash")).alias("first")
    nodes = stored(named.groupBy("rep").agg(F.min("print").alias("print"), F.min("sketch").alias("sketch"), first, F.min("bands").alias("bands")), "nodes")
    several = nodes.where(worded)
    found = links(several.groupBy("print").agg(F.min("rep").alias("rep")), distance)
    same = several.join(several.groupBy("print").agg(F.min("rep").alias("b")), "print").where("rep <> b").select(F.greatest("rep", "b").alias("a"), F.least("rep", "b").alias("b"))
    roots = stored(components(found.unionByName(same).unionByName(band_links(several, limit))), "candidates")
    roots = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    wanted = several.join(roots, several["rep"] == roots["node"]).select("rep", F.col("root").alias("key"), "first.doc", "first.text_hash")
    texts = columns_apart(docs, id_col, text_col).toDF("doc", "text").select(F.col("doc").cast("long"), "text", F.xxhash64("text").alias("text_hash"))
    texts = texts.join(wanted, ["doc", "text_hash"]).select("rep", "key", "text").dropDuplicates(["rep"])
    roots = components(exact_links(texts, similarity, words))
    groups = nodes.join(roots, nodes["rep"] == roots["node"], "left").select("rep", "first", F.coalesce("root", "rep").alias("root"))
    groups = stored(groups, "groups")
    least = groups.groupBy("root").agg(F.min("first").alias("kept"))
    groups = groups.join(least, "root").select("rep", "kept")
    gone = named.join(groups, "rep").where("doc <> kept.doc or not text_hash <=> kept.text_hash").select("doc", "text_hash").distinct()
    doc, text = F.col("row").getField(id_col).cast("long"), F.col("row").getField(text_col)
    keyed = boxed(docs).withColumns({"doc": doc, "text_hash": F.xxhash64(text)})
    alive = keyed.join(gone, ["doc", "text_hash"], "left_anti")
    twice = named.groupBy("doc", "text_hash").agg(F.count("*").alias("n")).where("n > 1").select("doc", "text_hash")
    twice = stored(twice, "repeats")
    if not twice.isEmpty():
        one = alive.join(twice, ["doc", "text_hash"], "left_semi").groupBy("doc", "text_hash").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
        alive = alive.join(twice, ["doc", "text_hash"], "left_anti").select("row").unionByName(one.select("row"))
    return alive.select(*unboxed(docs.columns))
