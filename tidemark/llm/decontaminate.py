"""Benchmark decontamination by pigeonhole edit matching.

An item with an error budget of k edits is cut into k + 1 pieces; a passage within the budget leaves at least one piece
whole. An item with pieces that many others share (such as the words of a template) is cut into more, n of them, if fewer
than n - k are shared: a passage leaves n - k whole, so one of the others is among them and only the others are looked for.
All pieces of a block of items are found in one Aho-Corasick pass over each text, each hit names the stretch of text where
the item would lie, and Myers' bit-parallel algorithm gives the smallest edit distance inside that stretch.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import boxed, columns_apart, stored, unboxed

#: Characters of items in one broadcast block; a larger benchmark takes more passes over the documents.
BLOCK_CHARS = 8_000_000
#: Normal characters under which an item is looked for word for word alone, between word bounds.
EXACT_CHARS = 24
#: Items that may share a piece before another cut is tried, the most pieces beyond k + 1, and the least length of one then.
SHARED, MORE_PIECES, LEAST_PIECE = 16, 8, 6


def normal(text: str) -> str:
    """Lower-cased, white space as single spaces."""
    return " ".join(text.lower().split())


def budget(length: int, error_rate: float) -> int:
    return int(length * error_rate)


def pieces(item: str, k: int, more: int = 0) -> list[tuple[int, str]]:
    """The item cut into k + 1 + more stretches of nearly equal length, with their starts."""
    n = k + 1 + more
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


def pattern_bits(item: str) -> dict[str, int]:
    bits: dict[str, int] = {}
    for i, c in enumerate(item):
        bits[c] = bits.get(c, 0) | 1 << i
    return bits


def myers(item_bits: dict[str, int], m: int, text: str, most: int) -> tuple[int, int]:
    """Smallest edit distance of the item to any stretch of text, and the first end where it is reached (exclusive).
    A distance over `most` is given as most + 1."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best, at = most + 1, -1
    for j, c in enumerate(text):
        eq = item_bits.get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph = down | ~(xh | up) & full
        mh = up & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & full
        mh = mh << 1 & full
        up = mh | ~(xv | ph) & full
        down = ph & xv
        if score < best:
            best, at = score, j + 1
    return best, at


def _found_in(wanted: set[str], texts: list[str]) -> Counter:
    """How many of the texts hold each of the strings."""
    automaton = ahocorasick.Automaton()
    for piece in wanted:
        automaton.add_word(piece, piece)
    if wanted:
        automaton.make_automaton()
    return Counter(piece for text in texts for piece in {x for _, x in automaton.iter(text)}) if wanted else Counter()


def chosen_pieces(items: list[tuple[str, int]]) -> list[list[tuple[int, str]]]:
    """The pieces to look for, for each item (text, k)."""
    first, texts = [pieces(text, k) for text, k in items], [text for text, _ in items]
    held = _found_in({p for own in first for _, p in own}, texts)
    crowded = [i for i, own in enumerate(first) if any(held[p] > SHARED for _, p in own)]
    cuts = {i: [pieces(*items[i], more) for more in range(1, MORE_PIECES + 1)] for i in crowded}
    cuts = {i: [cut for cut in own if min(len(p) for _, p in cut) >= LEAST_PIECE] for i, own in cuts.items()}
    held = _found_in({p for own in cuts.values() for cut in own for _, p in cut}, texts)
    for i in crowded:
        for cut in cuts[i]:
            rare = [(start, p) for start, p in cut if held[p] <= SHARED]
            if len(cut) - len(rare) < len(cut) - items[i][1]:
                first[i] = rare
                break
    return first


class Matcher:
    """The pieces of a block of items (item id, normal text) in one automaton. Items of one text are looked for once."""

    def __init__(self, items: list[tuple[int | None, str]], error_rate: float, exact_chars: int = EXACT_CHARS):
        ids: dict[str, list[int | None]] = {}
        for item_id, text in items:
            if text and item_id not in (own := ids.setdefault(text, [])):
                own.append(item_id)
        budgets = [(text, budget(len(text), error_rate) if len(text) >= exact_chars else 0) for text in ids]
        self.items = [(ids[text], text, k, pattern_bits(text), len(text) < exact_chars) for text, k in budgets]
        owners: dict[str, list[tuple[int, int]]] = {}
        for index, own in enumerate(chosen_pieces(budgets)):
            for start, piece in own:
                owners.setdefault(piece, []).append((index, start))
        self.automaton = ahocorasick.Automaton()
        for piece, found in owners.items():
            self.automaton.add_word(piece, (len(piece), found))
        if owners:
            self.automaton.make_automaton()
        self.empty = not owners

    def find(self, text: str) -> list[tuple[int | None, int, int, int]]:
        """(item id, distance, end in the normal text, length of the item) of every item within its budget, at its best place."""
        if self.empty:
            return []
        text = normal(text)
        spans: dict[int, list[list[int]]] = {}
        for last, (length, owners) in self.automaton.iter(text):
            begin = last - length + 1
            for index, start in owners:
                _, item, k, _, whole = self.items[index]
                if whole and (text[begin - 1 : begin].isalnum() or text[last + 1 : last + 2].isalnum()):
                    continue
                a, b = max(0, begin - start - k), min(len(text), begin - start + len(item) + k)
                own = spans.setdefault(index, [])
                # hits of one item come nearly in order, so stretches that meet are searched as one
                if own and a <= own[-1][1] and b >= own[-1][0]:
                    own[-1] = [min(a, own[-1][0]), max(b, own[-1][1])]
                else:
                    own.append([a, b])
        out = []
        for index, stretches in spans.items():
            item_ids, item, k, bits, whole = self.items[index]
            best, end = k + 1, -1
            for a, b in stretches:
                at = a if whole else text.find(item, a, b)
                score, place = (0, at - a + len(item)) if at >= 0 else myers(bits, len(item), text[a:b], k)
                if score < best:
                    best, end = score, a + place
                if not best:
                    break
            if best <= k:
                out.extend((item_id, best, end, len(item)) for item_id in item_ids)
        return out


#: The last matcher that this Python worker made, by a name of the block: the tasks that it runs share it.
_made: dict[str, Matcher] = {}


def _matcher(name: str, items, error_rate: float, exact_chars: int) -> Matcher:
    if name not in _made:
        _made.clear()
        _made[name] = Matcher(items.value, error_rate, exact_chars)
    return _made[name]


def _matches(items, error_rate: float, exact_chars: int):
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(name, items, error_rate, exact_chars)
        for batch in batches:
            rows = [
                (doc, *hit)
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
                if text
                for hit in matcher.find(text)
            ]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "item_id", "distance", "end", "item_chars"])

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, error_rate: float = 0.08, exact_chars: int = EXACT_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document and item such that the document holds the item within its budget of edits.

    doc_id, item_id, distance (the smallest), end (where that passage ends in the document's normal text, exclusive; of
    equally near passages the first), item_chars. The budget is error_rate times the item's length, rounded down; texts are
    compared lower-cased with single spaces. Items with less than exact_chars normal characters must be there word for word,
    not inside longer words. Null items, items without words and null texts match nothing; items that repeat an id with
    another text are matched each, one with a null id gives a null item_id. Rows that repeat an id give a row each, texts of
    any length are searched whole, and an empty table on either side gives none. Ids must be whole numbers; other columns are
    ignored. The items are broadcast in blocks of at most BLOCK_CHARS characters, each block being matched against all documents.
    """
    spark = docs.sparkSession
    rows = columns_apart(docs, id_col, text_col).toDF("doc", "text").select(F.col("doc").cast("long"), "text")
    items = columns_apart(benchmark, "item_id", "text").where("text is not null")
    found = None
    for block in _blocks(items):
        usable = spark.sparkContext.broadcast(_usable(block))
        part = rows.mapInArrow(_matches(usable, error_rate, exact_chars), "doc_id long, item_id long, distance long, end long, item_chars long")
        found = part if found is None else found.unionByName(part)
    return found


def _usable(items: list[tuple[int | None, str]]) -> list[tuple[int | None, str]]:
    return sorted({(i, x) for i, t in items if (x := normal(t))}, key=lambda x: (x[0] is None, x[0] or 0, x[1]))


def _blocks(items: DataFrame) -> Iterator[list[tuple[int | None, str]]]:
    """The items in blocks of at most BLOCK_CHARS characters (an item longer than that alone), read one at a time."""
    block, size, any_block = [], 0, False
    for row in items.toLocalIterator():
        if block and size + len(row["text"]) > BLOCK_CHARS:
            yield block
            block, size, any_block = [], 0, True
        block.append((row["item_id"], row["text"]))
        size += len(row["text"])
    if block or not any_block:
        yield block


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, error_rate: float = 0.08, exact_chars: int = EXACT_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the documents that hold an item; their columns. Rows without an id stay only if their text is clean
    as well: they are matched under a hash of their text."""
    rows = boxed(docs)
    key = F.xxhash64(F.col("row").getField(id_col).cast("long"), F.col("row").getField(text_col))
    keyed = rows.select(key.alias("doc_id"), F.col("row").getField(text_col).alias("text"))
    found = stored(contaminated(keyed, benchmark, error_rate, exact_chars).select("doc_id").distinct(), "contaminated")
    return rows.join(found, key == F.col("doc_id"), "left_anti").select(*unboxed(docs.columns))
