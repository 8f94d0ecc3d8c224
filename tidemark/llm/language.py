"""Language ID with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram's vector binds its letters' vectors, each permuted by its place;
a text's vector bundles (sums) those of its trigrams, a language's prototype those of its training texts. A text gets the
language whose prototype has the largest cosine with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import columns_apart

DIMENSIONS = 512
SEED = 7
UNKNOWN = "und"
#: Characters and texts that are turned into vectors together.
GROUP_CHARS, GROUP_TEXTS = 200_000, 32

_letters: dict[int, np.ndarray] = {}
_alpha: list[np.ndarray] = []


def letter_vector(code: int) -> np.ndarray:
    found = _letters.get(code)
    if found is None:
        if len(_letters) > 20_000:
            _letters.clear()
        found = _letters[code] = (2 * np.random.default_rng([SEED, code]).integers(0, 2, DIMENSIONS) - 1).astype(np.int8)
    return found


def letters_only(text: str | None) -> np.ndarray:
    """Code points of the lower-cased letters with one space wherever others stood, and at both ends; empty without letters."""
    if not _alpha:
        _alpha.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    codes = np.frombuffer(f" {(text or '').lower()} ".encode("utf-32-le", "replace"), np.uint32)
    codes = np.where(_alpha[0][codes], codes, np.uint32(32))
    codes = codes[np.concatenate(([True], (codes[1:] != 32) | (codes[:-1] != 32)))]
    return codes if len(codes) > 1 else codes[:0]


def bundled(texts: list[np.ndarray], owner: np.ndarray, owners: int) -> np.ndarray:
    """A vector for each owner: the sum over the trigrams of its texts (results of letters_only)."""
    keys, rows = [], []
    for codes, own in zip(texts, owner.tolist(), strict=True):
        if len(codes) >= 3:
            wide = codes.astype(np.int64)
            keys.append(wide[:-2] << 42 | wide[1:-1] << 21 | wide[2:])
            rows.append(np.full(len(codes) - 2, own))
    if not keys:
        return np.zeros((owners, DIMENSIONS))
    distinct, which = np.unique(np.concatenate(keys), return_inverse=True)
    counts = np.bincount(np.concatenate(rows) * len(distinct) + which, minlength=owners * len(distinct)).reshape(owners, len(distinct))
    places = np.stack([distinct >> 42, distinct >> 21 & 0x1FFFFF, distinct & 0x1FFFFF])
    codes, at = np.unique(places, return_inverse=True)
    at = at.reshape(places.shape)
    vectors = np.stack([letter_vector(c) for c in codes.tolist()])
    out = np.zeros((owners, DIMENSIONS))
    for i in range(0, len(distinct), 16384):
        part = slice(i, i + 16384)
        bound = np.roll(vectors, 2, axis=1)[at[0, part]] * np.roll(vectors, 1, axis=1)[at[1, part]] * vectors[at[2, part]]
        out += counts[:, part].astype(np.float32) @ bound.astype(np.float32)
    return out


def _groups(texts: list[str | None]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(number of the first, results of letters_only) of texts that come to GROUP_CHARS together; a longer text is alone, so
    that its many trigrams aren't counted for others."""
    group, start, size = [], 0, 0
    for i, text in enumerate(texts):
        codes = letters_only(text)
        if group and (size + len(codes) > GROUP_CHARS or len(group) >= GROUP_TEXTS):
            yield start, group
            group, start, size = [], i, 0
        group.append(codes)
        size += len(codes)
    if group:
        yield start, group


def _bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for start, group in _groups(texts):
            own = langs[start : start + len(group)]
            names = sorted(set(own))
            owner = np.array([names.index(x) for x in own])
            for name, vector in zip(names, bundled(group, owner, len(names)), strict=True):
                sums[name] = sums[name] + vector if name in sums else vector
    for name, vector in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([name] * DIMENSIONS), pa.array(range(DIMENSIONS), pa.int32()), pa.array(np.rint(vector).astype(np.int64))], ["lang", "i", "v"])


def prototypes(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> tuple[list[str], np.ndarray]:
    """The languages of docs, sorted, and their prototypes (unit vectors), from all texts with a language.

    Each task bundles its own texts; one sum for each language and dimension goes to the driver. Languages whose texts have
    no letters are not learned.
    """
    rows = columns_apart(docs, lang_col, text_col).toDF("lang", "text").where("lang is not null and text is not null")
    parts = rows.mapInArrow(_bundle, "lang string, i int, v long")
    found = parts.groupBy("lang", "i").agg(F.sum("v").cast("double").alias("v")).toPandas()
    names, vectors = [], []
    for name, own in found.groupby("lang", sort=True):
        vector = np.zeros(DIMENSIONS)
        vector[own["i"].to_numpy()] = own["v"].to_numpy()
        if vector.any():
            names.append(name)
            vectors.append(vector / np.linalg.norm(vector))
    return names, np.array(vectors).reshape(-1, DIMENSIONS)


def classify(texts: list[str | None], names: list[str], units: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The language of each text and the cosine with its prototype, 0 if negative; UNKNOWN and 0 without letters."""
    langs, scores = [], []
    for _, group in _groups(texts):
        vectors = bundled(group, np.arange(len(group)), len(group))
        norms = np.linalg.norm(vectors, axis=1)
        cosines = vectors @ units.T / np.maximum(norms, 1e-12)[:, None] if names else np.zeros((len(group), 0))
        for codes, row in zip(group, cosines, strict=True):
            known = len(codes) >= 3 and len(row) > 0
            langs.append(names[int(row.argmax())] if known else UNKNOWN)
            scores.append(min(1.0, max(0.0, float(row.max()))) if known else 0.0)
    return langs, np.array(scores)


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc, lang_pred and score of every row. A text that is null or has no letters is `und` with score 0, as is any text
    if no language was learned; equal cosines give the first language by name. Rows that repeat an id give a row each, texts
    of any length count whole, an empty table gives none. Ids must be whole numbers; other columns are ignored."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = classify(batch.column(1).to_pylist(), *held.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc", "lang_pred", "score"])

    rows = columns_apart(docs, id_col, text_col).toDF("doc", "text").select(F.col("doc").cast("long"), "text")
    return rows.mapInArrow(run, "doc long, lang_pred string, score double")
