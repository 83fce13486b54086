"""Language identification by prediction by partial matching over bytes.

For each language the context trees of orders 0 to 3 are counted over a bounded sample of its
labelled documents (``TRAIN_DOCS`` a language, those with the least hash of doc_id) and then
frozen. A byte is coded in its longest known context; the probability of a byte that the context
hasn't seen is its escape probability (method C: kinds over total plus kinds) times the
probability in the next shorter context, down to 1/256 (no exclusions). As statistics are frozen,
the code length of a byte depends on it and the three bytes before only, so the trees are unrolled
into a table of exact code lengths and whole texts are scored by lookups. The language with the
shortest code is given.

The table goes to all tasks: 4 bytes by language, by symbol and by context of the samples. It doesn't
grow with the corpus, but does with the number of languages (5 MB for four that share a script).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import packing as P
from . import textblock as T

TRAIN_DOCS = 200
_SCHEMA = "doc_id long, language string, bits_per_byte double, margin double"


@dataclass
class Trees:
    """languages; symbol of each byte (0: never seen); row of each three-symbol context; bits by language, row and symbol."""

    languages: list[str]
    symbol: np.ndarray
    size: int
    row: np.ndarray
    bits: np.ndarray


def _contexts(data: np.ndarray, offsets: np.ndarray, symbol: np.ndarray) -> list[np.ndarray]:
    """The symbols of all bytes, and those one, two and three places before (0 before a text)."""
    s = symbol[data].astype(np.int32)
    out = [s]
    lengths = np.diff(offsets)
    starts, lengths = offsets[:-1][lengths > 0], lengths[lengths > 0]
    for k in (1, 2, 3):
        before = np.zeros_like(s)
        before[k:] = s[: max(len(s) - k, 0)]
        for j in range(k):
            at = starts[lengths > j] + j
            before[at] = 0
        out.append(before)
    return out


def train(texts: dict[str, list[str]]) -> Trees:
    """Count and unroll the trees of each language."""
    languages = sorted(texts)
    blocks = {}
    seen = np.zeros(256, bool)
    for language in languages:
        parts = list(T.text_blocks(T.lowered(pa.array(texts[language], pa.string())), 1 << 40))
        blocks[language] = [(data, offsets) for _, _, data, offsets in parts]
        for data, _ in blocks[language]:
            seen[np.unique(data)] = True
    symbol = np.zeros(256, np.uint8 if seen.sum() < 255 else np.int16)
    symbol[seen] = np.arange(1, seen.sum() + 1)
    a = int(seen.sum()) + 1
    deep = []
    for language in languages:
        for data, offsets in blocks[language]:
            s, c1, c2, c3 = _contexts(data, offsets, symbol)
            deep.append(np.unique((c3.astype(np.int64) * a + c2) * a + c1))
    known = np.unique(np.concatenate(deep)) if deep else np.zeros(0, np.int64)
    row = np.tile(np.arange(a * a, dtype=np.int32), a)
    row[known] = a * a + np.arange(len(known))
    bits = np.empty((len(languages), (a * a + len(known)) * a), np.float32)
    for i, language in enumerate(languages):
        count = [np.zeros(a), np.zeros((a, a)), np.zeros((a * a, a)), np.zeros((len(known), a))]
        for data, offsets in blocks[language]:
            s, c1, c2, c3 = (x.astype(np.int64) for x in _contexts(data, offsets, symbol))
            count[0] += np.bincount(s, minlength=a)
            count[1] += np.bincount(c1 * a + s, minlength=a * a).reshape(a, a)
            count[2] += np.bincount((c2 * a + c1) * a + s, minlength=a**3).reshape(-1, a)
            at = np.searchsorted(known, (c3 * a + c2) * a + c1)
            count[3] += np.bincount(at * a + s, minlength=len(known) * a).reshape(-1, a)
        p = np.full((1, a), 1 / 256)
        p = _mixed(count[0][None], p)
        p = _mixed(count[1], np.repeat(p, a, 0))
        p = _mixed(count[2], np.tile(p, (a, 1)))
        deepest = _mixed(count[3], p[known % (a * a)]) if len(known) else np.zeros((0, a))
        bits[i] = -np.log2(np.concatenate([p, deepest])).astype(np.float32).ravel()
    return Trees(languages, symbol, a, row, bits)


def _mixed(count: np.ndarray, shorter: np.ndarray) -> np.ndarray:
    """Probabilities in contexts with these counts; a context that was never seen gives the shorter one's."""
    total, kinds = count.sum(1, keepdims=True), (count > 0).sum(1, keepdims=True)
    base = np.maximum(total + kinds, 1)
    return np.where(total == 0, shorter, np.where(count > 0, count / base, kinds / base * shorter))


def code_lengths(column, trees: Trees) -> tuple[np.ndarray, np.ndarray]:
    """Bits (rows, languages) and bytes of each text."""
    bits = np.zeros((len(column), len(trees.languages)))
    size = np.zeros(len(column), np.int64)
    a = trees.size
    for first, last, data, offsets in T.text_blocks(T.lowered(column), 1 << 20):
        lengths = np.diff(offsets)
        size[first:last] = lengths
        if not len(data):
            continue
        s, c1, c2, c3 = _contexts(data, offsets, trees.symbol)
        index = trees.row[(c3 * a + c2) * a + c1] * np.int64(a) + s
        filled = np.flatnonzero(lengths)
        for k in range(len(trees.languages)):
            bits[first + filled, k] = np.add.reduceat(trees.bits[k][index], offsets[:-1][filled], dtype=np.float64)
    return bits, size


def fitted(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> Trees:
    """Trees of every language in ``lang``, from at most ``train_docs`` of its documents."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("lang").alias("label"))
    narrow = narrow.filter("id is not null and label is not null").distinct()
    nth = F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64("id"), "id"))
    chosen = narrow.withColumn("nth", nth).filter(F.col("nth") <= train_docs).drop("nth")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("lang").alias("label"), "text").filter("text is not null")
    rows = texts.join(F.broadcast(chosen), ["id", "label"]).dropDuplicates(["id", "label"]).collect()
    by: dict[str, list[str]] = {}
    for row in sorted(rows, key=lambda r: (r["label"], r["id"])):
        by.setdefault(row["label"], []).append(row["text"])
    return train(by)


def identified(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """(doc_id, language, bits_per_byte, margin) of every row.

    ``margin`` is how many more bits a byte the next best language takes; null with one language.
    A tie goes to the language that sorts first. Null and empty texts, and all texts when no row
    has a language, get nulls. A text of any length is scored whole; an empty table gives no rows.
    Repeated rows each give theirs, a null doc_id stays null; other columns are not read.
    """
    shared = P.Shared(docs.sparkSession, fitted(docs, train_docs))

    def score(batches):
        trees = shared.value
        names = np.array([*trees.languages, None], object)
        for batch in batches:
            bits, size = code_lengths(batch.column("text"), trees)
            none = (size == 0) | (len(trees.languages) == 0)
            best = np.where(none, -1, bits.argmin(1) if bits.shape[1] else -1)
            ranked = np.sort(bits, 1) / np.maximum(size, 1)[:, None]
            first = ranked[:, 0] if ranked.shape[1] else np.zeros(len(size))
            second = ranked[:, 1] if ranked.shape[1] > 1 else first
            alone = none | (ranked.shape[1] < 2)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names[best], pa.string()), pa.array(first, mask=none), pa.array(second - first, mask=alone)], ["doc_id", "language", "bits_per_byte", "margin"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(score, _SCHEMA)
