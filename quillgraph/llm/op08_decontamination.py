"""Benchmark decontamination with suffix arrays over the training texts.

The words of the training documents, lower-cased and without punctuation, are cut into
shards of whole documents; each shard gets a suffix array over its words, built by prefix
doubling where only suffixes that still tie are sorted again. Every suffix of every test
item that is long enough to reach its threshold is binary-searched in every shard: ``MIN_WORDS``
words, or all words of an item that has fewer. (A shorter suffix is the tail of one that is searched, and
can't hold a match by itself.) An interval of suffixes that share that many words
with it gives the locations of its verbatim matches; each is then
extended word by word to the longest match, which never runs past the end of a document.
Arrays are sorted to a depth of at least ``MIN_WORDS`` words: deeper order can't change
which suffixes match, and lengths come from the texts themselves.

Shards are independent, so the work is one pass over the documents without a shuffle. Test
items travel to all tasks, some three bytes for each of their text; beyond ``TEST_BYTES`` of text they go in
several passes, whose results are the same as those of one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import packing as P
from . import textblock as T

MIN_WORDS = 10
SHARD_BYTES = 8 << 20
TEST_BYTES = 32 << 20
_SCHEMA = "doc_id long, item_id long, match_words int, doc_word int, item_word int"


@dataclass
class TestSet:
    """The words of all items, one after the other; of each item its id, first word, word after the last and
    threshold; and of each suffix that can reach it its item and first word."""

    __test__ = False
    ids: list
    tokens: np.ndarray
    first: np.ndarray
    end: np.ndarray
    need: np.ndarray
    item: np.ndarray
    start: np.ndarray


def _hashes(column):
    for first, last, data, offsets in T.text_blocks(T.lowered(column), SHARD_BYTES):
        starts, ends, rows = T.words(data, offsets)
        yield first, last, np.maximum(T.hash_spans(data, starts, ends), np.uint64(1)), rows


def test_set(ids: list, texts: list, min_words: int = MIN_WORDS) -> TestSet:
    """Suffixes of the items; an item of fewer than ``min_words`` words must match whole; one without words can't."""
    parts, sizes = [np.zeros(0, np.uint64)], np.zeros(len(texts), np.int64)
    for first, last, hashes, rows in _hashes(pa.array(texts, pa.string())):
        parts.append(hashes)
        sizes[first:last] = np.bincount(rows, minlength=last - first)
    end = np.cumsum(sizes)
    need = np.minimum(sizes, min_words)
    count = np.where(sizes > 0, sizes - need + 1, 0)
    item = np.repeat(np.arange(len(texts), dtype=np.int32), count)
    nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    start = ((end - sizes)[item] + nth).astype(np.int32)
    return TestSet(ids, np.concatenate([*parts, np.zeros(min_words, np.uint64)]), end - sizes, end, need, item, start)


test_set.__test__ = False


def suffix_array(tokens: np.ndarray, depth: int) -> np.ndarray:
    """Positions sorted by the words from there on, to a depth of at least ``depth`` words."""
    n = len(tokens)
    values, rank = np.unique(tokens, return_inverse=True)
    rank = rank.astype(np.int64) + 1
    key = rank * (len(values) + 2)
    key[:-1] += rank[1:]
    order = np.argsort(key)
    group = _starts(key[order], np.arange(n))
    rank[order] = group
    have = 2
    tied = np.flatnonzero(np.bincount(group, minlength=n)[group] > 1)
    while have < depth and len(tied):
        at = order[tied]
        after = at + have
        key = rank[at] * (n + 1)
        inside = after < n
        key[inside] += rank[after[inside]] + 1
        again = np.argsort(key)
        order[tied] = at = at[again]
        group = _starts(key[again], tied)
        rank[at] = group
        have *= 2
        new = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        tied = tied[np.repeat(np.diff(np.append(new, len(group))) > 1, np.diff(np.append(new, len(group))))]
    return order


def _starts(keys: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For sorted keys at increasing places: the place of the first of the equal ones."""
    new = np.concatenate([[True], keys[1:] != keys[:-1]])
    return np.maximum.accumulate(np.where(new, at, 0))


def _bound(tokens: np.ndarray, order: np.ndarray, test: TestSet, which: np.ndarray, upper: bool) -> np.ndarray:
    """Where the first ``need`` words of the suffixes would go in the array: before or after those that share them."""
    low, high = np.zeros(len(which), np.int64), np.full(len(which), len(order), np.int64)
    need = test.need[test.item[which]]
    span = np.arange(int(test.need.max()))
    wanted = test.tokens[test.start[which][:, None] + span]
    beyond = span[None] >= need[:, None]
    while (low < high).any():
        middle = (low + high) // 2
        here = tokens[order[np.minimum(middle, len(order) - 1)][:, None] + span]
        differ = (here != wanted) & ~beyond
        at = differ.argmax(1)
        row = np.arange(len(which))
        some = differ[row, at]
        right = np.where(some, here[row, at] < wanted[row, at], upper)
        right &= low < high
        low = np.where(right, middle + 1, low)
        high = np.where(right | (low >= high), high, middle)
    return low


def matches(hashes: np.ndarray, rows: np.ndarray, n_rows: int, test: TestSet) -> np.ndarray:
    """Maximal matches in one shard: row, item, words, first word in the document, first word in the item."""
    none = np.zeros((0, 5), np.int64)
    if not len(hashes) or not len(test.start):
        return none
    sizes = np.bincount(rows, minlength=n_rows)
    begin = np.cumsum(sizes + 1) - sizes - 1  # every document is followed by a 0 that no word equals
    width = int(test.need.max())
    tokens = np.zeros(int(len(hashes) + n_rows + width), np.uint64)
    place = np.arange(len(hashes)) + rows
    tokens[place] = hashes
    order = suffix_array(tokens[: len(hashes) + n_rows], width)
    words = T.distinct(hashes)
    head = test.tokens[test.start]
    found = np.minimum(np.searchsorted(words, head), len(words) - 1)
    out = []
    for which in np.array_split(np.flatnonzero(words[found] == head), max(1, len(head) // 200_000)):
        if not len(which):
            continue
        low = _bound(tokens, order, test, which, False)
        at = order[np.minimum(low, len(order) - 1)]
        span = np.arange(width)
        same = (tokens[at[:, None] + span] == test.tokens[test.start[which][:, None] + span]) | (span[None] >= test.need[test.item[which]][:, None])
        hit = same.all(1) & (low < len(order))
        which, low = which[hit], low[hit]
        if not len(which):
            continue
        high = _bound(tokens, order, test, which, True)
        count = high - low
        suffix = np.repeat(which, count)
        position = order[np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())]
        item = test.item[suffix]
        inner = (test.start[suffix] > test.first[item]) & (position > 0)
        inner[inner] = tokens[position[inner] - 1] == test.tokens[test.start[suffix[inner]] - 1]
        suffix, position = suffix[~inner], position[~inner]  # the others are the tails of longer matches
        item, start = test.item[suffix], test.start[suffix].astype(np.int64)
        length = test.need[item]
        going = np.arange(len(suffix))
        while len(going):
            going = going[start[going] + length[going] < test.end[item[going]]]
            more = tokens[position[going] + length[going]] == test.tokens[start[going] + length[going]]
            going = going[more]
            length[going] += 1
        row = np.searchsorted(begin, position, "right") - 1
        out.append(np.stack([row, item, length, position - begin[row], start - test.first[item]], 1))
    return np.concatenate(out) if out else none


def _test_sets(benchmark: DataFrame, min_words: int):
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = int(size // TEST_BYTES) + 1
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text is not null")
    for k in range(parts):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).collect()
        yield P.Shared(benchmark.sparkSession, test_set([r[0] for r in rows], [r[1] for r in rows], min_words))


def contaminated(docs: DataFrame, benchmark: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, item_id, match_words, doc_word, item_word): the longest verbatim match of each document with each item.

    Places count words from 0; of equally long matches the first in the document, then in the item,
    is given. Null and empty texts and items match nothing; an item of fewer than ``min_words`` words, even of one, matches where it
    stands whole. A text of any length is searched whole. An empty benchmark and an empty table give no rows; repeated rows
    each give theirs; null ids stay null. Other columns are not read.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    result = None
    for test in _test_sets(benchmark, min_words):

        def search(batches, test=test):
            for batch in batches:
                ids = batch.column("doc_id")
                for first, last, hashes, rows in _hashes(batch.column("text")):
                    found = matches(hashes, rows, last - first, test.value)
                    if not len(found):
                        continue
                    found = found[np.lexsort((found[:, 4], found[:, 3], -found[:, 2], found[:, 1], found[:, 0]))]
                    new = np.concatenate([[True], (found[1:, :2] != found[:-1, :2]).any(1)])
                    found = found[new]
                    items = pa.array([test.value.ids[i] for i in found[:, 1]], pa.int64())
                    numbers = [pa.array(found[:, k].astype(np.int32)) for k in (2, 3, 4)]
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(found[:, 0] + first)), items, *numbers], ["doc_id", "item_id", "match_words", "doc_word", "item_word"])

        part = narrow.mapInArrow(search, _SCHEMA)
        result = part if result is None else result.union(part)
    return result


def decontaminated(docs: DataFrame, benchmark: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` without the rows whose text has a verbatim match, as in ``contaminated``; all columns stay as they are."""
    for test in _test_sets(benchmark, min_words):

        def keep(batches, test=test):
            for batch in batches:
                clean = np.ones(len(batch), bool)
                for first, last, hashes, rows in _hashes(batch.column("text")):
                    clean[first + matches(hashes, rows, last - first, test.value)[:, 0]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
