"""Secret scans: Markov models of random strings against ordinary identifiers.

Texts are cut into atoms, the runs of ASCII letters and digits. Two character models of order 2 with backing
off by counts score each from its first sign: one of random strings, one of ordinary identifiers; the
log-likelihood ratio of an atom is the sum over its signs. Atoms that the models take for random and that one sign of ``JOINTS``
parts are one candidate, as a base64 string is (an atom between them may speak a little for an identifier, ``BRIDGE`` nats at
most). A candidate is a secret if its ratio, over all its signs, is at least ``EVIDENCE`` nats and, on average, at least
``MIN_RATIO`` nats a sign. So a secret stands by itself whatever name or path is joined to it, and how long it must be follows
from how sure its signs are. A string of digits only is a number to the models, as among their samples.

Both are trained from labelled samples: random strings over the alphabets of usual credentials, drawn with a fixed seed, are
labelled secret; identifiers joined from the words of at most ``TRAIN_DOCS`` documents labelled good, those words, and numbers
are labelled ordinary. Scans cover whole texts; results carry places, never the secret.
"""

from __future__ import annotations

import random
import re
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import packing as P
from . import textblock as T

TRAIN_DOCS = 400
SAMPLES = 4000
EVIDENCE = 20.0
MIN_RATIO = 0.4
BRIDGE = 3.0
JOINTS = b"+/_-"
_ALPHABET = (string.ascii_letters + string.digits).encode()
_SIZE = len(_ALPHABET) + 1
_CODE = np.zeros(256, np.int64)
_CODE[np.frombuffer(_ALPHABET, np.uint8)] = np.arange(1, _SIZE)
_JOINT = np.isin(np.arange(256), np.frombuffer(JOINTS, np.uint8))
_WORDS = "user name item list value index count file path key id data page line text node table row column date time start end test main config default request response handler version number total size secret access token session api public private".split()
_SCHEMA = "doc_id long, start_char int, length int, ratio double"


def labelled_samples(words: list[str], n: int = SAMPLES, seed: int = 7) -> list[tuple[str, int]]:
    """(string, 1 for secret): ``n`` of each kind."""
    rng = random.Random(seed)
    alphabets = ["0123456789abcdef"] * 3 + ["0123456789ABCDEF", string.ascii_uppercase + "234567", string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_letters + string.digits + "_-", string.ascii_lowercase + string.digits, string.ascii_uppercase + string.digits]
    samples = [("".join(rng.choices(rng.choice(alphabets), k=rng.choice((16, 20, 24, 32, 40, 43, 64)))), 1) for _ in range(n)]
    pool = [w for w in words if w.isascii()] or _WORDS
    for _ in range(n):
        parts = [rng.choice(pool if rng.random() < 0.7 else _WORDS) for _ in range(rng.choice((1, 2, 2, 3, 4, 5)))]
        way = rng.randrange(8)
        if way == 0:
            text = "_".join(parts).lower()
        elif way == 1:
            text = parts[0].lower() + "".join(p.title() for p in parts[1:])
        elif way == 2:
            text = "-".join(parts).lower()
        elif way == 3:
            text = "/".join(parts)
        elif way == 4:
            text = "_".join(parts).upper()
        elif way == 5:
            text = "".join(parts)
        elif way == 6:
            text = "_".join(parts) + rng.choice(("", "_", "-")) + str(rng.choice((rng.randrange(10), rng.randrange(100), rng.randrange(1990, 2030), rng.randrange(10**6))))
        else:
            text = "".join(rng.choices("0123456789", k=rng.randrange(1, 20)))
        samples.append((text, 0))
    return samples


def _transitions(texts: list[str]) -> np.ndarray:
    """log P(sign | two signs before in the atom), (size, size, size), Witten-Bell mixed with orders 1 and 0."""
    counts = np.zeros((_SIZE, _SIZE, _SIZE))
    for text in texts:
        for atom in re.findall("[A-Za-z0-9]+", text):
            c = np.concatenate([[0, 0], _CODE[np.frombuffer(atom.encode(), np.uint8)]])
            np.add.at(counts, (c[:-2], c[1:-1], c[2:]), 1)
    p = np.full(_SIZE, 1 / (_SIZE - 1))
    for level in (counts.sum((0, 1)), counts.sum(0), counts):
        total = level.sum(-1, keepdims=True)
        kinds = np.maximum((level > 0).sum(-1, keepdims=True), 1)
        p = (level + kinds * p) / (total + kinds)
    return np.log(p)


def train(samples: list[tuple[str, int]]) -> np.ndarray:
    """The log-likelihood ratio, secret over ordinary, of each sign after two others."""
    return (_transitions([t for t, y in samples if y]) - _transitions([t for t, y in samples if not y])).ravel().astype(np.float32)


def atom_ratios(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, ratios: np.ndarray) -> np.ndarray:
    """The log-likelihood ratio of each atom."""
    code = _CODE[data]
    size = ends - starts
    begin = np.cumsum(size) - size
    c = code[np.arange(size.sum()) - np.repeat(begin - starts, size)]
    c1, c2 = np.zeros_like(c), np.zeros_like(c)
    c1[1:], c2[2:] = c[:-1], c[:-2]
    c1[begin] = c2[begin] = 0
    second = begin[size > 1] + 1
    c2[second] = 0
    return np.add.reduceat(ratios[(c2 * _SIZE + c1) * _SIZE + c], begin, dtype=np.float64)


def scan(data: np.ndarray, offsets: np.ndarray, ratios: np.ndarray, evidence: float = EVIDENCE, min_ratio: float = MIN_RATIO):
    """Row, start and end byte, and ratio a sign of the secrets of a block."""
    empty = np.zeros(0, np.int64)
    starts, ends = T.spans(_CODE[data] > 0, offsets)
    if not len(starts):
        return empty, empty, empty, np.zeros(0)
    score = atom_ratios(data, starts, ends, ratios)
    joined = np.zeros(len(starts), bool)  # to the atom before
    joined[1:] = (starts[1:] == ends[:-1] + 1) & _JOINT[data[np.maximum(starts[1:] - 1, 0)]]
    joined[1:] &= T.row_of(starts[1:], offsets) == T.row_of(starts[:-1], offsets)
    random_like = score > 0
    bridge = ~random_like & (score > -BRIDGE) & joined
    bridge[1:] &= random_like[:-1]
    bridge[:-1] &= random_like[1:] & joined[1:]
    bridge[[0, -1]] = False
    member = random_like | bridge
    head = member & ~(joined & np.concatenate([[False], member[:-1]]))
    at = np.flatnonzero(member)
    if not len(at):
        return empty, empty, empty, np.zeros(0)
    first = np.flatnonzero(head[at])
    total = np.add.reduceat(score[at], first)
    signs = np.add.reduceat((ends - starts)[at], first)
    begin, end = starts[at[first]], ends[at[np.append(first[1:], len(at)) - 1]]
    hit = (total >= evidence) & (total >= min_ratio * signs)
    return T.row_of(begin[hit], offsets), begin[hit], end[hit], total[hit] / signs[hit]


def fitted(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> np.ndarray:
    """The ratios, with the words of at most ``train_docs`` documents of quality 1 as ordinary."""
    good = labels.filter("quality = 1").select(F.col("doc_id").cast("long").alias("id")).filter("id is not null").distinct()
    good = good.orderBy(F.xxhash64("id"), "id").limit(train_docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text").filter("text is not null").join(F.broadcast(good), "id").collect()
    words = sorted({w for r in rows for w in re.findall(r"(?<![\w+/=-])[A-Za-z]{2,30}(?![\w+/=-])", r["text"])})
    return train(labelled_samples(words))


def secrets(docs: DataFrame, labels: DataFrame, evidence: float = EVIDENCE, min_ratio: float = MIN_RATIO) -> DataFrame:
    """(doc_id, start_char, length, ratio) of every secret; characters count from 0.

    Null and empty texts have none; a text and a secret of any length are scored whole; a ratio equal to a threshold is a secret's.
    Repeated rows each give theirs, a null doc_id stays null; other columns are not read; an empty table gives no rows. Without
    good labelled documents a built-in list of words stands for ordinary ones.
    """
    shared = P.Shared(docs.sparkSession, fitted(docs, labels))

    def search(batches):
        for batch in batches:
            for first, _, data, offsets in T.text_blocks(batch.column("text"), 1 << 20):
                rows, starts, ends, score = scan(data, offsets, shared.value, evidence, min_ratio)
                if not len(rows):
                    continue
                chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                place = (chars[starts] - chars[offsets[rows]]).astype(np.int32)
                ids = batch.column("doc_id").take(pa.array(rows + first))
                yield pa.RecordBatch.from_arrays([ids, pa.array(place), pa.array((ends - starts).astype(np.int32)), pa.array(score)], ["doc_id", "start_char", "length", "ratio"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(search, _SCHEMA)
