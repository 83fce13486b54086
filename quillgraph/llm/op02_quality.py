"""Quality rules: a linear-chain conditional random field marks each line as content or boilerplate.

Every non-blank line of a text is described by binary features (binned lengths, shares of
signs, capitals, digits and repeated words, place in the text and share of it). The field is trained on a
bounded sample of labelled documents (``TRAIN_DOCS``, those with the least hash of doc_id). Labels are of
documents, so those of lines are inferred: lines of a document labelled bad are boilerplate, and so is, in a good one too, a line that stands
between different neighbours in ``REPEATS`` documents of the sample at least, as menus and footers do (and the lines of copies don't). A first
model, without the chain, learns from these; lines of good documents that it takes for boilerplate by ``MARGIN`` nats are relabelled, and those that it
takes for content are content, as long as content holds the share that decides; then the field is trained on the sequences of labels, and
``ROUNDS`` times more with good documents of the sample that it would reject ``TIMES`` times as heavy, since the label of a document is sure and those of its lines aren't.
Viterbi decoding labels the lines of every whole text, and a document stays if content
lines hold at least ``MIN_SHARE`` of the characters of its lines.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import packing as P
from . import textblock as T

TRAIN_DOCS = 3000
MIN_SHARE = 0.5
EPOCHS = 120
PENALTY = 1e-3
REPEATS = 3
MARGIN = 2.0
ROUNDS, TIMES = 2, 4
_CUT = 256

_BINS = {
    "characters": (20, 40, 80, 160, 320, 640, 1280),
    "capitals": (0.02, 0.06, 0.15, 0.3, 0.6),
    "signs": (0.005, 0.02, 0.05, 0.1, 0.2),
    "digits": (0.01, 0.05, 0.1, 0.3),
    "shouts": (0.01, 0.1, 0.3),
    "stops": (0.02, 0.05, 0.1, 0.2, 0.4),
    "bars": (0.02, 0.2),
    "fresh_words": (0.3, 0.5, 0.7, 0.85, 0.95),
    "word_length": (2.5, 3.5, 4.5, 5.5, 7.0, 9.0, 12.0),
    "words": (2, 4, 8, 16, 32, 64, 128),
    "repeated": (0.5,),
    "first": (0.5,),
    "last": (0.5,),
    "ends_sentence": (0.5,),
    "share": (0.02, 0.1, 0.3, 0.5, 0.9),
    "bulk": (0, 20, 40, 80, 160, 320, 640),
}
_SIZES = [len(b) + 1 for b in _BINS.values()]
_FIRST = np.cumsum([0, *_SIZES[:-1]])
WIDTH = int(sum(_SIZES))


def _classes() -> np.ndarray:
    table = np.zeros(256, np.uint8)  # 0: letters, blanks, bytes beyond ASCII
    table[ord("A") : ord("Z") + 1] = 1
    table[ord("0") : ord("9") + 1] = 2
    for c in b"#$%&*+/<=>@\\^_`{}~[]":
        table[c] = 3
    table[ord("!")] = 4
    for c in b".,;:?":
        table[c] = 5
    table[ord("|")] = 6
    return table


_CLASS = _classes()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def line_features(column):
    """(first row, row after the last, features of the lines, row of each, characters of each, hash of each) by block."""
    for first, last, data, offsets in T.text_blocks(column):
        starts, ends = T.spans((data != 10) & (data != 13), offsets)
        low = _LOWER[data]
        at, to = T.spans(T.word_mask(data), offsets)
        hashes = T.hash_spans(low, at, to)

        def count(mask):
            total = np.zeros(len(data) + 1, np.int64)
            np.cumsum(mask, out=total[1:])
            return (total[ends] - total[starts]).astype(np.float64)

        filled = count((data != 32) & (data != 9)) > 0
        starts, ends = starts[filled], ends[filled]
        rows = T.row_of(starts, offsets)
        n = len(starts)
        if n == 0:
            yield first, last, np.zeros((0, len(_BINS)), np.int16), rows, np.zeros(0), np.zeros(0, np.uint64)
            continue
        classes = _CLASS[data]
        chars = count((data & 0xC0) != 0x80)
        line = np.searchsorted(starts, at, "right") - 1
        words = np.bincount(line, minlength=n)[:n].astype(np.float64)
        distinct = np.bincount(T.unique_per_row(hashes, line)[0], minlength=n)[:n]
        per_word, per_char = np.maximum(words, 1), np.maximum(chars, 1)
        inner = count(T.word_mask(data) & ((data & 0xC0) != 0x80))
        whole = T.hash_spans(low, starts, ends)
        key = T.mix(whole ^ T.mix(rows.astype(np.uint64) + np.uint64(1)))
        seen = np.ones(n)
        seen[np.unique(key, return_index=True)[1]] = 0
        new_doc = np.concatenate([[True], rows[1:] != rows[:-1]])
        tail = data[ends - 1]
        share = chars / np.maximum(np.bincount(rows, weights=chars), 1)[rows]
        values = {
            "characters": chars,
            "capitals": count(classes == 1) / np.maximum(inner, 1),
            "signs": count(classes == 3) / per_char,
            "digits": count(classes == 2) / per_char,
            "shouts": count(classes == 4) / per_word,
            "stops": count(classes == 5) / per_word,
            "bars": count(classes == 6) / per_word,
            "fresh_words": distinct / per_word,
            "word_length": inner / per_word,
            "words": words,
            "repeated": seen,
            "first": new_doc.astype(float),
            "last": np.concatenate([new_doc[1:], [True]]).astype(float),
            "ends_sentence": np.isin(tail, np.frombuffer(b".!?:\"'", np.uint8)).astype(float),
            "share": share,
            "bulk": np.where(share > 0.5, chars, -1),
        }
        features = np.stack([np.searchsorted(bins, values[name], "right") + _FIRST[k] for k, (name, bins) in enumerate(_BINS.items())], 1)
        yield first, last, features.astype(np.int16), rows, chars, whole


@dataclass
class Field:
    """Weights of content against boilerplate: by feature, at the start, and from label to label."""

    weights: np.ndarray
    start: np.ndarray
    step: np.ndarray

    def emission(self, features: np.ndarray) -> np.ndarray:
        return self.weights[features].sum(1) if len(features) else np.zeros(0)


def _by_position(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequences from the longest, and how many are longer than t for each t."""
    order = np.argsort(-lengths, kind="stable")
    longer = np.searchsorted(-lengths[order], -np.arange(1, (lengths.max() if len(lengths) else 0) + 1), "right")
    return order, longer


def viterbi(field: Field, emission: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The most likely label, 1 for content, of each line of consecutive sequences of these lengths.

    A tie is decided for content.
    """
    labels = np.zeros(len(emission), np.int8)
    if not len(emission):
        return labels
    begin = np.cumsum(lengths) - lengths
    order, longer = _by_position(lengths)
    begin = begin[order]
    score = np.zeros((len(order), 2))
    back = []
    for t, n in enumerate(longer):
        gain = np.stack([np.zeros(n), emission[begin[:n] + t]], 1)
        if t == 0:
            score[:n] = field.start + gain
            continue
        ways = score[:n, :, None] + field.step[None]
        back.append(ways[:, 1] >= ways[:, 0])
        score[:n] = np.maximum(ways[:, 0], ways[:, 1]) + gain
    state = (score[:, 1] >= score[:, 0]).astype(np.int8)
    for t in range(len(longer) - 1, -1, -1):
        n = longer[t]
        labels[begin[:n] + t] = state[:n]
        if t:
            state[:n] = back[t - 1][np.arange(n), state[:n]]
    return labels


def train(features: np.ndarray, lengths: np.ndarray, labels: np.ndarray) -> Field:
    """Maximum conditional likelihood with an L2 penalty, by Adam over all sequences at once.

    Sequences of more than 256 lines are trained in pieces of 256. With labels of one kind
    only, the field marks every line as content.
    """
    field = Field(np.zeros(WIDTH), np.zeros(2), np.zeros((2, 2)))
    if len(labels) == 0 or labels.min() == labels.max():
        return field
    pieces = [min(_CUT, int(n) - k) for n in lengths for k in range(0, int(n), _CUT)]
    lengths = np.array(pieces)
    begin = np.cumsum(lengths) - lengths
    order, longer = _by_position(lengths)
    begin, total = begin[order], len(labels)
    onehot = np.stack([1 - labels, labels], 1).astype(float)
    inside = np.ones(total, bool)
    inside[begin] = False
    nth = np.flatnonzero(inside)
    seen_step = np.zeros((2, 2))
    np.add.at(seen_step, (labels[nth - 1], labels[nth]), 1.0)
    seen_start = onehot[begin].sum(0)
    flat = np.zeros(WIDTH + 6)
    m, v = np.zeros_like(flat), np.zeros_like(flat)
    for epoch in range(1, EPOCHS + 1):
        weights, start, step = flat[:WIDTH], flat[WIDTH : WIDTH + 2], flat[WIDTH + 2 :].reshape(2, 2)
        emit = np.stack([np.zeros(total), weights[features].sum(1)], 1)
        move = np.exp(step)
        alpha, beta = np.zeros((total, 2)), np.ones((total, 2))
        local = np.exp(emit - emit.max(1, keepdims=True))
        for t, n in enumerate(longer):
            at = begin[:n] + t
            a = local[at] * (np.exp(start) if t == 0 else alpha[at - 1] @ move)
            alpha[at] = a / a.sum(1, keepdims=True)
        expected_step = np.zeros((2, 2))
        for t in range(len(longer) - 1, 0, -1):
            n = longer[t]
            at = begin[:n] + t
            right = local[at] * beta[at]
            pair = alpha[at - 1][:, :, None] * move[None] * right[:, None, :]
            expected_step += (pair / pair.sum((1, 2), keepdims=True)).sum(0)
            b = right @ move.T
            beta[at - 1] = b / b.sum(1, keepdims=True)
        marginal = alpha * beta
        marginal /= marginal.sum(1, keepdims=True)
        off = marginal[:, 1] - labels
        gradient = np.concatenate([
            np.bincount(features.ravel(), weights=np.repeat(off, features.shape[1]), minlength=WIDTH),
            marginal[begin].sum(0) - seen_start,
            (expected_step - seen_step).ravel(),
        ]) / total + PENALTY * flat
        m = 0.9 * m + 0.1 * gradient
        v = 0.99 * v + 0.01 * gradient**2
        flat = flat - 0.15 * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.99**epoch)) + 1e-8)
    return Field(flat[:WIDTH], flat[WIDTH : WIDTH + 2], flat[WIDTH + 2 :].reshape(2, 2))


def repeated(lines: np.ndarray, lengths: np.ndarray, repeats: int = REPEATS) -> np.ndarray:
    """Which lines stand in ``repeats`` documents at least, with another line before and after each time.

    The copies of a document share the neighbours of a line, and so count once. ``lines`` are hashes, by document.
    """
    begin = np.cumsum(lengths) - lengths
    before, after = np.roll(lines, 1), np.roll(lines, -1)
    before[begin[lengths > 0]] = 0
    after[(begin + lengths - 1)[lengths > 0]] = 0
    out = np.ones(len(lines), bool)
    for near in (before, after):
        pairs = np.unique(np.stack([lines, near], 1), axis=0) if len(lines) else np.zeros((0, 2), np.uint64)
        values, n = np.unique(pairs[:, 0], return_counts=True)
        out &= n[np.searchsorted(values, lines)] >= repeats if len(lines) else out
    return out


def line_labels(features: np.ndarray, lengths: np.ndarray, quality: np.ndarray, chars: np.ndarray, lines: np.ndarray, min_share: float = MIN_SHARE) -> np.ndarray:
    """The labels of lines that the field is trained on, from those of their documents; see the module's text."""
    doc = np.repeat(np.arange(len(lengths)), lengths)
    total = np.maximum(np.bincount(doc, weights=chars, minlength=len(lengths)), 1)

    def allowed(marks: np.ndarray) -> np.ndarray:
        """The marks, but where content would not hold its share of a good document all its lines are content."""
        short = np.bincount(doc, weights=chars * marks, minlength=len(lengths)) < min_share * total
        return np.where(quality[doc] == 0, 0, np.where(short[doc], 1, marks))

    labels = allowed(np.where(repeated(lines, lengths), 0, 1))
    if not len(labels) or labels.min() == labels.max():
        return labels
    alone = train(features, np.ones(len(labels), np.int64), labels)
    odds = alone.emission(features) + alone.start[1] - alone.start[0]
    return allowed(np.where(odds < -MARGIN, 0, np.where(odds > 0, 1, labels)))


def settled(features: np.ndarray, lengths: np.ndarray, marks: np.ndarray, quality: np.ndarray, chars: np.ndarray, min_share: float = MIN_SHARE) -> Field:
    """The field trained on the marks of lines, with the good documents that it would reject weighed up; see the module's text."""
    field = train(features, lengths, marks)
    begin = np.cumsum(lengths) - lengths
    doc = np.repeat(np.arange(len(lengths)), lengths)
    times = np.ones(len(lengths), np.int64)
    for _ in range(ROUNDS):
        content = np.bincount(doc, weights=chars * viterbi(field, field.emission(features), lengths), minlength=len(lengths))
        lost = (quality == 1) & (content < min_share * np.bincount(doc, weights=chars, minlength=len(lengths)))
        if not lost.any():
            break
        times[lost] *= TIMES
        order = np.repeat(np.arange(len(lengths)), times)
        size = lengths[order]
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - begin[order], size)
        field = train(features[at], size, marks[at])
    return field


def fitted(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, min_share: float = MIN_SHARE) -> Field:
    """The field trained on at most ``train_docs`` labelled documents."""
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("quality").alias("y")).filter("id is not null and y in (0, 1)")
    known = known.groupBy("id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(train_docs)
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").filter("text is not null").join(F.broadcast(known), "id")

    def describe(batches):
        for batch in batches:
            ids, ys, packs = [], [], [[], [], []]
            for first, last, features, rows, chars, lines in line_features(batch.column("text")):
                at = np.searchsorted(rows, np.arange(last - first + 1))
                for i in np.flatnonzero(np.diff(at)):
                    ids.append(batch.column("id")[first + i].as_py())
                    ys.append(batch.column("y")[first + i].as_py())
                    for pack, values in zip(packs, (features, chars, lines)):
                        pack.append(values[at[i] : at[i + 1]].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ys, pa.int32()), *(pa.array(p, pa.binary()) for p in packs)], ["id", "y", "features", "chars", "lines"])

    rows = sorted(texts.mapInArrow(describe, "id long, y int, features binary, chars binary, lines binary").collect())
    joined = lambda name, kind: np.frombuffer(b"".join(r[name] for r in rows), kind)
    features, chars, lines = joined("features", np.int16).reshape(-1, len(_BINS)), joined("chars", np.float64), joined("lines", np.uint64)
    lengths = np.array([len(r["chars"]) // 8 for r in rows], np.int64)
    quality = np.array([r["y"] for r in rows], np.int64)
    return settled(features, lengths, line_labels(features, lengths, quality, chars, lines, min_share), quality, chars, min_share)


def judged(column, field: Field) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lines, content lines and content share of every text of a batch."""
    n = len(column)
    lines, content, share = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
    for first, last, features, rows, chars, _ in line_features(column):
        counts = np.bincount(rows, minlength=last - first)
        marks = viterbi(field, field.emission(features), counts[counts > 0])
        total = np.bincount(rows, weights=chars, minlength=last - first)
        held = np.bincount(rows, weights=chars * marks, minlength=last - first)
        lines[first:last] = counts
        content[first:last] = np.bincount(rows, weights=marks, minlength=last - first)
        share[first:last] = held / np.maximum(total, 1)
    return lines, content, share


def retained(docs: DataFrame, labels: DataFrame, min_share: float = MIN_SHARE) -> DataFrame:
    """(doc_id, n_lines, content_lines, content_share) of the documents that stay.

    A null or blank text has no line and is rejected; a share of exactly ``min_share`` stays; a text of any length is decoded whole. An
    empty table gives no rows; without labels of both kinds every line is content.
    Repeated rows are judged each; a null doc_id is kept as null; other columns are not read.
    Labels other than 0 and 1 are ignored, and the worst label of a repeated doc_id counts.
    """
    field = P.Shared(docs.sparkSession, fitted(docs, labels))

    def judge(batches):
        for batch in batches:
            lines, content, share = judged(batch.column("text"), field.value)
            out = pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lines), pa.array(content), pa.array(share)], ["doc_id", "n_lines", "content_lines", "content_share"])
            yield out.filter(pa.array((lines > 0) & (share >= min_share)))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(judge, "doc_id long, n_lines long, content_lines long, content_share double")


def filtered(docs: DataFrame, labels: DataFrame, min_share: float = MIN_SHARE) -> DataFrame:
    """The rows of ``docs`` that stay, with all columns, decided as in ``retained``."""
    field = P.Shared(docs.sparkSession, fitted(docs, labels))

    def judge(batches):
        for batch in batches:
            lines, _, share = judged(batch.column("text"), field.value)
            yield batch.filter(pa.array((lines > 0) & (share >= min_share)))

    return docs.mapInArrow(judge, docs.schema)
