"""Toxicity by lexicon induction: random walks from labelled seed terms over a word graph.

Seed terms are induced from the labels. In a sample of at most ``TRAIN_DOCS`` documents of each label
(those with the least hash of doc_id), every word and every prefix of ``STEM_FROM`` to ``STEM_TO``
characters is counted by the documents that have it; documents that share the least of one of ``COPY_HASHES`` hashes of five
consecutive words are copies and count once. The terms whose log-likelihood ratio for the label is the
highest (``SURE`` at least, and a share of toxic documents of ``LIFT`` times that of clean ones) are the
seeds, each word or prefix that overlaps with a better one left out. So an inflected word is seen as its stem, however rare each of its forms is. A language with
``LEAST_LABELLED`` labelled documents of either kind at least has a sample and seeds of its own; a sample of
all labelled documents serves the others.

Nodes of the graph are all seed terms (a word that begins with a seed stem stands for the longest such
stem), whatever their share of the corpus, and the other words that occur in ``MIN_SHARE`` to ``MAX_SHARE`` of all
documents, found exactly: words beyond are stop words or too rare for statistics of their own. Edges join nodes that
co-occur within ``WINDOW`` nodes of each other in a document, weighted by the pointwise mutual
information of all such co-occurrences in the corpus less ``SHIFT`` where that is positive. Walks with
restarts from the toxic seeds of a language, and from its clean terms by their clean documents,
give each node two probabilities; the log-ratio of their lifts over the stationary distribution is
its polarity in the language. Nodes whose polarity reaches a cut are the lexicon; a document's score adds
the weights of its lexicon terms less a penalty for each of its words; cut, penalty (of ``CUTS`` and
``PENALTIES``) and threshold are those that separate the sample best by F1, its documents weighted to the numbers of all
labelled ones.

Counts and graph cover all documents. The graph stays distributed, in blocks of the pair matrix;
only vectors over the nodes, whose number the shares bound, go to the driver and back, and some 60
bytes for each document of the samples.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import packing as P
from . import textblock as T

MIN_SHARE, MAX_SHARE = 0.001, 0.10
LEAST_DOCS = 3
STEM_FROM, STEM_TO = 3, 8
WINDOW = 3
SHIFT = 1.0
SEEDS = 100
SURE = 25.0
LIFT = 2.0
COPY_HASHES = 8
TRAIN_DOCS = 2000
LEAST_LABELLED = 10
STEPS = 8
WALK_TASKS, WALK_COLUMNS = 8, 16
RESTART = 0.15
CUTS = (4.0, 3.0, 2.0, 1.0)
PENALTIES = (0.0, 0.01, 0.02, 0.05, 0.1, 0.15, 0.2, 0.3)
SLOTS = 1 << 21
BLOCK_BYTES = 1 << 20
_KEYS = 6 << 20
_PAIR = np.dtype([("hash", "<u8"), ("n", "<u4")])
_SCORED = np.dtype([("y", "<u1"), ("n", "<i4"), ("sums", "<f8", (len(CUTS),))])
_STEM = np.uint64(0x5354454D5354454D)
_SCHEMA = "doc_id long, score double, hits int, distinct_words int"


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - 21)).astype(np.int64)


def prefix_ends(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The words of ``size`` characters at least, and where their first ``size`` characters end."""
    heads = np.flatnonzero((data & 0xC0) != 0x80)
    first = np.searchsorted(heads, starts)
    after = np.append(heads, len(data))[np.minimum(first + size, len(heads))]
    long = np.flatnonzero((after <= ends) & (first + size <= len(heads)))
    return long, after[long]


def stem_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of spans as stems, which differ from those of the same spans as words."""
    return T.mix(T.hash_spans(data, starts, ends) ^ _STEM)


@dataclass
class Stems:
    """The seed stems: sorted hashes for each number of characters that occurs, from the longest."""

    by_size: list[tuple[int, np.ndarray]]

    def terms(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The hash of each word, or of its longest seed stem."""
        hashes = T.hash_spans(data, starts, ends)
        todo = np.arange(len(starts))
        for size, stems in self.by_size:
            long, after = prefix_ends(data, starts[todo], ends[todo], size)
            found = stem_hashes(data, starts[todo][long], after)
            at, _ = nodes_of(found, stems)
            hashes[todo[long[at]]] = found[at]
            rest = np.ones(len(todo), bool)
            rest[long[at]] = False
            todo = todo[rest]
        return hashes


NO_STEMS = Stems([])


def _blocks(column, stems: Stems = NO_STEMS):
    """(first row, row after the last, term hashes, rows) by block."""
    for first, last, data, offsets in T.text_blocks(T.lowered(column), BLOCK_BYTES):
        starts, ends, rows = T.words(data, offsets)
        yield first, last, stems.terms(data, starts, ends), rows


def _count(batch: pa.RecordBatch, totals: np.ndarray) -> None:
    for _, _, hashes, rows in _blocks(batch.column("text")):
        rows, hashes = T.distinct_words(hashes, rows)
        totals[:SLOTS] += np.bincount(_slot(hashes), minlength=SLOTS)
        totals[-1] += T.filled_rows(rows)


def vocabulary(docs: DataFrame, min_share: float = MIN_SHARE, max_share: float = MAX_SHARE) -> np.ndarray:
    """Sorted hashes of the words whose document frequency is within the shares of the documents that have words.

    The forms of a stem are among them; where the stem is a node, no text has a node of theirs.
    """
    totals = P.hashed_totals(docs.select("text"), SLOTS + 1, _count)
    least = max(LEAST_DOCS, int(np.ceil(totals[-1] * min_share)))
    most = max(LEAST_DOCS, int(totals[-1] * max_share))
    often = P.Shared(docs.sparkSession, np.packbits(totals[:SLOTS] >= least))
    width = P.shuffle_width(docs.sparkSession)

    def count(batches):
        mask = np.unpackbits(often.value).astype(bool)
        router = P.Router(width)
        for batch in batches:
            held = []
            for _, _, hashes, rows in _blocks(batch.column("text")):
                keep = mask[_slot(hashes)]
                _, found, _ = T.unique_per_row(hashes[keep], rows[keep])
                held.append(_added(found, np.ones(len(found), np.int64)))
            if held:
                words, n = _added(np.concatenate([h for h, _ in held]), np.concatenate([c for _, c in held]))
                records = np.empty(len(words), _PAIR)
                records["hash"], records["n"] = words, n
                yield from router.add(words % np.uint64(width), records)
        yield from router.flush()

    def add(batches):
        records = P.unpacked(batches, _PAIR)
        words, n = _added(records["hash"], records["n"].astype(np.int64))
        kept = words[(n >= least) & (n <= most)]
        yield pa.RecordBatch.from_arrays([pa.array(kept.view(np.int64))], ["word"])

    rows = P.exchanged(docs.select("text").mapInArrow(count, P.BLOCK_SCHEMA), width).mapInArrow(add, "word long").toPandas()
    return np.sort(rows["word"].to_numpy().astype(np.int64).view(np.uint64))


def _added(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with the sums of their numbers."""
    if not len(keys):
        return keys, n
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[heads], np.add.reduceat(n, heads)


def nodes_of(hashes: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the hashes that are nodes, and their node numbers."""
    if not len(words) or not len(hashes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    number = np.minimum(np.searchsorted(words, hashes), len(words) - 1)
    at = np.flatnonzero(words[number] == hashes)
    return at, number[at]


def _encoded(keys: np.ndarray, n: np.ndarray, start: int) -> bytes:
    """Sorted keys from ``start`` on and their counts, mostly in two bytes each."""
    parts = [np.array([len(keys)], np.uint32)]
    for values in (np.diff(keys, prepend=start), n):
        large = values >= 255
        parts += [np.array([large.sum()], np.uint32), np.where(large, 255, values).astype(np.uint8), values[large].astype(np.uint64)]
    return b"".join(p.tobytes() for p in parts)


def _decoded(payload: bytes, start: int) -> tuple[np.ndarray, np.ndarray]:
    size = int(np.frombuffer(payload, np.uint32, 1)[0])
    at, out = 4, []
    for _ in range(2):
        large = int(np.frombuffer(payload, np.uint32, 1, at)[0])
        values = np.frombuffer(payload, np.uint8, size, at + 4).astype(np.int64)
        values[values == 255] = np.frombuffer(payload, np.uint64, large, at + 4 + size)
        at += 4 + size + 8 * large
        out.append(values)
    return start + np.cumsum(out[0]), out[1]


def _pairs(numbers: np.ndarray, rows: np.ndarray, v: int, window: int) -> np.ndarray:
    """Keys of the pairs of different nodes within the window, in one document; see ``_ends``."""
    out = []
    for k in range(1, window + 1):
        a, b = numbers[:-k], numbers[k:]
        keep = (rows[:-k] == rows[k:]) & (a != b)
        a, b = a[keep], b[keep]
        out.append((a + b) % v * v + np.minimum(a, b))
    return np.concatenate(out)


def _ends(keys: np.ndarray, v: int) -> tuple[np.ndarray, np.ndarray]:
    """The two nodes of a key, which is their sum modulo v, times v, plus one of them: even over the range of keys."""
    a = keys % v
    return a, (keys // v - a) % v


def graph(docs: DataFrame, words: np.ndarray, window: int = WINDOW, stems: Stems = NO_STEMS) -> DataFrame:
    """(dest, payload, marginal): blocks of the pair counts, and what all pairs add to each node."""
    v = len(words)
    shared = P.Shared(docs.sparkSession, (words, stems))
    parts = P.shuffle_width(docs.sparkSession)
    span = -(-v * v // parts)

    def emit(held):
        keys = np.concatenate(held)
        held.clear()
        keys.sort()
        heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        keys, n = keys[heads], np.diff(np.append(heads, len(keys)))
        cut = np.searchsorted(keys, np.arange(parts + 1) * span)
        live = np.flatnonzero(np.diff(cut))
        blobs = [_encoded(keys[cut[p] : cut[p + 1]], n[cut[p] : cut[p + 1]], int(p) * span) for p in live]
        return pa.RecordBatch.from_arrays([pa.array(live.astype(np.int32)), pa.array(blobs, pa.binary())], ["dest", "payload"])

    def count(batches):
        held: list[np.ndarray] = []
        for batch in batches:
            words, stems = shared.value
            for _, _, hashes, rows in _blocks(batch.column("text"), stems):
                at, number = nodes_of(hashes, words)
                held.append(_pairs(number, rows[at], v, window))
                if sum(map(len, held)) >= _KEYS:
                    yield emit(held)
        if held:
            yield emit(held)

    def add(batches):
        held, dest = [], None
        for batch in batches:
            for number, payload in zip(batch.column("dest").to_pylist(), batch.column("payload")):
                dest = number
                held.append(_decoded(payload.as_py(), dest * span))
        if dest is not None:
            keys, n = _added(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))
            a, b = _ends(keys, v)
            marginal = np.bincount(a, weights=n, minlength=v) + np.bincount(b, weights=n, minlength=v)
            yield pa.RecordBatch.from_arrays([pa.array([dest], pa.int32()), pa.array([_encoded(keys, n, dest * span)], pa.binary()), pa.array([marginal.tobytes()], pa.binary())], ["dest", "payload", "marginal"])

    blocks = P.exchanged(docs.select("text").mapInArrow(count, P.BLOCK_SCHEMA), parts)
    return P.checkpointed(blocks.mapInArrow(add, "dest int, payload binary, marginal binary"))


def _summed(parts: DataFrame, shape: tuple) -> np.ndarray:
    """The sum of the float64 arrays of a binary column: by task, of which there are ``WALK_TASKS`` at most, then of these in single precision."""
    name = parts.columns[0]

    def add(batches):
        total, some = np.zeros(shape), False
        for batch in batches:
            for payload in batch.column(0):
                total += np.frombuffer(payload.as_buffer(), np.float64).reshape(shape)
                some = True
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([total.astype(np.float32).tobytes()], pa.binary())], [name])

    total = np.zeros(shape)
    for row in parts.coalesce(WALK_TASKS).mapInArrow(add, f"{name} binary").collect():
        total += np.frombuffer(row[0], np.float32).reshape(shape)
    return total


def walk(blocks: DataFrame, v: int, restart: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities (nodes, kinds) of walks that restart from the columns of ``restart``, and the nodes' degrees.

    ``WALK_COLUMNS`` columns walk at a time, which bounds what goes to the tasks and back.
    """
    spark = blocks.sparkSession
    span = -(-v * v // P.shuffle_width(spark))
    marginal = _summed(blocks.select("marginal"), (v,))
    total = marginal.sum()
    shared = P.Shared(spark, marginal)
    blocks = blocks.select("dest", "payload").coalesce(WALK_TASKS)

    def times(x):
        """The symmetric weights times x, a matrix over the nodes."""
        sent = P.Shared(spark, x)

        def task(batches):
            c, x = shared.value, np.ascontiguousarray(sent.value.T)
            y, any_row = np.zeros_like(x), False
            for batch in batches:
                for dest, payload in zip(batch.column("dest").to_pylist(), batch.column("payload")):
                    any_row = True
                    keys, n = _decoded(payload.as_py(), dest * span)
                    a, b = _ends(keys, v)
                    weight = np.log(n * total / (c[a] * c[b])) - SHIFT
                    keep = weight > 0
                    a, b, weight = a[keep], b[keep], weight[keep]
                    for k in range(len(x)):
                        y[k] += np.bincount(a, weights=weight * x[k][b], minlength=v)
                        y[k] += np.bincount(b, weights=weight * x[k][a], minlength=v)
            if any_row:
                yield pa.RecordBatch.from_arrays([pa.array([y.T.tobytes()], pa.binary())], ["y"])

        try:
            return _summed(blocks.mapInArrow(task, "y binary"), x.shape)
        finally:
            sent.drop()

    degree = times(np.ones((v, 1)))[:, 0]
    out = []
    for at in range(0, restart.shape[1], WALK_COLUMNS):
        begin = restart[:, at : at + WALK_COLUMNS]
        x = begin
        for _ in range(steps):
            x = RESTART * begin + (1 - RESTART) * times(x / np.maximum(degree, 1e-12)[:, None])
        out.append(x)
    return np.concatenate(out, 1), degree


def with_language(docs: DataFrame) -> DataFrame:
    """(id, text, lang); a table without languages is of one."""
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("id"), "text", lang.alias("lang"))


def samples(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> tuple[list[str], np.ndarray, DataFrame]:
    """Languages fitted by themselves; labelled documents (groups, 2) by label; (grp, y, text) of the samples.

    The last group is of all labelled documents. The worst label of a doc_id counts; of rows that share a
    doc_id one may be drawn for each language.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("y")).filter("id is not null and y in (0, 1)")
    known = known.groupBy("id").agg(F.max("y").alias("y"))
    ids = P.checkpointed(with_language(docs).filter("text is not null and id is not null").select("id", "lang").distinct().join(known, "id"))
    found: dict = {}
    for r in ids.groupBy("lang", "y").count().collect():
        found.setdefault(r["lang"], [0, 0])[r["y"]] = r["count"]
    langs = sorted(k for k, n in found.items() if k is not None and min(n) >= LEAST_LABELLED)
    n = np.array([*(found[k] for k in langs), np.sum([[0, 0], *found.values()], axis=0)], np.float64)
    number = F.lit(None).cast("int")
    for k, name in enumerate(langs):
        number = F.when(F.col("lang").eqNullSafe(name), k).otherwise(number)
    groups = ids.withColumn("grp", number).filter("grp is not null").union(ids.withColumn("grp", F.lit(len(langs))))
    nth = F.row_number().over(Window.partitionBy("grp", "y").orderBy(F.xxhash64("id"), "id", "lang"))
    drawn = groups.withColumn("nth", nth).filter(F.col("nth") <= train_docs).select("id", F.col("lang").alias("of"), "grp", "y")
    texts = with_language(docs).filter("text is not null").join(F.broadcast(drawn), "id").filter(F.col("lang").eqNullSafe(F.col("of")))
    return langs, n, P.checkpointed(texts.select("grp", "y", "text"))


def likelihood_ratio(df: np.ndarray, n: np.ndarray) -> np.ndarray:
    """G squared of the label and each term, 0 where the term speaks against it; df: documents (terms, 2), n: of each label."""
    total = n.sum()
    out = np.zeros(len(df))
    for have, rest in ((df, df.sum(1)), (n - df, total - df.sum(1))):
        for y in (0, 1):
            with np.errstate(divide="ignore", invalid="ignore"):
                out += np.where(have[:, y] > 0, 2 * have[:, y] * np.log(have[:, y] * total / (rest * n[y])), 0)
    return np.where(df[:, 1] * n[0] > df[:, 0] * n[1], out, 0)


def _term_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """(characters of the prefix or 0 for whole words, hashes, places of the words, ends) of all terms of a block."""
    yield 0, T.hash_spans(data, starts, ends), np.arange(len(starts)), ends
    for size in range(STEM_FROM, STEM_TO + 1):
        long, after = prefix_ends(data, starts, ends, size)
        yield size, stem_hashes(data, starts[long], after), long, after


def _shingles(hashes: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """(n, ``COPY_HASHES``): by row the least of each of several hashes of five consecutive words (or fewer, at its end)."""
    mixed = T.mix(hashes)
    with np.errstate(over="ignore"):
        for k in range(1, 5):
            inside = np.flatnonzero(rows[:-k] == rows[k:]) if len(rows) > k else np.zeros(0, np.int64)
            mixed[inside] = T.mix(mixed[inside] + hashes[inside + k] * np.uint64(2 * k + 1))
        out = np.full((n, COPY_HASHES), ~np.uint64(0))
        cut = np.searchsorted(rows, np.arange(n + 1))
        some = np.flatnonzero(np.diff(cut))
        for k in range(COPY_HASHES if len(some) else 0):
            out[some, k] = np.minimum.reduceat(T.mix(mixed + np.uint64(k)), cut[:-1][some])
    return out


def induced(texts: list[tuple[int, str]], count: int = SEEDS, sure: float = SURE) -> list[tuple[str, int]]:
    """The seed terms of labelled texts, the surest first: (word, 0) or (stem, its characters)."""
    texts = sorted(texts)
    y = np.array([label for label, _ in texts], np.int64)
    column = pa.array([t for _, t in texts], pa.large_string())
    parts: list[list] = [[], []]
    n, seen = np.zeros(2), set()
    for first, last, data, offsets in T.text_blocks(T.lowered(column), BLOCK_BYTES):
        starts, ends, rows = T.words(data, offsets)
        own = np.zeros(last - first, bool)
        for i, least in enumerate(_shingles(T.hash_spans(data, starts, ends), rows, last - first).tolist()):
            label = int(y[first + i])
            marks = {(label, k, h) for k, h in enumerate(least)}
            if seen.isdisjoint(marks):
                own[i] = True
                n[label] += 1
            seen |= marks
        for _, hashes, at, _ in _term_spans(data, starts, ends):
            owner = rows[at]
            keep = own[owner]
            owner, hashes, _ = T.unique_per_row(hashes[keep], owner[keep])
            parts[1].append(hashes[y[first + owner] == 1])
            clean, times = np.unique(hashes[y[first + owner] == 0], return_counts=True)
            parts[0].append((clean, times))
    if not n.all() or not parts[1]:
        return []
    terms, bad = np.unique(np.concatenate(parts[1]), return_counts=True)
    terms, bad = terms[bad >= LEAST_DOCS], bad[bad >= LEAST_DOCS]
    good = np.zeros(len(terms), np.int64)
    for hashes, times in parts[0]:
        at, number = nodes_of(hashes, terms)
        good[number] += times[at]
    ratio = likelihood_ratio(np.stack([good, bad], 1).astype(np.float64), n)
    ratio[bad / n[1] < LIFT * good / n[0]] = 0
    terms, ratio = terms[ratio >= sure], ratio[ratio >= sure]
    spelled: dict[int, tuple[str, int]] = {}
    for _, _, data, offsets in T.text_blocks(T.lowered(column.filter(pa.array(y == 1))), BLOCK_BYTES):
        starts, ends, _ = T.words(data, offsets)
        for size, hashes, at, after in _term_spans(data, starts, ends):
            place, number = nodes_of(hashes, terms)
            for k, i in zip(*np.unique(number, return_index=True)):
                spelled.setdefault(int(k), (bytes(data[starts[at[place[i]]] : after[place[i]]]).decode(), size))
    order = sorted(spelled, key=lambda k: (-round(ratio[k], 6), spelled[k][1] > 0, -len(spelled[k][0]), spelled[k][0]))
    out: list[tuple[str, int]] = []
    for k in order:
        text = spelled[k][0]
        if len(out) < count and not any(text.startswith(t) or t.startswith(text) for t, _ in out):
            out.append(spelled[k])
    return out


def seed_terms(sample: DataFrame, groups: int) -> list[list[tuple[str, int]]]:
    """Of each group the seed terms; a group's sample, which ``TRAIN_DOCS`` bounds, is gathered in one task."""

    def induce(rows):
        found: list[tuple] = induced(list(zip(rows.column("y").to_pylist(), rows.column("text").to_pylist())))
        grp = rows.column("grp")[0].as_py()
        return pa.table([pa.array([grp] * len(found), pa.int32()), pa.array(range(len(found)), pa.int32()), pa.array([t for t, _ in found], pa.string()), pa.array([k for _, k in found], pa.int32())], ["grp", "nth", "term", "size"])

    out: list[list[tuple[str, int]]] = [[] for _ in range(groups)]
    for r in sorted(sample.groupBy("grp").applyInArrow(induce, "grp int, nth int, term string, size int").collect()):
        out[r["grp"]].append((r["term"], r["size"]))
    return out


def term_hash(term: str, size: int) -> int:
    data = np.frombuffer(term.encode(), np.uint8)
    return int((stem_hashes if size else T.hash_spans)(data, np.array([0]), np.array([len(data)]))[0])


def stems_of(terms: list[tuple[str, int]]) -> Stems:
    """The stems among seed terms."""
    by: dict[int, set] = {}
    for term, size in terms:
        if size:
            by.setdefault(size, set()).add(term_hash(term, size))
    return Stems([(size, np.array(sorted(by[size]), np.uint64)) for size in sorted(by, reverse=True)])


def clean_counts(sample: DataFrame, words: np.ndarray, stems: Stems, groups: int) -> np.ndarray:
    """Clean documents (nodes, groups) of the samples that have each node."""
    shared = P.Shared(sample.sparkSession, (words, stems))

    def count(batch, totals):
        words, stems = shared.value
        grp = batch.column("grp").to_numpy(zero_copy_only=False)
        for first, _, hashes, rows in _blocks(batch.column("text"), stems):
            at, number = nodes_of(hashes, words)
            pairs = T.distinct(rows[at] * np.int64(len(words)) + number)
            np.add.at(totals, pairs % len(words) * groups + grp[first + pairs // len(words)], 1)

    return P.hashed_totals(sample.filter("y = 0").select("text", "grp"), len(words) * groups, count).reshape(len(words), groups).astype(np.float64)


def starts_of(words: np.ndarray, terms: list[list[tuple[str, int]]], clean: np.ndarray) -> np.ndarray:
    """(nodes, 2 * groups): where walks restart, toxic seeds alike, clean terms by their clean documents."""
    out = np.zeros((len(words), 2 * len(terms)))
    for g, own in enumerate(terms):
        at = np.searchsorted(words, np.array([term_hash(*t) for t in own], np.uint64)) if own else np.zeros(0, np.int64)
        out[at, 2 * g] = 1
        out[:, 2 * g + 1] = np.where(out[:, 2 * g] > 0, 0, clean[:, g])
    return out / np.maximum(out.sum(0), 1)


def polarities(x: np.ndarray, degree: np.ndarray) -> np.ndarray:
    """(nodes, groups) from the probabilities of the walks from toxic and clean seeds, in turn."""
    usual = (degree + degree.mean() + 1e-12) / (degree + degree.mean() + 1e-12).sum()
    lift = x / usual[:, None]
    return np.log2((lift[:, ::2] + 0.1) / (lift[:, 1::2] + 0.1))


def lexicon_sums(sample: DataFrame, words: np.ndarray, polarity: np.ndarray, stems: Stems) -> list[np.ndarray]:
    """Of each group's sample the label, the words and, by cut, the sum of weights of each document that has any."""
    some = (polarity >= min(CUTS)).any(1)
    shared = P.Shared(sample.sparkSession, (words[some], polarity[some], stems))

    def add(batches):
        words, polarity, stems = shared.value
        for batch in batches:
            grp, y = batch.column("grp").to_numpy(zero_copy_only=False), batch.column("y").to_numpy(zero_copy_only=False)
            for first, last, hashes, rows in _blocks(batch.column("text"), stems):
                at, number = nodes_of(hashes, words)
                owner, n = rows[at], last - first
                out = np.zeros(n, _SCORED)
                out["y"], out["n"] = y[first:last], np.bincount(rows, minlength=n)
                value = polarity[number, grp[first + owner]]
                for k, cut in enumerate(CUTS):
                    out["sums"][:, k] = np.bincount(owner, weights=np.where(value >= cut, value, 0.0), minlength=n)
                live = (out["sums"] > 0).any(1)
                for g in np.unique(grp[first:last][live]):
                    yield pa.RecordBatch.from_arrays([pa.array([g], pa.int32()), pa.array([out[live & (grp[first:last] == g)].tobytes()], pa.binary())], ["grp", "rows"])

    out: list[list[bytes]] = [[] for _ in range(polarity.shape[1])]
    for r in sample.mapInArrow(add, "grp int, rows binary").toLocalIterator():
        out[r["grp"]].append(bytes(r["rows"]))
    return [np.sort(np.frombuffer(b"".join(x), _SCORED), order=("y", "n")) for x in out]


@dataclass
class Lexicon:
    """Sorted term hashes, their weights, the penalty of a word, and the least score of a toxic document."""

    words: np.ndarray
    weights: np.ndarray
    penalty: float
    threshold: float


def nothing() -> Lexicon:
    return Lexicon(np.zeros(0, np.uint64), np.zeros(0), 0.0, float("inf"))


def best_threshold(scores: np.ndarray, toxic: np.ndarray, weights: np.ndarray, positives: float) -> tuple[float, float]:
    """The highest F1 of weighted documents and its threshold, midway to the next lower score; of equal ones the highest."""
    order = np.argsort(-scores, kind="stable")
    s, w = scores[order], weights[order]
    hit = w * toxic[order]
    last = np.append(s[1:] != s[:-1], True)
    f1 = np.where(last, 2 * np.cumsum(hit) / (np.cumsum(w) + positives), -1)
    k = int(np.argmax(f1))
    return float(f1[k]), float((s[k] + s[k + 1]) / 2 if k + 1 < len(s) else s[k])


def best_lexicon(words: np.ndarray, polarity: np.ndarray, rows: np.ndarray, weight: np.ndarray, positives: float) -> Lexicon:
    """``weight``: how many labelled documents one of the sample stands for, by label."""
    best, found = 0.0, nothing()
    for k, cut in enumerate(CUTS):
        hit = rows[rows["sums"][:, k] > 0]
        for penalty in PENALTIES if len(hit) else ():
            f1, threshold = best_threshold(hit["sums"][:, k] - penalty * hit["n"], hit["y"], weight[hit["y"]], positives)
            if f1 > best:
                best, found = f1, Lexicon(words[polarity >= cut], polarity[polarity >= cut], penalty, threshold)
    return found


@dataclass
class Model:
    """Languages with a lexicon of their own, the lexicons (the last is for all others), and the stems of terms."""

    languages: list[str]
    lexicons: list[Lexicon]
    stems: Stems


def fitted(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, **bounds) -> Model:
    """The lexicons; empty, so that nothing is toxic, where labels of both kinds or seeds are missing."""
    langs, n, sample = samples(docs, labels, train_docs)
    none = Model([], [nothing()], NO_STEMS)
    if not n[-1].all():
        return none
    terms = seed_terms(sample, len(n))
    if not any(terms):
        return none
    stems = stems_of([t for own in terms for t in own])
    words = np.union1d(vocabulary(docs, **bounds), np.array([term_hash(*t) for own in terms for t in own], np.uint64))
    clean = clean_counts(sample, words, stems, len(n))
    x, degree = walk(graph(docs, words, stems=stems), len(words), starts_of(words, terms, clean))
    polarity = polarities(x, degree)
    rows = lexicon_sums(sample, words, polarity, stems)
    weight = np.maximum(n / train_docs, 1)
    return Model(langs, [best_lexicon(words, polarity[:, g], rows[g], weight[g], n[g, 1]) for g in range(len(n))], stems)


def toxic(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """(doc_id, score, hits, distinct_words) of the documents whose score reaches the threshold.

    ``hits`` counts lexicon terms, ``distinct_words`` different ones. A text without a lexicon term, a null
    or empty one among them, is never toxic; a text of any length is scored whole; a score equal to the threshold is toxic.
    Repeated rows each give theirs, a null doc_id stays null; the worst label of a repeated doc_id counts; of
    other columns only lang is read, where there is one. An empty table gives no rows.
    """
    shared = P.Shared(docs.sparkSession, fitted(docs, labels, **options))

    def score(batches):
        model = shared.value
        numbers = {k: i for i, k in enumerate(model.languages)}
        for batch in batches:
            group = np.array([numbers.get(k, len(numbers)) for k in batch.column("lang").to_pylist()], np.int64)
            for first, last, hashes, rows in _blocks(batch.column("text"), model.stems):
                n = last - first
                size = np.bincount(rows, minlength=n)
                for g in np.unique(group[first:last]):
                    lexicon = model.lexicons[g]
                    at, number = nodes_of(hashes, lexicon.words)
                    own = group[first:last][rows[at]] == g
                    owner, number = rows[at][own], number[own]
                    total = np.bincount(owner, weights=lexicon.weights[number], minlength=n) - lexicon.penalty * size
                    hits = np.bincount(owner, minlength=n)
                    distinct = np.bincount(T.distinct(owner * max(len(lexicon.words), 1) + number) // max(len(lexicon.words), 1), minlength=n)
                    over = np.flatnonzero((total >= lexicon.threshold) & (hits > 0))
                    ids = batch.column("id").take(pa.array(over + first))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(total[over]), pa.array(hits[over].astype(np.int32)), pa.array(distinct[over].astype(np.int32))], ["doc_id", "score", "hits", "distinct_words"])

    return with_language(docs).mapInArrow(score, _SCHEMA)
