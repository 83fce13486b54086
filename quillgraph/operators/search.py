"""Hybrid retrieval: BM25 and vector top-k, fused by reciprocal ranks."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from . import graph

RRF = 60
OVERFETCH = 3
K1, B = 1.2, 0.75
FLOOR = 1e-6
DIGITS = 9  # signals are rounded, so that ranks don't depend on the order of sums
DIMS = 256
SPREAD = 64
RUN_WORDS = 1 << 20
POSTINGS = "word string, id long, len long, at array<int>"
_OFFSET, _PRIME = np.uint64(2166136261), np.uint64(16777619)


@dataclass(frozen=True)
class Cutoffs:
    """Upper bounds on the signals; lower is better for both."""

    distance: float | None = None
    bm25: float | None = None


@dataclass(frozen=True)
class Options:
    n: int = 10
    cutoffs: Cutoffs = field(default_factory=Cutoffs)
    expand: bool = False


def phrases_of(text: str, most: int = 32) -> list[list[str]]:
    """The query's terms as lists of folded words; a term of several words is a phrase."""
    pieces = [p for p in dict.fromkeys(re.split(r"[\s\ufeff]+", text)) if re.search(r"[^\W_]", p)]
    return [re.findall(r"[^\W_]+", X.fold(p)) for p in pieces[:most]]


def posting_rows(notes: DataFrame) -> DataFrame:
    """(word, id, len, at): of each note (id, title, body) each word, where it stands, and the note's words in all.

    Places in the body follow those in the title at a distance that no phrase spans. A note also has a row of the
    empty word, so that notes without words are counted. Words are grouped within a note, so nothing is shuffled. Rows come in
    runs sorted by word, one of each ``RUN_WORDS`` words, which bounds what a task holds.
    """
    words = lambda c: X.words_of(F.coalesce(c, F.lit("")))

    def group(batches):
        for batch in batches:
            sizes = [pc.list_value_length(batch.column(name)).to_numpy(zero_copy_only=False).astype(np.int64) for name in ("title", "body")]
            for at, end in _runs(sizes[0] + sizes[1], RUN_WORDS):
                yield from run(batch.slice(at, end - at), [s[at:end] for s in sizes])

    def run(batch, sizes):
        n = len(batch)
        ids = batch.column("id")
        parts = []
        for k, (name, size) in enumerate(zip(("title", "body"), sizes)):
            owner = np.repeat(np.arange(n), size)
            parts.append((batch.column(name).flatten(), owner, np.arange(len(owner)) - (np.cumsum(size) - size)[owner] + (k << 30)))
        coded = pa.chunked_array([f for f, *_ in parts], pa.string()).dictionary_encode().combine_chunks()
        if isinstance(coded, pa.ChunkedArray):
            coded = coded.chunk(0)
        sort = pc.sort_indices(coded.dictionary).to_numpy()
        rank = np.empty(len(sort), np.int64)
        rank[sort] = np.arange(len(sort))
        key = rank[coded.indices.to_numpy()] * n + np.concatenate([o for _, o, _ in parts])
        order = np.argsort(key, kind="stable")
        key = key[order]
        heads = np.flatnonzero(np.diff(key, prepend=-1))
        at = np.concatenate([p for *_, p in parts]).astype(np.int32)[order]
        found = pa.ListArray.from_arrays(pa.array(np.append(heads, len(order)).astype(np.int32)), pa.array(at))
        code, rows = np.divmod(key[heads], n)
        size = pa.array(sizes[0] + sizes[1])
        none = pa.ListArray.from_arrays(pa.array(np.zeros(n + 1, np.int32)), pa.array([], pa.int32()))
        yield pa.RecordBatch.from_arrays([pa.array([""] * n, pa.string()), ids, size, none], ["word", "id", "len", "at"])
        yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(sort[code])), ids.take(pa.array(rows)), size.take(pa.array(rows)), found], ["word", "id", "len", "at"])

    return notes.select("id", words(F.col("title")).alias("title"), words(F.col("body")).alias("body")).mapInArrow(group, POSTINGS)


def _runs(sizes: np.ndarray, most: int):
    """(start, end) of runs of rows whose sizes sum up to ``most`` at most; a larger row is a run by itself."""
    total, at = np.cumsum(sizes), 0
    while at < len(sizes):
        before = total[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(total, before + most, "right")))
        yield at, end
        at = end


@dataclass(frozen=True)
class Keywords:
    """An inverted index: postings (word, id, len, at) of live notes, and their number and mean length (n, avgdl)."""

    postings: DataFrame
    totals: DataFrame

    @staticmethod
    def of(notes: DataFrame) -> Keywords:
        """Made from the notes themselves, which are read anew at each use."""
        rows = posting_rows(notes)
        return Keywords(rows, totals_of(rows))

    def rows(self, words: list[str]) -> DataFrame:
        """The postings of some words; of stored ones only the row groups that may hold them are read."""
        return self.postings.filter(F.col("word").isin(words))


def totals_of(postings: DataFrame) -> DataFrame:
    """(n, avgdl) of the notes of postings."""
    return postings.filter("word = ''").agg(F.count("*").alias("n"), F.avg("len").alias("avgdl"))


def store_postings(rows: DataFrame, place: str, merge: bool = False) -> None:
    """Write postings in runs sorted by word, so that a reader skips the row groups and pages without its words.

    Runs stay where ``posting_rows`` makes them, as segments do, so an index costs no more than its own size. To ``merge`` is to
    sort the rows of several passes anew; those of a word, however many, are then spread over ``SPREAD`` tasks by note.
    """
    if merge:
        rows = rows.repartition(F.col("word"), F.pmod(F.xxhash64("id"), F.lit(SPREAD))).sortWithinPartitions("word", "id")
    rows.write.option("parquet.block.size", 16 << 20).option("parquet.bloom.filter.enabled#word", "true").parquet(place)


def bm25_stats(keywords: Keywords, terms: list[str]) -> DataFrame:
    """(term, df, n, avgdl, idf) of single-word terms."""
    df = keywords.rows(terms).groupBy(F.col("word").alias("term")).agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(keywords.totals)).select("term", "df", "n", "avgdl", _idf(F.col("n"), F.col("df")).alias("idf"))


def _idf(n: Column, df: Column) -> Column:
    idf = F.log((n - df + 0.5) / (df + 0.5))
    return F.when(idf <= 0, FLOOR).otherwise(idf)


def term_counts(keywords: Keywords, phrases: list[list[str]]) -> DataFrame:
    """(id, len, term, tf): how often each phrase, by number, occurs in a note; overlaps count, columns don't join.

    Single words are read off their postings; for phrases the postings of their words meet by note.
    """
    single: dict[str, list[int]] = {}
    for k, phrase in enumerate(phrases):
        if len(phrase) == 1:
            single.setdefault(phrase[0], []).append(k)
    longer = [(k, p) for k, p in enumerate(phrases) if len(p) > 1]
    found = None
    if single:
        terms = F.coalesce(*(F.when(F.col("word") == w, F.array(*map(F.lit, ks))) for w, ks in single.items()))
        found = keywords.rows(list(single)).select("id", "len", F.explode(terms).alias("term"), F.size("at").alias("tf"))
    if longer:
        words = sorted({w for _, p in longer for w in p})
        held = F.map_from_entries(F.collect_list(F.struct("word", "at")))  # a note has one posting of a word
        notes = keywords.rows(words).groupBy("id").agg(F.first("len").alias("len"), held.alias("at"))

        def count(phrase: list[str]) -> Column:
            places = [F.coalesce(F.try_element_at("at", F.lit(w)), F.array().cast("array<int>")) for w in phrase]
            return F.size(F.filter(places[0], lambda x: reduce(lambda a, b: a & b, (F.array_contains(p, x + k) for k, p in enumerate(places[1:], 1)))))

        counts = F.filter(F.array(*(F.struct(F.lit(k).alias("term"), count(p).alias("tf")) for k, p in longer)), lambda s: s["tf"] > 0)
        more = notes.select("id", "len", F.explode(counts).alias("t")).select("id", "len", "t.*")
        found = more if found is None else found.unionByName(more)
    return found


def bm25(keywords: Keywords, query: str) -> DataFrame:
    """(id, score) of the notes that match, the better the lower."""
    phrases = phrases_of(query)
    if not phrases:
        return keywords.postings.select("id", F.lit(0.0).alias("score")).limit(0)
    hits = term_counts(keywords, phrases)
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    weighed = hits.join(F.broadcast(df.crossJoin(F.broadcast(keywords.totals))), "term")  # at most 32 rows
    f = F.col("tf").cast("double")
    part = _idf(F.col("n"), F.col("df")) * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("len") / F.col("avgdl")))
    return weighed.groupBy("id").agg(F.round(-F.sum(part), DIGITS).alias("score"))


_WORD = np.zeros(256, bool)
_WORD[np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789", np.uint8)] = True


def bag_of_words(texts: pa.Array, dims: int = DIMS) -> np.ndarray:
    """Counts of [a-z0-9]+ runs in FNV-1a buckets, a row a text; all words of the texts are hashed at once, a letter a step."""
    dotted = pc.replace_substring(pc.fill_null(texts.cast(pa.large_string()), ""), "İ", "i̇")
    lowered = pc.utf8_lower(dotted)
    offsets = np.frombuffer(lowered.buffers()[1], np.int64)[lowered.offset : lowered.offset + len(lowered) + 1]
    out = np.zeros((len(lowered), dims))
    data = np.frombuffer(lowered.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if len(lowered) and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    if not len(data):
        return out
    cuts = offsets - offsets[0]
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = _WORD[data]
    head = inside[1:-1] & ~inside[:-2]
    inner = cuts[(cuts > 0) & (cuts < len(data))]
    head[inner] = inside[1:-1][inner]
    tail = inside[1:-1] & ~inside[2:]
    tail[inner - 1] = inside[1:-1][inner - 1]
    starts, size = np.flatnonzero(head), np.flatnonzero(tail) + 1 - np.flatnonzero(head)
    h = np.full(len(starts), _OFFSET)
    going = np.arange(len(starts))
    for k in range(int(size.max()) if len(size) else 0):
        going = going[size[going] > k]
        h[going] = ((h[going] ^ data[starts[going] + k]) * _PRIME) & np.uint64(0xFFFFFFFF)
    row = np.searchsorted(cuts, starts, "right") - 1
    return np.bincount(row * dims + (h % np.uint64(dims)).astype(np.int64), minlength=len(out) * dims).reshape(-1, dims).astype(float)


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1; rows of zeros stay."""
    norm = np.sqrt((vectors * vectors).sum(-1, keepdims=True))
    return np.divide(vectors, norm, out=np.zeros_like(vectors), where=norm > 0)


class LexicalEmbedder:
    """The bag-of-words embedder: deterministic, no model to fetch."""

    def __init__(self, dims: int = DIMS):
        if not 1 <= dims <= 8192:
            raise ValueError("dims must be in 1..8192")
        self.dims, self.model = dims, f"token-overlap-{dims}"

    def embed(self, texts: list[str]) -> list[list[float]]:
        return bag_of_words(pa.array(texts, pa.string()), self.dims).tolist()


def _lists(rows: np.ndarray) -> pa.Array:
    """A matrix as a column of lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel()))


def slices(batch: pa.RecordBatch, rows: int = 512):
    for at in range(0, len(batch), rows):
        yield batch.slice(at, rows)


def token_vectors(rows: DataFrame, dims: int = DIMS) -> DataFrame:
    """(id, emb): unit vectors of rows (id, text); texts without a word give none."""

    def embed(batches):
        for batch in batches:
            for part in slices(batch):
                vectors = unit(bag_of_words(part.column("text"), dims))
                some = vectors.any(1)
                yield pa.RecordBatch.from_arrays([part.column("id").filter(pa.array(some)), _lists(vectors[some])], ["id", "emb"])

    return rows.select(F.col("id").cast("long").alias("id"), "text").mapInArrow(embed, "id long, emb array<double>")


def embedded(rows: DataFrame, embedder) -> DataFrame:
    """(id, emb) of rows (id, text) by an embedder: unit vectors, null for those of zeros.

    The lexical one runs on whole columns. Any other is asked by ``embed(texts)``, once for each batch of a task;
    a wrong number of vectors or a wrong width ends the pass.
    """
    rows = rows.select(F.col("id").cast("long").alias("id"), "text")
    if isinstance(embedder, LexicalEmbedder):
        return rows.select("id").join(token_vectors(rows, embedder.dims), "id", "left")

    def ask(batches):
        for batch in batches:
            for part in slices(batch):
                texts = part.column("text").to_pylist()
                vectors = embedder.embed(texts)
                if len(vectors) != len(texts):
                    raise RuntimeError(f"embedder {embedder.model} gave {len(vectors)} vectors for {len(texts)} texts")
                wide = next((v for v in vectors if len(v) != embedder.dims), None)
                if wide is not None:
                    raise RuntimeError(f"embedder {embedder.model} gave a vector of width {len(wide)}, not {embedder.dims}")
                made = unit(np.array(vectors, float).reshape(-1, embedder.dims))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([v if any(v) else None for v in made.tolist()], pa.list_(pa.float64()))], ["id", "emb"])

    return rows.mapInArrow(ask, "id long, emb array<double>")


def cosine_distance(vectors: DataFrame, query: list[float]) -> DataFrame:
    """(id, distance) of vectors (id, emb) of any length from the query."""
    q = np.asarray(query, float)
    q = q / (np.linalg.norm(q) or 1.0)

    def distance(batches):
        for batch in batches:
            if len(batch):
                m = batch.column("emb").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(batch), -1)
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array((1 - unit(m) @ q).round(DIGITS))], ["id", "distance"])

    return vectors.select(F.col("id").cast("long").alias("id"), "emb").mapInArrow(distance, "id long, distance double")


def ranked(signal: DataFrame, notes: DataFrame, value: str, k: int, ceiling: float | None, allowed: Column | None) -> DataFrame:
    """The best ``k`` of a signal, then the filters, then ranks among what is left.

    The limit comes first on purpose: a reader whose notes aren't among the best gets fewer hits.
    """
    best = F.broadcast(signal.orderBy(value, "id").limit(k))
    kept = best.join(notes.select("id", "path", "title", "superseded_by"), "id").filter("superseded_by is null")
    if ceiling is not None:
        kept = kept.filter(F.col(value) <= ceiling)
    if allowed is not None:
        kept = kept.filter(allowed)
    return kept.withColumn("rank", F.row_number().over(Window.orderBy(value, "id")))  # at most k rows


def fused(vector: DataFrame | None, words: DataFrame | None, n: int) -> DataFrame:
    """(id, path, title, score, vec_rank, fts_rank) of ranked signals by summed reciprocal ranks, then path."""
    side = lambda s, name: s.select("id", "path", "title", F.col("rank").alias(name))
    if vector is None and words is None:
        raise ValueError("no signal")
    if vector is None:
        both = side(words, "fts_rank").withColumn("vec_rank", F.lit(None).cast("int"))
    elif words is None:
        both = side(vector, "vec_rank").withColumn("fts_rank", F.lit(None).cast("int"))
    else:
        both = side(vector, "vec_rank").join(side(words, "fts_rank"), ["id", "path", "title"], "full")
    part = lambda c: F.coalesce(1.0 / (RRF + F.col(c)), F.lit(0.0))
    scored = both.withColumn("score", part("vec_rank") + part("fts_rank"))
    return scored.select("id", "path", "title", "score", "vec_rank", "fts_rank").orderBy(F.desc("score"), "path").limit(n)


def hybrid(notes: DataFrame, vectors: DataFrame | None, query: str, query_vector: list[float] | None, options: Options = Options(), allowed: Column | None = None, edges: DataFrame | None = None, keywords: Keywords | None = None) -> DataFrame:
    """Fused hits of notes (id, path, title, superseded_by), and with ``expand`` their neighbours after them.

    Columns: id, path, title, score, vec_rank, fts_rank, expansion. Neighbours are live, allowed, ordered
    by path, at most n, and have score 0. Without ``keywords`` the notes' bodies are read for them.
    """
    if not isinstance(options.n, int) or options.n < 1:
        raise ValueError("n must be a positive integer")
    k = OVERFETCH * options.n
    vector = words = None
    if vectors is not None and query_vector is not None and any(query_vector):
        vector = ranked(cosine_distance(vectors, query_vector), notes, "distance", k, options.cutoffs.distance, allowed)
    if phrases_of(query):
        words = ranked(bm25(keywords or Keywords.of(notes), query), notes, "score", k, options.cutoffs.bm25, allowed)
    if vector is None and words is None:
        return notes.select("id", "path", "title", F.lit(0.0).alias("score"), F.lit(0).alias("vec_rank"), F.lit(0).alias("fts_rank"), F.lit(False).alias("expansion")).limit(0)
    hits = fused(vector, words, options.n).withColumn("expansion", F.lit(False))
    if not options.expand or edges is None:
        return hits
    hits = notes.sparkSession.createDataFrame(hits.collect(), hits.schema)  # at most n rows, which three branches below use
    near = graph.neighbours(edges, notes, hits).filter("superseded_by is null")
    near = (near if allowed is None else near.filter(allowed)).orderBy("path").limit(options.n)
    return hits.unionByName(near.select("id", "path", "title", F.lit(0.0).alias("score"), F.lit(None).cast("int").alias("vec_rank"), F.lit(None).cast("int").alias("fts_rank"), F.lit(True).alias("expansion")))
