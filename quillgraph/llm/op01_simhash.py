"""Near-duplicate removal by SimHash with bit-sliced comparison.

Each text gets a signature of 256 bits: the signs of the sums, over its distinct words, of
a random +-1 vector per word weighted by the word's inverse document frequency over all
documents. Documents whose signatures differ in at most ``radius`` bits are duplicates, and
so are documents that a chain of such pairs links; of each group the least doc_id stays.

Equal signatures are joined first. Signatures that share one of their four words of 64 bits and are
within the radius of the least document of those that do are linked to it: a linear pass that joins the bulk
of large groups. What is left is to compare documents of different groups. Candidates share all bits of a sample of
``Plan.route`` + ``Plan.own`` bits. The samples come in groups that have the ``route`` bits in common, so that a
signature travels once a group; ``plan`` derives their numbers from the number of signatures, so that a sample's keys
hold some ``LOAD`` signatures each, a route ``ROUTE_ROWS``, and a pair at the radius shares a key with a probability
of at least ``RECALL``. Within a key every document is compared with all of other groups:
bit planes are stored vertically, 64 documents to a word; distances of a query to all of them are
kept in bitwise counters that carry-save adders update, and entries whose 64 distances all exceed
the radius are given up every 32 planes.

Routes that hold more than ``HOT_ROWS`` signatures are split into blocks that meet in pairs; the blocks of one
large group don't meet, as there is nothing to find between them. So a group of a third of all rows costs in
proportion to its rows, and no task holds more than two blocks of a route.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import packing as P
from . import textblock as T

BITS = 256
SLOTS = 1 << 20
RADIUS = 60
RECALL = 0.92
LEAST_BITS, LEAST_ROUTE = 12, 4
LOAD, ROUTE_ROWS, HOT_ROWS = 64, 8192, 65536
PER_GROUP = 8

_RECORD = np.dtype([("task", "<u8"), ("group", "<u2"), ("id", "<i8"), ("comp", "<i8"), ("sig", "<u8", (4,))])


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - 20)).astype(np.int64)


def _count_words(batch: pa.RecordBatch, totals: np.ndarray) -> None:
    for _, _, data, offsets in T.text_blocks(T.lowered(batch.column("text"))):
        starts, ends, rows = T.words(data, offsets)
        rows, hashes = T.distinct_words(T.hash_spans(data, starts, ends), rows)
        np.add(totals[: len(totals) - 1], np.bincount(_slot(hashes), minlength=SLOTS), out=totals[: len(totals) - 1])
        totals[-1] += T.filled_rows(rows)


def word_frequencies(docs: DataFrame) -> np.ndarray:
    """Document frequency of each hashed word over all documents; the last slot counts documents with words."""
    return P.hashed_totals(docs.select("text"), SLOTS + 1, _count_words)


def _lut() -> np.ndarray:
    return np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float64) * 2 - 1


def signature(hashes: np.ndarray, weights: np.ndarray, lut: np.ndarray) -> np.ndarray:
    """Four uint64 for distinct word hashes and their weights."""
    wide = np.empty((len(hashes), 4), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(4):
            wide[:, k] = T.mix(hashes + np.uint64(k * 0x9E3779B9 + 1))
    index = wide.view(np.uint8).reshape(-1, 32).astype(np.int32) + np.arange(32, dtype=np.int32) * 256
    histogram = np.bincount(index.ravel(), weights=np.repeat(weights, 32), minlength=8192).reshape(32, 256)
    return np.packbits((histogram @ lut > 0).ravel(), bitorder="little").view(np.uint64)


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, sig): rows with a doc_id and at least one word."""
    totals = word_frequencies(docs)
    n = int(totals[-1])
    weights = P.Shared(docs.sparkSession, np.maximum(0.0, np.log((n + 1) / (totals[:-1] + 0.5))).astype(np.float32))

    def sign(batches):
        table, lut = weights.value, _lut()
        for batch in batches:
            ids, sigs = [], []
            column = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for first, last, data, offsets in T.text_blocks(T.lowered(batch.column("text"))):
                starts, ends, rows = T.words(data, offsets)
                rows, hashes = T.distinct_words(T.hash_spans(data, starts, ends), rows)
                w = table[_slot(hashes)].astype(np.float64) + 1e-9
                at = np.searchsorted(rows, np.arange(last - first + 1))
                for i in np.flatnonzero(np.diff(at)):
                    ids.append(int(column[first + i]))
                    sigs.append(signature(hashes[at[i] : at[i + 1]], w[at[i] : at[i + 1]], lut).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sigs, pa.binary())], ["doc_id", "sig"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null")
    return rows.mapInArrow(sign, "doc_id long, sig binary")


@dataclass(frozen=True)
class Plan:
    """``groups`` samples of ``route`` bits, each with ``PER_GROUP`` samples of ``own`` further bits."""

    route: int
    own: int
    groups: int

    def samples(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each group the places of its route bits and, by sample, of the own bits."""
        rng = np.random.default_rng(20240131)
        out = []
        for _ in range(self.groups):
            order = rng.permutation(BITS)
            rest = order[self.route :]
            out.append((order[: self.route], np.array([rng.choice(rest, self.own, replace=False) for _ in range(PER_GROUP)])))
        return out


def _shared(bits: int, of: int, differing: int) -> float:
    """The chance that none of ``bits`` places drawn from ``of`` is one of those that differ."""
    return math.prod(max(0, of - differing - k) / (of - k) for k in range(bits))


def plan(n: int, radius: int = RADIUS) -> Plan:
    """The samples for ``n`` signatures; see the module's text."""
    bits = min(BITS // 4, max(LEAST_BITS, math.ceil(math.log2(max(1, n / LOAD)))))
    route = min(bits - 1, max(LEAST_ROUTE, math.ceil(math.log2(max(1, n / ROUTE_ROWS)))))
    inside = 1 - (1 - _shared(bits - route, BITS - route, radius)) ** PER_GROUP
    hit = _shared(route, BITS, radius) * inside
    return Plan(route, bits - route, max(1, math.ceil(math.log(1 - RECALL) / math.log(1 - hit)) if hit < 1 else 1))


def _gathered(bits: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The bits (n, 256) at some places, as numbers."""
    out = np.zeros(len(bits), np.uint64)
    for k, place in enumerate(places):
        out |= bits[:, place].astype(np.uint64) << np.uint64(k)
    return out


def _bits(sigs: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(sigs).view(np.uint8), axis=1, bitorder="little")


def sample_keys(sigs: np.ndarray, how: Plan) -> np.ndarray:
    """Keys (n, groups * PER_GROUP) of signatures (n, 4), of route and own bits."""
    bits = _bits(sigs)
    columns = []
    for route, own in how.samples():
        head = _gathered(bits, route) << np.uint64(how.own)
        columns += [head | _gathered(bits, places) for places in own]
    return np.stack(columns, 1)


def _carry_save(a, b, c):
    u = a ^ b
    return u ^ c, (a & b) | (u & c)


class _Counter:
    """Bitwise counters of words of 64 lanes: ones, twos, fours, eights and the ripple above."""

    def __init__(self, n: int):
        self.low = [np.zeros(n, np.uint64) for _ in range(4)]
        self.high = [np.zeros(n, np.uint64) for _ in range(5)]

    def add16(self, x: list[np.ndarray]) -> None:
        ones, twos, fours, eights = self.low
        level = x
        carries = []
        for k in range(0, 16, 2):
            ones, c = _carry_save(ones, level[k], level[k + 1])
            carries.append(c)
        level, carries = carries, []
        for k in range(0, 8, 2):
            twos, c = _carry_save(twos, level[k], level[k + 1])
            carries.append(c)
        level, carries = carries, []
        for k in range(0, 4, 2):
            fours, c = _carry_save(fours, level[k], level[k + 1])
            carries.append(c)
        eights, carry = _carry_save(eights, carries[0], carries[1])
        self.low = [ones, twos, fours, eights]
        for k in range(5):
            self.high[k], carry = self.high[k] ^ carry, self.high[k] & carry

    def keep(self, mask: np.ndarray) -> None:
        self.low = [x[mask] for x in self.low]
        self.high = [x[mask] for x in self.high]

    def above(self, radius: int) -> np.ndarray:
        """Lanes whose count exceeds the radius."""
        planes = self.low + self.high
        more = np.zeros_like(planes[0])
        equal = ~more
        for k in range(len(planes) - 1, -1, -1):
            if radius >> k & 1:
                equal &= planes[k]
            else:
                more |= equal & planes[k]
                equal &= ~planes[k]
        return more


def _find(parent: np.ndarray, x: np.ndarray) -> np.ndarray:
    while True:
        up = parent[x]
        if np.array_equal(up, parent[up]):
            return up
        parent[x] = parent[up]


def _unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    while len(a):
        a, b = _find(parent, a), _find(parent, b)
        apart = a != b
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))


def sliced_pairs(sigs: np.ndarray, sizes: np.ndarray, radius: int, entries: int = 16384, last: np.ndarray | None = None):
    """Pairs (i, j), i < j, of rows in the same run whose signatures are within the radius.

    ``sizes`` are the lengths of the runs of rows that share a key; ``last`` is the last row of each row's group in its run (the row
    itself where it isn't given): a row meets the rows after that one only. Yields arrays.
    """
    n = len(sigs)
    words = -(-sizes // 64)
    first_word = np.cumsum(words) - words
    run = np.repeat(np.arange(len(sizes)), sizes)
    local = np.arange(n) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    word, lane = first_word[run] + local // 64, local % 64
    total = int(words.sum())
    bits = np.unpackbits(np.ascontiguousarray(sigs).view(np.uint8), axis=1, bitorder="little")
    lanes = np.zeros((total * 64, BITS), np.uint8)
    lanes[word * 64 + lane] = bits
    planes = np.ascontiguousarray(np.packbits(lanes, axis=0, bitorder="little").T).view(np.uint64)
    del lanes
    query = np.ascontiguousarray(bits.T)
    row_at = np.full(total * 64, -1, np.int64)
    row_at[word * 64 + lane] = np.arange(n)
    filled = np.zeros(total, np.uint64)
    np.bitwise_or.at(filled, word, np.uint64(1) << lane.astype(np.uint64))
    flip = np.array([0, ~np.uint64(0)], np.uint64)
    if last is not None:
        word, lane = word[last], lane[last]
    after = np.where(lane == 63, np.uint64(0), ~np.uint64(0) << ((lane + 1) % 64).astype(np.uint64))
    todo = (first_word + words)[run] - word
    done = np.cumsum(todo)
    for begin in range(0, int(done[-1]) if n else 0, entries):
        at = np.arange(begin, min(begin + entries, int(done[-1])))
        q = np.searchsorted(done, at, "right")
        step = at - (done[q] - todo[q])
        w = word[q] + step
        live = filled[w] & np.where(step == 0, after[q], ~np.uint64(0))
        some = live != 0
        q, w, live = q[some], w[some], live[some]
        counter = _Counter(len(q))
        for block in range(0, BITS, 32):
            for half in (0, 16):
                counter.add16([planes[p][w] ^ flip[query[p][q]] for p in range(block + half, block + half + 16)])
            live = live & ~counter.above(radius)
            keep = live != 0
            if not keep.any():
                q = q[:0]
                break
            if keep.mean() < 0.8:
                q, w, live = q[keep], w[keep], live[keep]
                counter.keep(keep)
        if len(q):
            flags = np.unpackbits(live.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            e, bit = np.nonzero(flags)
            if len(e):
                yield q[e], row_at[w[e] * 64 + bit]


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal values."""
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return starts, np.diff(np.append(starts, len(keys)))


def _local_groups(records: np.ndarray, how: Plan, radius: int) -> np.ndarray:
    """Edges (comp, another comp) that connect the groups of the rows which share a key and a task and are within the radius."""
    names, comp = np.unique(records["comp"], return_inverse=True)
    parent = np.arange(len(names))
    order = np.argsort(records["task"], kind="stable")
    records, comp = records[order], comp[order]
    samples = how.samples()
    for start, size in zip(*_runs(records["task"])):
        part, own = records[start : start + size], comp[start : start + size]
        if own.min() == own.max():
            continue
        bits = _bits(part["sig"])
        for places in samples[int(part["group"][0])][1]:
            now = _find(parent, own)
            if now.min() == now.max():
                break
            key = _gathered(bits, places)
            order = np.lexsort((now, key))
            starts, sizes = _runs(key[order])
            mixed = np.maximum.reduceat(now[order], starts) != np.minimum.reduceat(now[order], starts)
            order = order[np.repeat(mixed, sizes)]
            sizes = sizes[mixed]
            at = 0
            while at < len(sizes):  # some 128 words of 64 rows at a time
                to = max(at + 1, int(np.searchsorted(np.cumsum(-(-sizes[at:] // 64)), 128, "right")) + at)
                first = int(sizes[:at].sum())
                rows = order[first : first + int(sizes[at:to].sum())]
                run = np.repeat(np.arange(to - at), sizes[at:to])
                heads, lengths = _runs(run * (len(names) + 1) + now[rows])
                last = np.repeat(heads + lengths - 1, lengths)
                for a, b in sliced_pairs(part["sig"][rows], sizes[at:to], radius, last=last):
                    _unite(parent, own[rows[a]].copy(), own[rows[b]].copy())
                at = to
    root = _find(parent, np.arange(len(names)))
    grouped = np.flatnonzero(root != np.arange(len(names)))
    return np.stack([names[grouped], names[root[grouped]]], 1)


def _routes(sigs: np.ndarray, how: Plan):
    """(group, route of each signature) for each group of samples; a route is unique over the groups."""
    bits = _bits(sigs)
    for group, (places, _) in enumerate(how.samples()):
        yield group, _gathered(bits, places) | np.uint64(group << how.route)


@dataclass
class Hot:
    """A route of many signatures: how many blocks its small groups have, and the large groups' first blocks and numbers of blocks."""

    small: int
    large: dict[int, tuple[int, int]]
    blocks: int

    def block_of(self, comps: np.ndarray, ids: np.ndarray) -> np.ndarray:
        out = (T.mix(comps.astype(np.uint64)) % np.uint64(max(self.small, 1))).astype(np.int64)
        for comp, (first, n) in self.large.items():
            own = np.flatnonzero(comps == comp)
            out[own] = first + (T.mix(ids[own].astype(np.uint64)) % np.uint64(n)).astype(np.int64)
        return out

    def partners(self, block: int) -> list[int]:
        """The blocks that a block meets: all but itself and those of its own large group."""
        own = next((range(first, first + n) for first, n in self.large.values() if first <= block < first + n), range(block, block + 1))
        return [b for b in range(self.blocks) if b not in own]


def hot_routes(rows: DataFrame, how: Plan, hot_rows: int = HOT_ROWS) -> dict[int, Hot]:
    """The routes of more than ``hot_rows`` rows (doc_id, comp, sig), and how they are cut.

    They are as many as rows * groups / hot_rows at most, and so are their large groups.
    """

    def count(batches):
        for batch in batches:
            if len(batch):
                sigs = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint64).reshape(-1, 4)
                comps = batch.column("comp").to_numpy()
                for _, route in _routes(sigs, how):
                    order = np.lexsort((comps, route))
                    heads = np.flatnonzero(np.concatenate([[True], (route[order][1:] != route[order][:-1]) | (comps[order][1:] != comps[order][:-1])]))
                    yield pa.RecordBatch.from_arrays([pa.array(route[order][heads].astype(np.int64)), pa.array(comps[order][heads]), pa.array(np.diff(np.append(heads, len(order))))], ["route", "comp", "n"])

    def count_routes(batches):
        for batch in batches:
            if len(batch):
                sigs = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint64).reshape(-1, 4)
                for _, route in _routes(sigs, how):
                    values, n = np.unique(route, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(values.astype(np.int64)), pa.array(n)], ["route", "n"])

    sizes = rows.mapInArrow(count_routes, "route long, n long").groupBy("route").agg(F.sum("n").alias("n")).filter(F.col("n") > hot_rows).collect()
    if not sizes:
        return {}
    known = {r["route"] for r in sizes}
    wanted = F.col("route").isin(sorted(known))
    large = rows.mapInArrow(count, "route long, comp long, n long").filter(wanted).groupBy("route", "comp").agg(F.sum("n").alias("n")).filter(F.col("n") > hot_rows // 2).collect()
    out = {}
    for r in sizes:
        own = sorted((x["comp"], x["n"]) for x in large if x["route"] == r["route"])
        rest = r["n"] - sum(n for _, n in own)
        small = -(-rest // hot_rows)
        at, cut = small, {}
        for comp, n in own:
            cut[comp] = (at, -(-n // hot_rows))
            at += cut[comp][1]
        out[r["route"]] = Hot(small, cut, at)
    return out


def similar_edges(rows: DataFrame, how: Plan, radius: int = RADIUS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(a, b), a != b: links that connect the groups of all rows (doc_id, comp, sig) which share a key and are within the radius."""
    width = P.shuffle_width(rows.sparkSession)
    hot = P.Shared(rows.sparkSession, hot_routes(rows, how, hot_rows))

    def scatter(batches):
        router = P.Router(width)
        for batch in batches:
            if not len(batch):
                continue
            ids, comps = batch.column("doc_id").to_numpy(), batch.column("comp").to_numpy()
            sigs = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint64).reshape(-1, 4)
            for group, route in _routes(sigs, how):
                parts = [(np.arange(len(ids)), T.mix(route + np.uint64(1)))]
                for name in np.intersect1d(route, np.array(sorted(hot.value), np.uint64)).tolist():
                    at, task = parts[0]
                    parts[0] = at[route[at] != name], task[route[at] != name]
                    own = np.flatnonzero(route == name)
                    block = hot.value[name].block_of(comps[own], ids[own])
                    for b in np.unique(block).tolist():
                        mine = own[block == b]
                        for other in hot.value[name].partners(b):
                            pair = np.array([name, min(b, other), max(b, other)], np.uint64)
                            parts.append((mine, np.full(len(mine), T.mix(T.mix(T.mix(pair[:1] + np.uint64(1)) + pair[1:2]) + pair[2:])[0])))
                for at, task in parts:
                    records = np.empty(len(at), _RECORD)
                    records["task"], records["group"] = task, group
                    records["id"], records["comp"], records["sig"] = ids[at], comps[at], sigs[at]
                    yield from router.add(task % np.uint64(width), records)
        yield from router.flush()

    def compare(batches):
        edges = _local_groups(P.unpacked(batches, _RECORD), how, radius)
        yield pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], ["a", "b"])

    return P.exchanged(rows.mapInArrow(scatter, P.BLOCK_SCHEMA), width).mapInArrow(compare, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of the component of each node, by large-star and small-star rounds.

    A round's least neighbours are aggregated before the shuffle and joined back, so that the neighbours of a hot node may be split
    over tasks.
    """

    def leveled(pairs: DataFrame) -> DataFrame:
        least = pairs.groupBy("a").agg(F.min("b").alias("m"))
        return pairs.join(least, "a")

    now = P.checkpointed(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == before or not state["n"]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = leveled(both).filter("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()
        small = leveled(large)
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b")))
        now = P.checkpointed(small.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())


def _renamed(rows: DataFrame, names: DataFrame, column: str) -> DataFrame:
    """``rows`` with the root of ``column`` by (node, root) in its place, where it has one."""
    names = names.toDF("named", "instead")
    return rows.join(names, rows[column] == names["named"], "left").withColumn(column, F.coalesce("instead", column)).drop("named", "instead")


def word_links(rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): each row (doc_id, sig) and, for each word of its signature, the least row with that word, if within the radius."""
    words = [F.conv(F.substring(F.hex("sig"), 16 * k + 1, 16), 16, -10).cast("long") for k in range(4)]
    wide = rows.select("doc_id", F.array(*words).alias("words"))
    each = wide.select("doc_id", "words", F.posexplode("words").alias("place", "word"))
    least = each.groupBy("place", "word").agg(F.min(F.struct("doc_id", "words")).alias("m"), F.count("*").alias("n")).filter("n > 1")
    both = each.join(least.select("place", "word", F.col("m.doc_id").alias("b"), F.col("m.words").alias("other")), ["place", "word"]).filter("doc_id <> b")
    apart = F.aggregate(F.zip_with("words", "other", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return both.filter(apart <= radius).select(F.col("doc_id").alias("a"), "b")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(doc_id, duplicate_of) of every document that has a near copy with a lesser doc_id in its group.

    Texts without a word and null texts are never duplicates; a text of any length is signed whole; rows without a doc_id are left
    out; rows that share a doc_id are one document, linked by any of their texts. Ties do not arise: groups are named by their least
    doc_id. An empty table gives no rows. Other columns are not read.
    """
    signed = P.checkpointed(signatures(docs))
    least = signed.groupBy("sig").agg(F.min("doc_id").alias("sid"))
    rows = P.checkpointed(least.select(F.col("sid").alias("doc_id"), "sig"))
    same = signed.join(least, "sig").filter("doc_id <> sid").select(F.col("doc_id").alias("a"), F.col("sid").alias("b"))
    first = P.checkpointed(components(same.union(word_links(rows, radius))))
    grouped = P.checkpointed(_renamed(rows.withColumn("comp", F.col("doc_id")), first, "comp"))
    second = P.checkpointed(components(similar_edges(grouped, plan(rows.count(), radius), radius, hot_rows)))
    moved = _renamed(first, second, "root")
    alone = second.join(first.select("node"), "node", "left_anti")
    return moved.union(alone).select(F.col("node").alias("doc_id"), F.col("root").alias("duplicate_of"))


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without the near copies: one document of each group stays, with all its columns.

    Rows that repeat both doc_id and text stay once; rows without a doc_id all stay. Otherwise as ``near_duplicates``.
    """
    key = P.fresh_name(docs, "copy_of_group")
    gone = near_duplicates(docs, **options).select(F.col("doc_id").alias(key))
    kept = docs.join(gone, docs["doc_id"].cast("long") == gone[key], "left_anti")
    named = kept.filter("doc_id is not null").dropDuplicates(["doc_id", "text"])
    return named.unionByName(kept.filter("doc_id is null"))
