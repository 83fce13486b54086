"""Line deduplication by an exact set-similarity join.

A line is the set of its words. A later line (by doc_id, then line number) is removed if an
earlier one has a Jaccard similarity of at least ``NUM/DEN`` with it, or the same words. Words
are ordered by rarity, counted over all lines (in a hashed table of fixed size: any fixed order
keeps the join exact, a rarer-first one keeps it fast). Lines that reach the threshold share a
word of their prefixes, so each line is posted under its prefix words, except words that no
other line has. Within a word's postings the length filter bounds a window of sizes, the
positional filter bounds the overlap, and parity sketches (64 bits; 512 for pairs with a line
of over 120 words) bound the symmetric difference from below; none of them drops a pair that would pass.
Pairs that are left are verified on the words themselves.

Of each word's postings the lines that have a pair left are sent, with their words, to one group,
where overlaps are counted exactly: a line travels once for each of its prefix words that has such a
pair, however many pairs there are, and no pair is left out. Lines with the same words are
folded to their first occurrence before they are paired, so hot lines cost no pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import packing as P
from . import textblock as T

NUM, DEN = 9, 10
SLOTS = 1 << 21
LEAST_MARKS, MOST_MARKS = 20, 29
_ROWS = 512
SHORT_TO = 120
_LONG = 512
_CHUNK = 1 << 20
_BASE = [("token", "<u4"), ("size", "<u4"), ("pos", "<u2"), ("lead", "?"), ("set", "<u8"), ("doc", "<i8"), ("line", "<i4")]
_SHORT_RECORD = np.dtype([*_BASE, ("parity", "<u8", (1,))])
_LONG_RECORD = np.dtype([*_BASE, ("parity", "<u8", (_LONG // 64,))])
_MEMBER = "part long, doc long, line int, set long"
_SET = np.uint64(0x5851F42D4C957F2D)


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - 21)).astype(np.int64)


def _line_words(column):
    """(first row, row of each line, number of each line, word hashes, line of each word) by block.

    Lines without a word are left out; numbers count every line of the text from 0.
    """
    for first, _, data, offsets in T.text_blocks(T.lowered(column)):
        at, to = T.spans(T.word_mask(data), offsets)
        hashes = T.hash_spans(data, at, to)
        breaks = np.flatnonzero(data == 10)
        rows = T.row_of(at, offsets)
        before = np.searchsorted(breaks, at)
        new = np.concatenate([[True], (before[1:] != before[:-1]) | (rows[1:] != rows[:-1])]) if len(at) else np.zeros(0, bool)
        heads = np.flatnonzero(new)
        line_rows = rows[heads]
        numbers = before[heads] - np.searchsorted(breaks, offsets[line_rows])
        yield first, line_rows, numbers, hashes, np.cumsum(new) - 1


def _count(batch: pa.RecordBatch, totals: np.ndarray) -> None:
    for _, _, _, hashes, line in _line_words(batch.column("text")):
        hashes = T.distinct_words(hashes, line)[1]
        totals += np.bincount(_slot(hashes), minlength=SLOTS)


def rarity(docs: DataFrame) -> np.ndarray:
    """Sixteen-bit rank of each hashed word by the number of lines that hold it; 0 for a single line."""
    totals = P.hashed_totals(docs.select("text"), SLOTS, _count)
    return np.minimum(np.floor(np.log2(np.maximum(totals, 1)) * 31), 1023).astype(np.uint16) + (totals > 1)


def _postings(column, ids: np.ndarray, rank: np.ndarray, num: int, den: int):
    """Posting records of all lines: (short ones, long ones) by block."""
    for first, line_rows, numbers, hashes, line in _line_words(column):
        if not len(hashes):
            continue
        order_value = (rank[_slot(hashes)].astype(np.uint64) << np.uint64(53)) | (hashes >> np.uint64(11))
        by = T._row_sort(order_value, line)
        value, hashes, line = order_value[by], hashes[by], line[by]
        new = np.concatenate([[True], (value[1:] != value[:-1]) | (line[1:] != line[:-1])])
        value, hashes, line = value[new], hashes[new], line[new]
        n = len(line_rows)
        begin = np.searchsorted(line, np.arange(n))
        size = np.diff(np.append(begin, len(line)))
        with np.errstate(over="ignore"):
            whole = np.add.reduceat(T.mix(hashes + _SET), begin)
        one = np.uint64(1)
        parity = np.bitwise_xor.reduceat(one << (hashes & np.uint64(63)), begin)
        place = np.arange(len(line)) - begin[line]
        prefix = size - (num * size + den - 1) // den + 1
        posted = (place < prefix[line]) & (value >> np.uint64(53) > 0)
        at = np.flatnonzero(posted)
        owner = line[at]
        base = {"token": (T.mix(hashes[at]) >> np.uint64(32)).astype(np.uint32), "size": size[owner], "pos": np.minimum(place[at], 65535), "lead": np.concatenate([[True], owner[1:] != owner[:-1]]) if len(at) else posted[:0], "set": whole[owner], "doc": ids[first + line_rows[owner]], "line": numbers[owner]}
        short = size[owner] <= SHORT_TO
        out = []
        for dtype, mask in ((_SHORT_RECORD, short), (_LONG_RECORD, size[owner] >= num * SHORT_TO // den)):
            records = np.zeros(int(mask.sum()), dtype)
            for name, values in base.items():
                records[name] = values[mask]
            if dtype is _SHORT_RECORD:
                records["parity"][:, 0] = parity[owner[mask]]
            elif len(records):
                bit = (hashes >> np.uint64(6)) & np.uint64(_LONG - 1)
                wide = np.zeros((n, _LONG // 64), np.uint64)
                for w in range(_LONG // 64):
                    wide[:, w] = np.bitwise_xor.reduceat(np.where(bit >> np.uint64(6) == w, one << (bit & np.uint64(63)), np.uint64(0)), begin)
                records["parity"] = wide[owner[mask]]
            out.append(records)
        yield out


def _line_key(doc: np.ndarray, line: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return T.mix(doc.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + line.astype(np.uint64))


def _folded(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first line of each (word, set), and lead postings of the later ones, with the first as theirs."""
    r = r[np.lexsort((r["line"], r["doc"], r["set"], r["token"]))]
    new = np.concatenate([[True], (r["token"][1:] != r["token"][:-1]) | (r["set"][1:] != r["set"][:-1])]) if len(r) else np.zeros(0, bool)
    heads = np.flatnonzero(new)
    first = r[heads[np.cumsum(new) - 1]] if len(r) else r
    later = r["lead"] & ((r["doc"] != first["doc"]) | (r["line"] != first["line"]))
    return r[new], np.stack([r["doc"][later], r["line"][later]], 1) if later.any() else np.zeros((0, 2), np.int64)


def _survivors(r: np.ndarray, num: int, den: int):
    """Chunks of pairs of record numbers that pass all filters; r is sorted by word and size."""
    n = len(r)
    size, pos = r["size"].astype(np.int64), r["pos"].astype(np.int64)
    key = (r["token"].astype(np.uint64) << np.uint64(32)) | r["size"].astype(np.uint64)
    least = (r["token"].astype(np.uint64) << np.uint64(32)) | ((num * size + den - 1) // den).astype(np.uint64)
    start = np.searchsorted(key, least)
    count = np.arange(n) - start
    done = np.cumsum(count)
    parity = np.ascontiguousarray(r["parity"])
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + _CHUNK, "right")))
        c = count[at:to]
        i = np.repeat(np.arange(at, to), c)
        j = np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c) + start[i]
        both = size[i] + size[j]
        need = (num * both + num + den - 1) // (num + den)
        ok = 1 + np.minimum(size[i] - pos[i], size[j] - pos[j]) - 1 >= need
        i, j, slack = i[ok], j[ok], (both - 2 * need)[ok]
        ok = np.bitwise_count(parity[i] ^ parity[j]).sum(1, dtype=np.int64) <= slack
        i, j = i[ok], j[ok]
        differ = (r["doc"][i] != r["doc"][j]) | (r["line"][i] != r["line"][j])
        yield i[differ], j[differ]
        at = to


def _members(r: np.ndarray, num: int, den: int) -> np.ndarray:
    """The postings that are in a pair that passes all filters."""
    r = r[np.argsort((r["token"].astype(np.uint64) << np.uint64(32)) | r["size"].astype(np.uint64), kind="stable")]
    paired = np.zeros(len(r), bool)
    for later, earlier in _survivors(r, num, den):
        paired[later] = True
        paired[earlier] = True
    return r[paired]


def _matched(sizes: np.ndarray, words: np.ndarray, num: int, den: int) -> np.ndarray:
    """Of sets in order of place, given by their sizes and joined words: those that an earlier one matches."""
    n = len(sizes)
    begin = np.append(0, np.cumsum(sizes))
    hit = np.zeros(n, bool)
    for a in range(0, n, _ROWS):
        for b in range(0, a + 1, _ROWS):
            x, y = slice(begin[b], begin[min(b + _ROWS, n)]), slice(begin[a], begin[min(a + _ROWS, n)])
            rows_x = np.repeat(np.arange(len(sizes[b : b + _ROWS])), sizes[b : b + _ROWS])
            rows_y = np.repeat(np.arange(len(sizes[a : a + _ROWS])), sizes[a : a + _ROWS])
            both, number = np.unique(np.concatenate([words[x], words[y]]), return_inverse=True)
            shared = np.zeros((rows_y.max() + 1, rows_x.max() + 1), np.float32)
            for low in range(0, len(both), 8192):
                mx, my = (np.zeros((rows.max() + 1, min(8192, len(both) - low)), np.float32) for rows in (rows_x, rows_y))
                for m, rows, part in ((mx, rows_x, number[: len(rows_x)]), (my, rows_y, number[len(rows_x) :])):
                    here = (part >= low) & (part < low + 8192)
                    m[rows[here], part[here] - low] = 1
                shared += my @ mx.T
            enough = shared * (num + den) >= num * (sizes[a : a + _ROWS, None] + sizes[None, b : b + _ROWS])
            if a == b:
                enough &= np.tri(len(enough), k=-1, dtype=bool)
            hit[a : a + _ROWS] |= enough.any(1)
    return hit


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, string_split(text, chr(10)) AS lines FROM {docs} WHERE doc_id IS NOT NULL AND text IS NOT NULL
), l AS (
  SELECT doc_id, i - 1 AS line, list_sort(list_distinct(regexp_extract_all(lower(lines[i]), '[0-9a-z_\x{{80}}-\x{{10FFFF}}]+'))) AS words
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM d)
), n AS (
  SELECT doc_id, line, words, row_number() OVER (PARTITION BY words ORDER BY doc_id, line) AS nth FROM l WHERE len(words) > 0
), f AS (
  SELECT row_number() OVER (ORDER BY doc_id, line) AS id, doc_id, line, words, len(words) AS size FROM n WHERE nth = 1
), w AS (
  SELECT id, size, unnest(words) AS word FROM f
), m AS (
  SELECT b.id FROM w a JOIN w b ON a.word = b.word AND a.id < b.id AND a.size * 10 >= b.size * 9 AND b.size * 10 >= a.size * 9
  GROUP BY a.id, b.id, a.size, b.size HAVING count(*) * 19 >= (a.size + b.size) * 9
), r AS (
  SELECT doc_id, line FROM n WHERE nth > 1 UNION SELECT f.doc_id, f.line FROM f JOIN m USING (id)
), g AS (
  SELECT doc_id, list(line) AS lost FROM r GROUP BY doc_id
), c AS (
  SELECT d.doc_id, g.lost, d.text AS old, d.lang, d.source, d.n_chars,
         CASE WHEN g.lost IS NULL THEN d.text
              ELSE list_aggregate(list_filter(string_split(d.text, chr(10)), lambda x, i: NOT list_contains(g.lost, i - 1)), 'string_agg', chr(10)) END AS text
  FROM {docs} d LEFT JOIN g ON d.doc_id = g.doc_id
)
SELECT doc_id, text, lang, source, CASE WHEN lost IS NULL THEN n_chars ELSE length(text) END AS n_chars
FROM c WHERE lost IS NULL OR regexp_matches(text, '[0-9A-Za-z_\x{{80}}-\x{{FFFF}}]')
"""


class _Join:
    """The stages of the join over one DataFrame of (doc_id, text)."""

    def __init__(self, docs: DataFrame, num: int, den: int):
        self.docs, self.num, self.den = docs, num, den
        self.spark = docs.sparkSession
        self.width = P.shuffle_width(self.spark)
        self.rank = P.Shared(self.spark, rarity(docs))

    def blocks(self) -> DataFrame:
        rank, width, num, den = self.rank, self.width, self.num, self.den

        def post(batches):
            routers = P.Router(width), P.Router(width)
            for batch in batches:
                ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
                for block in _postings(batch.column("text"), ids, rank.value, num, den):
                    for kind, records in enumerate(block):
                        for out in routers[kind].add(records["token"] % width, records):
                            yield _shifted(out, kind * width)
            for kind in (0, 1):
                for out in routers[kind].flush():
                    yield _shifted(out, kind * width)

        return P.exchanged(self.docs.mapInArrow(post, P.BLOCK_SCHEMA), 2 * width)

    def members(self) -> DataFrame:
        """(part, doc, line, set) of lines that have a pair left in a word's postings; part null: the same words as an earlier line."""
        width, num, den = self.width, self.num, self.den

        def search(batches):
            batches = list(batches)
            dest = next((b.column("dest")[0].as_py() for b in batches if len(b)), 0)
            records = P.unpacked(iter(batches), _LONG_RECORD if dest >= width else _SHORT_RECORD)
            firsts, copies = _folded(records)
            del records
            r = _members(firsts, num, den)
            part = r["token"].astype(np.int64) * 2 + (dest >= width)
            names = ["part", "doc", "line", "set"]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(r["doc"]), pa.array(r["line"]), pa.array(r["set"].view(np.int64))], names)
            none = pa.nulls(len(copies), pa.int64())
            yield pa.RecordBatch.from_arrays([none, pa.array(copies[:, 0]), pa.array(copies[:, 1].astype(np.int32)), none], names)

        return self.blocks().mapInArrow(search, _MEMBER)

    def verified(self, members: DataFrame) -> DataFrame:
        """(doc, line) of the members that an earlier member of their group matches, counted on their words.

        A line is known by its document, number and set of words, as rows with other texts may share its doc_id.
        """
        marks = P.Shared(self.spark, _marks(members))
        num, den = self.num, self.den

        def lines(batches):
            for batch in batches:
                batch = batch.filter(pa.array(_marked(marks.value, _line_key(batch.column("doc_id").to_numpy(zero_copy_only=False), np.zeros(len(batch))))))
                ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
                for first, line_rows, numbers, hashes, line in _line_words(batch.column("text")):
                    doc = ids[first + line_rows]
                    wanted = _marked(marks.value, _line_key(doc, numbers + 1))
                    keep = wanted[line] if len(line) else np.zeros(0, bool)
                    owner, value, _ = T.unique_per_row(hashes[keep], line[keep])
                    wanted = np.flatnonzero(wanted)
                    begin = np.searchsorted(owner, np.append(wanted, len(line_rows)))
                    with np.errstate(over="ignore"):
                        sets = np.add.reduceat(T.mix(value + _SET), begin[:-1]) if len(wanted) else np.zeros(0, np.uint64)
                    words = pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(value.view(np.int64)))
                    yield pa.RecordBatch.from_arrays([pa.array(doc[wanted].astype(np.int64)), pa.array(numbers[wanted].astype(np.int32)), pa.array(sets.view(np.int64)), words], ["doc", "line", "set", "words"])

        def compare(batches):
            batches = list(batches)
            if not batches:
                return
            table = pa.Table.from_batches(batches).combine_chunks()
            part, doc, line = (table.column(c).to_numpy() for c in ("part", "doc", "line"))
            order = np.lexsort((line, doc, part))
            found = []
            if len(order):
                words = table.column("words").chunk(0)
                offsets = words.offsets.to_numpy().astype(np.int64)
                flat = words.values.to_numpy()
                sizes = np.diff(offsets)
                cut = np.flatnonzero(np.concatenate([[True], np.diff(part[order]) != 0, [True]]))
                for a, b in zip(cut[:-1], cut[1:]):
                    rows = order[a:b]
                    group = np.concatenate([flat[offsets[i] : offsets[i + 1]] for i in rows])
                    found.append(rows[_matched(sizes[rows], group, num, den)])
            rows = np.concatenate(found) if found else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(doc[rows].astype(np.int64)), pa.array(line[rows].astype(np.int32))], ["doc", "line"])

        sets = self.docs.mapInArrow(lines, "doc long, line int, set long, words array<long>").dropDuplicates(["doc", "line", "set"])
        held = members.join(sets, ["doc", "line", "set"]).repartition(self.width, "part")
        return held.mapInArrow(compare, "doc long, line int").distinct()


def _shifted(batch: pa.RecordBatch, by: int) -> pa.RecordBatch:
    dest = pa.array(batch.column("dest").to_numpy() + np.int32(by), pa.int32())
    return pa.RecordBatch.from_arrays([dest, batch.column("payload")], ["dest", "payload"])


def _marked(marks: np.ndarray, keys: np.ndarray) -> np.ndarray:
    slot = keys % np.uint64(8 * len(marks))
    return ((marks[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)


def _marks(members: DataFrame, most: int = MOST_MARKS) -> np.ndarray:
    """A bitmap over hashed keys of the members and their documents, of some sixteen bits a member.

    A false positive costs a line that is sent in vain, and nothing else. The bitmap goes to all tasks, so it has 2**most bits
    (64 MB) at most: with many more members than that most lines are sent, and the join picks them out.
    """
    n = members.count()
    bits = 1 << int(np.clip(np.ceil(np.log2(max(1, 16 * n))), min(LEAST_MARKS, most), most))
    parts = max(1, bits >> 25)
    span = bits // parts
    record = np.dtype([("at", "<u4"), ("bits", "u1")])

    def collect(batches):
        used = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            doc, line = batch.column("doc").to_numpy(), batch.column("line").to_numpy()
            for place in (line.astype(np.int64) + 1, np.zeros(len(line))):
                slot = _line_key(doc, place) % np.uint64(bits)
                np.bitwise_or.at(used, (slot >> np.uint64(3)).astype(np.int64), np.uint8(1) << (slot & np.uint64(7)).astype(np.uint8))
        at = np.flatnonzero(used)
        records = np.empty(len(at), record)
        records["at"], records["bits"] = at, used[at]
        router = P.Router(parts)
        yield from router.add(at // (span // 8), records)
        yield from router.flush()

    def merge(batches):
        used, part = np.zeros(span // 8, np.uint8), None
        for batch in batches:
            for k in range(len(batch)):
                part = batch.column("dest")[k].as_py()
                records = P.unpacked(iter([batch.slice(k, 1)]), record)
                np.bitwise_or.at(used, records["at"].astype(np.int64) - part * (span // 8), records["bits"])
        if part is not None:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([used.tobytes()], pa.binary())], ["dest", "payload"])

    out = np.zeros(bits // 8, np.uint8)
    for row in P.exchanged(members.select("doc", "line").mapInArrow(collect, P.BLOCK_SCHEMA), parts).mapInArrow(merge, P.BLOCK_SCHEMA).collect():
        out[row["dest"] * (span // 8) : (row["dest"] + 1) * (span // 8)] = np.frombuffer(row["payload"], np.uint8)
    return out


def repeated_lines(docs: DataFrame, num: int = NUM, den: int = DEN) -> DataFrame:
    """(doc, line) of every line to remove, numbered from 0 in its text.

    Lines without a word, and so null and blank texts, are never removed; texts and lines of any length are compared whole. Rows
    without a doc_id take no part; rows that share a doc_id share decisions, line number by line number, and don't remove each other's
    same line, whether or not their texts differ. Of equal lines the one of the least doc_id and number stays. An empty table gives no rows.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null and text is not null")
    join = _Join(narrow, num, den)
    found = P.checkpointed(join.members())
    copies = found.filter("part is null").select("doc", "line")
    return copies.union(join.verified(found.filter("part is not null"))).distinct()


def deduplicated(docs: DataFrame, num: int = NUM, den: int = DEN) -> DataFrame:
    """``docs`` without the later matches, with all columns; n_chars, if there, follows the text.

    A text that loses lines is joined again from the others; a document that lost lines and has no
    word left goes. Documents that lose nothing (null and empty texts among them) stay as they are.
    """
    row, lost, old = (P.fresh_name(docs, f"line_{x}") for x in ("doc", "lost", "text"))
    gone = repeated_lines(docs, num, den).groupBy("doc").agg(F.collect_set("line").alias(lost)).withColumnRenamed("doc", row)
    joined = docs.join(gone, docs["doc_id"].cast("long") == gone[row], "left")
    lines = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(F.col(lost), i))
    text = F.when(F.col(lost).isNull(), F.col("text")).otherwise(F.array_join(lines, "\n"))
    cleaned = joined.withColumn(old, text)
    cleaned = cleaned.filter(F.col(lost).isNull() | F.col(old).rlike("[0-9A-Za-z_\\u0080-\\uFFFF]"))
    new = {"text": F.col(old)}
    if "n_chars" in docs.columns:
        length = F.length(old).cast(docs.schema["n_chars"].dataType)
        new["n_chars"] = F.when(F.col(lost).isNull(), F.col("n_chars")).otherwise(length)
    return cleaned.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])
