"""License scans with a positional index of rare words.

A template is a licence's notice, given by its mandatory key phrases. The words of all phrases are counted over all
documents. Each phrase is posted under its anchors, the words of its highest inverse document frequency (two of them, or one if it has
no other): word -> (phrase, place in the phrase). Of a file only the anchors that it holds are looked up, each phrase by its rarest
one first: its common licence words ("the", "is", "license" where that is common) are never looked up. A phrase is a candidate
where both its anchors stand at the distance that their places say; then it is verified word by word against the file's words there.
A file has a licence if all phrases of one of its templates are verified. Rarity decides what is looked up, never what is found.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import packing as P
from . import textblock as T

ANCHORS = 2
#: Licence and mandatory phrases, as words in lower case; a licence may have several such lists.
LICENSES: list[tuple[str, tuple[str, ...]]] = [
    ("MIT", ("mit license",)),
    ("MIT", ("permission is hereby granted free of charge", "the software is provided as is without warranty of any kind")),
    ("Apache-2.0", ("apache license version 2 0",)),
    ("Apache-2.0", ("www apache org licenses license 2 0",)),
    ("GPL-3.0", ("gnu general public license version 3",)),
    ("GPL-3.0", ("gnu general public license", "either version 3 of the license")),
    ("GPL-2.0", ("gnu general public license version 2",)),
    ("GPL-2.0", ("gnu general public license", "either version 2 of the license")),
    ("LGPL-3.0", ("gnu lesser general public license version 3",)),
    ("LGPL-2.1", ("gnu lesser general public license version 2 1",)),
    ("AGPL-3.0", ("gnu affero general public license version 3",)),
    ("BSD", ("redistribution and use in source and binary forms", "redistributions of source code must retain the above copyright notice")),
    ("BSD", ("bsd license",)),
    ("ISC", ("permission to use copy modify and or distribute this software for any purpose", "the software is provided as is and the author disclaims all warranties")),
    ("MPL-2.0", ("mozilla public license version 2 0",)),
    ("MPL-2.0", ("mozilla public license v 2 0",)),
    ("EPL-2.0", ("eclipse public license version 2 0",)),
    ("Unlicense", ("this is free and unencumbered software released into the public domain",)),
    ("CC0-1.0", ("cc0 1 0 universal",)),
    ("CC-BY-4.0", ("cc by 4 0",)),
    ("CC-BY-4.0", ("creative commons attribution 4 0 international",)),
    ("CC-BY-SA-4.0", ("cc by sa 4 0",)),
    ("CC-BY-NC-4.0", ("cc by nc 4 0",)),
    ("CC-BY-NC-4.0", ("creative commons attribution noncommercial 4 0 international",)),
    ("CC-BY-ND-4.0", ("cc by nd 4 0",)),
    ("CC-BY-NC-SA-4.0", ("cc by nc sa 4 0",)),
    ("BSD-3-Clause", ("redistribution and use in source and binary forms", "neither the name of", "may be used to endorse or promote products derived from this software without specific prior written permission")),
    ("Apache-2.0", ("licensed under the apache license version 2 0 the license", "you may not use this file except in compliance with the license")),
    ("BSL-1.0", ("boost software license version 1 0",)),
    ("BSL-1.0", ("permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",)),
    ("Zlib", ("this software is provided as is without any express or implied warranty", "altered source versions must be plainly marked as such")),
    ("PostgreSQL", ("permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted",)),
    ("WTFPL", ("do what the fuck you want to public license",)),
    ("Artistic-2.0", ("the artistic license 2 0",)),
    ("EUPL-1.2", ("european union public licence v 1 2",)),
    ("OFL-1.1", ("sil open font license version 1 1",)),
    ("CDDL-1.0", ("common development and distribution license", "version 1 0")),
    ("Proprietary", ("all rights reserved",)),
]
_SCHEMA = "doc_id long, license string, first_word int"


def _phrases(licenses) -> list[list[str]]:
    return [p.split() for p in sorted({p for _, phrases in licenses for p in phrases})]


def _vocabulary(licenses) -> np.ndarray:
    return np.array(sorted({T.hash_bytes(w.encode()) for p in _phrases(licenses) for w in p}), np.uint64)


def _known(hashes: np.ndarray, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which words are licence words, and their numbers."""
    slot = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
    at = np.flatnonzero(vocabulary[slot] == hashes)
    return at, slot[at]


def document_frequency(docs: DataFrame, licenses=LICENSES) -> np.ndarray:
    """In how many documents each licence word occurs."""
    vocabulary = _vocabulary(licenses)

    def count(batch, totals):
        for _, _, data, offsets in T.text_blocks(T.lowered(batch.column("text"))):
            starts, ends, rows = T.words(data, offsets)
            at, word = _known(T.hash_spans(data, starts, ends), vocabulary)
            pairs = np.unique(rows[at] * len(vocabulary) + word)
            totals += np.bincount(pairs % len(vocabulary), minlength=len(totals))

    return P.hashed_totals(docs.select("text"), len(vocabulary), count, 1)


def index(frequency: np.ndarray, licenses=LICENSES) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, list[int]]]]:
    """Anchors by their hashes, sorted; their frequencies; and of each phrase the hashes of its words and the places of its
    anchors, the rarest first (ties: the earlier place)."""
    vocabulary = _vocabulary(licenses)
    phrases = []
    for phrase in _phrases(licenses):
        words = np.array([T.hash_bytes(w.encode()) for w in phrase], np.uint64)
        rank = frequency[np.searchsorted(vocabulary, words)]
        phrases.append((words, sorted(range(len(words)), key=lambda k: (rank[k], k))[:ANCHORS]))
    anchors = np.unique(np.concatenate([words[at] for words, at in phrases]))
    return anchors, frequency[np.searchsorted(vocabulary, anchors)], phrases


def found(hashes: np.ndarray, rows: np.ndarray, at: np.ndarray, anchor: np.ndarray, phrases, anchors: np.ndarray) -> dict[int, np.ndarray]:
    """For each phrase the sorted places, among all words of the block, where it stands within one text; ``at`` are the places of anchors."""
    order = np.argsort(anchor, kind="stable")
    cut = np.searchsorted(anchor[order], np.arange(len(anchors) + 1))
    places = at[order]
    result = {}
    for number, (words, own) in enumerate(phrases):
        of = [int(np.searchsorted(anchors, words[k])) for k in own]
        start = places[cut[of[0]] : cut[of[0] + 1]] - own[0]
        if len(own) > 1 and len(start):
            start = np.intersect1d(start, places[cut[of[1]] : cut[of[1] + 1]] - own[1], assume_unique=True)
        start = start[(start >= 0) & (start + len(words) <= len(rows))]
        start = start[rows[start] == rows[start + len(words) - 1]] if len(start) else start
        for k, word in enumerate(words):
            if k not in own and len(start):
                start = start[hashes[start + k] == word]
        result[number] = start
    return result


def scanned(docs: DataFrame, licenses=LICENSES) -> DataFrame:
    """(doc_id, license, first_word): each licence of each row; the word, from 0, where its first phrase first stands.

    Of several templates of a licence the least place counts, and of a phrase that stands more than once the first. Null and empty texts
    have none; a text of any length is scanned whole; an empty table gives no rows. Repeated rows each give theirs; a null doc_id
    stays null; other columns are not read.
    """
    names = {" ".join(p): k for k, p in enumerate(_phrases(licenses))}
    lists = [(name, [names[" ".join(p.split())] for p in phrases]) for name, phrases in licenses]
    shared = P.Shared(docs.sparkSession, index(document_frequency(docs, licenses), licenses))

    def scan(batches):
        for batch in batches:
            for first, last, data, offsets in T.text_blocks(T.lowered(batch.column("text"))):
                starts, ends, rows = T.words(data, offsets)
                anchors, _, phrases = shared.value
                hashes = T.hash_spans(data, starts, ends)
                at, anchor = _known(hashes, anchors)
                if not len(at):
                    continue
                places = found(hashes, rows, at, anchor, phrases, anchors)
                head = np.searchsorted(rows, np.arange(last - first))
                best: dict[tuple[int, str], int] = {}
                for name, numbers in lists:
                    holders = set(rows[places[numbers[0]]].tolist())
                    for n in numbers[1:]:
                        holders &= set(rows[places[n]].tolist())
                    if holders:
                        here = places[numbers[0]]
                        owner, once = np.unique(rows[here], return_index=True)
                        for row, place in zip(owner.tolist(), (here[once] - head[owner]).tolist()):
                            if row in holders:
                                best[row, name] = min(place, best.get((row, name), place))
                if best:
                    keys = sorted(best)
                    ids = batch.column("doc_id").take(pa.array([first + r for r, _ in keys]))
                    yield pa.RecordBatch.from_arrays([ids, pa.array([n for _, n in keys]), pa.array([best[k] for k in keys], pa.int32())], ["doc_id", "license", "first_word"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, _SCHEMA)


def _oracle(licenses=LICENSES) -> str:
    rows = ", ".join(f"('{name}', [{', '.join(repr(p) for p in phrases)}])" for name, phrases in licenses)
    return f"""
WITH t(license, phrases) AS (VALUES {rows}),
d AS (
  SELECT doc_id, ' ' || trim(regexp_replace(lower(text), '[^0-9a-z_\\x{{80}}-\\x{{10FFFF}}]+', ' ', 'g')) || ' ' AS words
  FROM {{docs}} WHERE text IS NOT NULL
), h AS (
  SELECT doc_id, license, substr(words, 1, strpos(words, ' ' || phrases[1] || ' ')) AS lead FROM d, t
  WHERE len(list_filter(phrases, lambda p: contains(words, ' ' || p || ' '))) = len(phrases)
)
SELECT doc_id, license, CAST(min(length(lead) - length(replace(lead, ' ', '')) - 1) AS INTEGER) AS first_word FROM h GROUP BY doc_id, license
"""


ORACLE_SQL = _oracle()
