"""Operators against brute force, SQL, round trips and held-out labels."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from quillgraph.llm import op01_simhash, op02_quality, op03_linededup, op04_mixing, op05_html, op06_language, op07_toxicity, op08_decontamination, op09_licenses, op10_secrets
from quillgraph.llm import textblock as T
from quillgraph.llm import queries

from .conftest import WORDS, sentence, text

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="module")
def labelled(spark):
    return spark.read.parquet(f"{SF}/labels.parquet").cache()


def test_words_and_hashes():
    texts = ["Ab c_d 1,2", "", None, "é—x “q” naïve", "a" * 40 + " " + "a" * 41]
    import pyarrow as pa

    (first, last, data, offsets), = T.text_blocks(T.lowered(pa.array(texts)))
    starts, ends, rows = T.words(data, offsets)
    got = [(int(r), bytes(data[a:b]).decode()) for a, b, r in zip(starts, ends, rows)]
    assert got == [(0, "ab"), (0, "c_d"), (0, "1"), (0, "2"), (3, "é"), (3, "x"), (3, "q"), (3, "naïve"), (4, "a" * 40), (4, "a" * 41)]
    hashes = T.hash_spans(data, starts, ends)
    assert len(set(hashes.tolist())) == len(got) and [T.hash_bytes(w.encode()) for _, w in got] == hashes.tolist()
    assert sum(z - a for a, z, *_ in T.text_blocks(pa.array(["x" * 50] * 30), 100)) == 30


def test_sliced_distances_equal_popcount():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, (40, 4), dtype=np.uint64)
    noise = np.packbits(rng.random((300, 256)) < 0.2, axis=1).view(np.uint64)
    sigs = base[rng.integers(0, 40, 300)] ^ noise
    sizes = np.array([1, 70, 129, 100])
    got = sorted((int(i), int(j)) for a, b in op01_simhash.sliced_pairs(sigs, sizes, 80, 64) for i, j in zip(a, b))
    want, at = [], 0
    for size in sizes:
        for i in range(at, at + size):
            for j in range(i + 1, at + size):
                if np.bitwise_count(sigs[i] ^ sigs[j]).sum() <= 80:
                    want.append((i, j))
        at += size
    assert got == want and want


def test_near_duplicates_recall(documents):
    rows = op01_simhash.signatures(documents).collect()
    ids = np.array([r["doc_id"] for r in rows])
    sigs = np.array([np.frombuffer(bytes(r["sig"]), np.uint64) for r in rows])
    group = {r["doc_id"]: r["duplicate_of"] for r in op01_simhash.near_duplicates(documents).collect()}
    pairs = [(int(ids[i]), int(ids[j])) for i in range(len(ids)) for j in np.flatnonzero(np.bitwise_count(sigs[i + 1 :] ^ sigs[i]).sum(1) <= op01_simhash.RADIUS) + i + 1]
    together = sum(group.get(a, a) == group.get(b, b) for a, b in pairs)
    assert together >= 0.95 * len(pairs) and len(pairs) > 50
    linked = {x for p in pairs for x in p}
    assert set(group) <= linked and all(group[x] < x for x in group)


@pytest.mark.parametrize("n", [1000, 10**5, 10**6])
def test_keys_reach_every_distance_up_to_the_radius(n):
    rng = np.random.default_rng(7)
    how = op01_simhash.plan(n)
    for distance in (20, 40, 50, 56, op01_simhash.RADIUS):
        sigs = rng.integers(0, 2**64, (1500, 4), dtype=np.uint64)
        flips = np.zeros((1500, op01_simhash.BITS), np.uint8)
        flips[np.arange(1500)[:, None], rng.random(flips.shape).argpartition(distance, 1)[:, :distance]] = 1
        near = sigs ^ np.packbits(flips, axis=1).view(np.uint64)
        assert (np.bitwise_count(sigs ^ near).sum(1) == distance).all()
        keys = [op01_simhash.sample_keys(x, how) for x in (sigs, near)]
        assert (keys[0] == keys[1]).any(1).mean() >= 0.9, distance


def test_keys_follow_the_number_of_signatures():
    for n in (0, 1, 10**4, 10**6, 10**8):
        how = op01_simhash.plan(n)
        assert n / 2 ** (how.route + how.own) <= op01_simhash.LOAD and n / 2**how.route <= op01_simhash.ROUTE_ROWS


def _force_groups(ids, sigs, radius):
    parent = dict(zip(ids, ids))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(sigs[i + 1 :] ^ sigs[i]).sum(1) <= radius) + i + 1:
            a, b = find(ids[i]), find(ids[j])
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in ids if find(x) != x}


def test_groups_equal_brute_force_with_hot_routes(frame):
    rng = random.Random(31)
    texts = [" ".join(f"{rng.choice(WORDS)}{rng.randrange(40)}" for _ in range(80)) for _ in range(25)]
    rows = [(k, t) for k, t in enumerate(texts)]
    for k in range(400):  # one group holds most rows
        words = texts[0 if k % 4 else k % 25].split(" ")
        for i in rng.sample(range(80), rng.randrange(5)):
            words[i] = rng.choice(WORDS)
        rows.append((100 + k, " ".join(words)))
    docs = frame(rows)
    signed = op01_simhash.signatures(docs).collect()
    ids, sigs = [r["doc_id"] for r in signed], np.array([np.frombuffer(bytes(r["sig"]), np.uint64) for r in signed])
    want = _force_groups(ids, sigs, op01_simhash.RADIUS)
    found = []
    for hot_rows in (op01_simhash.HOT_ROWS, 40, 7):
        found.append({r["doc_id"]: r["duplicate_of"] for r in op01_simhash.near_duplicates(docs, hot_rows=hot_rows).collect()})
    assert found[0] == found[1] == found[2]
    assert len(found[0]) >= 0.97 * len(want) and found[0].keys() <= want.keys()


def test_groups_equal_brute_force_on_documents(documents):
    signed = op01_simhash.signatures(documents).collect()
    ids, sigs = [r["doc_id"] for r in signed], np.array([np.frombuffer(bytes(r["sig"]), np.uint64) for r in signed])
    want = _force_groups(ids, sigs, op01_simhash.RADIUS)
    got = {r["doc_id"]: r["duplicate_of"] for r in op01_simhash.near_duplicates(documents).collect()}
    assert len(got.keys() - want.keys()) == 0 and len(got) >= 0.97 * len(want)
    assert sum(got[k] == want[k] for k in got) >= 0.97 * len(want)


def test_large_groups_dont_meet_themselves(spark, frame):
    how = op01_simhash.plan(100)
    rng = np.random.default_rng(3)
    sigs = np.tile(rng.integers(0, 2**64, 4, dtype=np.uint64), (300, 1))
    sigs[:, 0] ^= np.arange(300, dtype=np.uint64) % 8
    rows = spark.createDataFrame([(i, 0 if i < 290 else i, bytearray(s.tobytes())) for i, s in enumerate(sigs)], "doc_id long, comp long, sig binary")
    for hot in op01_simhash.hot_routes(rows, how, 64).values():
        assert hot.large[0][1] > 1 and all(not set(range(hot.large[0][0], sum(hot.large[0]))) & set(hot.partners(b)) for b in range(hot.large[0][0], sum(hot.large[0])))
    assert {frozenset(r) for r in op01_simhash.similar_edges(rows, how, hot_rows=64).collect()} and op01_simhash.components(op01_simhash.similar_edges(rows, how, hot_rows=64)).count() == 10


def test_copies_are_caught_and_others_left(frame):
    rng = random.Random(2)
    texts = [" ".join(f"{rng.choice(WORDS)}{rng.randrange(40)}" for _ in range(120)) for _ in range(60)]
    rows = list(enumerate(texts))
    for k in range(20):
        words = texts[k].split(" ")
        for i in rng.sample(range(len(words)), len(words) // 20):
            words[i] = rng.choice(WORDS)
        rows.append((100 + k, " ".join(words)))
    got = {r["doc_id"]: r["duplicate_of"] for r in op01_simhash.near_duplicates(frame(rows)).collect()}
    want = {100 + k: k for k in range(20)}
    assert got.items() <= want.items() and len(got) >= 19


def test_quality_on_held_out_labels(documents, labelled):
    kept = {r["doc_id"] for r in op02_quality.retained(documents, labelled.filter("doc_id % 2 = 0")).collect()}
    truth = {r["doc_id"]: r["quality"] for r in labelled.filter("doc_id % 2 = 1").collect()}
    good = [i in kept for i, q in truth.items() if q == 1]
    bad = [i not in kept for i, q in truth.items() if q == 0]
    assert np.mean(good) > 0.98 and np.mean(bad) > 0.8


def test_navigation_around_prose_gets_mixed_marks(frame, spark):
    rng = random.Random(23)
    menu = ["Home", "About us", "Contact", "Terms of use", "Sign in"]
    rows, truth = [], []
    for k in range(240):
        lines = [sentence(rng, rng.randrange(12, 30)) for _ in range(6)]
        if k % 3 == 0:
            lines = [" | ".join(rng.sample(menu, 3)).upper() + " $$$ >>>" for _ in range(6)]
        elif k % 3 == 1:
            lines[0:0] = rng.sample(menu, 3)
            lines += rng.sample(menu, 2)
        rows.append((k, "\n".join(lines)))
        truth.append((k, int(k % 3 != 0), 0))
    labels = spark.createDataFrame(truth, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in op02_quality.retained(frame(rows), labels.filter("doc_id % 2 = 0")).collect()}
    assert set(got) == {k for k in range(240) if k % 3}
    mixed = [got[k] for k in range(240) if k % 3 == 1]
    assert np.mean([r["content_lines"] == 6 and r["n_lines"] == 11 and 0 < r["content_share"] < 1 for r in mixed]) > 0.9
    assert all(got[k]["content_share"] == 1 for k in range(240) if k % 3 == 2)


def test_short_documents_like_a_repeated_line_stay(frame, spark):
    rng = random.Random(41)
    footer = sentence(rng, 9)
    rows, truth = [], []
    for k in range(400):
        lines = [sentence(rng, rng.randrange(4, 30)) for _ in range(rng.choice((1, 1, 2, 5)))]
        if k % 4 == 0:
            lines = ["$$$ >>> ### 12345 " * 3 for _ in range(3)]
        elif k % 4 == 1:
            lines = [sentence(rng, 20) for _ in range(3)]
            lines.insert(rng.randrange(4), footer)
        rows.append((k, "\n".join(lines)))
        truth.append((k, int(k % 4 != 0), 0))
    labels = spark.createDataFrame(truth, "doc_id long, quality int, toxic int")
    kept = {r["doc_id"] for r in op02_quality.retained(frame(rows), labels.filter("(doc_id div 4) % 2 = 0")).collect()}
    assert not any(k % 4 == 0 for k in kept)
    assert len(kept) >= 0.99 * 300


def test_line_labels_equal_brute_force():
    rng = np.random.default_rng(6)
    lengths = rng.integers(1, 9, 40)
    lines = rng.integers(1, 12, lengths.sum()).astype(np.uint64)
    docs = np.split(lines, np.cumsum(lengths)[:-1])
    before, after = {}, {}
    for d in docs:
        for i, x in enumerate(d.tolist()):
            before.setdefault(x, set()).add(d[i - 1] if i else None)
            after.setdefault(x, set()).add(d[i + 1] if i + 1 < len(d) else None)
    want = [len(before[x]) >= 3 and len(after[x]) >= 3 for x in lines.tolist()]
    assert op02_quality.repeated(lines, lengths).tolist() == want
    copies = np.tile(np.array([5, 6, 7], np.uint64), 10)
    assert not op02_quality.repeated(copies, np.full(10, 3)).any()
    n = int(lengths.sum())
    marks = op02_quality.line_labels(rng.integers(0, op02_quality.WIDTH, (n, 5)), lengths, rng.integers(0, 2, 40), rng.random(n) + 1, lines)
    assert set(np.unique(marks)) <= {0, 1}


def test_content_shares_equal_brute_force(documents, labelled):
    import pyarrow as pa

    field = op02_quality.fitted(documents, labelled)
    got = {r["doc_id"]: (r["n_lines"], r["content_lines"], r["content_share"]) for r in op02_quality.retained(documents, labelled).collect()}
    for r in documents.orderBy("doc_id").limit(120).collect():
        lines = [x for x in re.split(r"[\n\r]", r["text"] or "") if x.strip(" \t")]
        (_, _, features, _, chars, _), = op02_quality.line_features(pa.array([r["text"]])) if r["text"] else [(0, 0, np.zeros((0, 14), np.int16), 0, np.zeros(0), 0)]
        assert chars.tolist() == [len(x) for x in lines]
        emission, best = field.emission(features), {0: (field.start[0], []), 1: (field.start[1], [])}
        if not lines:
            assert r["doc_id"] not in got
            continue
        best = {y: (field.start[y] + emission[0] * y, [y]) for y in (0, 1)}
        for e in emission[1:]:
            best = {y: max(((best[x][0] + field.step[x, y] + e * y, best[x][1] + [y]) for x in (0, 1)), key=lambda b: b[0]) for y in (0, 1)}
        marks = max(best.values(), key=lambda b: b[0])[1]
        share = sum(len(x) for x, m in zip(lines, marks) if m) / sum(map(len, lines))
        assert (r["doc_id"] in got) == (share >= op02_quality.MIN_SHARE)
        if r["doc_id"] in got:
            assert got[r["doc_id"]][:2] == (len(lines), sum(marks)) and abs(got[r["doc_id"]][2] - share) < 1e-9


def test_viterbi_equals_enumeration():
    rng = np.random.default_rng(4)
    field = op02_quality.Field(np.zeros(op02_quality.WIDTH), rng.normal(size=2), rng.normal(size=(2, 2)))
    lengths = np.array([3, 1, 6, 2])
    emission = rng.normal(size=lengths.sum())
    got = op02_quality.viterbi(field, emission, lengths)
    at = 0
    for n in lengths:
        def score(code):
            y = [code >> k & 1 for k in range(n)]
            return field.start[y[0]] + sum(emission[at + k] * y[k] for k in range(n)) + sum(field.step[a, b] for a, b in zip(y, y[1:]))

        best = max(range(2**n), key=score)
        assert [best >> k & 1 for k in range(n)] == got[at : at + n].tolist()
        at += n


@pytest.mark.parametrize("num,den", [(9, 10), (7, 10)])
def test_line_join_equals_brute_force(frame, num, den):
    rng = random.Random(num)
    pool = [sentence(rng, rng.choice((1, 3, 8, 20, 60, 150))) for _ in range(40)]
    rows = []
    for k in range(60):
        lines = []
        for _ in range(5):
            words = rng.choice(pool).split(" ")
            for i in range(len(words)):
                if rng.random() < 0.04:
                    words[i] = rng.choice(WORDS)
            lines.append(" ".join(words))
        rows.append((k, "\n".join([*lines, "", "!!"])))
    got = {(r["doc"], r["line"]) for r in op03_linededup.repeated_lines(frame(rows), num, den).collect()}
    seen, want = [], set()
    for k, t in rows:
        for n, line in enumerate(t.split("\n")):
            words = frozenset(re.findall(r"\w+", line.lower()))
            if not words:
                continue
            if any(len(words & w) * (num + den) >= num * (len(words) + len(w)) for w in seen):
                want.add((k, n))
            seen.append(words)
    assert got == want and len(want) > 50


def test_rows_that_share_an_id_keep_each_line(frame):
    rng = random.Random(3)
    words = [sentence(rng, 40).split(" ") for _ in range(6)]
    rows = [(1, " ".join(words[0])), (1, " ".join(words[1])), (1, " ".join(words[2])), (2, " ".join(words[0][:-1])), (3, " ".join(words[1][:-1])), (4, " ".join(words[2][:-1])), (5, " ".join(words[3]))]
    assert {(r["doc"], r["line"]) for r in op03_linededup.repeated_lines(frame(rows)).collect()} == {(2, 0), (3, 0), (4, 0)}


def test_small_bitmaps_and_other_widths_change_nothing(frame, spark, monkeypatch):
    rng = random.Random(77)
    pool = [sentence(rng, rng.choice((3, 20, 150))) for _ in range(30)]
    rows = [(k, "\n".join(" ".join(w for w in rng.choice(pool).split(" ") if rng.random() > 0.03) for _ in range(5))) for k in range(60)]
    docs = frame(rows)
    want = sorted(op03_linededup.repeated_lines(docs).collect())
    real = op03_linededup._marks
    monkeypatch.setattr(op03_linededup, "_marks", lambda members: real(members, 4))
    assert sorted(op03_linededup.repeated_lines(docs).collect()) == want
    monkeypatch.setattr(op03_linededup, "_marks", lambda members: (monkeypatch.setattr(op03_linededup, "LEAST_MARKS", 27), real(members))[1])
    for width in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", width)
        try:
            assert sorted(op03_linededup.repeated_lines(docs).collect()) == want and len(want) > 20
            assert op01_simhash.near_duplicates(docs).count() >= 0
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_equal_their_sql(spark, name):
    db = duckdb.connect()
    for table in ("documents", "pages", "labels", "benchmark"):
        db.execute(f"create view {table} as select * from read_parquet('{SF}/{table}.parquet')")
    found = db.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    want = Counter(map(tuple, found.fetchall()))
    got = Counter(tuple(r[c] for c in columns) for r in queries.queries()[name](spark, SF).collect())
    assert got == want


def test_mixing_is_systematic(frame):
    rows = [(k, "x" * (10 + k % 7), "en", ("hot", "cold", None)[0 if k % 10 else k // 10 % 2 + 1]) for k in range(1000)]
    weights = {"hot": 1.0, "cold": 2.0, None: 1.0}
    out = op04_mixing.mixed(frame(rows), weights, ranges=7)
    chars = Counter()
    for r in out.collect():
        chars[r["source"]] += len(r["text"])
    total = sum(len(r[1]) for r in rows)
    for source, weight in weights.items():
        assert abs(chars[source] - total * weight / 4) < 20
    copies = Counter(r["doc_id"] for r in out.collect())
    for source in weights:
        of = [copies[r[0]] for r in rows if r[3] == source]
        assert max(of) - min(of) <= 1
    assert out.exceptAll(op04_mixing.mixed(frame(rows), weights, ranges=3)).count() == 0


def test_style_tree_removes_what_a_site_repeats(spark):
    rng = random.Random(8)
    page = lambda k: f"<html><body><div class=nav>Home Shop Help</div><article><p>{text(rng, 3)}</p></article><footer>All the same here</footer></body></html>"
    pages = spark.createDataFrame([(k, f"https://www.site{k % 2}.example/{k}", page(k)) for k in range(40)] + [(99, "https://alone.example/", page(99))], "page_id long, url string, html string")
    for r in op05_html.extracted(pages).collect():
        repeated = "Home Shop Help" in r["text"], "All the same here" in r["text"]
        assert repeated == ((True, True) if r["page_id"] == 99 else (False, False)) and len(r["text"]) > 100
    few = {tuple(r) for r in op05_html.extracted(pages, most=-1).collect()}
    assert few == {tuple(r) for r in op05_html.extracted(pages).collect()}


def test_importance_equals_brute_force(spark):
    rng = random.Random(9)
    htmls = ["<div class=a><p>" + rng.choice(("same. ", "other. ")) + f"own {k}</p>" + "<ul>" + "<li>x</li>" * rng.randint(1, 3) + "</ul></div>" for k in range(12)]
    pages = spark.createDataFrame([(k, "http://h/", t) for k, t in enumerate(htmls)], "page_id long, url string, html string")
    got = {r["key"]: r["importance"] for r in op05_html.importance(pages).collect()}
    nodes: dict = {}
    for t in htmls:
        root = op05_html.parse(t)
        by_style = {}
        for node, parent, style in op05_html.walk(root, "h"):
            n = nodes.setdefault(node.key, {"m": 0, "styles": Counter(), "contents": {}, "parent": parent})
            n["m"] += 1
            n["styles"][style] += 1
            for c, times in Counter(op05_html.contents(node)).items():
                n["contents"].setdefault(c, []).append(times)
            by_style.setdefault(parent, []).append(node.key)

    def entropy(counts):
        p = np.array(counts) / sum(counts)
        return float(-(p * np.log(p)).sum())

    def importance(key):
        n = nodes[key]
        own_styles = {s: c for s, c in n["styles"].items() if s}
        if n["m"] <= 1:
            own = 1.0
        else:
            leaf = 1 - np.mean([entropy(c) for c in n["contents"].values()] or [0]) / np.log(n["m"])
            spread = entropy(list(n["styles"].values())) / np.log(n["m"])
            own = leaf if not own_styles else max(spread, leaf) if n["contents"] else spread
        if not own_styles:
            return own
        inner = sum(c / n["m"] * np.mean([importance(k) for k in nodes if nodes[k]["parent"] == s]) for s, c in own_styles.items())
        share = op05_html.DECAY ** len(own_styles)
        return (1 - share) * own + share * inner

    assert got.keys() == nodes.keys()
    assert all(abs(got[k] - importance(k)) < 1e-9 for k in nodes)


def test_deep_pages_are_judged_at_every_depth(spark):
    deep = lambda k: "<div class=x>" * 500 + f"<nav>Same menu</nav><p>own text {k} of this page</p>" + "</div>" * 500 + "</b></section><p>after</p>"
    pages = spark.createDataFrame([(k, "http://h/", deep(k)) for k in range(12)], "page_id long, url string, html string")
    for r in op05_html.extracted(pages).collect():
        assert r["text"] == f"own text {r['page_id']} of this page" and r["removed"] == 2
    root = op05_html.parse(deep(1))
    depth, node = 0, root
    while node.children():
        depth, node = depth + 1, node.children()[0]
    assert depth == 501 and [c.tag for c in root.children()] == ["div", "p"]


def test_extracted_text_equals_brute_force(spark):
    rng = random.Random(19)
    body = lambda k: "".join(f"<{t} class=c{rng.randrange(3)}>{rng.choice(('Menu. ', 'Legal. ', f'Story {k} {rng.random()}. '))}</{t}>" for t in rng.choices(("p", "div", "section"), k=6))
    htmls = [f"<html><body><header>Top bar</header>{body(k)}</body></html>" for k in range(15)]
    pages = spark.createDataFrame([(k, "http://h/", t) for k, t in enumerate(htmls)] + [(50, "http://h/", None), (51, None, "<p>x")], "page_id long, url string, html string")
    low = {r["key"] for r in op05_html.importance(pages).collect() if r["importance"] < op05_html.THRESHOLD}

    def text(node):
        """(text, everything in it is noise)"""
        parts = [(p, None) if isinstance(p, str) else text(p) for p in node.parts]
        noise = node.key in low and all(n for _, n in parts if n is not None)
        return "\n" + "".join("" if n else t for t, n in parts) + "\n", noise

    got = {r["page_id"]: r["text"] for r in op05_html.extracted(pages).collect()}
    for k, t in enumerate(htmls):
        root = op05_html.parse(t)
        list(op05_html.walk(root, "h"))
        out, noise = text(root)
        lines = [] if noise else [" ".join(x.split()) for x in out.split("\n")]
        assert got[k] == "\n".join(x for x in lines if x)
    assert got[50] is None and got[51] == "x"


def test_a_very_long_page_and_clashing_columns(spark):
    from pyspark.sql import functions as F

    long = "<p>" + "word " * 300_000 + "</p>"
    rows = [(1, "http://a/", long), (1, "http://a/", long), (2, "http://a/", "<p>other</p>"), (None, "http://a/", "<p>other</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    wide = pages.withColumns({c: F.lit(1) for c in ("key", "text", "noise", "id", "n", "style", "parent", "removed", "m")})
    for most in (op05_html.BROADCAST_NODES, -1):
        got = sorted(map(str, op05_html.extracted(wide, most=most).collect()))
        assert got == sorted(map(str, op05_html.extracted(pages).collect())) and len(got) == 4


def test_code_lengths_equal_the_trees_bit_by_bit():
    trees = op06_language.train({"a": ["abracadabra", "banana"], "b": ["mississippi"]})
    import pyarrow as pa

    texts = ["banana", "", "xyz miss", "a"]
    bits, size = op06_language.code_lengths(pa.array(texts), trees)
    for k, samples in enumerate((["abracadabra", "banana"], ["mississippi"])):
        counts: dict = {}
        for s in samples:
            padded = "\0\0\0" + s
            for i in range(3, len(padded)):
                for order in range(4):
                    counts.setdefault(padded[i - order : i], Counter())[padded[i]] += 1

        known = set("abracadabra banana mississippi".replace(" ", ""))

        def p(context, c):
            shorter = 1 / 256 if not context else p(context[1:], c)
            if context is None or context not in counts:
                return shorter
            seen = counts[context]
            base = sum(seen.values()) + len(seen)
            return seen[c] / base if c in seen else len(seen) / base * shorter

        for t, got in zip(texts, bits[:, k]):
            plain = "".join(c if c in known else "\0" for c in t)
            padded = "\0\0\0" + plain
            want = -sum(np.log2(p(padded[i - 3 : i], padded[i])) for i in range(3, len(padded)))
            assert abs(got - want) < 1e-3


def test_languages(documents):
    truth = {r["doc_id"]: r["lang"] for r in documents.collect()}
    got = {r["doc_id"]: r["language"] for r in op06_language.identified(documents, 40).collect()}
    assert got.keys() == truth.keys() and np.mean([got[i] == truth[i] for i in truth]) > 0.99


def test_toxicity_finds_unseen_words(frame, spark):
    rng = random.Random(6)
    bad = [f"vile{k}" for k in range(12)]
    rows, truth = [], []
    for k in range(900):
        words = [f"{rng.choice(WORDS)}{rng.randrange(10)}" for _ in range(60)]
        toxic = k % 6 == 0
        if toxic:
            for _ in range(6):
                words.insert(rng.randrange(60), rng.choice(bad))
        rows.append((k, " ".join(words)))
        truth.append((k, 1, int(toxic)))
    labels = spark.createDataFrame(truth, "doc_id long, quality int, toxic int")
    got = {r["doc_id"] for r in op07_toxicity.toxic(frame(rows), labels.filter("doc_id % 5 < 2")).collect()}
    held = [(k in got, t) for k, _, t in truth if k % 5 >= 2]
    assert np.mean([f for f, t in held if t]) > 0.95 and np.mean([f for f, t in held if not t]) < 0.02


def test_toxicity_is_fitted_by_language(frame, spark):
    rng = random.Random(12)
    words = [f"gift{k}" for k in range(12)]
    rows, truth = [], []
    for k in range(1800):
        lang = "de" if k % 5 == 0 else "en"
        said = [f"{lang}{rng.choice(WORDS)}{rng.randrange(10)}" for _ in range(50)]
        toxic = k % 3 == 0
        if lang == "de" and toxic:
            said[10:10] = rng.sample(words, 5)
        elif toxic:
            said[10:10] = [f"vile{rng.randrange(30)}" for _ in range(5)]
        elif rng.random() < (0.9 if lang == "en" else 0.2):
            said.insert(rng.randrange(50), rng.choice(words))
        rows.append((k, " ".join(said), lang, "s0"))
        truth.append((k, 1, int(toxic)))
    labels = spark.createDataFrame(truth, "doc_id long, quality int, toxic int")
    got = {r["doc_id"] for r in op07_toxicity.toxic(frame(rows), labels.filter("doc_id % 2 = 0")).collect()}
    held = [(k in got, truth[k][2]) for k, _, lang, _ in rows if k % 2 and lang == "de"]
    assert np.mean([f for f, t in held if t]) > 0.9 and np.mean([f for f, t in held if not t]) < 0.05


def test_pair_counts_and_walks_equal_brute_force(frame, monkeypatch):
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choice(WORDS[:12]) for _ in range(30))) for k in range(20)]
    docs = frame(rows)
    words = op07_toxicity.vocabulary(docs, 0.05, 1.0)
    assert len(words) == 12
    blocks = op07_toxicity.graph(docs, words)
    want, v = Counter(), len(words)
    number = {w: int(np.searchsorted(words, np.uint64(T.hash_bytes(w.encode())))) for w in WORDS[:12]}
    for _, t in rows:
        seq = [number[w] for w in t.split()]
        for i in range(len(seq)):
            for j in range(i + 1, min(i + 1 + op07_toxicity.WINDOW, len(seq))):
                if seq[i] != seq[j]:
                    want[frozenset((seq[i], seq[j]))] += 1
    got = {}
    span = -(-v * v // 4)
    marginal = np.zeros(v)
    for r in blocks.collect():
        keys, n = op07_toxicity._decoded(bytes(r["payload"]), r["dest"] * span)
        a, b = op07_toxicity._ends(keys, v)
        got |= {frozenset((int(x), int(y))): int(c) for x, y, c in zip(a, b, n)}
        marginal += np.frombuffer(r["marginal"], np.float64)
    assert got == want
    assert marginal.sum() == 2 * sum(want.values())
    # walks over the dense matrix of weights
    n = np.zeros((v, v))
    for pair, c in want.items():
        a, b = pair
        n[a, b] = n[b, a] = c
    rows_ = np.zeros((v, 3))
    rows_[0, 0] = rows_[3, 1] = 1
    rows_[:, 2] = 1 / v
    blocks = op07_toxicity.graph(docs, words, window=op07_toxicity.WINDOW)
    monkeypatch.setattr(op07_toxicity, "SHIFT", -1.0)  # with so few words only that leaves edges
    with np.errstate(divide="ignore"):
        weight = np.maximum(np.log(n * n.sum() / np.outer(n.sum(0), n.sum(0))) + 1, 0)
    x, degree = op07_toxicity.walk(blocks, v, rows_)
    assert np.allclose(degree, weight.sum(0), rtol=1e-5) and (degree > 0).all()
    want_x = rows_.copy()
    for _ in range(op07_toxicity.STEPS):
        want_x = op07_toxicity.RESTART * rows_ + (1 - op07_toxicity.RESTART) * weight @ (want_x / degree[:, None])
    assert np.allclose(x, want_x, atol=1e-6)
    usual = (degree + degree.mean()) / (degree + degree.mean()).sum()
    lift = want_x[:, :2] / usual[:, None]
    assert np.allclose(op07_toxicity.polarities(x[:, :2], degree)[:, 0], np.log2((lift[:, 0] + 0.1) / (lift[:, 1] + 0.1)), atol=1e-4)


def test_seed_terms_equal_brute_force():
    rng = random.Random(41)
    texts = []
    for k in range(120):
        words = [rng.choice(WORDS) + rng.choice(("", "x", "yz")) for _ in range(30)]
        if k % 4 == 0:
            words[5:5] = [rng.choice(("grimalo", "grimkeit", "grimung", "fooé", "fooéü")) for _ in range(3)]
        texts.append((int(k % 4 == 0), " ".join(words)))
    texts += [texts[0]] * 10  # copies count once
    got = op07_toxicity.induced(texts)
    seen, docs = set(), []
    for y, t in sorted(texts):
        if (y, t) not in seen:
            seen.add((y, t))
            docs.append((y, set(t.split())))
    count: dict = {}
    for y, words in docs:
        terms = {(w, 0) for w in words} | {(w[:k], k) for w in words for k in range(op07_toxicity.STEM_FROM, op07_toxicity.STEM_TO + 1) if len(w) >= k}
        for t in terms:
            count.setdefault(t, [0, 0])[y] += 1
    n = [sum(y == k for y, _ in docs) for k in (0, 1)]

    def ratio(c):
        if c[1] < op07_toxicity.LEAST_DOCS or c[1] * n[0] <= c[0] * n[1] or c[1] / n[1] < op07_toxicity.LIFT * c[0] / n[0]:
            return 0
        total = 0.0
        for y in (0, 1):
            for have, of in ((c[y], sum(c)), (n[y] - c[y], sum(n) - sum(c))):
                total += 2 * have * np.log(have * sum(n) / (of * n[y])) if have else 0
        return total

    want: list = []
    for (t, k), r in sorted(((t, ratio(c)) for t, c in count.items()), key=lambda x: (-round(x[1], 6), x[0][1] > 0, -len(x[0][0].encode()), x[0][0])):
        if r >= op07_toxicity.SURE and not any(t.startswith(o) or o.startswith(t) for o, _ in want):
            want.append((t, k))
    assert got == want and {t[:4] for t, _ in want} == {"grim", "fooé"}


def test_scores_equal_brute_force(frame, monkeypatch):
    stems = op07_toxicity.stems_of([("grim", 4), ("gri", 3), ("fooé", 4)])
    terms = {("grim", 4): 3.0, ("gri", 3): 1.0, ("fooé", 4): 2.0, ("plain", 0): 1.5}
    order = sorted((op07_toxicity.term_hash(*t), w) for t, w in terms.items())
    lexicon = op07_toxicity.Lexicon(np.array([h for h, _ in order], np.uint64), np.array([w for _, w in order]), 0.1, 2.0)
    monkeypatch.setattr(op07_toxicity, "fitted", lambda docs, labels: op07_toxicity.Model(["de"], [lexicon, op07_toxicity.nothing()], stems))
    texts = ["grimwort griffin plain", "gri grim GRIMM", "Fooéx fooé foo", "plain plain", "", None, "gr fo", "plainly plaine grimaud " * 3]
    rows = [(k, t, "de", "s") for k, t in enumerate(texts)] + [(50, "grim grim grim", "en", "s"), (None, "grim", "de", "s")]
    got = {r["doc_id"]: (round(r["score"], 6), r["hits"], r["distinct_words"]) for r in op07_toxicity.toxic(frame(rows), None).collect()}
    want = {}
    for i, t, lang, _ in rows:
        words = re.findall(r"\w+", (t or "").lower())
        of = []
        for w in words:
            stem = next((s for s in (("grim", 4), ("fooé", 4), ("gri", 3)) if w.startswith(s[0])), (w, 0))
            if stem in terms:
                of.append(stem)
        score = sum(terms[s] for s in of) - 0.1 * len(words)
        if lang == "de" and of and score >= 2.0 - 1e-9:
            want[i] = (round(score, 6), len(of), len(set(of)))
    assert got == want and len(want) >= 4


def test_toxic_stems_are_found_in_every_language(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = {r["doc_id"] for r in op07_toxicity.toxic(docs, labels.filter("doc_id % 2 = 0")).collect()}
    held = docs.select("doc_id", "lang").join(labels.filter("doc_id % 2 = 1"), "doc_id").collect()
    found = lambda y, lang=None: [r["doc_id"] in got for r in held if r["toxic"] == y and lang in (None, r["lang"])]
    assert np.mean(found(1)) >= 0.9 and np.mean(found(0)) < 0.01
    assert all(np.mean(found(1, lang)) > 0.7 for lang in ("de", "en", "es", "fr"))


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(2)
    tokens = rng.integers(1, 4, 400).astype(np.uint64)
    order = op08_decontamination.suffix_array(tokens, 400)
    want = sorted(range(400), key=lambda i: tokens[i:].tolist())
    assert order.tolist() == want


def test_matches_equal_brute_force(frame, spark, monkeypatch):
    rng = random.Random(1)
    items = [sentence(rng, n) for n in (30, 12, 7, 4, 25, 3)] + ["Zebra!", "", "--"]
    rows = []
    for k in range(40):
        words = text(rng, 3).split()
        if k % 3 == 0:
            item = rng.choice(items).split()
            if not item:
                continue
            a = rng.randrange(len(item))
            b = rng.randrange(a, len(item)) + 1
            at = rng.randrange(len(words))
            words[at:at] = [w.upper() for w in item[a:b]]
        rows.append((k, " ".join(words)))
    rows += [(100, items[0] + " " + items[0]), (101, items[0][:40]), (102, ""), (103, "a zebra, here"), (104, "ZEBRA"), (105, "zebras")] + [(200 + k, f"Said {t.upper()} and more") for k, t in enumerate(items)]
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["match_words"], r["doc_word"], r["item_word"]) for r in op08_decontamination.contaminated(frame(rows), benchmark).collect()}
    want = {}
    for d, t in rows:
        x = re.findall(r"\w+", t.lower())
        for i, item in enumerate(items):
            y = re.findall(r"\w+", item.lower())
            best = None
            for p in range(len(x)):
                for q in range(len(y)):
                    n = 0
                    while p + n < len(x) and q + n < len(y) and x[p + n] == y[q + n]:
                        n += 1
                    if n >= min(10, len(y)) and n and (best is None or (-n, p, q) < (-best[0], *best[1:])):
                        best = (n, p, q)
            if best:
                want[d, i] = best
    assert got == want and want
    assert {i for _, i in want} == set(range(7))
    kept = {r["doc_id"] for r in op08_decontamination.decontaminated(frame(rows), benchmark).collect()}
    assert kept == {d for d, _ in rows} - {d for d, _ in want}
    monkeypatch.setattr(op08_decontamination, "TEST_BYTES", 100)
    again = op08_decontamination.contaminated(frame(rows), benchmark).collect()
    assert {(r["doc_id"], r["item_id"]): (r["match_words"], r["doc_word"], r["item_word"]) for r in again} == want and len(again) == len(want)
    assert {r["doc_id"] for r in op08_decontamination.decontaminated(frame(rows), benchmark).collect()} == kept


def test_licences_equal_brute_force(frame):
    rng = random.Random(4)
    notices = ["Released under the MIT License.", "Licensed under the Apache License, Version 2.0", "MIT licence", "GNU General Public License (see it): either version 3 of the License", "License MIT", "cc-by-nc 4.0"]
    rows = [(k, text(rng, 2) + "\n" + " ".join(rng.sample(notices, 2)) + sentence(rng, 3)) for k in range(60)] + [(99, "mit"), (100, "license"), (101, "end mit"), (102, "License begins")]
    got = {tuple(r) for r in op09_licenses.scanned(frame(rows)).collect()}
    want = {}
    for d, t in rows:
        words = re.findall(r"\w+", t.lower())
        at = lambda p: next((i for i in range(len(words)) if words[i : i + len(p)] == p), None)
        for name, phrases in op09_licenses.LICENSES:
            places = [at(p.split()) for p in phrases]
            if None not in places:
                want[d, name] = min(places[0], want.get((d, name), places[0]))
    assert got == {(*k, v) for k, v in want.items()} and len(want) > 40


def _secret_spans(texts, ratios, **options):
    import pyarrow as pa

    (_, _, data, offsets), = T.text_blocks(pa.array(texts))
    rows, starts, ends, ratio = op10_secrets.scan(data, offsets, ratios, **options)
    return [(int(r), bytes(data[a:b]).decode(), float(x)) for r, a, b, x in zip(rows, starts, ends, ratio)]


def _force_spans(text, ratios, evidence, min_ratio):
    """The same by plain loops."""
    code = {chr(c): k + 1 for k, c in enumerate(op10_secrets._ALPHABET)}
    atoms = [(m.start(), m.end()) for m in re.finditer("[A-Za-z0-9]+", text)]
    size = op10_secrets._SIZE
    score = []
    for a, b in atoms:
        c = [0, 0, *(code[x] for x in text[a:b])]
        score.append(sum(float(ratios[(c[k - 2] * size + c[k - 1]) * size + c[k]]) for k in range(2, len(c))))
    joined = [k > 0 and atoms[k][0] == atoms[k - 1][1] + 1 and text[atoms[k][0] - 1] in "+/_-" for k in range(len(atoms))]
    member = [s > 0 or (s > -op10_secrets.BRIDGE and 0 < k < len(score) - 1 and joined[k] and joined[k + 1] and score[k - 1] > 0 and score[k + 1] > 0) for k, s in enumerate(score)]
    out, k = [], 0
    while k < len(atoms):
        if not member[k]:
            k += 1
            continue
        to = k + 1
        while to < len(atoms) and member[to] and joined[to]:
            to += 1
        total, signs = sum(score[k:to]), sum(b - a for a, b in atoms[k:to])
        if total >= evidence and total >= min_ratio * signs:
            out.append((text[atoms[k][0] : atoms[to - 1][1]], total / signs))
        k = to
    return out


def test_secrets_equal_brute_force(documents):
    texts = [r["text"] or "" for r in documents.orderBy("doc_id").limit(150).collect()]
    texts += ["key=ab12CD34ef56", "a/b_c-d+e 9f86d081884c7d65/2f-QmX1", "x__y--z", ""]
    ratios = op10_secrets.train(op10_secrets.labelled_samples(["alpha", "beta", "gamma"], 500))
    got = _secret_spans(texts, ratios, evidence=3.0, min_ratio=0.1)
    want = [(k, s, x) for k, t in enumerate(texts) for s, x in _force_spans(t, ratios, 3.0, 0.1)]
    assert [g[:2] for g in got] == [w[:2] for w in want] and len(want) > 100
    assert np.allclose([g[2] for g in got], [w[2] for w in want], atol=1e-5)


def test_secrets_on_held_out_samples(documents, labelled):
    words = sorted({w for r in documents.limit(300).collect() for w in re.findall(r"[a-z]{2,30}", r["text"])})
    ratios = op10_secrets.train(op10_secrets.labelled_samples(words, seed=1))
    rng = random.Random(17)
    secrets = ["".join(rng.choices(alphabet, k=n)) for n in (12, 16, 24, 40) for alphabet in ("0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(60)]
    for form in ("{}", "key={}", "aws_secret_access_key={}", "config/default/token/{}", "password: {}", 'token = "{}"', "default_session_token={};"):
        found = _secret_spans([form.format(x) for x in secrets], ratios)
        exact = sum(secrets[k] == span for k, span, _ in found)
        assert exact > 0.9 * len(secrets), (form, exact)
    ordinary = [t for t, y in op10_secrets.labelled_samples(words, 1500, seed=2) if not y]
    assert len({k for k, *_ in _secret_spans([f"key = '{t}'" for t in ordinary], ratios)}) < 0.01 * len(ordinary)
    assert _secret_spans(["12345678901234567890", "call 555-123-4567 on 2024-01-15", "getUserNameById", ""], ratios) == []
    got = {(r["doc_id"], r["start_char"], r["length"]) for r in op10_secrets.secrets(documents, labelled).collect()}
    planted = {(r["doc_id"], m.start(1), 40) for r in documents.collect() for m in re.finditer(r'token = "([0-9a-f]{40})"', r["text"])}
    assert planted <= got and len(got) <= len(planted) * 1.1
