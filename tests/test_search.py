import itertools
import re
import sqlite3

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillgraph.operators import cluster, scope, search

CORPUS = [
    ("n/price.md", "Pricing model", "How we price seats and usage. renewal discounts need approval.", None),
    ("n/renew.md", "Acme renewal", "Acme wants a renewal with new pricing before June.", None),
    ("n/onboard.md", "Onboarding", "The customer-workspace is made on day one; a a a", None),
    ("n/old.md", "Old pricing", "acme acme acme pricing pricing", "n/price.md"),
    ("l/inv.md", "Invoice INV-2031", "Total due for Acme. Café receipts.", None),
    ("l/misc.md", "Misc", "nothing of note", None),
    ("n/workspace.md", "Workspace", "customer of a workspace", None),
]


@pytest.fixture(scope="module")
def notes(spark):
    return spark.createDataFrame([(k, *row) for k, row in enumerate(CORPUS, 1)], "id long, path string, title string, body string, superseded_by string").cache()


@pytest.mark.parametrize("query", ["pricing", "acme renewal pricing", "customer-workspace", '"a a"', "INV-2031", "cafe", "a-a"])
def test_bm25_equals_sqlite(spark, notes, query):
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(title, body)")
    for k, (_, title, body, _) in enumerate(CORPUS, 1):
        db.execute("insert into t(rowid, title, body) values (?,?,?)", (k, title, body))
    match = " OR ".join('"' + t.replace('"', '""') + '"' for t in dict.fromkeys(query.split()) if re.search(r"[^\W_]", t))
    want = dict(db.execute("select rowid, rank from t where t match ?", (match,)).fetchall())
    got = {r["id"]: r["score"] for r in search.bm25(search.Keywords.of(notes), query).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-6 for k in want)


SCRIPTS = ["한국어 문서", "Синий йод", "синии", "Ελλάδα Άλφα ΣΊΣΥΦΟΣ", "σίσυφος", "ガイド ブック", "Cafe\u0301 naïve ÅNGSTRÖM", "日本語テキスト", "cafe angstrom", "", "Straße", "İstanbul x"]


@pytest.mark.parametrize("query", ["한국어", "Синий", "йод", "синии", "Ελλάδα", "Σίσυφος", "ガイド", "Café", "cafe\u0301", "ångström", "日本語テキスト", "naive", "straße", "ブック-ガイド"])
def test_scripts_are_folded_as_sqlite_does(spark, query):
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(body)")
    for k, text in enumerate(SCRIPTS, 1):
        db.execute("insert into t(rowid, body) values (?,?)", (k, text))
    rows = spark.createDataFrame([(k, "", t) for k, t in enumerate(SCRIPTS, 1)], "id long, title string, body string")
    want = {r[0] for r in db.execute("select rowid from t where t match ?", ('"' + query + '"',)).fetchall()}
    assert {r["id"] for r in search.bm25(search.Keywords.of(rows), query).collect()} == want and want - {None} or query == "ブック-ガイド"


def test_stored_postings_answer_as_the_notes_do(spark, notes, tmp_path):
    search.store_postings(search.posting_rows(notes), str(tmp_path / "postings"))
    stored = spark.read.parquet(str(tmp_path / "postings"))
    keywords = search.Keywords(stored, search.totals_of(stored))
    for query in ("acme renewal pricing", '"a a" acme', "customer-workspace day-one", "none"):
        assert sorted(search.bm25(keywords, query).collect()) == sorted(search.bm25(search.Keywords.of(notes), query).collect())
    assert "EqualTo(word,acme)" in keywords.rows(["acme"])._jdf.queryExecution().executedPlan().toString()


def test_bags_equal_plain_counting():
    import pyarrow as pa

    texts = ["Acme acme x1", None, "", "ÉCOLE école K", "a" * 300, "日本", "İstanbul"]
    got = search.bag_of_words(pa.array(texts), 16)
    for row, text in zip(got, texts):
        want = np.zeros(16)
        for word in re.findall("[a-z0-9]+", (text or "").lower()):
            h = 2166136261
            for c in word.encode():
                h = (h ^ c) * 16777619 % 2**32
            want[h % 16] += 1
        assert row.tolist() == want.tolist()


def _vectors(spark, notes):
    return search.token_vectors(notes.select("id", F.concat_ws("\n\n", "title", "body").alias("text")))


def test_hybrid_fuses_filters_and_starves(spark, notes):
    vectors = _vectors(spark, notes)
    vector = search.LexicalEmbedder().embed(["acme renewal pricing"])[0]
    hits = search.hybrid(notes, vectors, "acme renewal pricing", vector).collect()
    assert hits[0]["path"] == "n/renew.md" and "n/old.md" not in [h["path"] for h in hits]
    for h in hits:
        want = sum(1 / (60 + r) for r in (h["vec_rank"], h["fts_rank"]) if r is not None)
        assert abs(h["score"] - want) < 1e-12
    assert search.hybrid(notes, vectors, "zzz", None).collect() == []
    assert search.hybrid(notes, vectors, "***", [0.0] * 256).collect() == []
    cut = search.Options(cutoffs=search.Cutoffs(distance=-1.0, bm25=-100.0))
    assert search.hybrid(notes, vectors, "acme renewal pricing", vector, cut).collect() == []
    allowed = F.col("path").startswith("l/misc")
    assert search.hybrid(notes, vectors, "acme renewal pricing", vector, search.Options(n=1), allowed).collect() == []
    with pytest.raises(ValueError):
        search.hybrid(notes, vectors, "x", None, search.Options(n=0))


def test_expansion_appends_neighbours(spark, notes):
    edges = spark.createDataFrame([(2, "misc", 6), (7, "renew", 2), (2, "old", 4)], "from_id long, to_slug string, to_id long")
    hits = search.hybrid(notes, None, "June", None, search.Options(expand=True), None, edges).collect()
    assert [(h["path"], h["expansion"]) for h in hits] == [("n/renew.md", False), ("l/misc.md", True), ("n/workspace.md", True)]


POLICIES = [
    [],
    [{"prefix": "", "read": True}],
    [{"prefix": "a", "read": True}, {"prefix": "a/b", "read": False}],
    [{"prefix": "a", "read": True, "write": True}, {"prefix": "a/b", "write": False}],
    [{"prefix": "", "read": True}, {"prefix": "🔒secret", "read": False}],
    [{"prefix": "a/b", "read": True}, {"prefix": "c", "read": True}],
]
PATHS = ["x.md", "a/x.md", "ab/x.md", "a/b/x.md", "a/b/c/x.md", "c/x.md", "🔒secret/x.md", "a_b/x.md", "a%/x.md", "A/x.md", ""]


def test_policy_column_equals_may(spark):
    paths = spark.createDataFrame([(p,) for p in PATHS], "path string")
    for rules in POLICIES:
        compiled = scope.compiled({"x": rules})["x"]
        got = {r["path"]: r["ok"] for r in paths.withColumn("ok", scope.readable(compiled, F.col("path"))).collect()}
        assert got == {p: scope.may(compiled, "read", p) for p in PATHS}


def test_policy_errors():
    for bad in ("x", [1], [{"prefix": 1}], [{"prefix": "a", "read": 1}], [{"prefix": "a/../b", "read": True}], [{"prefix": "a", "read": True}, {"prefix": "a/", "read": False}], [{"prefix": "a", "write": True}]):
        with pytest.raises(scope.PolicyError):
            scope.compiled({"x": bad})
    with pytest.raises(scope.PolicyError):
        scope.rules_for({}, "x")
    assert scope.rules_for(None, None) is None and scope.may(None, "write", "x")


def test_pairs_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(60, 5))
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(m)], "id long, emb array<double>")
    u = search.unit(m)
    want = {(i, j) for i, j in itertools.combinations(range(60), 2) if 1 - u[i] @ u[j] <= 0.3}
    for blocks in (1, 3):
        assert {(r["a"], r["b"]) for r in cluster.pairs(rows, 0.3, blocks).collect()} == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 7), st.integers(0, 7)), max_size=20))
def test_linkage_by_component_equals_linkage_of_all(raw):
    found = {(min(a, b), max(a, b)): d / 10 for d, a, b in raw if a != b}
    rows = [(d, a, b) for (a, b), d in found.items()]
    whole = cluster.link_completely(list(range(8)), rows)
    parent = list(range(8))
    for _, a, b in rows:
        x, y = parent[a], parent[b]
        parent = [min(x, y) if p in (x, y) else p for p in parent]
    parts = []
    for root in set(parent):
        ids = [i for i in range(8) if parent[i] == root]
        parts += cluster.link_completely(ids, [r for r in rows if r[1] in ids])
    assert sorted(whole) == sorted(parts)


def test_clusters(spark):
    angle = lambda d: [float(np.cos(d)), float(np.sin(d))]
    rows = spark.createDataFrame([(1, angle(0.0), "a/x.md", None), (2, angle(0.1), "a/y.md", None), (3, angle(0.25), "b/z.md", None), (4, angle(3.0), "a/far.md", None), (5, angle(0.01), "a/old.md", "a/x.md")], "id long, emb array<double>, path string, superseded_by string")
    got = cluster.clusters(rows, rows, 0.02).collect()
    assert [(r["members"], r["namespace"]) for r in got] == [(["a/x.md", "a/y.md"], "a/")]
    got = cluster.clusters(rows, rows, 0.05).collect()
    assert [(r["members"], r["namespace"]) for r in got] == [(["a/x.md", "a/y.md", "b/z.md"], None)]


def test_postings_are_stored_without_a_shuffle(spark, tmp_path):
    """Each task's postings stay in its own file, in runs sorted by word that are bounded by words and not by notes."""
    rows = spark.range(40).repartition(2).select("id", F.concat(F.lit("Doc "), "id").alias("title"), F.lit("b a c a").alias("body"))
    search.store_postings(search.posting_rows(rows), str(tmp_path / "postings"))
    assert len(list((tmp_path / "postings").glob("part-*.parquet"))) == 2
    assert [list(search._runs(np.array(sizes), 5)) for sizes in ([2, 3, 1, 9, 0], [], [0, 0])] == [[(0, 2), (2, 3), (3, 4), (4, 5)], [], [(0, 2)]]
    import pyarrow.parquet as pq

    for file in (tmp_path / "postings").glob("part-*.parquet"):
        words = pq.read_table(file).column("word").to_pylist()
        assert words == sorted(words) and words.count("a") == words.count("")


def test_texts_of_the_view_travel_once_at_most(spark, tmp_path):
    """Neighbours are joined by keys; postings and vectors need none, unless ids repeat."""
    from quillgraph.plans import catalog

    rows = [(k, f"text {k}", "en", "s") for k in (1, 2, 3, 5)]
    schema = "doc_id long, text string, lang string, source string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/once/documents.parquet")
    spark.createDataFrame([*rows, (2, "again", "en", "s"), (None, None, "de", "s")], schema).write.parquet(f"{tmp_path}/twice/documents.parquet")
    was = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
        above = plan(catalog.view(spark, f"{tmp_path}/once").select("raw")).split("\n")
        text = [line for line in above if "FileScan" in line and "text#" in line.split("]")[0]]
        assert len(text) == 1
        at = above.index(text[0])
        depth = above[at].index("FileScan")
        over = []
        for line in reversed(above[:at]):
            here = next(k for k, c in enumerate(line) if c not in " :+-|")
            if here < depth:
                over.append(line)
                depth = here
        assert sum("Exchange" in line for line in over) == 1
        assert "Exchange" not in plan(catalog.texts(spark, f"{tmp_path}/once"))
        for name in ("once", "twice"):
            documents = spark.read.parquet(f"{tmp_path}/{name}/documents.parquet")
            same = spark.sql(catalog.NOTES_SQL, documents=documents)
            assert sorted(map(str, catalog.view(spark, f"{tmp_path}/{name}").collect())) == sorted(map(str, same.collect()))
            assert sorted(map(str, catalog.texts(spark, f"{tmp_path}/{name}").collect())) == sorted(map(str, same.select("id", "title", "text").collect()))
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


def test_groups_of_arrays_equal_those_of_tuples():
    rng = np.random.default_rng(3)
    for n, share in ((12, 0.5), (30, 0.8), (40, 0.2), (2, 1.0)):
        i, j = np.triu_indices(n, 1)
        some = rng.random(len(i)) < share
        some[0] = True
        ids = np.sort(rng.choice(1000, n, replace=False)).astype(np.int64)
        a, b, d = ids[i[some]], ids[j[some]], rng.integers(0, 6, some.sum()) / 10
        a, b, d = np.append(a, a[:3]), np.append(b, b[:3]), np.append(d, d[:3] + 0.05)  # repeated ids give a pair twice
        want = cluster.link_completely(sorted({*a.tolist(), *b.tolist()}), list(zip(d.tolist(), a.tolist(), b.tolist())))
        got = {}
        for c, k, far in zip(*(x.tolist() for x in cluster.linked_groups(a, b, d))):
            got.setdefault((c, far), []).append(k)
        inside = lambda g: max(v for v, p, q in zip(d, a, b) if p in g and q in g)
        assert sorted(got.items()) == sorted(((g[0], inside(g)), g) for g in want)


def test_pairs_of_a_component_take_few_bytes():
    import tracemalloc

    a, b = (x.astype(np.int64) for x in np.triu_indices(500, 1))
    d = np.linspace(0, 0.5, len(a))
    tracemalloc.start()
    clusters = cluster.linked_groups(a, b, d)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert set(clusters[0].tolist()) == {0} and len(clusters[1]) == 500 and peak < 120 * len(a)
