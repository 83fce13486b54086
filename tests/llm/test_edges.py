"""Each operator and stage on nulls, blank and long texts, repeated rows, ties, empty tables and clashing columns."""

import pytest

import corpus_pipeline
from quillgraph.llm import op01_simhash, op02_quality, op03_linededup, op04_mixing, op05_html, op06_language, op07_toxicity, op08_decontamination, op09_licenses, op10_secrets, queries


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven"), (2, None), (None, "a b"), (3, "")], "item_id long, text string")


@pytest.fixture(scope="module")
def folder(tmp_path_factory, odd, labels, benchmark):
    place = tmp_path_factory.mktemp("tables")
    odd.write.parquet(f"{place}/documents.parquet")
    labels.write.parquet(f"{place}/labels.parquet")
    benchmark.write.parquet(f"{place}/benchmark.parquet")
    return str(place)


def _operators(labels, benchmark):
    return {
        "near_duplicates": op01_simhash.near_duplicates,
        "retained": lambda d: op02_quality.retained(d, labels),
        "repeated_lines": op03_linededup.repeated_lines,
        "mixed": op04_mixing.mixed,
        "identified": op06_language.identified,
        "toxic": lambda d: op07_toxicity.toxic(d, labels),
        "contaminated": lambda d: op08_decontamination.contaminated(d, benchmark),
        "scanned": op09_licenses.scanned,
        "secrets": lambda d: op10_secrets.secrets(d, labels),
    }


@pytest.mark.parametrize("name", ["near_duplicates", "retained", "repeated_lines", "mixed", "identified", "toxic", "contaminated", "scanned", "secrets"])
def test_odd_rows_and_clashing_columns(odd, clashing, labels, benchmark, name):
    operator = _operators(labels, benchmark)[name]
    plain = operator(odd)
    key = lambda r: repr(r)
    again = operator(clashing).select(*plain.columns)
    assert sorted(plain.collect(), key=key) == sorted(again.collect(), key=key)
    assert operator(odd.limit(0)).collect() == []


@pytest.mark.parametrize("stage", range(5))
def test_stages(spark, odd, clashing, folder, stage):
    name, function = corpus_pipeline.STAGES[stage]
    out = function(spark, clashing, folder)
    extra = set(out.columns) - set(clashing.columns)
    assert not extra and [c for c in clashing.columns if c != "copy_no"] == [c for c in out.columns if c != "copy_no"]
    rows, wide = function(spark, odd, folder).collect(), out.select(*odd.columns).collect()
    assert len(rows) == len(wide)
    if stage < 4:
        assert function(spark, odd, folder).columns == odd.columns
    assert function(spark, odd.limit(0), folder).collect() == []


def test_results_on_odd_rows(odd, labels, benchmark):
    assert {tuple(r) for r in op01_simhash.near_duplicates(odd).collect()} == {(8, 1)}
    kept = op01_simhash.deduplicated(odd).collect()
    assert sorted(r["doc_id"] or 0 for r in kept) == [0, 0, 1, 2, 3, 4, 5, 6, 7, 9, 10]
    assert {r["doc_id"] for r in op02_quality.retained(odd, labels.limit(0)).collect()} >= {1, None, 5, 7, 8, 10}
    assert not {2, 3, 4} & {r["doc_id"] for r in op02_quality.retained(odd, labels.limit(0)).collect()}
    kept = op03_linededup.deduplicated(odd).collect()
    assert sum(r["doc_id"] == 1 for r in kept) == 2 and {2, 3, 4, 6} <= {r["doc_id"] for r in kept}
    found = {r["doc_id"]: r["language"] for r in op06_language.identified(odd).collect()}
    assert found[2] is None and found[3] is None and found[5] == "en"
    assert len(op06_language.identified(odd).collect()) == odd.count()


def test_pages(spark):
    rows = [(1, None, None), (2, "http://a.example/x", ""), (2, "http://a.example/x", ""), (None, "not an address", "<p>text"), (3, "http://b.example", "<div>" * 2000 + "deep"), (4, "http://b.example", "<p class='a' id=\"b\">x<b>y</b><!-- c --><script>if (a<b) {}</script><td></p></nav>z &amp; &#65;")]
    pages = spark.createDataFrame([(*r, 7, 8) for r in rows], "page_id long, url string, html string, key int, text int")
    got = {(r["page_id"], r["url"]): r["text"] for r in op05_html.extracted(pages).collect()}
    assert got[1, None] is None and got[2, "http://a.example/x"] == "" and got[None, "not an address"] == "text"
    assert got[3, "http://b.example"] == "deep" and "xy" in got[4, "http://b.example"] and "z & A" in got[4, "http://b.example"] and "if" not in got[4, "http://b.example"]
    assert len(op05_html.extracted(pages).collect()) == len(rows)
    assert op05_html.extracted(pages.limit(0)).collect() == []


def test_pipeline_runs_the_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, spark.createDataFrame(docs.collect(), docs.schema), folder)
    key = lambda r: repr(r)
    assert sorted(docs.collect(), key=key) == sorted(corpus_pipeline.run(spark, folder).collect(), key=key)


def test_every_operator_has_a_query():
    assert {q.split("_")[0] for q in queries.queries()} == {f"op{k}" for k in range(1, 11)}
