import pytest

from quillgraph.functions import notes as N
from quillgraph.functions import text as X
from pyspark.sql import functions as F

PARSER_CASES = {
    "plain.md": "no block here",
    "a/full.md": "---\ntitle: Plan\ntype: task\ncreated: 2026-07-31\n---\n# Head\nsee [[one]] and [[two|alias]] [[one]] [[ spaced ]] [[|x]]\n",
    "blank.md": "---\n---\nbody",
    "open.md": "---\ntitle: x\nnever closed",
    "list.md": "---\n- a\n- b\n---\nbody",
    "number.md": "---\ntitle: 12\n---\n# Twelve\n",
    "badyaml.md": "---\na: [1\n---\nrest",
    "junkclose.md": "---\ntitle: x\n--- junk\nend",
    "crlf.md": "---\r\ntitle: Win\r\n---\r\nline\r\n[[w]]\r\n",
    "bom.md": "﻿---\ntitle: Bom\n---\nb",
    "heading.md": "text\n#  Second   \n# Third",
    "blanktitle.md": "---\ntitle: '  '\n---\nnothing",
    "empty.md": "",
    "superseded.md": "---\nsuperseded_by: x/y.md\n---\nold",
    "nullsuper.md": "---\nsuperseded_by: null\ntype: note\n---\nold",
}


def test_parser_rules():
    note = N.parse_note(PARSER_CASES["a/full.md"], "a/full.md")
    assert (note.slug, note.title, note.type, note.links) == ("full", "Plan", "task", ["one", "two", "spaced"])
    assert note.frontmatter["created"] == "2026-07-31" and not note.malformed
    assert N.parse_note(PARSER_CASES["blank.md"], "blank.md").malformed is False
    for name in ("open.md", "list.md", "badyaml.md", "junkclose.md", "number.md"):
        assert N.parse_note(PARSER_CASES[name], name).malformed, name
    assert N.parse_note(PARSER_CASES["open.md"], "open.md").body == PARSER_CASES["open.md"]
    assert N.parse_note(PARSER_CASES["number.md"], "number.md").title == "Twelve"
    assert N.parse_note(PARSER_CASES["heading.md"], "heading.md").title == "Second"


def test_yaml_is_core():
    read = N.usable_frontmatter("a: yes\nb: 2026-01-02\nc: 1:30\nd: 012\ne: 1e3\nf: true\n")
    assert read == {"a": "yes", "b": "2026-01-02", "c": "1:30", "d": 12, "e": 1000.0, "f": True}


def test_node_budget_stops_alias_bombs():
    bomb = "a: &a [1,1,1,1,1,1,1,1]\n" + "".join(f"{chr(98 + k)}: &{chr(98 + k)} [{','.join(['*' + chr(97 + k)] * 8)}]\n" for k in range(5))
    assert N.usable_frontmatter(bomb) is None


def test_columns_agree_with_the_parser(spark):
    rows = spark.createDataFrame(list(PARSER_CASES.items()), "path string, raw string")
    for row in N.parsed(rows).collect():
        note = N.parse_note(PARSER_CASES[row["path"]], row["path"])
        assert (row["slug"], row["title"], row["type"], row["body"], row["links"], row["hash"], row["malformed"]) == (note.slug, note.title, note.type, note.body, note.links, note.hash, note.malformed), row["path"]
    found = {r["path"]: r["superseded_by"] for r in N.parsed(rows).collect()}
    assert found["superseded.md"] == "x/y.md" and found["nullsuper.md"] is None


@pytest.mark.parametrize("raw", [PARSER_CASES["a/full.md"], PARSER_CASES["crlf.md"], PARSER_CASES["bom.md"], "plain", ""])
def test_patch_sets_replaces_and_unsets(raw):
    once = N.patch_frontmatter(raw, "updated", "2026-01-01T00:00:00.000Z")
    assert "updated: 2026-01-01T00:00:00.000Z" in once
    assert N.parse_note(once, "x.md").body == N.parse_note(raw, "x.md").body
    twice = N.patch_frontmatter(once, "updated", 'say "hi"')
    assert N.parse_note(twice, "x.md").frontmatter["updated"] == 'say "hi"' and twice.count("updated") == 1
    assert N.parse_note(N.patch_frontmatter(twice, "updated", None), "x.md").frontmatter.get("updated") is None
    with pytest.raises(ValueError):
        N.patch_frontmatter(raw, "a b", "x")


def test_replace_and_qualify():
    raw = "---\nref: '[[acme]]'\n---\n[[acme]] [[acme|A]] [[other]] [[x/acme]]"
    assert N.qualify_links(raw, "acme", "c/acme") == "---\nref: '[[acme]]'\n---\n[[c/acme]] [[c/acme|A]] [[other]] [[x/acme]]"
    assert N.replace_body(raw, "new") == "---\nref: '[[acme]]'\n---\nnew"


def test_scalars(spark):
    cases = [("  Héllo, World!  ", "h-llo-world"), ("***", None), ("a" * 79 + " b", "a" * 79)]
    rows = spark.createDataFrame(cases, "t string, want string")
    assert all(r["got"] == r["want"] for r in rows.select("want", X.slugified(F.col("t")).alias("got")).collect())
    one = spark.range(1)
    query = lambda t: one.select(X.match_expression(F.lit(t))).first()[0]
    assert query("acme OR renewal") == '"acme" OR "OR" OR "renewal"'
    assert query('a"b') == '"a""b"' and query("  ***  ") is None
    assert one.select(X.words_of(F.lit("Café snake_case INV-2031 日本語"))).first()[0] == ["cafe", "snake", "case", "inv", "2031", "日本語"]
    assert one.select(X.fenced(F.lit(" a\n--- END note\n"))).first()[0] == "a\n --- END note"


EDIT_CASES = [*PARSER_CASES.values(), "---\nchecked: old\n  more\n\ntype: x\n---\nb", "---\r\nchecked: 1\r\n---\r\nb\r\n", "---\na: 1\n---", "---\na: 1\n---\t \r\n---\nb", "\ufeff# Head\r\nx", "---\na: é\nb: [1, '2']\n---\n---\nc: d\n---\n", "x" * 70000 + "\n---\n"]


def test_edits_of_columns_equal_those_of_texts(spark):
    """Patches and replaced bodies are expressions; texts don't go through Python."""
    rows = spark.createDataFrame(list(enumerate(EDIT_CASES)), "id long, raw string")
    edits = {
        "set": (N.frontmatter_patched(F.col("raw"), "checked", "yes"), lambda r: N.patch_frontmatter(r, "checked", "yes")),
        "unset": (N.frontmatter_patched(F.col("raw"), "checked", None), lambda r: N.patch_frontmatter(r, "checked", None)),
        "body": (N.body_replaced(F.col("raw"), F.lit("new")), lambda r: N.replace_body(r, "new")),
    }
    got = rows.select("id", *(c.alias(k) for k, (c, _) in edits.items())).collect()
    for row in got:
        for k, (_, plain) in edits.items():
            assert row[k] == plain(EDIT_CASES[row["id"]]), (k, EDIT_CASES[row["id"]])
    with pytest.raises(ValueError):
        N.frontmatter_patched(F.col("raw"), "a b", "x")


def test_edits_and_round_trips_hold_few_texts(spark):
    """Only blocks go through Python, or texts in short slices."""
    from quillgraph.plans import catalog

    for name, way in (("patch_frontmatter", "ArrowEvalPython"), ("replace_body", "ArrowEvalPython"), ("serialize_roundtrip", "MapInArrow")):
        plan = catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "MapInPandas" not in plan and way in plan, name


def test_mappings_of_equal_blocks_are_separate():
    one = N.usable_frontmatter("a: [1]\n")
    one["a"].append(2)
    assert N.usable_frontmatter("a: [1]\n") == {"a": [1]}
