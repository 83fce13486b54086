import os
import shutil
import subprocess
import sys
import time
from pathlib import Path

import pytest

from quillgraph import cli
from quillgraph.api import Notebook
from quillgraph.functions import notes as N
from quillgraph.operators import discards, embedding, gate, index, search

FILES = {
    "notes/acme.md": "---\ntype: account\nnumber: 01234  # keep\n---\n# Acme\nAcme renewal and pricing. [[globex]] [[ghost]]\n",
    "notes/globex.md": "# Globex\nSee [[acme]].\n",
    "one/dup.md": "# Dup one\n",
    "two/dup.md": "# Dup two\n",
    "notes/hub.md": "# Hub\n[[dup]] [[one/dup]]\n",
    "lonely.md": "# Lonely\nnothing links here\n",
    "_draft.md": "# Draft\n",
    ".hidden/x.md": "no",
    "readme.txt": "no",
}


def _write(root, files):
    for path, text in files.items():
        place = Path(root) / path
        place.parent.mkdir(parents=True, exist_ok=True)
        place.write_text(text)


@pytest.fixture
def notebook(spark, tmp_path):
    root = tmp_path / "notebook"
    _write(root, FILES)
    held = Notebook(spark, str(root), cutoffs=search.Cutoffs(distance=0.8))
    held.reindex()
    return held


def test_scan_skips_hidden_and_links(tmp_path):
    _write(tmp_path, FILES)
    os.symlink(tmp_path / "lonely.md", tmp_path / "link.md")
    assert index.scan_notebook(str(tmp_path)) == sorted(p for p in FILES if p.endswith(".md") and not p.startswith("."))


def test_index_graph_and_doctor(notebook):
    Path(notebook.root, "lonely.md").write_text("# Lonely\nchanged\n")
    Path(notebook.root, "_draft.md").unlink()
    report = notebook.doctor()
    assert report["stale"] == ["lonely.md"] and report["missing"] == ["_draft.md"]
    assert report["broken"] == [("notes/acme.md", "ghost")]
    assert report["ambiguous"] == [("notes/hub.md", "dup", ["one/dup", "two/dup"])]
    assert report["orphans"] == ["lonely.md", "two/dup.md"]
    again = notebook.reindex()
    assert again["unchanged"] == 6 and not again.get("updated")


def test_a_failed_pass_leaves_the_index(notebook):
    before = notebook.held.current
    Path(notebook.root, "new.md").write_text("# New\n")

    def fail():
        raise RuntimeError("no")

    with pytest.raises(RuntimeError):
        notebook.held.refresh(notebook.root, before_swap=fail)
    assert notebook.held.current == before and notebook.held.table("notes").count() == 7


def test_another_embedder_must_reindex(spark, notebook):
    other = Notebook(spark, notebook.root, embedder=search.LexicalEmbedder(64))
    with pytest.raises(ValueError):
        other.search("acme")
    assert other.reindex()["reembedded"] == 1
    assert other.search("acme").count() > 0


def test_new_stem_collisions_are_qualified(notebook):
    _write(notebook.root, {"other/acme.md": "# Another\n"})
    stats = notebook.reindex()
    assert stats["qualified"] == [{"stem": "acme", "target": "notes/acme", "rewritten": ["notes/globex.md"], "skipped": []}]
    assert "[[notes/acme]]" in Path(notebook.root, "notes/globex.md").read_text()
    assert notebook.reindex()["unchanged"] == 8


def test_get_and_list(notebook):
    assert notebook.get("notes/acme.md").title == "Acme"
    assert notebook.get("notes/none.md") is None and notebook.get("a\0.md") is None
    with pytest.raises(gate.GateError):
        notebook.get("../x.md")
    assert [r["path"] for r in notebook.list("notes/").collect()] == ["notes/acme.md", "notes/globex.md", "notes/hub.md"]


CANDIDATE = gate.Candidate("Acme renewal", "Acme renewal and pricing agreed.", namespace="notes")


def _decide(notebook, decision):
    notebook.decider = lambda candidate, similar: decision(similar) if callable(decision) else decision
    return notebook.propose(CANDIDATE, gate.Context("tester", "t-1"))


def test_create_update_supersede_discard(notebook):
    made = _decide(notebook, {"action": "create"})
    text = Path(notebook.root, made.path).read_text()
    assert made.path == "notes/acme-renewal.md" and 'note_agent: "tester"' in text and 'note_source: "t-1"' in text
    assert _decide(notebook, {"action": "create"}).path == "notes/acme-renewal-2.md"
    done = _decide(notebook, {"action": "update", "target": "notes/acme.md"})
    text = Path(notebook.root, "notes/acme.md").read_text()
    assert done.action == "update" and "number: 01234  # keep" in text and text.endswith(CANDIDATE.body)
    done = _decide(notebook, {"action": "supersede", "target": "notes/acme.md"})
    old = N.parse_note(Path(notebook.root, "notes/acme.md").read_text(), "notes/acme.md")
    assert done.superseded == "notes/acme.md" and old.frontmatter["superseded_by"] == done.path
    assert "notes/acme.md" not in [r["path"] for r in notebook.search("acme renewal").collect()]
    assert _decide(notebook, {"action": "discard"}).path is None
    entries, bad = discards.list_discards(notebook.spark, notebook.root)
    assert bad == 0 and entries.first()["candidate"]["title"] == "Acme renewal"
    notebook.decider = lambda candidate, similar: {"action": "create"}
    assert notebook.restore_discard(1).action == "create"


def test_edits_in_between_fall_back_to_create(notebook):
    def decision(similar):
        place = Path(notebook.root, "notes/acme.md")
        place.write_text(place.read_text() + "human edit\n")
        return {"action": "update", "target": "notes/acme.md"}

    result = _decide(notebook, decision)
    assert result.fell_back and result.action == "create" and "human edit" in Path(notebook.root, "notes/acme.md").read_text()


def test_gate_refusals(spark, notebook):
    with pytest.raises(gate.GateError):
        _decide(notebook, {"action": "update", "target": "lonely-stranger.md"})
    notebook.decider = lambda candidate, similar: {"action": "create"}
    with pytest.raises(gate.GateError):
        notebook.propose(gate.Candidate("x", "y", namespace="../out"))
    with pytest.raises(gate.GateError):
        notebook.gate.propose(CANDIDATE, notebook.decider, search.Cutoffs())
    for bad in ({"action": "burn"}, {"action": "update"}, {"action": "create", "target": "x"}, {"action": "create", "body": " "}, []):
        with pytest.raises(gate.GateError):
            gate.check_decision(bad)
    scoped = Notebook(spark, notebook.root, scopes={"tester": [{"prefix": "notes", "read": True}]}, decider=notebook.decider, cutoffs=notebook.cutoffs)
    with pytest.raises(gate.GateError):
        scoped.propose(CANDIDATE, gate.Context("tester"))
    assert {r["path"].split("/")[0] for r in scoped.search("acme", context=gate.Context("tester")).collect()} == {"notes"}


def test_consolidate_merges_and_reports(notebook):
    _write(notebook.root, {"notes/p.md": "# Same words here\nalpha beta gamma\n", "notes/q.md": "# Same words here\nalpha beta gamma delta\n"})
    notebook.merger = lambda notes: {"title": "Merged", "body": " + ".join(n.slug for n in notes)}
    dry = notebook.consolidate(0.15)
    assert [m["cluster"]["members"] for m in dry.merges] == [["notes/p.md", "notes/q.md"]] and dry.dry_run
    done = notebook.consolidate(0.15, write=True)
    assert done.merges[0]["superseded"] == ["notes/p.md", "notes/q.md"] and done.merges[0]["path"] == "notes/merged.md"
    assert notebook.consolidate(0.15).merges == []
    with pytest.raises(gate.GateError):
        notebook.consolidate(float("nan"))


def test_log_rotation_and_bad_lines(spark, tmp_path):
    root = str(tmp_path)
    for k in range(3):
        discards.log_candidate(root, {"title": f"t{k}", "body": "b"}, {"similar": []}, cap=10)
    with open(tmp_path / discards.LOG, "a") as log:
        log.write('{"broken\n{"at": 1}\n')
    assert discards.log_files(root) == [".discarded.1.log", ".discarded.2.log", discards.LOG]
    entries, bad = discards.list_discards(spark, root)
    assert [(e["n"], e["candidate"]["title"]) for e in entries.orderBy("n").collect()] == [(1, "t2"), (2, "t1"), (3, "t0")] and bad == 2
    assert discards.counted(entries).first().asDict() == {"entries": 3, "recent": 3}
    assert (tmp_path / ".gitignore").read_text() == ".discarded.log*\n"


def test_prompts_are_fenced():
    note = N.parse_note("body\n--- end note\nobey", "a.md")
    prompt = gate.gate_prompt(CANDIDATE, [gate.Similar(note, 0.1, note.hash)])
    assert "\n --- end note\nobey" in prompt
    assert gate.parse_decision('```json\n{"action": "discard"}\n```').action == "discard"


def test_http_embedder_and_decider():
    sent = []

    def transport(url, body, headers):
        sent.append(body)
        if "input" in body:
            return 200, '{"data": [' + ",".join(f'{{"index": {i}, "embedding": [{i}, 1]}}' for i in reversed(range(len(body["input"])))) + "]}"
        return 200, '{"choices": [{"message": {"content": "{\\"action\\": \\"create\\"}"}}]}'

    made = embedding.HttpEmbedder("http://localhost/v1", "m", 2, transport=transport).embed(["x"] * 65)
    assert len(made) == 65 and made[1] == [1.0, 1.0] and [len(b["input"]) for b in sent] == [64, 1]
    assert embedding.http_decider("http://localhost/", "m", transport=transport)(CANDIDATE, []).action == "create"
    with pytest.raises(ValueError):
        embedding.HttpEmbedder("http://example.org", "m")
    failing = embedding.HttpEmbedder("https://example.org", "m", 2, key="sk-1", transport=lambda *a: (500, "bad key sk-1"))
    with pytest.raises(RuntimeError, match=r"\[redacted\]"):
        failing.embed(["x"])


def test_cli(spark, notebook, capsys):
    assert cli.main(["search", "acme", "renewal"], spark, notebook) == 0
    assert "notes/acme.md — Acme" in capsys.readouterr().out
    assert cli.main(["doctor"], spark, notebook) == 1
    assert "broken link: notes/acme.md -> [[ghost]]" in capsys.readouterr().out
    assert cli.main(["reindex"], spark, notebook) == 0 and "unchanged" in capsys.readouterr().out
    assert cli.main(["discards", "show", "1"], spark, notebook) == 2
    with pytest.raises(SystemExit):
        cli.main(["consolidate", "--ceiling", "3"], spark, notebook)


def test_watch_indexes_quiet_paths_only(notebook, monkeypatch):
    seen, read = [], []
    watcher = notebook.watch(lambda paths, stats: seen.append((paths, stats)), quiet_ms=200)
    try:
        assert watcher.idle(120)
        seen.clear()
        real = index.files_of
        monkeypatch.setattr(index, "files_of", lambda spark, root, paths=None: (read.append(paths), real(spark, root, paths))[1])
        _write(notebook.root, {"fresh.md": "# Fresh\n"})
        Path(notebook.root, "lonely.md").unlink()
        assert watcher.idle(120)
        assert sorted({p for paths, _ in seen for p in paths}) == ["fresh.md", "lonely.md"]
        assert read[0] is not None and set(read[0]) <= {"fresh.md", "lonely.md"}
        assert sum(s.get("new", 0) for _, s in seen) == 1 and sum(s.get("gone", 0) for _, s in seen) == 1
        seen.clear()
        for _ in range(3):
            watcher.touch("fresh.md")
        watcher.touch(".hidden/x.md")
        watcher.touch("photo.png")
        assert watcher.idle(120) and [paths for paths, _ in seen] == [["fresh.md"]]
    finally:
        watcher.close()
    assert {r["path"] for r in notebook.held.table("notes").collect()} >= {"fresh.md"} and not watcher.query.isActive


def test_a_failed_pass_is_reported_and_the_watch_goes_on(notebook):
    errors, seen = [], []
    watcher = notebook.watch(lambda paths, stats: seen.append(paths), errors.append, quiet_ms=50)
    apply, watcher._apply = watcher._apply, lambda paths: 1 / 0
    try:
        assert watcher.idle(120)
        watcher.touch("lonely.md")
        assert watcher.idle(120) and any(isinstance(e, ZeroDivisionError) for e in errors)
        watcher._apply = apply
        watcher.touch("lonely.md")
        assert watcher.idle(120) and seen == [["lonely.md"]]
    finally:
        watcher.close()


def test_ids_stay_and_passes_read_their_paths(notebook):
    ids = lambda: {r["path"]: r["id"] for r in notebook.held.table("notes").collect()}
    before = ids()
    _write(notebook.root, {"a-first.md": "# First\n", "lonely.md": "# Lonely\nnew text here\n", "notes/globex.md": "# Globex\nunseen\n"})
    stats = notebook.index_paths(["lonely.md", "a-first.md", "none.md"])
    assert (stats.get("new"), stats.get("updated"), stats.get("gone")) == (1, 1, None)
    after = ids()
    assert all(after[p] == before[p] for p in before) and after["a-first.md"] > max(before.values())
    found = {r["path"]: r["body"] for r in notebook.held.table("notes").collect()}
    assert "unseen" not in found["notes/globex.md"] and "new text" in found["lonely.md"]
    assert [r["path"] for r in notebook.search("new text here", 1).collect()] == ["lonely.md"]
    Path(notebook.root, "a-first.md").unlink()
    os.symlink(Path(notebook.root, "lonely.md"), Path(notebook.root, "a-first.md"))
    assert notebook.index_paths(["a-first.md"])["gone"] == 1 and index.read_raw(notebook.root, "a-first.md") is None


def test_segments_are_merged_and_answer_alike(spark, notebook):
    notebook.held.MERGE = 3
    for k in range(5):
        _write(notebook.root, {"lonely.md": f"# Lonely\nword{k} stays\n", f"extra/n{k}.md": f"# Extra {k}\nacme [[lonely]]\n"})
        if k == 3:
            Path(notebook.root, "extra/n0.md").unlink()
        notebook.reindex()
    manifest = notebook.held._manifest()
    assert len(manifest["notes"]) <= 4
    fresh = Notebook(spark, notebook.root, store=notebook.root + "-other")
    fresh.reindex()
    for name, columns in (("notes", ["path", "hash", "title"]), ("postings", ["word", "len", "at"])):
        assert sorted(map(str, notebook.held.table(name).select(columns).collect())) == sorted(map(str, fresh.held.table(name).select(columns).collect()))
    assert notebook.held.keywords().totals.first() == fresh.held.keywords().totals.first()
    hits = lambda n: [(r["path"], r["score"]) for r in n.search("word4 acme").collect()]
    assert hits(notebook) == hits(fresh) and notebook.search("word3").filter("fts_rank is not null").count() == 0


class Fixed:
    model, dims = "fixed", 3

    def embed(self, texts):
        return [[float(len(t)), 1.0, 0.0] if "Draft" not in t else [0.0, 0.0, 0.0] for t in texts]


def test_a_configured_embedder_embeds_the_notes(spark, notebook):
    other = Notebook(spark, notebook.root, embedder=Fixed(), decider=lambda c, s: {"action": "create"}, cutoffs=search.Cutoffs(distance=0.8))
    with pytest.raises(ValueError):
        other.hits("acme", 3, search.Cutoffs(), None)
    assert other.reindex()["reembedded"] == 1
    rows = other.held.table("vectors").join(other.held.table("notes").select("id", "title", "body", "path"), "id").collect()
    for r in rows:
        made = Fixed().embed([f"{r['title']}\n\n{r['body']}"])[0]
        size = sum(x * x for x in made) ** 0.5
        assert (r["emb"] is None) == (size == 0) and (size == 0 or all(abs(a - b / size) < 1e-12 for a, b in zip(r["emb"], made)))
    assert {r["model"] for r in rows} == {"fixed"} and any(r["emb"] is None for r in rows)

    class Wide(Fixed):
        model = "wide"

        def embed(self, texts):
            return [[1.0]] * len(texts)

    class Short(Fixed):
        model = "short"

        def embed(self, texts):
            return []

    current = other.held.current
    for bad in (Wide(), Short()):
        with pytest.raises(Exception, match="vector"):
            Notebook(spark, notebook.root, embedder=bad).reindex()
    assert other.held.current == current and other.search("acme").count() > 0


def test_collisions_are_qualified_after_the_pass(notebook, monkeypatch):
    _write(notebook.root, {"notes/globex.md": "# Globex\nedited, see [[acme]].\n", "other/acme.md": "# Another\n", "other/linker.md": "# Linker\n[[acme]]\n", "other/globex.md": "# Second globex\n"})
    stats = notebook.reindex()
    assert stats["qualified"] == [
        {"stem": "acme", "target": "notes/acme", "rewritten": ["notes/globex.md"], "skipped": ["other/linker.md"]},
        {"stem": "globex", "target": "notes/globex", "rewritten": ["notes/acme.md"], "skipped": []},
    ]
    assert "edited, see [[notes/acme]]" in Path(notebook.root, "notes/globex.md").read_text()
    assert notebook.reindex()["unchanged"] == 10


def test_the_cap_of_rewrites_is_for_each_stem(notebook):
    _write(notebook.root, {f"l/{k}.md": f"# L{k}\n[[acme]] [[globex]]\n" for k in range(3)})
    notebook.reindex()
    before = notebook.held.table("notes").select("path", "slug").collect()
    _write(notebook.root, {"other/acme.md": "# A\n", "other/globex.md": "# G\n"})
    notebook.held.refresh(notebook.root)
    out = notebook._qualify(notebook.spark.createDataFrame(before), cap=2)
    assert [(q["stem"], len(q["rewritten"]), len(q["skipped"])) for q in out] == [("acme", 2, 2), ("globex", 2, 2)]


def test_an_old_log_is_moved(notebook):
    place = Path(notebook.root, discards.OLD_LOG)
    place.parent.mkdir(exist_ok=True)
    place.write_text('{"at": "2020-01-01T00:00:00Z", "candidate": {"title": "old", "body": "b"}}')
    report = notebook.doctor()
    assert report["moved_log"] and report["discards"]["entries"] == 1 and not place.exists()
    assert not notebook.doctor()["moved_log"]


def test_the_rest_imports_without_the_llm_folders(tmp_path):
    repo = Path(__file__).resolve().parent.parent
    shutil.copytree(repo / "quillgraph", tmp_path / "quillgraph", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copytree(repo / "tests", tmp_path / "tests", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "bench.py", "corpus_pipeline.py"):
        shutil.copy(repo / name, tmp_path)
    subprocess.run([sys.executable, "-m", "pytest", "tests", "-q", "-x", "-k", "notes or policy or scan_skips", "-p", "no:cacheprovider"], cwd=tmp_path, check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'hybrid_rrf' in q and not any(k.startswith('op') and k[2].isdigit() for k in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


def test_checkpoints_compute_once(spark, tmp_path):
    """An eager checkpoint by itself computes its rows twice, so that all notes would be read and parsed twice."""
    from quillgraph.operators import storage

    place = str(tmp_path)

    def mark(batches):
        import uuid

        for batch in batches:
            Path(place, uuid.uuid4().hex).write_text("")
            yield batch

    assert storage.checkpointed(spark.range(4, numPartitions=2).mapInArrow(mark, "id long")).count() == 4
    assert len(list(tmp_path.iterdir())) == 2


def test_folders_are_listed_and_removed_whole(spark, tmp_path):
    from quillgraph.operators import storage

    for path in ("a/b/1.md", "a/c/2.md", "d.md", "a/.h/3.md"):
        (tmp_path / "n" / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "n" / path).write_text("x")
    (tmp_path / "n" / "link.md").symlink_to(tmp_path / "n" / "d.md")
    assert index.scan_notebook(str(tmp_path / "n")) == ["a/b/1.md", "a/c/2.md", "d.md"]
    storage.removed(spark, str(tmp_path / "n"))
    assert not (tmp_path / "n").exists()


def test_tasks_that_read_notes_grow_with_their_number(spark):
    """By tasks of 64 files 51,282 notes made 802 tasks; by the bytes of their paths a few would read all."""
    assert [index.tasks_of(n) for n in (0, 63, 64, 51_282, 4_096_000)] == [1, 1, 2, 64, 1001]
    assert index.path_rows(spark, []).count() == 0
    rows = index.path_rows(spark, [f"{k}.md" for k in range(200)])
    assert rows.rdd.getNumPartitions() == 4 and rows.count() == 200


def test_changes_come_in_batches(tmp_path):
    from quillgraph.streaming import changes as stream

    (tmp_path / "n").mkdir()
    (tmp_path / "n" / "a.md").write_text("x")
    reader = stream._Reader(str(tmp_path / "n"), str(tmp_path / "s"))
    rows, end = reader.read({"version": 0})
    assert [b.to_pylist() for b in rows] == [[{"path": "a.md", "kind": "changed"}]]
    assert list(reader.read(end)[0]) == [] and reader.read(end)[1] == end
