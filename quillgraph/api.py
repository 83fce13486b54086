"""The facade over a folder of notes: open, search, get, list, propose, consolidate, reindex, doctor, watch."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import notes as N
from .operators import cluster, discards, gate, graph, index, scope, search, storage
from .streaming import changes

QUALIFY_CAP = 500


class Notebook:
    """A folder of notes and its index. Without a policy everyone may read and write everything."""

    def __init__(self, spark: SparkSession, root: str, embedder=None, scopes: dict | None = None, store: str | None = None, decider: Callable | None = None, merger: Callable | None = None, cutoffs: search.Cutoffs | None = None):
        self.spark, self.root = spark, os.path.abspath(root)
        self.policy = scope.compiled(scopes)
        self.embedder = embedder or search.LexicalEmbedder()
        self.held = index.Index(spark, store or os.path.join(self.root, ".quillgraph"), self.embedder)
        self.gate = gate.Gate(self.root, self, self.policy)
        self.decider, self.merger, self.cutoffs = decider, merger, cutoffs or search.Cutoffs()

    def _rules(self, context: gate.Context | None):
        return scope.rules_for(self.policy, context.agent if context else None)

    def refresh(self, root: str | None = None, rebuild: bool = False) -> dict:
        return self.reindex(rebuild)

    def reindex(self, rebuild: bool = False) -> dict:
        """Index what changed; then qualify bare links that a new note made ambiguous, and index those files."""
        return self._pass(None, rebuild)

    def index_paths(self, paths: list[str]) -> dict:
        """The same for these paths only; the other files are not read. After a change of embedder all notes are indexed."""
        stats = self._pass(sorted(set(paths)), False)
        if not stats["reembedded"]:
            return stats
        full = self._pass(None, False)
        return full | {"reembedded": 1, "qualified": stats["qualified"] + full["qualified"]}

    def _pass(self, paths: list[str] | None, rebuild: bool) -> dict:
        before = None if rebuild else self.held.table("notes")
        if before is not None:
            before = storage.checkpointed(before.select("path", "slug"))  # the pass may remove the files it is read from
        stats = self.held.refresh(self.root, rebuild, paths=paths)
        stats["qualified"] = self._qualify(before) if before is not None and stats.get("new") else []
        rewritten = sorted({p for q in stats["qualified"] for p in q["rewritten"]})
        if rewritten:
            try:
                self.held.refresh(self.root, paths=rewritten)
            except Exception as error:  # the files have changed already; the stats are the only record of which
                stats["index_error"] = str(error)
        return stats

    def _qualify(self, before: DataFrame, cap: int = QUALIFY_CAP) -> list[dict]:
        """Rewrite the bare links to stems that one known note had before this pass and a new one has now too.

        Only the collisions and their linkers come to the driver, which writes their files one by one. A linker is left alone and
        reported if it is new itself, has changed since it was indexed, or comes after ``cap`` rewrites of its stem.
        """
        after, edges = self.held.table("notes"), self.held.table("edges")
        new = after.join(before.select("path"), "path", "left_anti")
        still = before.join(after.select("path"), "path", "left_semi")
        found = graph.collisions(still, new).select("slug", "target").distinct()
        links = edges.join(F.broadcast(found), edges["to_slug"] == F.col("slug")).select("from_id", "slug")
        hashes = after.select(F.col("id").alias("from_id"), "path", "hash").join(new.select("path", F.lit(True).alias("is_new")), "path", "left")
        linkers: dict[str, list] = {}
        for row in links.join(hashes, "from_id").select("slug", "path", "hash", "is_new").collect():
            linkers.setdefault(row["slug"], []).append((row["path"], row["hash"], bool(row["is_new"])))
        out = []
        for row in sorted(found.collect()):
            stem, target = row["slug"], row["target"]
            if stem not in linkers or not index.is_note(self.root, target + ".md"):
                continue
            usable = "/" in target and not set("[]|\r\n") & set(target) and target == target.strip()
            entry = {"stem": stem, "target": target if usable else None, "rewritten": [], "skipped": []}
            for path, known_hash, is_new in sorted(linkers[stem]):
                done = usable and not is_new and len(entry["rewritten"]) < cap and self._requalify(path, known_hash, stem, target)
                entry["rewritten" if done else "skipped"].append(path)
            out.append(entry)
        return out

    def _requalify(self, path: str, known_hash: str, stem: str, target: str) -> bool:
        """Qualify the links of one file, if it is still as it was indexed; a file that can't be read or written is left."""
        place = gate.confined(self.root, path)
        try:
            raw = index.read_raw(self.root, path)
            if raw is None or N.parse_note(raw, path).hash != known_hash:
                return False
            text = N.qualify_links(raw, stem, target)
            if text == raw:
                return False
            gate.write_atomic(place, text)
            return True
        except OSError:
            return False

    def _query_vector(self, query: str) -> list[float]:
        """A query's vector, of the embedder's width; an index of another embedder is refused."""
        if self.held.stale():
            raise ValueError("the index was made by another embedder: reindex first")
        vectors = self.embedder.embed([query])
        if len(vectors) != 1 or len(vectors[0]) != self.embedder.dims:
            raise ValueError(f"the embedder didn't give one vector of width {self.embedder.dims}")
        return list(vectors[0])

    def search(self, query: str, n: int = 10, cutoffs: search.Cutoffs | None = None, expand: bool = False, context: gate.Context | None = None) -> DataFrame:
        """Fused hits: id, path, title, score, vec_rank, fts_rank, expansion."""
        rules = self._rules(context)
        notes, vectors, edges = (self.held.table(t) for t in ("notes", "vectors", "edges"))
        if notes is None:
            raise LookupError("the notebook is not indexed")
        vector = self._query_vector(query)
        allowed = None if rules is None else scope.readable(rules, F.col("path"))
        options = search.Options(n, cutoffs or search.Cutoffs(), expand)
        return search.hybrid(notes.select("id", "path", "title", "superseded_by"), vectors.filter("emb is not null").select("id", "emb"), query, vector, options, allowed, edges, self.held.keywords())

    def hits(self, query: str, n: int, cutoffs: search.Cutoffs, rules) -> list[tuple[str, float]]:
        """What the gate searches with: (path, score)."""
        notes, vectors = self.held.table("notes"), self.held.table("vectors")
        if notes is None:
            return []
        allowed = None if rules is None else scope.readable(rules, F.col("path"))
        found = search.hybrid(notes.select("id", "path", "title", "superseded_by"), vectors.filter("emb is not null").select("id", "emb"), query, self._query_vector(query), search.Options(n, cutoffs), allowed, None, self.held.keywords())
        return [(r["path"], r["score"]) for r in found.collect()]

    def get(self, path: str, context: gate.Context | None = None) -> N.Note | None:
        """The note of a file as it is now; None if there is none or it may not be read."""
        rules = self._rules(context)
        if "\0" in path or not path.endswith(".md"):
            return None
        place = gate.confined(self.root, path)
        rel = os.path.relpath(place, os.path.realpath(self.root)).replace(os.sep, "/")
        if not scope.may(rules, "read", rel) or not place.is_file():
            return None
        raw = index.read_raw(self.root, rel)
        return None if raw is None else N.parse_note(raw, rel)

    def list(self, prefix: str | None = None, context: gate.Context | None = None) -> DataFrame:
        """(path, title), by path, of the notes under a prefix."""
        return scope.listed(self.held.table("notes"), prefix, self._rules(context)).orderBy("path")

    def propose(self, candidate: gate.Candidate, context: gate.Context | None = None) -> gate.Result:
        if self.decider is None:
            raise ValueError("the notebook was opened without a decider")
        return self.gate.propose(candidate, self.decider, self.cutoffs, context=context)

    def clusters(self, ceiling: float) -> list[dict]:
        vectors = self.held.table("vectors").filter("emb is not null")
        return [r.asDict() for r in cluster.clusters(vectors.select("id", "emb"), self.held.table("notes"), ceiling).collect()]

    def consolidate(self, ceiling: float, cap: int = gate.MAX_MERGES, write: bool = False, context: gate.Context | None = None) -> gate.Report:
        if self.merger is None:
            raise ValueError("the notebook was opened without a merger")
        return self.gate.consolidate(lambda: self.clusters(ceiling), self.merger, ceiling, cap, write, context)

    def doctor(self, repair: bool = True, rebuild: bool = False) -> dict:
        """Drift before the repair, and what is wrong with the graph after it."""
        moved = discards.move_old_log(self.root)
        files = index.files_of(self.spark, self.root).select("path", F.sha2("raw", 256).alias("hash"))
        held = self.held.table("notes")
        drift = index.drift(files, held.select("path", "hash")).collect() if held is not None else [{"path": p, "kind": "stale"} for p in index.scan_notebook(self.root)]
        report = {kind: sorted(r["path"] for r in drift if r["kind"] == kind) for kind in ("stale", "missing")}
        if repair or rebuild or held is None:
            report["reembedded"] = bool(self.reindex(rebuild).get("reembedded"))
        notes, edges = self.held.table("notes"), self.held.table("edges")
        report["broken"] = sorted((r["path"], r["target"]) for r in graph.broken(edges, notes).collect())
        report["ambiguous"] = sorted((r["path"], r["target"], r["candidates"]) for r in graph.ambiguous(edges, notes).collect())
        report["orphans"] = sorted(r["path"] for r in graph.orphans(edges, notes).collect())
        report["malformed"] = sorted(r["path"] for r in notes.filter("malformed").select("path").collect())
        entries, bad = discards.list_discards(self.spark, self.root)
        counted = discards.counted(entries).first()
        report["moved_log"] = moved
        report["discards"] = {"entries": counted["entries"], "recent": counted["recent"], "malformed": bad}
        return report

    def restore_discard(self, n: int, context: gate.Context | None = None) -> gate.Result:
        """Propose the n-th discarded candidate again."""
        entry = discards.get_discard(self.spark, self.root, n)
        if entry is None:
            raise LookupError(f"no discarded candidate {n}")
        return self.propose(gate.Candidate(**entry["candidate"]), context)

    def watch(self, on_change: Callable | None = None, on_error: Callable | None = None, quiet_ms: int = changes.QUIET_MS) -> changes.Watcher:
        """A watcher that indexes the paths that changed, each once it has been quiet; on_change gets them and the counts."""
        return changes.watch(self.spark, self.root, self.index_paths, on_change, on_error, quiet_ms)

