"""python -m quillgraph.cli COMMAND: reindex, doctor, search, watch, consolidate, discards."""

from __future__ import annotations

import argparse
import re
import sys
import time

from pyspark.sql import SparkSession

from .api import Notebook
from .operators import discards


def safe(text: str) -> str:
    """Control characters as question marks."""
    return re.sub(r"[\x00-\x1f\x7f-\x9f]", "?", str(text))


def _ceiling(text: str) -> float:
    value = float(text)
    if not 0 <= value <= 2:
        raise argparse.ArgumentTypeError("a cosine distance is in 0..2")
    return value


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quillgraph")
    top.add_argument("--root", default=".")
    commands = top.add_subparsers(dest="command", required=True)
    commands.add_parser("reindex").add_argument("--rebuild", action="store_true")
    doctor = commands.add_parser("doctor")
    doctor.add_argument("--rebuild", action="store_true")
    doctor.add_argument("--no-repair", action="store_true")
    commands.add_parser("search").add_argument("query", nargs="+")
    commands.add_parser("watch").add_argument("--seconds", type=float)
    consolidate = commands.add_parser("consolidate")
    consolidate.add_argument("--ceiling", type=_ceiling, required=True)
    log = commands.add_parser("discards")
    log.add_argument("verb", choices=("list", "show", "restore"), nargs="?", default="list")
    log.add_argument("n", type=int, nargs="?")
    return top


def summary(stats: dict) -> str:
    get = lambda k: stats.get(k, 0)
    text = f"{get('new')} new, {get('updated')} changed, {get('gone')} removed, {get('unchanged')} unchanged"
    text += " (re-embedded: model or dims changed)" if stats.get("reembedded") else ""
    for q in stats.get("qualified", []):
        text += f"; [[{safe(q['stem'])}]] " + (f"qualified to [[{safe(q['target'])}]] in {len(q['rewritten'])} notes" if q["target"] else f"went ambiguous, {len(q['skipped'])} notes left")
    return text


def main(argv: list[str] | None = None, spark: SparkSession | None = None, notebook: Notebook | None = None) -> int:
    """Run a command; 0 if all is well, 1 if links are left to repair or there is nothing to show, 2 on errors."""
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("quillgraph").getOrCreate()
    notebook = notebook or Notebook(spark, args.root)
    try:
        return _run(args, spark, notebook)
    except (ValueError, LookupError) as error:
        print(safe(error), file=sys.stderr)
        return 2


def _run(args, spark: SparkSession, notebook: Notebook) -> int:
    if args.command == "reindex":
        print(summary(notebook.reindex(args.rebuild)))
    elif args.command == "search":
        if notebook.held.current is None:
            print("notebook is not indexed (run reindex)")
            return 0
        hits = notebook.search(" ".join(args.query)).collect()
        print("\n".join(safe(f"{h['score']:.4f}  {h['path']} — {h['title']}") for h in hits) or "no matches")
    elif args.command == "doctor":
        report = notebook.doctor(not args.no_repair, args.rebuild)
        print(f"{len(report['stale'])} stale, {len(report['missing'])} missing")
        if report["discards"]["entries"]:
            print(f"discard log: {report['discards']['entries']} entries ({report['discards']['recent']} recent)")
        for path, target in report["broken"]:
            print(safe(f"broken link: {path} -> [[{target}]]"))
        for path, target, candidates in report["ambiguous"]:
            print(safe(f"ambiguous link: {path} -> [[{target}]] ({', '.join(candidates)})"))
        for kind in ("malformed", "orphans"):
            for path in report[kind]:
                print(safe(f"{kind.removesuffix('s')}: {path}"))
        return int(bool(report["broken"] or report["ambiguous"]))
    elif args.command == "consolidate":
        notebook.reindex()
        for c in notebook.clusters(args.ceiling):
            print(safe(f"{c['distance']:.4f}  {c['namespace'] if c['namespace'] is not None else '(several namespaces)'}  {', '.join(c['members'])}"))
    elif args.command == "watch":
        watcher = notebook.watch(lambda paths, stats: print(summary(stats)))
        try:
            watcher.query.awaitTermination() if args.seconds is None else time.sleep(args.seconds)
        except KeyboardInterrupt:
            pass
        finally:
            watcher.close()
    elif args.verb == "list":
        entries, bad = discards.list_discards(spark, notebook.root)
        for e in entries.orderBy("n").collect():
            print(safe(f"{e['n']}  {e['at']}  {e['candidate']['title']}"))
        if bad:
            print(f"{bad} lines can't be read")
    elif args.n is None:
        raise ValueError(f"discards {args.verb} needs a number")
    elif args.verb == "show":
        entry = discards.get_discard(spark, notebook.root, args.n)
        if entry is None:
            raise LookupError(f"no discarded candidate {args.n}")
        print(safe(entry["candidate"]["title"]))
        print("\n".join(safe(line) for line in entry["candidate"]["body"].split("\n")))
    else:
        result = notebook.restore_discard(args.n)
        print(safe(f"{result.action}  {result.path or ''}"))
    return 0


if __name__ == "__main__":
    sys.exit(main())
