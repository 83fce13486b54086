"""The discard log: one JSON object a line, rotated by size, read newest first."""

from __future__ import annotations

import json
import os
import re
from datetime import datetime, timedelta, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import index, storage

LOG = ".discarded.log"
OLD_LOG = os.path.join(".quillgraph", "discarded.log")
CAP = 5 << 20
_ROTATED = re.compile(r"\.discarded\.(\d+)\.log")
ENTRY = "at string, candidate struct<title:string,body:string,type:string,namespace:string>, decision struct<action:string,target:string,body:string>, reason string, similar array<struct<path:string,hash:string,score:double>>"


def now() -> str:
    return datetime.now(timezone.utc).isoformat(timespec="milliseconds").replace("+00:00", "Z")


def log_files(root: str) -> list[str]:
    """Rotated logs by number, oldest first, then the live one."""
    if not os.path.isdir(root):
        return []
    rotated = sorted((int(m[1]), n) for n in os.listdir(root) if (m := _ROTATED.fullmatch(n)))
    return [n for _, n in rotated] + [LOG] * os.path.isfile(os.path.join(root, LOG))


def ignore_logs(root: str) -> None:
    """Keep the logs out of version control: one line in .gitignore, added once; links aren't followed."""
    fd = os.open(os.path.join(root, ".gitignore"), os.O_RDWR | os.O_CREAT | os.O_NOFOLLOW, 0o644)
    with os.fdopen(fd, "r+") as file:
        held = file.read()
        if f"{LOG}*" not in held.split("\n"):
            file.write(("\n" if held and not held.endswith("\n") else "") + f"{LOG}*\n")


def log_candidate(root: str, candidate: dict, extra: dict, cap: int = CAP) -> None:
    """Append an entry; a log that has reached the cap becomes the next numbered one first."""
    path = Path(root) / LOG
    if path.exists() and not path.is_symlink() and path.lstat().st_size >= cap:
        last = max((int(m[1]) for n in os.listdir(root) if (m := _ROTATED.fullmatch(n))), default=0)
        path.rename(path.with_name(f".discarded.{last + 1}.log"))
    if not path.exists():
        ignore_logs(root)
    fd = os.open(path, os.O_WRONLY | os.O_APPEND | os.O_CREAT | os.O_NOFOLLOW, 0o644)
    with os.fdopen(fd, "a") as file:
        file.write(json.dumps({"at": now(), "candidate": candidate, **extra}, ensure_ascii=False) + "\n")


def move_old_log(root: str) -> bool:
    """Append a log from where it once was kept, in the index's folder, to the live one, then remove it; whether there was one."""
    old = Path(root) / OLD_LOG
    if not old.exists():
        return False
    lines = old.read_text("utf-8", "replace")
    if lines:
        if not (Path(root) / LOG).exists():
            ignore_logs(root)
        fd = os.open(Path(root) / LOG, os.O_WRONLY | os.O_APPEND | os.O_CREAT | os.O_NOFOLLOW, 0o644)
        with os.fdopen(fd, "a") as file:
            file.write(lines if lines.endswith("\n") else lines + "\n")
    old.unlink()
    return True


def entries_of(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries, malformed lines) of (file, line, value); entries have n = 1 for the newest."""
    read = lines.filter(F.trim("value") != "").withColumn("e", F.from_json("value", ENTRY))
    usable = F.col("e.at").isNotNull() & F.col("e.candidate.title").isNotNull() & F.col("e.candidate.body").isNotNull()
    good = read.filter(usable)
    newest = storage.numbered(good, [F.desc("file"), F.desc("line")], "n")
    return newest.select("n", "e.*"), read.filter(~F.coalesce(usable, F.lit(False))).select("file", "line", "value")


def lines_of(spark: SparkSession, root: str) -> DataFrame:
    """(file, line, value) of all logs, files by age. Each log, whose size its rotation bounds, is read by one task.

    (Spark's text source passes over names that begin with a dot.)
    """
    logs = spark.createDataFrame(list(enumerate(log_files(root))), "file int, path string")
    return index.files_of(spark, root, logs.repartition("path")).join(F.broadcast(logs), "path").select("file", F.posexplode(F.split("raw", "\n")).alias("line", "value"))


def list_discards(spark: SparkSession, root: str) -> tuple[DataFrame, int]:
    """The entries of all logs of a folder, and how many lines couldn't be read."""
    entries, bad = entries_of(lines_of(spark, root))
    return entries, bad.count()


def get_discard(spark: SparkSession, root: str, n: int) -> dict | None:
    """The n-th entry from the newest, or None."""
    row = list_discards(spark, root)[0].filter(F.col("n") == n).first()
    return None if row is None else row.asDict(True)


def counted(entries: DataFrame, at: datetime | None = None) -> DataFrame:
    """(entries, recent): all, and those of the last seven days; times that can't be read count as old."""
    since = (at or datetime.now(timezone.utc)) - timedelta(days=7)
    recent = F.count_if(F.try_to_timestamp("at") >= F.lit(since))
    return entries.agg(F.count("*").alias("entries"), recent.alias("recent"))
