"""The link graph: resolution of targets, and what is wrong with it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def edges_of(notes: DataFrame) -> DataFrame:
    """(from_id, to_slug), once each, of notes (id, links)."""
    return notes.select(F.col("id").alias("from_id"), F.explode("links").alias("to_slug")).distinct()


def resolved(edges: DataFrame, notes: DataFrame) -> DataFrame:
    """(from_id, to_slug, to_id): by the exact path if there is one, else by the stem if one note only has it.

    The uniqueness of stems is a pre-aggregation, so both lookups are plain equi-joins.
    """
    by_path = notes.select(X.link_target(F.col("path")).alias("to_slug"), F.col("id").alias("path_id"))
    by_stem = notes.groupBy(F.col("slug").alias("to_slug")).agg(F.min("id").alias("stem_id"), F.count("*").alias("holders")).filter("holders = 1").drop("holders")
    joined = edges.join(by_path, "to_slug", "left").join(by_stem, "to_slug", "left")
    return joined.select("from_id", "to_slug", F.coalesce("path_id", "stem_id").alias("to_id"))


def unresolved(edges: DataFrame, notes: DataFrame) -> DataFrame:
    """(path, target) of the links that resolve to nothing."""
    lost = edges.filter("to_id is null")
    return lost.join(notes.select("id", "path"), lost["from_id"] == F.col("id")).select("path", F.col("to_slug").alias("target"))


def shared_stems(notes: DataFrame) -> DataFrame:
    """(slug, targets) of the stems that several notes have; targets sorted."""
    held = notes.groupBy("slug").agg(F.sort_array(F.collect_list(X.link_target(F.col("path")))).alias("targets"))
    return held.filter(F.size("targets") > 1)


def ambiguous(edges: DataFrame, notes: DataFrame) -> DataFrame:
    """(path, target, candidates) of unresolved bare links whose stem several notes have."""
    shared = shared_stems(notes).select(F.col("slug").alias("target"), F.col("targets").alias("candidates"))
    return unresolved(edges, notes).filter(~F.col("target").contains("/")).join(shared, "target")


def broken(edges: DataFrame, notes: DataFrame) -> DataFrame:
    """(path, target) of unresolved links that aren't ambiguous."""
    shared = shared_stems(notes).select(F.col("slug").alias("target"))
    return unresolved(edges, notes).join(shared, "target", "left_anti")


def orphans(edges: DataFrame, notes: DataFrame) -> DataFrame:
    """(path) of the notes without any link out and without a resolved link in: two anti-joins."""
    out = edges.select(F.col("from_id").alias("id"))
    into = edges.filter("to_id is not null").select(F.col("to_id").alias("id"))
    return notes.join(out, "id", "left_anti").join(into, "id", "left_anti").select("path")


def backlinkers(edges: DataFrame, notes: DataFrame, stems: DataFrame) -> DataFrame:
    """(stem, path) of the notes that link to a bare stem of ``stems`` (stem)."""
    linkers = edges.join(stems, edges["to_slug"] == stems["stem"])
    return linkers.join(notes.select("id", "path"), F.col("from_id") == F.col("id")).select("stem", "path").distinct()


def collisions(known: DataFrame, new: DataFrame) -> DataFrame:
    """(slug, path, target): new notes whose stem exactly one known note has, with that note's target."""
    holders = known.groupBy("slug").agg(F.count("*").alias("n"), F.min("path").alias("incumbent")).filter("n = 1")
    return new.join(holders, "slug").select("slug", "path", X.link_target(F.col("incumbent")).alias("target"))


def neighbours(edges: DataFrame, notes: DataFrame, hits: DataFrame) -> DataFrame:
    """Notes one link away, in either direction, from the hits (id), without the hits.

    The two directions are a union of equi-joins: an OR in EXISTS would be a nested loop.
    """
    known = edges.filter("to_id is not null").select("from_id", "to_id")
    ids = F.broadcast(hits.select("id"))  # the hits of a search, which its limit bounds
    out = known.join(ids.select(F.col("id").alias("from_id")), "from_id").select(F.col("to_id").alias("id"))
    into = known.join(ids.select(F.col("id").alias("to_id")), "to_id").select(F.col("from_id").alias("id"))
    near = out.union(into).distinct().join(ids, "id", "left_anti")
    return notes.join(near, "id", "left_semi")
