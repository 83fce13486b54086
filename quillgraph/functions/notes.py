"""Notes: front matter, links, titles and hashes of markdown files; textual edits that keep every other byte."""

from __future__ import annotations

import hashlib
import json
import posixpath
import re
from copy import deepcopy
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
import yaml
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as X

NODE_BUDGET = 4096
_CLOSE = re.compile(r"^---[ \t]*$", re.M)
_LINK = re.compile(r"\[\[([^\[\]\n]{1,256})\]\]")
_HEADING = re.compile(r"^#[ \t]+(.+?)[ \t]*$", re.M)
_STAMP = re.compile(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?Z$")
_EDGES = " \t\n\r\f\v                 　﻿"


class _CoreLoader(yaml.SafeLoader):
    """YAML scalars as in version 1.2: no dates, no yes and no, no sexagesimal numbers."""


_CoreLoader.yaml_implicit_resolvers = {
    first: [(tag, pattern) for tag, pattern in rules if tag not in ("tag:yaml.org,2002:timestamp", "tag:yaml.org,2002:bool", "tag:yaml.org,2002:int", "tag:yaml.org,2002:float")]
    for first, rules in yaml.SafeLoader.yaml_implicit_resolvers.items()
}
_CoreLoader.add_implicit_resolver("tag:yaml.org,2002:bool", re.compile(r"^(?:true|True|TRUE|false|False|FALSE)$"), list("tTfF"))
_CoreLoader.add_implicit_resolver("tag:yaml.org,2002:int", re.compile(r"^(?:[-+]?[0-9]+|0o[0-7]+|0x[0-9a-fA-F]+)$"), list("-+0123456789"))
_CoreLoader.add_implicit_resolver("tag:yaml.org,2002:float", re.compile(r"^(?:[-+]?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?|[-+]?\.(?:inf|Inf|INF)|\.(?:nan|NaN|NAN))$"), list("-+.0123456789"))


def _core_int(loader, node):
    value = loader.construct_scalar(node)
    return int(value, 8 if value.startswith("0o") else 16 if value.startswith("0x") else 10)


_CoreLoader.add_constructor("tag:yaml.org,2002:int", _core_int)


@dataclass
class Note:
    path: str
    slug: str
    title: str
    type: str | None
    frontmatter: dict
    body: str
    links: list[str]
    hash: str
    malformed: bool


def within_budget(value, budget: int = NODE_BUDGET) -> bool:
    """Whether a value has no more nodes than the budget, those that are referred to again counted again."""
    stack, seen = [value], 0
    while stack:
        seen += 1
        if seen > budget:
            return False
        item = stack.pop()
        if isinstance(item, dict):
            stack.extend(item.values())
        elif isinstance(item, list):
            stack.extend(item)
    return True


def _usable(block: str) -> dict | None:
    if not block.strip(_EDGES):
        return {}
    try:
        value = yaml.load(block, _CoreLoader)
    except (yaml.YAMLError, ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) and within_budget(value) else None


@lru_cache(4096)
def _usable_once(block: str) -> dict | None:
    return _usable(block)


def usable_frontmatter(block: str) -> dict | None:
    """The mapping that a block holds; {} if blank, None if it isn't one or too large. Short blocks, which repeat over notes, are read once."""
    return deepcopy(_usable_once(block)) if len(block) <= 512 else _usable(block)


def split_frontmatter(text: str) -> tuple[str | None, str, bool]:
    """(block or None, body, unterminated) of a text without marks of byte order and carriage returns."""
    if not text.startswith("---\n"):
        return None, text, False
    close = _CLOSE.search(text, 4)
    if close is None:
        return None, text, True
    return text[4 : close.start()], text[close.end() + 1 :], False


def links_of(body: str) -> list[str]:
    found = (m.split("|", 1)[0].strip(_EDGES) for m in _LINK.findall(body))
    return list(dict.fromkeys(x for x in found if x))


def parse_note(raw: str, path: str) -> Note:
    """The note that a file holds. Never fails: what can't be read as front matter is body, and the note is malformed."""
    text = raw.removeprefix("﻿").replace("\r\n", "\n")
    block, body, malformed = split_frontmatter(text)
    frontmatter: dict = {}
    if block is not None:
        usable = usable_frontmatter(block)
        if usable is None:
            body, malformed = text, True
        else:
            frontmatter = usable
    title, kind = frontmatter.get("title"), frontmatter.get("type")
    malformed |= any(v is not None and not isinstance(v, str) for v in (title, kind))
    slug = posixpath.basename(path).removesuffix(".md")
    heading = _HEADING.search(body)
    if not isinstance(title, str) or not title.strip(_EDGES):
        title = heading[1] if heading else slug
    return Note(path, slug, title, kind if isinstance(kind, str) else None, frontmatter, body, links_of(body), hashlib.sha256(raw.encode("utf-8", "surrogatepass")).hexdigest(), malformed)


def serialize_note(frontmatter: dict, body: str) -> str:
    """A file's text; without a block if there is no front matter."""
    if not frontmatter:
        return body
    return f"---\n{yaml.safe_dump(frontmatter, sort_keys=False, allow_unicode=True, width=10**9)}---\n{body}"


def frontmatter_block(raw: str) -> tuple[int, int, int] | None:
    """Where, in a file as it is, the block starts and ends and the body starts; None without a usable block."""
    bom = 1 if raw.startswith("﻿") else 0
    opening = re.compile(r"---\r?\n").match(raw, bom)
    if not opening:
        return None
    close = re.compile(r"^---[ \t]*(?:\r?\n|\r?\Z)", re.M).search(raw, opening.end())
    if not close or usable_frontmatter(raw[opening.end() : close.start()].replace("\r\n", "\n")) is None:
        return None
    return opening.end(), close.start(), close.end()


def _key_line(key: str, value: str | None) -> str | None:
    if not re.fullmatch(r"[A-Za-z0-9_-]+", key):
        raise ValueError(f"not a front matter key: {key!r}")
    return None if value is None else f"{key}: {value if _STAMP.match(value) else json.dumps(value, ensure_ascii=False)}"


def _patched_block(block: str, key: str, line: str | None, newline: str) -> str:
    out, done, skipping = [], False, False
    for old in block.splitlines(keepends=True):
        if skipping and (old[:1] in " \t" or not old.strip()):
            continue
        skipping = False
        if re.match(rf"{re.escape(key)}[ \t]*:(?:[ \t\r\n]|$)", old):
            skipping = True
            if line is not None:
                out.append(line + newline)
            done = True
            continue
        out.append(old)
    if not done and line is not None:
        out.append(line + newline)
    return "".join(out)


def patch_frontmatter(raw: str, key: str, value: str | None) -> str:
    """The file with a top-level key set (every line of it), or unset with None; all other bytes stay."""
    line = _key_line(key, value)
    newline = "\r\n" if "\r\n" in raw else "\n"
    place = frontmatter_block(raw)
    if place is None:
        if line is None:
            return raw
        bom = "\ufeff" if raw.startswith("\ufeff") else ""
        return f"{bom}---{newline}{line}{newline}---{newline}{raw[len(bom):]}"
    start, end, _ = place
    return raw[:start] + _patched_block(raw[start:end], key, line, newline) + raw[end:]


def replace_body(raw: str, body: str) -> str:
    """The file with its front matter as it is and another body."""
    place = frontmatter_block(raw)
    return body if place is None else raw[: place[2]] + body


def qualify_links(raw: str, stem: str, target: str) -> str:
    """The file with bare links to the stem, in its body, rewritten to the target."""
    place = frontmatter_block(raw)
    cut = place[2] if place else 0

    def rewrite(match):
        name, bar, alias = match[1].partition("|")
        return f"[[{target}{bar}{alias}]]" if name.strip(_EDGES) == stem else match[0]

    return raw[:cut] + _LINK.sub(rewrite, raw[cut:])


@F.pandas_udf(T.StructType([T.StructField("frontmatter", T.StringType()), T.StructField("usable", T.BooleanType())]))
def read_block(blocks: pd.Series) -> pd.DataFrame:
    """A block's mapping as JSON, and whether it is one."""
    values = [None if b is None else usable_frontmatter(b) for b in blocks]
    return pd.DataFrame({"frontmatter": [None if v is None else json.dumps(v, ensure_ascii=False, default=str) for v in values], "usable": [v is not None for v in values]})


def _text(raw: Column) -> Column:
    return F.replace(F.regexp_replace(raw, "^﻿", ""), F.lit("\r\n"), F.lit("\n"))


def split(raw: Column) -> tuple[Column, Column, Column]:
    """(block or null, body, unterminated) of a file's text, as expressions."""
    text = _text(raw)
    opened = text.startswith("---\n")
    pattern = r"(?s)\A---\n(.*?)(?<=\n)---[ \t]*(?:\n|\z)(.*)\z"
    closed = opened & text.rlike(pattern)
    return F.when(closed, F.regexp_extract(text, pattern, 1)), F.when(closed, F.regexp_extract(text, pattern, 2)).otherwise(text), opened & ~closed


_PLACES = r"(?s)\A(\x{FEFF}?---\r?\n)(.*?)((?<=\n)---[ \t]*(?:\r?\n|\r?\z))(.*)\z"


def _place(raw: Column, part: int) -> Column:
    """Of ``frontmatter_block``, as an expression: 1 what is before the block, 2 the block, 3 the line that closes it, 4 the body; null without a block."""
    return F.when(raw.rlike(_PLACES), F.regexp_extract(raw, _PLACES, part))


def frontmatter_patched(raw: Column, key: str, value: str | None) -> Column:
    """``patch_frontmatter`` of a column. Only the blocks go through Python."""
    line = _key_line(key, value)

    @F.pandas_udf("string")
    def patch(blocks: pd.Series, newlines: pd.Series) -> pd.Series:
        usable = lambda b: b is not None and usable_frontmatter(b.replace("\r\n", "\n")) is not None
        return pd.Series([_patched_block(b, key, line, n) if usable(b) else None for b, n in zip(blocks, newlines)], dtype=object)

    newline = F.when(raw.contains("\r\n"), "\r\n").otherwise("\n")
    patched = patch(_place(raw, 2), newline)
    bare = raw
    if line is not None:
        bom = F.when(raw.startswith("\ufeff"), "\ufeff").otherwise("")
        bare = F.concat(bom, F.lit("---"), newline, F.lit(line), newline, F.lit("---"), newline, F.regexp_replace(raw, r"\A\x{FEFF}", ""))
    return F.when(patched.isNotNull(), F.concat(_place(raw, 1), patched, _place(raw, 3), _place(raw, 4))).otherwise(bare)


def body_replaced(raw: Column, body: Column) -> Column:
    """``replace_body`` of a column. Only the blocks go through Python."""
    block = _place(raw, 2)
    usable = read_block(F.replace(block, F.lit("\r\n"), F.lit("\n")))["usable"]
    return F.when(usable, F.concat(_place(raw, 1), block, _place(raw, 3), body)).otherwise(body)


def parsed(files: DataFrame, *kept: str) -> DataFrame:
    """Notes of files (path, raw): path, slug, title, type, frontmatter (JSON), body, links, hash, superseded_by, malformed, and columns of the files that are kept.

    Everything but YAML is an expression; only the blocks go through Python.
    """
    block, body, open_ended = split(F.col("raw"))
    read = files.select("*", block.alias("block"), body.alias("split_body"), open_ended.alias("open_ended")).withColumn("read", read_block("block"))
    bad = F.col("open_ended") | (F.col("block").isNotNull() & ~F.col("read.usable"))
    front = F.when(bad | F.col("block").isNull(), F.lit("{}")).otherwise(F.col("read.frontmatter"))
    notes = read.select(*kept, "path", "raw", front.alias("frontmatter"), F.when(bad, _text(F.col("raw"))).otherwise(F.col("split_body")).alias("body"), bad.alias("bad"))
    value = F.try_parse_json("frontmatter")
    kind = lambda key: F.schema_of_variant(F.try_variant_get(value, f"$.{key}", "variant"))
    text = lambda key: F.when(kind(key) == "STRING", F.try_variant_get(value, f"$.{key}", "string"))
    odd = lambda key: F.coalesce(~kind(key).isin("STRING", "VOID"), F.lit(False))
    title = F.when(X.trimmed(text("title")) != "", text("title"))
    return notes.select(
        "path", X.slug_of(F.col("path")).alias("slug"), F.coalesce(title, X.heading_of(F.col("body")), X.slug_of(F.col("path"))).alias("title"), text("type").alias("type"), "frontmatter", "body",
        X.links_of(F.col("body")).alias("links"), F.sha2("raw", 256).alias("hash"), text("superseded_by").alias("superseded_by"), (F.col("bad") | odd("title") | odd("type")).alias("malformed"), *kept,
    )
