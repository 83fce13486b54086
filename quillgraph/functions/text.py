"""Column expressions over paths, titles, links and words."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = r"[\s\p{Z}\x{FEFF}]"
WIKILINK = r"\[\[([^\[\]\n]{1,256})\]\]"


def trimmed(text: Column) -> Column:
    """Without Unicode blanks at either end."""
    return F.regexp_replace(text, f"^{BLANK}+|{BLANK}+$", "")


def is_note_path(path: Column) -> Column:
    """Ends in .md and no segment is hidden."""
    return path.endswith(".md") & ~path.rlike(r"(^|[/\\])\.")


def slug_of(path: Column) -> Column:
    """The file name without .md."""
    return F.regexp_extract(path, r"([^/]+)\.md$", 1)


def namespace_of(path: Column) -> Column:
    """Everything up to and with the last slash; empty at the root."""
    return F.regexp_extract(path, r"^(.*/)?[^/]*$", 1)


def normalized_prefix(prefix: Column) -> Column:
    """Without slashes at the edges but one at the end; the root is empty."""
    bare = F.regexp_replace(F.coalesce(prefix, F.lit("")), r"^/+|/+$", "")
    return F.when(bare == "", bare).otherwise(F.concat(bare, F.lit("/")))


def link_target(path: Column) -> Column:
    """The target that names a path: it without a trailing .md."""
    return F.regexp_replace(path, r"\.md$", "")


def is_writable_target(target: Column) -> Column:
    """A link to the target would be read back as the same target."""
    return ~target.rlike(r"[\[\]\r\n|]") & (trimmed(target) == target)


def slugified(title: Column) -> Column:
    """Lower case, runs of other signs as one dash, 80 signs at most before dashes at the ends go; null if empty."""
    dashed = F.substring(F.regexp_replace(F.lower(title), "[^a-z0-9]+", "-"), 1, 80)
    return F.nullif(F.regexp_replace(dashed, "^-+|-+$", ""), F.lit(""))


def content_stem(title: Column, body: Column) -> Column:
    """A stem from the content, for titles that give no slug."""
    return F.concat(F.lit("note-"), F.substring(F.sha2(F.concat(title, F.lit("\n\n"), body), 256), 1, 8))


def scrubbed(text: Column) -> Column:
    """Control characters as question marks."""
    return F.regexp_replace(text, r"\p{Cc}", "?")


def fenced(text: Column) -> Column:
    """Trimmed, with lines that look like a prompt's fence moved in by one blank."""
    return F.regexp_replace(trimmed(text), r"(?im)^(---[ \t]*(?:begin|end))", " $1")


def links_of(body: Column) -> Column:
    """Targets of the wikilinks, each once in order of first sight, aliases cut, blank ones left out."""
    targets = F.transform(F.regexp_extract_all(body, F.lit(WIKILINK), F.lit(1)), lambda x: trimmed(F.split_part(x, F.lit("|"), F.lit(1))))
    return F.filter(F.array_distinct(targets), lambda x: x != "")


def heading_of(body: Column) -> Column:
    """The first level-one heading, null if there is none."""
    return F.nullif(F.regexp_extract(body, r"(?m)^#[ \t]+(.+?)[ \t]*$", 1), F.lit(""))


def qualified(body: Column, stem: Column, target: Column) -> Column:
    """Bare links to the stem, with or without an alias, rewritten to the target."""
    quoted = F.concat(F.lit(r"\[\[[ \t]*\Q"), stem, F.lit(r"\E[ \t]*(\|[^\[\]\n]*)?\]\]"))
    safe = F.regexp_replace(target, r"([\\$])", r"\\$1")
    return F.regexp_replace(body, quoted, F.concat(F.lit("[["), safe, F.lit("$1]]")))


_MARKS = r"[\u0300-\u0331]"


def _folding() -> tuple[str, str]:
    """Lower-case Latin letters with diacritics, and the letters without; the final sigma is a sigma."""
    plain, marked = ["σ"], ["ς"]
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        parts = unicodedata.normalize("NFD", chr(code))
        if chr(code).lower() == chr(code) and len(parts) > 1 and parts[0].isascii() and all(map(unicodedata.combining, parts[1:])):
            marked.append(chr(code))
            plain.append(parts[0])
    return "".join(marked), "".join(plain)


_MARKED, _PLAIN = _folding()
_FOLD = str.maketrans(_MARKED, _PLAIN)


def folded(text: Column) -> Column:
    """Lower case without Latin diacritics and without combining marks; other scripts keep theirs. Texts in ASCII are lowered only."""
    marked = F.regexp_replace(F.translate(F.lower(text), _MARKED, _PLAIN), _MARKS, "")
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(marked)


def fold(text: str) -> str:
    """What ``folded`` is for columns."""
    return re.sub(_MARKS, "", text.lower().translate(_FOLD))


def words_of(text: Column) -> Column:
    """Folded runs of letters and digits, in order."""
    return F.regexp_extract_all(folded(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def search_terms(text: Column, most: int = 32) -> Column:
    """Distinct pieces between blanks that hold a letter or digit, the first ``most``."""
    pieces = F.filter(F.split(text, f"{BLANK}+"), lambda x: x.rlike(r"[\p{L}\p{N}]"))
    return F.slice(F.array_distinct(pieces), 1, most)


def match_expression(text: Column) -> Column:
    """The terms as quoted phrases joined by OR; null without terms."""
    quoted = F.transform(search_terms(text), lambda t: F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"')))
    return F.nullif(F.array_join(quoted, " OR "), F.lit(""))
