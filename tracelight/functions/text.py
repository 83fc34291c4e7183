"""Text and path functions as Column expressions."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Names that mark a file as an archive, in a walk and inside an input.
WALK_ARCHIVES = ("zip", "tar", "gz", "tgz", "bz2", "xz", "7z", "jar", "war", "whl", "vsix", "apk", "epub", "nupkg")
INPUT_ARCHIVES = (".zip", ".jar", ".war", ".whl", ".egg", ".vsix", ".apk", ".tgz", ".crate", ".gem", ".tar.gz", ".tar.bz2", ".tar.xz")

ELLIPSIS = "…"


@F.pandas_udf(StringType())
def nfc(texts: pd.Series) -> pd.Series:
    """Unicode normal form C; there is no built-in for it."""
    return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def newlines_to_lf(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def strip_bom(text: Column) -> Column:
    return F.regexp_replace(text, "^﻿", "")


def occurrences(text: Column, part: str) -> Column:
    """How often ``part`` stands in the text, without overlaps."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("long")


def dominant_newline(text: Column) -> Column:
    """``crlf`` if strictly more lines end that way, else ``lf``."""
    crlf = occurrences(text, "\r\n")
    return F.when(crlf > occurrences(text, "\n") - crlf, "crlf").otherwise("lf")


def canonical_relpath(path: Column) -> Column:
    """Forward slashes, and no empty or ``.`` segments."""
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    return F.array_join(F.filter(parts, lambda p: ~p.isin("", ".")), "/")


def lexical_normal(path: Column) -> Column:
    """Resolves ``..`` by name alone; a ``..`` that leaves the root stays."""
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda p: ~p.isin("", "."))
    none = F.lit("").cast("string")
    keep = lambda acc, p: F.when(acc == "", p).otherwise(F.concat(acc, F.lit("/"), p))
    drop = lambda acc: F.regexp_replace(acc, "/?[^/]*$", "")
    step = lambda acc, p: F.when((p == "..") & (acc != "") & ~F.regexp_like(acc, F.lit(r"(^|/)\.\.$")), drop(acc)).otherwise(keep(acc, p))
    return F.aggregate(parts, none, step)


def display_path(path: Column) -> Column:
    return F.regexp_replace(path, r"^\\\\\?\\", "")


def member_fault(path: Column) -> Column:
    """Why the path of an archive member is refused; null if it is fine."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    return (
        F.when(F.length(F.trim(p)) == 0, "empty")
        .when(p.startswith("/"), "absolute")
        .when(F.regexp_like(p, F.lit("^[A-Za-z]:")), "drive")
        .when(F.exists(F.split(p, "/"), lambda x: x == ".."), "parent")
    )


def extension(path: Column) -> Column:
    """Lower-case text after the last dot of the last segment; empty if there is none."""
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))


def is_archive(path: Column, names: tuple[str, ...] = WALK_ARCHIVES) -> Column:
    return extension(path).isin(*names)


def clip(text: Column, width: int) -> Column:
    """At most ``width`` characters, the last an ellipsis if some are left out."""
    return F.when(F.length(text) > width, F.concat(F.left(text, F.lit(width - 1)), F.lit(ELLIPSIS))).otherwise(text)


def hint(text: Column, most: int = 240) -> Column:
    """At most ``most`` bytes, cut between characters, with an ellipsis if some are left out."""
    fits = lambda k: F.octet_length(F.left(text, k)) <= most
    cut = F.array_max(F.filter(F.sequence(F.lit(most // 4), F.lit(most)), fits))
    return F.when(F.octet_length(text) > most, F.concat(F.left(text, cut), F.lit(ELLIPSIS))).otherwise(text)


def wrapped(text: Column, width: int = 76) -> Column:
    """Words in lines of at most ``width`` characters; a longer word has a line of its own."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    tail = lambda acc: F.length(F.substring_index(acc, "\n", -1))
    step = lambda acc, w: F.when(acc == "", w).when(tail(acc) + 1 + F.length(w) <= width, F.concat(acc, F.lit(" "), w)).otherwise(F.concat(acc, F.lit("\n"), w))
    return F.aggregate(words, F.lit(""), step)


def report_stem(name: Column) -> Column:
    """The stem of a report from a name, a file name or a path."""
    last = F.element_at(F.split(name, r"[/\\]"), -1)
    return F.regexp_replace(last, r"\.json$", "")


def relabel(path: Column, root: str) -> Column:
    """A path below ``root`` as a label that starts with its last segment."""
    return F.regexp_replace(path, "^" + re.escape(root.rstrip("/")) + "/", root.rstrip("/").rsplit("/", 1)[-1] + "/")


def safe_report_name(name: Column) -> Column:
    return F.regexp_like(name, F.lit(r"^[A-Za-z0-9_-][A-Za-z0-9._-]{0,119}$"))


def line_of(text: Column, offset: Column) -> Column:
    """Line, from 1, of a character offset."""
    before = F.substring(text, F.lit(1), offset)
    return occurrences(before, "\n") + 1


def glob_regex(pattern: str) -> str:
    """An anchored, case-folded regular expression for a path pattern with ``*``, ``**`` and ``?``."""
    out, i = "", 0
    p = pattern.lower()
    while i < len(p):
        if p.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif p.startswith("/**", i) and i + 3 == len(p):
            out, i = out + "(?:/.*)?", i + 3
        elif p.startswith("**", i):
            out, i = out + ".*", i + 2
        elif p[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif p[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.escape(p[i]), i + 1
    return f"^{out}$"


def excluded(path: Column, patterns: list[str]) -> Column:
    """Whether a pattern matches; patterns are few and compiled on the driver into one expression."""
    return F.regexp_like(F.lower(path), F.lit("|".join(map(glob_regex, patterns)) or "^$a"))
