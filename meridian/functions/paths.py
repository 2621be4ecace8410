"""Paths, folders, names and tags as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that trimming removes, as a class of a regular expression.
BLANK = r"[\s﻿ ]"
BLANKS = " \t\n\x0b\f\r\ufeff\xa0"  #: the same as characters


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, f"^{BLANK}+|{BLANK}+$", "")


def normal_path(c: Column) -> Column:
    """Trimmed, slashes forward, none leading, none doubled; '.' is the empty path.

    Most paths are like that already, which their ends and a search for slashes tell without a regular expression.
    """
    first, last = F.substring(c, 1, 1), F.substring(c, -1, 1)
    odd = F.contains(c, F.lit("\\")) | F.contains(c, F.lit("//")) | F.contains(F.lit("/" + BLANKS), first) | F.contains(F.lit(BLANKS), last) | (c == ".")
    p = F.regexp_replace(F.regexp_replace(F.regexp_replace(trimmed(c), r"\\", "/"), "^/+", ""), "/{2,}", "/")
    return F.when(odd, F.regexp_replace(p, r"^\.\z", "")).otherwise(c)


def normal_prefix(c: Column) -> Column:
    return F.regexp_replace(normal_path(c), "/+$", "")


def normal_prefixes(prefixes: Column) -> Column:
    """A sorted set of prefixes without empty ones."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(prefixes, normal_prefix), lambda p: p != "")))


def excluded(path: Column, prefixes: Sequence[str]) -> Column:
    """The path is one of the prefixes, or lies below it."""
    out = F.lit(False)
    for p in prefixes:
        out = out | (path == p) | path.startswith(p + "/")
    return out


def valid_weight(w: Column) -> Column:
    return (w > 0) & ~F.isnan(w) & (w < float("inf"))


def basename(path: Column, given: Column | None = None) -> Column:
    """The last segment without .md, unless a name that is not blank is given."""
    own = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?i)\.md$", "")
    return own if given is None else F.when(F.coalesce(trimmed(given), F.lit("")) == "", own).otherwise(given)


def top_folder(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 1, F.substring_index(path, "/", 1))


def region_key(path: Column) -> Column:
    """The first two folders, or the only one; null for files outside folders."""
    s = F.filter(F.split(path, "/"), lambda x: x != "")
    return F.when(F.size(s) >= 3, F.concat(s[0], F.lit("/"), s[1])).when(F.size(s) == 2, s[0])


def continental(path: Column, degree: Column) -> Column:
    return (degree > 0) & top_folder(path).isNotNull()


def root_island(path: Column, degree: Column) -> Column:
    return (degree > 0) & top_folder(path).isNull()


def relative_id(path: Column) -> Column:
    """The path without its first segment."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "^[^/]*/", "")).otherwise(path)


def display_name(c: Column) -> Column:
    """Hyphens and underscores as spaces, runs collapsed, first letters in upper case."""
    words = F.split(trimmed(F.regexp_replace(F.regexp_replace(c, "[-_]+", " "), r"\s+", " ")), " ")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 20))), " ")


def clean_tags(tags: Column) -> Column:
    """Tags with one leading #, none empty, the first spelling of each, sorted without case."""
    named = F.filter(F.transform(tags, lambda t: F.regexp_replace(trimmed(t), "^#+", "")), lambda t: t != "")
    hashed = F.transform(named, lambda t: F.concat(F.lit("#"), t))
    first = F.aggregate(hashed, F.array().cast("array<string>"), lambda a, t: F.when(F.exists(a, lambda x: F.lower(x) == F.lower(t)), a).otherwise(F.concat(a, F.array(t))))
    return F.transform(F.array_sort(F.transform(first, lambda t: F.struct(F.lower(t).alias("k"), t.alias("v")))), lambda s: s["v"])


def valid_pin(path: Column) -> Column:
    """The normalised path if it can be pinned, else null: no empty, '.' or '..' segments."""
    p = F.regexp_replace(normal_path(path), "/+$", "")
    return F.when((p != "") & ~F.exists(F.split(p, "/"), lambda s: s.isin("", ".", "..")), p)


def valid_pins(paths: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.transform(paths, valid_pin), lambda p: p.isNotNull())))


def renamed_pin(path: Column, old: str, new: str, folder: bool) -> Column:
    """The pin after a file (exact match) or a folder (prefix of segments) was renamed."""
    out = F.when(path == old, F.lit(new))
    if folder:
        out = out.when(path.startswith(old + "/"), F.concat(F.lit(new), F.substring(path, len(old) + 1, 1 << 20)))
    return out.otherwise(path)
