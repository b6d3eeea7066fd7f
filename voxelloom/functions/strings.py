"""Path and pattern functions as Spark columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_regex(glob: str) -> str:
    """A regular expression for a whole name, of a pattern with *, ? and [sets]."""
    out, at = "", 0
    while at < len(glob):
        c = glob[at]
        close = glob.find("]", at + 2) if c == "[" else -1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif close > 0:
            inner = glob[at + 1 : close].replace("\\", "\\\\")
            out += "[" + ("^" + inner[1:] if inner[0] == "!" else inner) + "]"
            at = close
        else:
            out += re.escape(c)
        at += 1
    return f"(?s)^{out}$"


def basename(path: Column) -> Column:
    return F.substring_index(F.replace(path, F.lit("\\"), F.lit("/")), "/", -1)


def parent(path: Column) -> Column:
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "/?[^/]*$", "")


def suffix_of(name: Column, pattern: str) -> Column:
    """What tells a file from others of a pattern with one *: the part at the star and after. The whole name if it
    doesn't fit or the pattern has no star or several."""
    before, star, after = pattern.partition("*")
    if not star or "*" in after:
        return name
    if not before:
        return F.when(name.endswith(after), F.lit(after) if after else name).otherwise(name)
    fits = name.startswith(before) & name.endswith(after) & (F.length(name) >= len(before) + len(after))
    return F.when(fits, F.substring(name, len(before) + 1, 1 << 30)).otherwise(name)


def characters(path: Column) -> Column:
    """The set of a path's characters."""
    return F.array_remove(F.array_distinct(F.split(path, "")), "")


def shared_characters(x: Column, y: Column) -> Column:
    """Shared share of two sets; 1 if both are empty."""
    common = F.size(F.array_intersect(x, y))
    union = F.size(x) + F.size(y) - common
    return F.when(union == 0, F.lit(1.0)).otherwise(common / union)


def path_similarity(a: Column, b: Column) -> Column:
    """Shared share of the two paths' sets of characters; 1 if both are empty."""
    return shared_characters(characters(a), characters(b))
