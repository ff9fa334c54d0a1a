"""Scalar helpers: globs, path parts, tokens, versions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_to_regex(glob: str) -> str:
    """fnmatch pattern (``*``, ``?``, ``[seq]``, ``[!seq]``) as an anchored Java regex."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and "]" in glob[i + 2 :]:
            j = glob.index("]", i + 2)
            body = glob[i + 1 : j].replace("\\", "\\\\")
            out.append("[" + ("^" + body[1:] if body[0] == "!" else body) + "]")
            i = j
        else:
            out.append(re.escape(c))
        i += 1
    return "(?s)^" + "".join(out) + "$"


def glob_column(pattern: Column) -> Column:
    """A column of ``*``/``?`` globs as anchored regexes."""
    quoted = F.regexp_replace(pattern, r"([.\\+^$(){}|\[\]])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(F.replace(quoted, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit("$"))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def ancestors(path: Column) -> Column:
    """Every directory above a path, outermost first: a/b/c.py -> [a, a/b]."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).otherwise(
        F.expr("cast(array() as array<string>)")
    )


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def camel_tokens(text: Column) -> Column:
    """Lower-cased parts of camelCase, snake_case and digits, with a plural s taken off longer words."""
    parts = F.regexp_extract_all(text, F.lit("[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+"), F.lit(0))
    singular = lambda w: F.when(F.endswith(w, F.lit("s")) & (F.length(w) > 3), F.substr(w, F.lit(1), F.length(w) - 1)).otherwise(w)
    return F.transform(F.transform(parts, F.lower), singular)


def version_key(version: Column) -> Column:
    """Numeric prefix parts of a version: v1.20.3-rc -> [1, 20, 3]."""
    head = F.regexp_extract(version, r"^v?([0-9]+(?:\.[0-9]+)*)", 1)
    return F.when(head != "", F.transform(F.split(head, "[.]"), lambda p: p.cast("int")))


def version_at_most(a: Column, b: Column) -> Column:
    """a <= b over padded numeric parts; null where either has none."""
    ka, kb = version_key(a), version_key(b)
    n = F.greatest(F.size(ka), F.size(kb))
    pad = lambda k: F.transform(F.sequence(F.lit(1), n), lambda i: F.coalesce(F.try_element_at(k, i), F.lit(0)))
    return F.when(ka.isNotNull() & kb.isNotNull(), pad(ka) <= pad(kb))


def confidence_rank(c: Column) -> Column:
    """exact > resolved > derived > recovered; anything else ranks below all."""
    return F.when(c == "exact", 3).when(c == "resolved", 2).when(c == "derived", 1).when(c == "recovered", 0).otherwise(-1)


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 4)
