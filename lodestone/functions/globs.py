"""Glob selection: patterns become one anchored regular expression at plan time."""

from __future__ import annotations

import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def regex(glob: str) -> str:
    """``*`` and ``?`` also match slashes; ``**/`` is any number of directories; [] and {} work as usual."""
    out, i, depth = [], 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i) and (i == 0 or glob[i - 1] == "/"):
            out.append("(?:.*/)?")
            i += 3
            continue
        if c == "*":
            while i + 1 < len(glob) and glob[i + 1] == "*":
                i += 1
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[":
            end = glob.find("]", i + 2)
            if end < 0:
                raise ValueError(f"unclosed [ in {glob!r}")
            body = glob[i + 1 : end].replace("\\", "\\\\")
            out.append("[" + ("^" + body[1:] if body[0] in "!^" else body) + "]")
            i = end
        elif c == "{":
            depth += 1
            out.append("(?:")
        elif c == "}" and depth:
            depth -= 1
            out.append(")")
        elif c == "," and depth:
            out.append("|")
        elif c == "\\" and i + 1 < len(glob):
            i += 1
            out.append(re.escape(glob[i]))
        else:
            out.append(re.escape(c))
        i += 1
    if depth:
        raise ValueError(f"unclosed {{ in {glob!r}")
    return r"\A(?s:" + "".join(out) + r")\z"


def regexes(glob: Column) -> Column:
    """The regular expression of each row's glob; each distinct one is made once a batch."""

    @F.pandas_udf(T.StringType())
    def made(globs: pd.Series) -> pd.Series:
        return globs.map({g: regex(g) for g in globs.dropna().unique()})

    return made(glob)


def any_of(column: Column, globs: Iterable[str]) -> Column:
    patterns = [regex(g) for g in globs]
    return column.rlike("|".join(patterns)) if patterns else F.lit(False)


def selected(column: Column | str, include: Iterable[str] = (), exclude: Iterable[str] = ()) -> Column:
    """True if include is empty or matches, and no exclude matches."""
    c = F.col(column) if isinstance(column, str) else column
    include = list(include)
    return (any_of(c, include) if include else F.lit(True)) & ~any_of(c, exclude)
