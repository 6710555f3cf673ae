"""Header resolution: which input column stands for which canonical column."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class AmbiguousHeader(ValueError):
    """Two input headers stand for the same canonical column."""


def header_key(name: str) -> str:
    """Lower-case letters and digits of a header."""
    return re.sub("[^a-z0-9]", "", name.strip().lower())


def resolve(columns: list[str], candidates: list[str]) -> str | None:
    """First candidate present as written, else the first present after normalisation."""
    exact = next((name for name in candidates if name in columns), None)
    if exact is not None:
        if sum(name.lower() == exact.lower() for name in columns) > 1:
            raise AmbiguousHeader(f"headers differ from {exact!r} only in case; rename one column")
        return exact
    for candidate in candidates:
        found = [name for name in columns if header_key(name) == header_key(candidate)]
        if len(found) > 1:
            raise AmbiguousHeader(f"headers {found!r} all match {candidate!r}; rename one column")
        if found:
            return found[0]
    return None


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def pick(df: DataFrame, candidates: list[str], default: str | None = None) -> tuple[Column, T.DataType]:
    """(column, its type) for the first matching header, or the default as text."""
    name = resolve(df.columns, candidates)
    if name is None:
        return F.lit(default).cast("string"), T.StringType()
    return quoted(name), df.schema[name].dataType
