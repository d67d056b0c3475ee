"""Namespaces: lower-case segments joined by slashes, 16 deep at most."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SEGMENT = r"[a-z0-9][a-z0-9_-]*"
MAX_DEPTH = 16
PATTERN = rf"^{SEGMENT}(/{SEGMENT}){{0,{MAX_DEPTH - 1}}}$"


def normalise(ns: str) -> str:
    """The namespace without outer white space and slashes; an error if it is none."""
    out = ns.strip().strip("/")
    if not re.fullmatch(PATTERN[1:-1], out):
        raise ValueError(f"not a namespace: {ns!r}")
    return out


def is_valid(ns: Column) -> Column:
    return F.regexp_replace(F.trim(ns), "^/+|/+$", "").rlike(PATTERN)


def parent(ns: Column) -> Column:
    """Null at the top."""
    return F.when(F.instr(ns, "/") > 0, F.regexp_extract(ns, r"^(.*)/[^/]*$", 1))


def is_within(ns: Column, ancestor: Column) -> Column:
    return (ns == ancestor) | F.startswith(ns, F.concat(ancestor, F.lit("/")))
