"""What a path says about a file, and whether a match crosses a boundary between blocks of a text."""

from __future__ import annotations

import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

LEGAL_NAME = r"^(licen[cs]es?|copying|mit-license|copyright|unlicense)([._-].*)?$"
NOTICE_NAME = r"^notices?([._-].*)?$"
LEGAL_DIRECTORIES = tuple(f"licen{c}e{s}" for c in "cs" for s in ("", "s"))
PROJECT_SKIPS = ("vendor", "node_modules", "__pycache__", ".bundle", ".venv", "venv", "target", "build", "dist", "out", "_build", "deps", "Pods", "third_party", "thirdparty", "external", "testdata", "tmp", "temp", "cache", "coverage")
LEADERS = ("//", "--", "#", "*", ";", "%")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def directories(path: Column) -> Column:
    """The names of the directories above a file."""
    parts = F.split(path, "/")
    return F.slice(parts, 1, F.size(parts) - 1)


def depth(path: Column) -> Column:
    return F.when(path == ".", 0).otherwise(F.size(F.split(path, "/")))


def legal_roles(path: Column) -> Column:
    """['license'], ['notice'], both or neither."""
    name = F.lower(base_name(path))
    licence = F.exists(directories(path), lambda d: F.lower(d).isin(*LEGAL_DIRECTORIES)) | name.rlike(LEGAL_NAME)
    return F.array_compact(F.array(F.when(licence, "license"), F.when(name.rlike(NOTICE_NAME), "notice")))


def is_readme(path: Column) -> Column:
    return F.lower(base_name(path)).rlike(r"^readme(\..*)?$")


def is_root_expression_file(path: Column) -> Column:
    return (depth(path) == 1) & ((F.size(legal_roles(path)) > 0) | is_readme(path))


def uses_document_markers(path: Column) -> Column:
    return F.lower(base_name(path)).rlike(r"^readme$|\.(md|markdown|mdown|mdx|mkd)$")


def skip_reason(name: Column, configured: Iterable[str] = (), everything: bool = False) -> Column:
    """Why a directory of this name is not entered, or null."""
    reason = F.when(name == ".git", "version-control").when(name.isin(*configured), "configured-directory")
    if not everything:
        reason = reason.when(name.startswith("."), "hidden-directory").when(name.isin(*PROJECT_SKIPS), "project-scope")
    return reason


# --- block boundaries


_HEADING = re.compile(rb"[#=]")
_LIST_ITEM = re.compile(rb"(?:[-*+>]|[0-9]+[.)])[ \t]")


def _strip_leader(line: bytes, leader: bytes) -> bytes | None:
    if not line.startswith(leader):
        return None
    while line.startswith(leader):
        line = line[len(leader) :]
    return line.strip()


def _document_boundary(left: bytes, right: bytes) -> bool:
    table = any(line.startswith(b"|") or line.endswith(b"|") for line in (left, right))
    return bool(table or _HEADING.match(left) or _HEADING.match(right) or _LIST_ITEM.match(right))


def crosses(data: bytes, start: int, end: int, markers: bool) -> bool:
    """Whether data[start:end] runs over an empty line, or in a marked-up document over a heading, table or list item."""
    if start < 0 or start >= end or end > len(data):
        return False
    at = data.find(b"\n", start, end)
    while at >= 0:
        right_end = data.find(b"\n", at + 1)
        left = data[data.rfind(b"\n", 0, at) + 1 : at].strip()
        right = data[at + 1 : right_end if right_end >= 0 else len(data)].strip()
        bare = (left, right)
        for leader in LEADERS:
            both = _strip_leader(left, leader.encode()), _strip_leader(right, leader.encode())
            if None not in both:
                bare = both
                break
        if not bare[0] or not bare[1] or (markers and _document_boundary(left, right)):
            return True
        at = data.find(b"\n", at + 1, end)
    return False


def crosses_block_boundary(text: Column, start: Column, end: Column, markers: Column) -> Column:
    @F.pandas_udf("boolean")
    def run(texts: pd.Series, starts: pd.Series, ends: pd.Series, marks: pd.Series) -> pd.Series:
        rows = zip(texts, starts, ends, marks, strict=True)
        return pd.Series([crosses(t.encode() if isinstance(t, str) else bytes(t or b""), int(s), int(e), bool(m)) for t, s, e, m in rows])

    return run(text, start.cast("long"), end.cast("long"), markers)
