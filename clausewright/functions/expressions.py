"""Licence expressions: identifiers, rewriting, identification, and the SPDX grammar.

Columns work inside the JVM; the grammar needs a parser, which is plain Python behind one Arrow UDF.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PLACEHOLDERS = ("free-unknown", "generic-cla", "generic-exception", "generic-export-compliance", "generic-tos", "generic-trademark", "other-copyleft", "other-permissive", "public-domain-disclaimer", "see-license", "unknown", "unknown-license-reference", "unknown-spdx", "warranty-disclaimer")
REF_PREFIX = "LicenseRef-scancode-"
UNKNOWN_KEY = "unknown-spdx"
_PIECES = r"[() \t\r\n]|[^() \t\r\n]+"
_OPERATORS = ("AND", "OR", "WITH")
_SEPARATORS = ("(", ")", " ", "\t", "\r", "\n")


def pieces(expression: Column) -> Column:
    """Separators and words of an expression, in order."""
    return F.regexp_extract_all(expression, F.lit(_PIECES), F.lit(0))


def _is_id(piece: Column) -> Column:
    return ~piece.isin(*_SEPARATORS) & ~F.upper(piece).isin(*_OPERATORS)


def expression_ids(expression: Column) -> Column:
    """Distinct identifiers in the order of their first use."""
    return F.array_distinct(F.filter(pieces(F.coalesce(expression, F.lit(""))), _is_id))


def rewrite(expression: Column, replace: Callable[[Column], Column]) -> Column:
    """The expression with each identifier replaced; operators, parentheses and white space stay as they are."""
    return F.array_join(F.transform(pieces(F.coalesce(expression, F.lit(""))), lambda p: F.when(_is_id(p), replace(p)).otherwise(p)), "")


def lookup(mapping: dict[str, str], fallback: Callable[[Column], Column] = lambda p: F.concat(F.lit(REF_PREFIX), F.lower(p))) -> Callable[[Column], Column]:
    """A replacement by a small literal map, with the reference namespace as fallback."""
    keys, values = list(mapping), list(mapping.values())
    table = F.map_from_arrays(F.array(*map(F.lit, keys)), F.array(*map(F.lit, values))) if keys else F.lit(None)
    return lambda p: F.coalesce(F.element_at(table, F.lower(p)) if keys else F.lit(None).cast("string"), fallback(p))


def is_placeholder(identifier: Column) -> Column:
    return F.lower(identifier).isin(*PLACEHOLDERS)


def identification(ids: Column) -> Column:
    """identified, partial or NOASSERTION, from the identifiers of an expression."""
    holds, all_of = F.exists(ids, is_placeholder), F.forall(ids, is_placeholder)
    return F.when(F.size(ids) <= 0, "NOASSERTION").when(all_of, "NOASSERTION").when(holds, "partial").otherwise("identified")


# --- the SPDX grammar


@dataclass
class Leaf:
    text: str


@dataclass
class Pair:
    operator: str
    left: Leaf | Pair
    right: Leaf | Pair


_WORDS = re.compile(r"[()]|[^()\s]+")
_ID = re.compile(r"[A-Za-z0-9.-]+\+?|DocumentRef-[A-Za-z0-9.-]+:LicenseRef-[A-Za-z0-9.-]+")


def parse(text: str) -> Leaf | Pair | None:
    """The tree of an expression, or None if it is malformed. WITH binds before AND, AND before OR; each is left-associative."""
    words = _WORDS.findall(text)
    at = 0

    def peek() -> str:
        return words[at] if at < len(words) else ""

    def operand() -> Leaf | Pair | None:
        nonlocal at
        word = peek()
        if word == "(":
            at += 1
            inner = level(0)
            if inner is None or peek() != ")":
                return None
            at += 1
            return inner
        if not _ID.fullmatch(word) or word.upper() in (*_OPERATORS, "NONE", "NOASSERTION"):
            return None
        at += 1
        return Leaf(word)

    def exception() -> Leaf | Pair | None:
        nonlocal at
        left = operand()
        if left is not None and peek().upper() == "WITH":
            at += 1
            right = operand()
            if not isinstance(left, Leaf) or not isinstance(right, Leaf):
                return None
            return Pair("WITH", left, right)
        return left

    def level(n: int) -> Leaf | Pair | None:
        nonlocal at
        name = ("OR", "AND")[n]
        below = (lambda: level(1)) if n == 0 else exception
        left = below()
        while left is not None and peek().upper() == name:
            at += 1
            right = below()
            left = None if right is None else Pair(name, left, right)
        return left

    tree = level(0)
    return tree if at == len(words) else None


def _leaves(tree: Leaf | Pair) -> Iterator[Leaf]:
    if isinstance(tree, Leaf):
        yield tree
    else:
        yield from _leaves(tree.left)
        yield from _leaves(tree.right)


def render(tree: Leaf | Pair, outer: str = "") -> str:
    """The expression with parentheses only around an operand of another operator."""
    if isinstance(tree, Leaf):
        return tree.text
    inner = f"{render(tree.left, tree.operator)} {tree.operator} {render(tree.right, tree.operator)}"
    return f"({inner})" if outer and outer != tree.operator and tree.operator != "WITH" else inner


def rewritten(text: str, replace: Callable[[str], str]) -> str:
    """A valid expression with each identifier replaced and rendered anew; any other text as it is."""
    tree = parse(text)
    if tree is None:
        return text
    for leaf in _leaves(tree):
        leaf.text = replace(leaf.text)
    return render(tree)


class Resolver:
    """SPDX identifiers to keys, and keys to reported identifiers. Both maps have lower-case keys."""

    def __init__(self, keys: dict[str, str], reporting: dict[str, str]):
        self.keys = {k.lower(): v for k, v in keys.items()}
        self.reporting = {k.lower(): v for k, v in reporting.items()}

    @staticmethod
    def of_rules(keys: dict[str, str], reporting: dict[str, str], expressions: list[str]) -> Resolver:
        """With every identifier of the given rule expressions mapped to itself where no map names it."""
        r = Resolver(keys, reporting)
        for expression in expressions:
            for word in re.findall(r"[^() \t\r\n]+", expression):
                if word.upper() not in _OPERATORS:
                    low = word.lower()
                    r.keys.setdefault(low, low)
                    r.reporting.setdefault(low, REF_PREFIX + low)
        return r

    def resolve(self, identifier: str) -> str | None:
        low = identifier.lower()
        if low in self.keys:
            return self.keys[low]
        bare = low.removeprefix(REF_PREFIX.lower())
        if bare != low and bare in self.keys:
            return self.keys[bare]
        return UNKNOWN_KEY if low.startswith(("licenseref-", "documentref-")) else None

    def report(self, key: str) -> str:
        return self.reporting.get(key.lower(), REF_PREFIX + key.lower())

    def normalize(self, text: str) -> tuple[str, list[str], list[str]]:
        """(expression, reported identifiers, keys); all empty if it is malformed or an identifier is unknown."""
        tree = parse(text)
        if tree is None:
            return "", [], []
        ids: list[str] = []
        keys: list[str] = []
        for leaf in _leaves(tree):
            key = self.resolve(leaf.text)
            if key is None:
                return "", [], []
            leaf.text = self.report(key)
            keys += [key] if key not in keys else []
            ids += [leaf.text] if leaf.text not in ids else []
        return render(tree), ids, keys

    #: Names that declared licences often carry instead of an identifier.
    ALIASES = {"mit license": "mit", "the mit license": "mit", "apache license 2.0": "apache-2.0", "apache license, version 2.0": "apache-2.0", "apache 2.0": "apache-2.0", "bsd 3-clause": "bsd-3-clause", "new bsd license": "bsd-3-clause", "isc license": "isc", "gplv3": "gpl-3.0-only", "gplv2": "gpl-2.0-only", "mpl 2.0": "mpl-2.0"}

    def lax(self, text: str) -> str:
        """Like normalize, after each OR-separated name that is an alias has become its identifier; unknown gives ''."""
        names = [self.ALIASES.get(part.strip().lower(), part.strip()) for part in re.split(r"\s+OR\s+", text)]
        return self.normalize(" OR ".join(names))[0]


def identify(keys: list[str]) -> str:
    """identification() for plain Python lists."""
    holds = [k.lower() in PLACEHOLDERS for k in keys]
    return "NOASSERTION" if not keys or all(holds) else "partial" if any(holds) else "identified"


def normalize(df: DataFrame, column: str, resolver: Resolver, lax: bool = False) -> DataFrame:
    """``df`` with struct ``normalized`` (expression, license_ids, keys) of the column; empty where it is no valid expression."""
    shared = df.sparkSession.sparkContext.broadcast(resolver)

    @F.pandas_udf("expression string, license_ids array<string>, keys array<string>")
    def run(values: pd.Series) -> pd.DataFrame:
        r = shared.value
        rows = [(r.lax(v), [], []) if lax else r.normalize(v) for v in values.fillna("")]
        return pd.DataFrame(rows, columns=["expression", "license_ids", "keys"])

    return df.withColumn("normalized", run(F.col(column).cast("string")))
