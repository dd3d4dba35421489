"""Comparison of found expressions with expected ones, and of one run with another."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausewright.functions import expressions, policy
from clausewright.operators.filters import Options, kept_by

TOP = 20


def clean(expressions: Column) -> Column:
    """Sorted distinct expressions without the empty one."""
    return F.array_sort(F.array_distinct(F.filter(F.coalesce(expressions, F.array().cast("array<string>")), lambda x: x != "")))


def stage(expected: Column, actual: Column, exact_expected: Column) -> Column:
    """Where a case went wrong, or 'passed'. exact_expected: the expected expressions that matched before filtering."""
    missing, extra = F.array_except(expected, actual), F.array_except(actual, expected)
    lost = F.array_intersect(missing, exact_expected)
    return (
        F.when((F.size(missing) == 0) & (F.size(extra) == 0), "passed")
        .when((F.size(missing) > 0) & (F.size(lost) == F.size(missing)), "filter-suppressed")
        .when(F.size(lost) > 0, "mixed")
        .when(F.size(actual) == 0, "no-exact-match")
        .when((F.size(missing) > 0) & (F.size(extra) > 0), "wrong-exact-rule-set")
        .when(F.size(missing) > 0, "partial-exact-rule-set")
        .otherwise("filter-retained")
    )


def outcomes(cases: DataFrame) -> DataFrame:
    """Cases (path, expected, actual, exact_expected, skipped) with their stage; null for a skipped one."""
    rows = cases.select(*[c for c in ("profile",) if c in cases.columns], "path", "skipped", *[clean(F.col(c)).alias(c) for c in ("expected", "actual", "exact_expected")])
    return rows.withColumn("stage", F.when(~F.col("skipped"), stage(F.col("expected"), F.col("actual"), F.col("exact_expected"))))


def rate(found: DataFrame) -> DataFrame:
    """cases, evaluated, passed, skipped and percent passed, of outcomes()."""
    out = found.agg(F.count("*").alias("cases"), F.count("stage").alias("evaluated"), F.count_if(F.col("stage") == "passed").alias("passed"), F.count_if(F.col("skipped")).alias("skipped"))
    return out.withColumn("percent", F.when(F.col("evaluated") > 0, F.round(100 * F.col("passed") / F.col("evaluated"), 2)).otherwise(0.0))


#: Filter configurations that are compared, from none to all.
PROFILES = {"raw": Options(False, False, False), "contained": Options(True, False, False), "overlapping": Options(True, True, False), "false positives": Options()}


def profiles(found: DataFrame, rules: DataFrame, expected: DataFrame) -> DataFrame:
    """profile, path, expected, actual, exact_expected and skipped of each document under each filter configuration. ``found``:
    match.hits, which is read once for all of them; ``expected``: doc_id, expected. An expression is exact_expected if it is expected
    and a candidate has it."""
    facts = F.broadcast(rules.select("rule_index", F.col("reported_expression").alias("expression")).where("expression <> ''"))
    kept = kept_by(found, rules, list(PROFILES.values())).join(facts, "rule_index")
    sets = [F.collect_set(F.when(F.col("kept").bitwiseAND(F.lit(1 << k)) != 0, F.col("expression"))).alias(f"actual_{k}") for k in range(len(PROFILES))]
    cases = expected.select("doc_id", "expected").join(kept.groupBy("doc_id").agg(*sets), "doc_id", "left")
    actual = [F.coalesce(f"actual_{k}", F.array().cast("array<string>")) for k in range(len(PROFILES))]
    exact = F.array_intersect("expected", actual[list(PROFILES).index("raw")])
    named = F.inline(F.array(*[F.struct(F.lit(name).alias("profile"), a.alias("actual")) for name, a in zip(PROFILES, actual, strict=True)]))
    rows = cases.select(F.col("doc_id").cast("string").alias("path"), "expected", exact.alias("exact_expected"), named)
    return rows.select("profile", "path", "expected", "actual", "exact_expected", F.lit(False).alias("skipped"))


def profile(found: DataFrame) -> DataFrame:
    """Cases by filter configuration and stage, with totals. found: outcomes() with a column ``profile``."""
    return found.rollup("profile", "stage").agg(F.count("*").alias("cases"), F.grouping_id().alias("level"))


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change) of the cases whose result differs between two runs: regression, improvement, stage, added or removed."""
    a = before.select("path", F.col("stage").alias("was"), F.lit(True).alias("in_before"))
    b = after.select("path", F.col("stage").alias("now"), F.lit(True).alias("in_after"))
    joined = a.join(b, "path", "full_outer")
    change = F.when(F.col("in_before").isNull(), "added").when(F.col("in_after").isNull(), "removed").when(F.col("was").eqNullSafe(F.col("now")), None)
    change = change.when(F.col("was") == "passed", "regression").when(F.col("now") == "passed", "improvement").otherwise("stage")
    return joined.withColumn("change", change).where("change IS NOT NULL").select("path", "was", "now", "change")


def compare_tools(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """path, both tools' sorted distinct expressions and whether they agree. Inputs: path, expression."""
    a = ours.groupBy("path").agg(F.sort_array(F.collect_set("expression")).alias("ours"))
    b = theirs.groupBy("path").agg(F.sort_array(F.collect_set("expression")).alias("theirs"))
    empty = F.array().cast("array<string>")
    joined = a.join(b, "path", "full_outer").select("path", F.coalesce("ours", empty).alias("ours"), F.coalesce("theirs", empty).alias("theirs"))
    return joined.withColumn("agree", F.col("ours") == F.col("theirs"))


def problems(before: DataFrame, after: DataFrame, limit: int = TOP) -> DataFrame:
    """The first problems of a run against an earlier one, in order, and a last row if there are more: divergences that are new, or
    whose stage, expected, actual or exact expressions changed, a fallen number of passes and another number of cases."""
    counts = lambda f: f.agg(F.count("*").alias("cases"), F.count("stage").alias("evaluated"), F.count_if(F.col("stage") == "passed").alias("passed"))
    a, b = counts(before).alias("a"), counts(after).alias("b")
    both = a.join(F.broadcast(b))  # one row each
    text = F.array_compact(F.array(
        F.when((F.col("a.cases") != F.col("b.cases")) | (F.col("a.evaluated") != F.col("b.evaluated")), F.format_string("suite size changed from %d/%d to %d/%d", "a.cases", "a.evaluated", "b.cases", "b.evaluated")),
        F.when(F.col("b.passed") < F.col("a.passed"), F.format_string("pass count fell from %d to %d", "a.passed", "b.passed")),
    ))
    totals = both.select(F.explode(text).alias("problem"))
    columns = ["path", "stage", "expected", "actual", "exact_expected"]
    wrong = lambda f, n: f.where("stage <> 'passed'").select(*[F.col(c).alias(f"{n}_{c}") for c in columns])
    joined = wrong(after, "now").join(wrong(before, "was"), F.col("now_path") == F.col("was_path"), "left")
    changed = F.lit(False)
    for c in columns[1:]:
        changed = changed | ~F.col(f"now_{c}").eqNullSafe(F.col(f"was_{c}"))
    named = joined.select(F.when(F.col("was_path").isNull(), F.concat(F.lit("new divergence: "), "now_path")).when(changed, F.concat(F.lit("changed divergence: "), "now_path")).alias("problem")).where("problem IS NOT NULL")
    return top(totals.unionByName(named), "problem", limit, "more problems are left out")


def top(rows: DataFrame, column: str, limit: int = TOP, more: str = "...") -> DataFrame:
    """(place, ``column``): the first values in order, and ``more`` after them if some are left out."""
    first = rows.select(column).orderBy(column).limit(limit + 1)
    ranked = first.withColumn("place", F.row_number().over(Window.orderBy(column)))  # limit + 1 rows
    return ranked.select(F.col("place").cast("long").alias("place"), F.when(F.col("place") <= limit, F.col(column)).otherwise(more).alias(column))


def sample_text(values: Column, limit: int = TOP) -> Column:
    """The first values of a list in one text, and how many there are where some are left out."""
    text = F.array_join(F.slice(values, 1, limit), ", ")
    return F.when(F.size(values) == 0, "(none)").when(F.size(values) <= limit, text).otherwise(F.concat(text, F.lit(" ... ("), F.size(values).cast("string"), F.lit(" total)")))


def is_comparison_file(path: Column) -> Column:
    """Files at the root of a project that another tool looks at as well: legal files and readmes."""
    plain = F.regexp_replace(path, r"^\./", "")
    return ~plain.contains("/") & ((F.size(policy.legal_roles(path)) > 0) | policy.is_readme(plain))


def rule_expression(expression: Column, keys: dict[str, str]) -> Column:
    """A reported expression in the identifiers of the rules. ``keys``: SPDX identifiers, lower-case, to keys."""
    table = expressions.lookup(keys, fallback=lambda p: p)

    def resolve(p: Column) -> Column:
        low, bare = F.lower(p), F.regexp_replace(F.lower(p), f"^{expressions.REF_PREFIX.lower()}", "")
        none = F.lit(expressions.UNKNOWN_KEY)  # LicenseRef, DocumentRef and what no map names
        known = lambda x: x.isin(*keys)
        return F.when(known(low), table(low)).when((bare != low) & known(bare), table(bare)).otherwise(none)

    return expressions.rewrite(expression, resolve)


def comparison_expression(df: DataFrame, column: str, keys: dict[str, str]) -> DataFrame:
    """``df`` with ``comparable``: another tool's expression in the keys of the rules; as it is where it is malformed."""
    resolver = {k.lower(): v for k, v in keys.items()}

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: v if not isinstance(v, str) else expressions.rewritten(v, lambda i: resolver.get(i.lower(), i)))

    return df.withColumn("comparable", run(F.col(column).cast("string")))
