"""The rule table: built-in rules, flags and kinds, validation, and what matching needs of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clausewright.functions.expressions import expression_ids, identification, lookup, rewrite
from clausewright.functions.tokens import tokens

TEXT, NOTICE, TAG, REFERENCE, INTRO, CLUE, FALSE_POSITIVE, REQUIRED_PHRASE, CONTINUOUS, DEPRECATED = (1 << k for k in range(1, 11))
KINDS = {TEXT: "text", NOTICE: "notice", TAG: "tag", REFERENCE: "reference", INTRO: "intro", CLUE: "clue"}
KIND_MASK = sum(KINDS)
MAX_RULES, MAX_WORDS = 100_000, 1_000_000

#: (rule_id, expression, text, flags, relevance); our own wording of names, notices and references.
BUILTIN: list[tuple[str, str, str, int, int]] = [
    ("all-rights-reserved.RULE", "proprietary-license", "all rights reserved", CLUE, 60),
    ("apache-2.0_name.RULE", "apache-2.0", "Apache License, Version 2.0", REFERENCE, 100),
    ("apache-2.0_notice.RULE", "apache-2.0", "Licensed under the Apache License, Version 2.0", NOTICE, 100),
    ("apache_name.RULE", "apache-2.0", "Apache License", REFERENCE, 80),
    ("apache_under.RULE", "apache-2.0", "the Apache License, Version", REFERENCE, 70),
    ("by-nc.RULE", "cc-by-nc-4.0", "BY-NC 4.0", REFERENCE, 90),
    ("cc-by-nc_notice.RULE", "cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", NOTICE, 100),
    ("general-public.RULE", "gpl-1.0-plus", "General Public License", REFERENCE, 70),
    ("gpl-3.0_notice.RULE", "gpl-3.0", "work is licensed under the GNU General Public License, version 3", NOTICE, 100),
    ("gpl-3.0_ref.RULE", "gpl-3.0", "Public License, version 3", REFERENCE, 90),
    ("gpl_any.RULE", "gpl-1.0-plus OR other-copyleft", "GNU General Public", REFERENCE, 50),
    ("licensed-under.RULE", "unknown-license-reference", "is licensed under the", INTRO, 50),
    ("mit_name.RULE", "mit", "MIT License", REFERENCE, 100),
    ("mit_notice.RULE", "mit", "Released under the MIT", NOTICE, 95),
    ("of-the-version.RULE", "", "License, Version 2", FALSE_POSITIVE, 0),
    ("public-domain.RULE", "public-domain", "dedicated to the public domain", NOTICE, 100),
    ("released-under.RULE", "see-license", "under the MIT License", REFERENCE, 60),
    ("this-work.RULE", "", "this work", FALSE_POSITIVE, 0),
]
REPORTING: dict[str, str] = {"apache-2.0": "Apache-2.0", "cc-by-nc-4.0": "CC-BY-NC-4.0", "gpl-1.0-plus": "GPL-1.0-or-later", "gpl-2.0": "GPL-2.0-only", "gpl-2.0-plus": "GPL-2.0-or-later", "gpl-3.0": "GPL-3.0-only", "mit": "MIT", "isc": "ISC", "bsd-new": "BSD-3-Clause", "classpath-exception-2.0": "Classpath-exception-2.0"}
SPDX_KEYS: dict[str, str] = {"apache-2.0": "apache-2.0", "cc-by-nc-4.0": "cc-by-nc-4.0", "gpl-1.0+": "gpl-1.0-plus", "gpl-1.0-or-later": "gpl-1.0-plus", "gpl-2.0": "gpl-2.0", "gpl-2.0-only": "gpl-2.0", "gpl-2.0+": "gpl-2.0-plus", "gpl-2.0-or-later": "gpl-2.0-plus", "gpl-3.0": "gpl-3.0", "gpl-3.0-only": "gpl-3.0", "mit": "mit", "isc": "isc", "bsd-3-clause": "bsd-new", "bsd-new": "bsd-new", "classpath-exception-2.0": "classpath-exception-2.0"}


def has(flag: int, flags: str | Column = "flags") -> Column:
    column = F.col(flags) if isinstance(flags, str) else flags
    return column.bitwiseAND(F.lit(flag)) != 0


def kind(flags: str | Column = "flags") -> Column:
    """The category, if exactly one category bit is set."""
    column = F.col(flags) if isinstance(flags, str) else flags
    out = F.lit(None).cast("string")
    for bit, name in KINDS.items():
        out = F.when(column.bitwiseAND(F.lit(KIND_MASK)) == bit, name).otherwise(out)
    return F.coalesce(out, F.lit("unknown"))


def prepare(raw: DataFrame, reporting: dict[str, str] | None = None) -> DataFrame:
    """Rules ready to match from (rule_id, expression, text, flags, relevance). rule_index is the rank of rule_id in byte order."""
    rows = raw.withColumn("tokens", tokens(F.col("text"))).withColumn("n_tokens", F.size("tokens"))
    rows = rows.withColumn("rule_index", F.row_number().over(Window.orderBy("rule_id")) - 1)  # a dictionary is small
    ids = expression_ids(F.col("expression"))
    to_reported = lookup(REPORTING if reporting is None else {k.lower(): v for k, v in reporting.items()})
    rows = rows.withColumn("reported_expression", rewrite(F.col("expression"), to_reported)).withColumn("identification", identification(ids))
    rows = rows.withColumn("license_ids", expression_ids(F.col("reported_expression"))).withColumn("kind", kind())
    return rows.select("rule_index", "rule_id", "expression", "reported_expression", "license_ids", "identification", "tokens", "n_tokens", "flags", "kind", "relevance")


_built: dict[str, DataFrame] = {}


def builtin(spark: SparkSession) -> DataFrame:
    """The built-in rules, prepared once a session."""
    key = spark.sparkContext.applicationId
    if key not in _built:
        prepared = prepare(spark.createDataFrame(BUILTIN, "rule_id string, expression string, text string, flags int, relevance int"))
        _built.clear()
        _built[key] = spark.createDataFrame(prepared.collect(), prepared.schema)
    return _built[key]


def violations(rules: DataFrame, vocabulary_size: int | None = None) -> DataFrame:
    """(rule_id, problem) of a rule table that is not fit for matching; empty if it is fine."""
    repeated = rules.groupBy("rule_id").count().where("count > 1").select("rule_id", F.lit("duplicate rule id").alias("problem"))
    checks = [(F.col("rule_id").isNull() | (F.col("rule_id") == ""), "no rule id"), (~has(FALSE_POSITIVE) & (F.coalesce("expression", F.lit("")) == ""), "no expression"), (F.col("n_tokens") == 0, "no tokens"), (~F.col("relevance").between(0, 100), "relevance out of range"), (F.col("rule_index") >= MAX_RULES, "too many rules"), (F.col("rule_index") != F.col("__order"), "not in the order of rule ids")]
    rules = rules.withColumn("__order", F.row_number().over(Window.orderBy("rule_id")) - 1)  # a dictionary is small
    out = repeated
    for condition, problem in checks:
        out = out.unionByName(rules.where(condition).select("rule_id", F.lit(problem).alias("problem")))
    if vocabulary_size is not None and vocabulary_size > MAX_WORDS:
        out = out.unionByName(rules.limit(1).select(F.lit(None).cast("string").alias("rule_id"), F.lit("too many words").alias("problem")))
    return out
