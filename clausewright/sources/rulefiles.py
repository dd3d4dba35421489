"""Rule tables from files with front matter, and as Parquet."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewright.functions.expressions import REF_PREFIX
from clausewright.operators import rules

RAW = "rule_id string, expression string, text string, flags int, relevance int"
FLAGS = {"is_license_text": 2, "is_license_notice": 4, "is_license_tag": 8, "is_license_reference": 16, "is_license_intro": 32, "is_license_clue": 64, "is_false_positive": 128, "is_required_phrase": 256, "is_continuous": 512, "is_deprecated": 1024}


def split_front_matter(source: str) -> tuple[dict[str, str], str]:
    """(keys, body) of a file that begins with a block between lines of three dashes."""
    lines = source.removeprefix("﻿").splitlines(keepends=True)
    at = 0
    while at < len(lines) and not lines[at].strip():
        at += 1
    if at == len(lines) or lines[at].strip() != "---":
        raise ValueError("the front matter has no opening line")
    close = next((k for k in range(at + 1, len(lines)) if lines[k].strip() == "---"), None)
    if close is None:
        raise ValueError("the front matter has no closing line")
    keys: dict[str, str] = {}
    last = ""
    for line in lines[at + 1 : close]:
        m = re.match(r"([A-Za-z_]+):\s*(.*?)\s*$", line)
        item = re.match(r"\s*-\s+(.*?)\s*$", line)
        if m:
            last = m[1]
            keys[last] = m[2].strip("'\"")
        elif item and last:  # an item of a list; the items of a key are lines of its value
            keys[last] = "\n".join(x for x in (keys[last], item[1].strip("'\"")) if x)
    return keys, "".join(lines[close + 1 :])


def parse_rule(name: str, source: str) -> tuple[str, str, str, int, int]:
    """(rule_id, expression, text, flags, relevance). The expression of a .LICENSE file is its key, and it is a text."""
    keys, body = split_front_matter(source)
    flags = sum(bit for key, bit in FLAGS.items() if keys.get(key, "").lower() in ("yes", "true", "on"))
    expression = keys.get("license_expression", "")
    if name.endswith(".LICENSE"):
        expression, flags = keys.get("key", ""), flags | FLAGS["is_license_text"]
    relevance = int(keys.get("relevance") or 100)
    if not 0 <= relevance <= 100:
        raise ValueError(f"{name}: relevance {relevance} is not between 0 and 100")
    if not expression and not flags & FLAGS["is_false_positive"]:
        raise ValueError(f"{name}: no licence expression")
    return name, expression, body.strip(), flags, relevance


def load_directory(spark: SparkSession, folder: str, extensions: tuple[str, ...] = (".RULE", ".LICENSE")) -> DataFrame:
    """The raw rules of a folder, ready for ``rules.prepare``. A dictionary is small: it is read on the driver."""
    rows = []
    for name in sorted(os.listdir(folder)):
        if name.endswith(extensions):
            with open(os.path.join(folder, name), encoding="utf-8") as f:
                rows.append(parse_rule(name, f.read()))
    return spark.createDataFrame(rows, RAW)


def metadata(folder: str) -> list[tuple[str, str, str, list[str]]]:
    """(file, key, SPDX key, other SPDX keys) of the .LICENSE files of a folder, by name."""
    rows = []
    for name in sorted(os.listdir(folder)):
        if name.endswith(".LICENSE"):
            with open(os.path.join(folder, name), encoding="utf-8") as f:
                keys, _ = split_front_matter(f.read())
            if not keys.get("key"):
                raise ValueError(f"{name}: no key")
            rows.append((name, keys["key"], keys.get("spdx_license_key", ""), [x for x in keys.get("other_spdx_license_keys", "").split("\n") if x]))
    return rows


def mappings(metas: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From (file, key, spdx_key, others): (spdx_lower, key) and (key_lower, reporting_id). Where several licences claim an identifier,
    its own key goes before a primary SPDX key and that before another one; among equals the first file."""
    reported = F.when(F.coalesce("spdx_key", F.lit("")) != "", F.col("spdx_key")).otherwise(F.concat(F.lit(REF_PREFIX), "key"))
    claims = F.concat(F.array(F.struct(F.lit(0).alias("rank"), F.lit(0).alias("place"), F.col("key").alias("spdx")), F.struct(F.lit(1).alias("rank"), F.lit(0).alias("place"), reported.alias("spdx"))), F.transform(F.coalesce("others", F.array().cast("array<string>")), lambda o, i: F.struct(F.lit(2).alias("rank"), i.alias("place"), o.alias("spdx"))))
    rows = metas.select("file", "key", F.inline(claims)).where("spdx <> ''")
    keys = rows.groupBy(F.lower("spdx").alias("spdx_lower")).agg(F.min_by("key", F.struct("rank", "file", "place")).alias("key"))
    return keys, metas.groupBy(F.lower("key").alias("key_lower")).agg(F.max_by(reported, "file").alias("reporting_id"))


def load_mappings(folder: str) -> tuple[dict[str, str], dict[str, str]]:
    """SPDX identifiers to keys and keys to reported identifiers, both lower-case on the left, by the precedence of ``mappings``."""
    rows = metadata(folder)
    reporting = {key.lower(): spdx or REF_PREFIX + key for _, key, spdx, _ in rows}
    keys: dict[str, str] = {}
    for claim in (lambda r: [r[1]], lambda r: [reporting[r[1].lower()]], lambda r: r[3]):
        for row in rows:
            for spdx in claim(row):
                keys.setdefault(spdx.lower(), row[1])
    return keys, reporting


def read_version(path: str) -> tuple[str, str]:
    """(version, commit) of a version file: lines of key=value, blank ones and comments aside."""
    found: dict[str, str] = {}
    with open(path, encoding="utf-8") as f:
        for number, line in enumerate(f, 1):
            line = line.strip()
            if not line or line.startswith("#"):
                continue
            key, sign, value = (x.strip() for x in line.partition("="))
            if not sign or not value:
                raise ValueError(f"{path}:{number}: no key and value")
            if key not in ("version", "commit") or key in found:
                raise ValueError(f"{path}:{number}: {'repeated' if key in found else 'unknown'} key {key}")
            found[key] = value
    if "version" not in found or not re.fullmatch("[0-9a-fA-F]{40}", found.get("commit", "")):
        raise ValueError(f"{path}: a version and a commit of 40 hexadecimal digits are needed")
    return found["version"], found["commit"]


def write_table(prepared: DataFrame, path: str) -> None:
    prepared.orderBy("rule_id").coalesce(1).write.mode("overwrite").parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A written rule table; ValueError with the first problems if it is not fit for matching."""
    found = spark.read.parquet(path)
    wrong = rules.violations(found).orderBy("rule_id", "problem").limit(5).collect()
    if wrong:
        raise ValueError("; ".join(f"{r['rule_id']}: {r['problem']}" for r in wrong))
    return found
