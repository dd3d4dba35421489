"""The registered queries of the licence operators and their SQL counterparts.

All integers are cast to BIGINT and all doubles rounded on both sides, so that values compare equal.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewright.functions import expressions as E
from clausewright.functions import policy, tokens
from clausewright.operators import detect, evaluate, filters, gate, match, rules, spdx
from clausewright.session import table
from clausewright.sources import rulefiles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Callable[[SparkSession, str], DataFrame]], Callable[[SparkSession, str], DataFrame]]:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _long(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(n).cast("long").alias(n) if t in ("int", "smallint", "tinyint") else F.col(n) for n, t in df.dtypes])


def _quoted(x: object) -> str:
    if isinstance(x, list):
        return f"CAST([{', '.join(map(_quoted, x))}] AS VARCHAR[])"
    return "NULL" if x is None else str(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'"


def _rule_rows() -> str:
    """The built-in rules as SQL rows, prepared by the same rules in plain Python."""
    import re

    rows = []
    for index, (rule_id, expression, text, flags, relevance) in enumerate(sorted(rules.BUILTIN)):
        words = re.findall(r"[^\W_]+(?:\+[^\W_]*)?", text.lower())
        ids = list(dict.fromkeys(w for w in re.findall(r"[^() ]+", expression) if w not in ("AND", "OR", "WITH")))
        reported = [rules.REPORTING.get(i, E.REF_PREFIX + i) for i in ids]
        full = expression
        for i, r in sorted(zip(ids, reported, strict=True), key=lambda x: -len(x[0])):
            full = re.sub(rf"(?<![\w.+-]){re.escape(i)}(?![\w.+-])", r, full)
        kind = rules.KINDS.get(flags & rules.KIND_MASK, "unknown")
        rows.append(f"({', '.join(map(_quoted, [index, rule_id, expression, full, reported, E.identify(ids), words, len(words), flags, kind, relevance]))})")
    return ", ".join(rows)


_WORD_SQL = r"[\p{L}\p{N}]+(?:\+[\p{L}\p{N}]*)?"
_TOKENS_SQL = f"list_transform(regexp_extract_all(text, '{_WORD_SQL}'), lambda w: lower(w))"
_CTE_TOKENS = f"doc_tokens AS (SELECT doc_id, text, {_TOKENS_SQL} AS tokens FROM documents)"
_CTE_RULES = f"rules(rule_index, rule_id, expression, reported, license_ids, identification, tokens, n, flags, kind, relevance) AS (VALUES {_rule_rows()})"
_CTE_FOUND = f"""{_CTE_TOKENS}, {_CTE_RULES}, places AS (SELECT doc_id, tokens, unnest(range(len(tokens))) AS p FROM doc_tokens),
whole AS (SELECT DISTINCT doc_id FROM doc_tokens d JOIN rules r ON d.tokens = r.tokens),
found AS (SELECT doc_id, rule_index, p AS s, p + n AS e, r.expression, r.flags FROM places d JOIN rules r ON d.tokens[p + 1] = r.tokens[1] AND list_slice(d.tokens, p + 1, p + n) = r.tokens WHERE doc_id NOT IN (SELECT doc_id FROM whole) OR (p = 0 AND n = len(d.tokens)))"""
_BIG = "CAST({} AS BIGINT) AS {}"


def _hits(spark: SparkSession, sf_dir: str, method: str | None = None) -> DataFrame:
    return match.hits(_docs(spark, sf_dir), rules.builtin(spark), method)


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.candidates(_hits(spark, sf_dir))


# --- tokens


@query(f"WITH {_CTE_TOKENS} SELECT doc_id, CAST(len(tokens) AS BIGINT) AS n_tokens, CAST(len(list_distinct(tokens)) AS BIGINT) AS n_distinct FROM doc_tokens")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = match.doc_tokens(_docs(spark, sf_dir))
    return words.select("doc_id", F.col("n_tokens").cast("long").alias("n_tokens"), F.size(F.array_distinct("tokens")).cast("long").alias("n_distinct"))


@query(rf"""WITH parts AS (SELECT doc_id, unnest(regexp_extract_all(text, '([^\p{{L}}\p{{N}}]*)({_WORD_SQL})', 1)) AS gap, unnest(regexp_extract_all(text, '([^\p{{L}}\p{{N}}]*)({_WORD_SQL})', 2)) AS word,
 generate_subscripts(regexp_extract_all(text, '([^\p{{L}}\p{{N}}]*)({_WORD_SQL})', 2), 1) - 1 AS pos FROM documents),
ends AS (SELECT doc_id, pos, lower(word) AS token, strlen(word) AS n, sum(strlen(gap) + strlen(word)) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS e FROM parts)
SELECT doc_id, CAST(pos AS BIGINT) AS pos, token, CAST(e - n AS BIGINT) AS byte_start, CAST(e AS BIGINT) AS byte_end FROM ends""")
def token_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(tokens.spans(_docs(spark, sf_dir)))


@query(f"WITH {_CTE_TOKENS}, words AS (SELECT DISTINCT unnest(tokens) AS word FROM doc_tokens) SELECT word, CAST(row_number() OVER (ORDER BY word) AS BIGINT) AS id FROM words")
def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.vocabulary(match.doc_tokens(_docs(spark, sf_dir)))


# --- matching


@query(f"WITH {_CTE_TOKENS}, dictionary AS (SELECT min(doc_id) AS rule_doc, tokens FROM doc_tokens WHERE len(tokens) > 0 GROUP BY tokens) SELECT doc_id, rule_doc, CAST(len(d.tokens) AS BIGINT) AS n_tokens FROM doc_tokens d JOIN dictionary r ON d.tokens = r.tokens")
def hash_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against a dictionary of all texts: the first document of the same words."""
    found = match.same_text(match.doc_tokens(_docs(spark, sf_dir)))
    return found.select("doc_id", F.col("first").alias("rule_doc"), F.col("n_tokens").cast("long").alias("n_tokens"))


_EXACT_SQL = f"WITH {_CTE_FOUND} SELECT doc_id, CAST(rule_index AS BIGINT) AS rule_index, CAST(s AS BIGINT) AS tok_start, CAST(e AS BIGINT) AS tok_end FROM found"


@query(_EXACT_SQL)
def exact_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(_candidates(spark, sf_dir).drop("method"))


@query(_EXACT_SQL)
def automaton_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(match.candidates(_hits(spark, sf_dir, "automaton")).drop("method"))


@query(f"WITH {_CTE_FOUND} SELECT doc_id, CAST(count(*) AS BIGINT) AS candidates FROM found GROUP BY doc_id HAVING count(*) > 5")
def candidate_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents over a candidate limit (5 here, so that some are)."""
    return match.over_limit(_hits(spark, sf_dir), 5)


@query(f"WITH {_CTE_FOUND}, found_licences AS (SELECT DISTINCT doc_id, r.reported AS expression FROM found f JOIN rules r USING (rule_index) WHERE r.kind = 'notice') SELECT expression, CAST(count(*) AS BIGINT) AS documents FROM found_licences GROUP BY expression")
def license_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by licence notice: the flagship query."""
    notices = F.broadcast(rules.builtin(spark).where("kind = 'notice'").select("rule_index", F.col("reported_expression").alias("expression")))
    return _candidates(spark, sf_dir).join(notices, "rule_index").select("doc_id", "expression").distinct().groupBy("expression").agg(F.count("*").alias("documents"))


# --- filters

_CONTAINED_SQL = f"{_CTE_FOUND}, marked AS (SELECT *, coalesce(e <= max(e) OVER (PARTITION BY doc_id ORDER BY s, e - s DESC, rule_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS is_contained FROM found)"


@query(f"WITH {_CONTAINED_SQL} SELECT doc_id, CAST(rule_index AS BIGINT) AS rule_index, CAST(s AS BIGINT) AS tok_start, CAST(e AS BIGINT) AS tok_end, is_contained FROM marked")
def contained_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(filters.contained(_candidates(spark, sf_dir).drop("method")))


@query(f"WITH {_CONTAINED_SQL}, active AS (SELECT m.* FROM marked m JOIN rules r USING (rule_index) WHERE NOT is_contained AND r.kind <> 'notice' AND (m.flags & 128) = 0), gone AS (SELECT * FROM marked WHERE is_contained) SELECT doc_id, CAST(rule_index AS BIGINT) AS rule_index, CAST(s AS BIGINT) AS tok_start, CAST(e AS BIGINT) AS tok_end FROM gone g WHERE NOT EXISTS (SELECT 1 FROM active a WHERE a.doc_id = g.doc_id AND a.s < g.e AND g.s < a.e)")
def restore_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contained candidates that overlap no active one, once notices and false positives no longer count as active."""
    facts = F.broadcast(rules.builtin(spark).select("rule_index", "flags", "kind"))
    marked = filters.contained(_candidates(spark, sf_dir)).join(facts, "rule_index")
    active = filters.without_false_positives(marked.where("NOT is_contained AND kind <> 'notice'"))
    back = filters.restore(active, marked.where("is_contained"))
    return _long(back.select("doc_id", "rule_index", "tok_start", "tok_end"))


# The greedy pass as recursion: one step for each pair that the pass looks at. State: the current row, the next one, the last kept
# row and the removed ones. Input: a table of candidates (doc_id, rule_index, s, e, expression, flags).


def _walk_sql(source: str) -> str:
    return f"""kept AS (SELECT doc_id, rule_index, s, e, expression, flags, row_number() OVER (PARTITION BY doc_id ORDER BY s, e - s DESC, rule_index) AS k, count(*) OVER (PARTITION BY doc_id) AS n FROM {source}),
pairs AS (SELECT a.doc_id, a.k AS i, b.k AS j, a.s AS a_s, a.e AS a_e, b.s AS b_s, b.e AS b_e, a.e - a.s AS a_n, b.e - b.s AS b_n, least(a.e, b.e) - greatest(a.s, b.s) AS o, a.expression = b.expression AS same, (a.flags & b.flags & 128) <> 0 AS fp FROM kept a JOIN kept b ON a.doc_id = b.doc_id AND b.k > a.k AND b.s < a.e),
verdict AS (SELECT *, CASE WHEN fp THEN '' WHEN o >= 0.9 * b_n AND a_n >= b_n THEN 'next' WHEN o >= 0.9 * a_n AND a_n <= b_n THEN 'current' WHEN o >= 0.7 * b_n AND a_n >= b_n THEN 'next' WHEN o >= 0.7 * a_n AND a_n <= b_n THEN 'current'
 WHEN same AND (o >= 0.4 * b_n OR o >= 0.4 * a_n) THEN CASE WHEN a_n >= b_n THEN 'next' ELSE 'current' END ELSE 'ask' END AS v FROM pairs),
walk(doc_id, n, i, j, prev, gone) AS (
 SELECT DISTINCT doc_id, n, CAST(1 AS BIGINT), CAST(2 AS BIGINT), CAST(0 AS BIGINT), CAST([] AS BIGINT[]) FROM kept
 UNION ALL
 SELECT w.doc_id, w.n,
  CASE WHEN w.done THEN w.i + 1 WHEN w.v = 'current' THEN w.i + 1 ELSE w.i END,
  CASE WHEN w.done OR w.v = 'current' THEN w.i + 2 ELSE w.j + 1 END,
  CASE WHEN w.done AND NOT list_contains(w.gone, w.i) THEN w.i ELSE w.prev END,
  CASE WHEN NOT w.done AND w.v = 'next' THEN list_append(w.gone, w.j) WHEN NOT w.done AND w.v = 'current' THEN list_append(w.gone, w.i) ELSE w.gone END
 FROM (SELECT s.*, (list_contains(s.gone, s.i) OR s.j > s.n OR v.v IS NULL) AS done,
   CASE WHEN list_contains(s.gone, s.j) THEN '' WHEN v.v <> 'ask' THEN v.v WHEN p.k IS NULL OR least(p.e, v.b_e) > greatest(p.s, v.b_s) THEN '' WHEN greatest(0, least(p.e, v.a_e) - greatest(p.s, v.a_s)) + v.o >= 0.9 * v.a_n THEN 'current' ELSE '' END AS v
  FROM walk s LEFT JOIN verdict v ON v.doc_id = s.doc_id AND v.i = s.i AND v.j = s.j LEFT JOIN kept p ON p.doc_id = s.doc_id AND p.k = s.prev WHERE s.i < s.n) w),
walked AS (SELECT k.doc_id, k.rule_index, k.s, k.e, k.expression, k.flags, list_contains(f.gone, k.k) AS is_overlapping FROM kept k JOIN (SELECT doc_id, gone FROM walk WHERE i >= n) f USING (doc_id))"""


_ACTIVE_SQL = f"{_CONTAINED_SQL}, uncontained AS (SELECT * FROM marked WHERE NOT is_contained), {_walk_sql('uncontained')}"


@query(f"WITH RECURSIVE {_ACTIVE_SQL} SELECT doc_id, CAST(rule_index AS BIGINT) AS rule_index, CAST(s AS BIGINT) AS tok_start, CAST(e AS BIGINT) AS tok_end, is_overlapping FROM walked")
def overlap_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the greedy pass drops a candidate that the contained filter kept."""
    states = filters.filter_overlaps(_hits(spark, sf_dir), rules.builtin(spark))
    return _long(states.select("doc_id", "rule_index", "tok_start", "tok_end", (F.col("state") == "overlapping").alias("is_overlapping")))


# All filters: contained, overlapping, what comes back of each (the contained ones first), contained again, false positives.
_STATES_SQL = f"""{_ACTIVE_SQL}, first AS (SELECT m.*, coalesce(w.is_overlapping, false) AS is_overlapping FROM marked m LEFT JOIN walked w USING (doc_id, rule_index, s, e)),
second AS (SELECT f.*, is_contained AND NOT EXISTS (SELECT 1 FROM first a WHERE a.doc_id = f.doc_id AND NOT a.is_contained AND NOT a.is_overlapping AND a.s < f.e AND f.s < a.e) AS back FROM first f),
third AS (SELECT f.*, back OR (is_overlapping AND NOT EXISTS (SELECT 1 FROM second a WHERE a.doc_id = f.doc_id AND (a.back OR (NOT a.is_contained AND NOT a.is_overlapping)) AND a.s < f.e AND f.s < a.e)) AS again FROM second f),
fourth AS (SELECT *, NOT is_contained AND NOT is_overlapping OR again AS alive FROM third),
fifth AS (SELECT *, alive AND coalesce(e <= max(CASE WHEN alive THEN e END) OVER (PARTITION BY doc_id ORDER BY s, e - s DESC, rule_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS late FROM fourth),
states AS (SELECT *, CASE WHEN alive AND NOT late AND (flags & 128) = 0 THEN 'active' WHEN alive THEN 'final' WHEN is_contained THEN 'contained' ELSE 'overlapping' END AS state FROM fifth)"""


@query(f"WITH RECURSIVE {_STATES_SQL} SELECT doc_id, CAST(rule_index AS BIGINT) AS rule_index, CAST(s AS BIGINT) AS tok_start, CAST(e AS BIGINT) AS tok_end, state FROM states")
def filtered_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of each candidate after all filters."""
    return _long(filters.filter_states(_hits(spark, sf_dir), rules.builtin(spark)).drop("method"))


# --- grouping

_SURVIVORS_SQL = f"""{_STATES_SQL}, alive AS (SELECT f.doc_id, r.rule_index, r.rule_id, r.reported AS expression, r.license_ids, r.identification, r.kind, r.relevance, f.s, f.e, (r.flags & 64) <> 0 AS is_clue FROM states f JOIN rules r USING (rule_index) WHERE state = 'active'),
parts AS (SELECT doc_id, unnest(regexp_extract_all(text, '([^\\p{{L}}\\p{{N}}]*)({_WORD_SQL})', 1)) AS gap, unnest(regexp_extract_all(text, '([^\\p{{L}}\\p{{N}}]*)({_WORD_SQL})', 2)) AS word, generate_subscripts(regexp_extract_all(text, '({_WORD_SQL})', 1), 1) - 1 AS pos FROM documents WHERE doc_id IN (SELECT doc_id FROM alive)),
ends AS (SELECT doc_id, pos, strlen(word) AS n, sum(strlen(gap) + strlen(word)) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS e FROM parts),
matched AS (SELECT k.doc_id, k.rule_id, k.expression, k.license_ids, k.identification, k.kind, k.relevance, k.is_clue, CAST(a.e - a.n AS BIGINT) AS b_start, CAST(z.e AS BIGINT) AS b_end FROM alive k JOIN ends a ON a.doc_id = k.doc_id AND a.pos = k.s JOIN ends z ON z.doc_id = k.doc_id AND z.pos = k.e - 1)"""


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.rule_matches(_docs(spark, sf_dir), rules.builtin(spark))


@query(f"WITH RECURSIVE {_SURVIVORS_SQL} SELECT doc_id, rule_id, expression, identification, kind, CAST(relevance AS DOUBLE) AS score, b_start AS \"start\", b_end AS \"end\", is_clue, array_to_string(license_ids, ',') AS license_ids FROM matched")
def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _matches(spark, sf_dir)
    return found.select("doc_id", "rule_id", "expression", "identification", "kind", "score", "start", "end", "is_clue", F.array_join("license_ids", ",").alias("license_ids"))


@query(f"WITH RECURSIVE {_SURVIVORS_SQL} SELECT m.doc_id, m.rule_id, decode(array_slice(encode(text), b_start + 1, b_end)) AS matched FROM matched m JOIN documents d ON d.doc_id = m.doc_id")
def matched_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bytes that each match covers."""
    return detect.rule_matches(_docs(spark, sf_dir), rules.builtin(spark), matched_text=True).select("doc_id", "rule_id", "matched")


@query(f"WITH RECURSIVE {_SURVIVORS_SQL} SELECT doc_id, expression, arg_min(identification, (b_start, b_end, rule_id)) AS identification, CAST(count(*) AS BIGINT) AS n, CAST(min(b_start) AS BIGINT) AS first_start, string_agg(rule_id, '|' ORDER BY b_start, b_end, rule_id) AS rule_ids FROM matched WHERE NOT is_clue GROUP BY doc_id, expression")
def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _detections(_matches(spark, sf_dir))


def _detections(found: DataFrame) -> DataFrame:
    found = detect.detections(found)
    return found.select("doc_id", "expression", "identification", F.size("matches").cast("long").alias("n"), F.col("matches")[0]["start"].alias("first_start"), F.array_join(F.transform("matches", lambda m: m["rule_id"]), "|").alias("rule_ids"))


@query(f"WITH RECURSIVE {_SURVIVORS_SQL} SELECT doc_id, CAST(count(*) AS BIGINT) AS n, string_agg(rule_id || '@' || b_start, '|' ORDER BY b_start, b_end, rule_id) AS clues FROM matched WHERE is_clue GROUP BY doc_id")
def clues(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect.clues(_matches(spark, sf_dir))
    return found.select("doc_id", F.size("clues").cast("long").alias("n"), F.array_join(F.transform("clues", lambda m: F.concat(m["rule_id"], F.lit("@"), m["start"].cast("string"))), "|").alias("clues"))


@query(f"WITH {_CONTAINED_SQL} SELECT r.rule_id, CAST(count(*) AS BIGINT) AS candidates, CAST(count(*) FILTER (WHERE is_contained) AS BIGINT) AS contained FROM marked m JOIN rules r USING (rule_index) WHERE (r.flags & 128) <> 0 GROUP BY r.rule_id")
def false_positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the false-positive rules match before they are removed."""
    facts = F.broadcast(rules.builtin(spark).where(rules.has(rules.FALSE_POSITIVE)).select("rule_index", "rule_id"))
    marked = filters.contained(_candidates(spark, sf_dir)).join(facts, "rule_index")
    return marked.groupBy("rule_id").agg(F.count("*").alias("candidates"), F.count_if("is_contained").alias("contained"))


@query(f"WITH {_CTE_RULES} SELECT rule_id, CAST(rule_index AS BIGINT) AS rule_index, kind, reported AS reported_expression, identification, CAST(n AS BIGINT) AS n_tokens, array_to_string(license_ids, ',') AS license_ids FROM rules")
def rule_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.builtin(spark).select("rule_id", "rule_index", "kind", "reported_expression", "identification", "n_tokens", F.array_join("license_ids", ",").alias("license_ids"))
    return _long(found)


# A path for each document, made of its language and source
_PATH_SQL = "CASE lang WHEN 'en' THEN source || '/LICENCES/part.txt' WHEN 'fr' THEN 'NOTICE.md' WHEN 'de' THEN 'licence-' || source ELSE 'readme.' || source END"

# An expression for each document, made of its language and source, so that every row takes part
_EXPRESSION_SQL = "CASE lang WHEN 'en' THEN 'mit AND (free-unknown OR ' || source || ')' WHEN 'fr' THEN 'unknown' WHEN 'de' THEN 'gpl-2.0 WITH classpath-exception-2.0' ELSE 'apache-2.0 OR mit OR apache-2.0' END"
_IDS_SQL = f"list_filter(regexp_extract_all({_EXPRESSION_SQL}, '[^() ]+'), lambda w: upper(w) NOT IN ('AND', 'OR', 'WITH'))"
_PLACEHOLDERS_SQL = ", ".join(_quoted(p) for p in E.PLACEHOLDERS)


@query(f"WITH ids AS (SELECT doc_id, {_IDS_SQL} AS ids FROM documents) SELECT doc_id, CASE WHEN len(list_filter(ids, lambda i: lower(i) NOT IN ({_PLACEHOLDERS_SQL}))) = 0 THEN 'NOASSERTION' WHEN len(list_filter(ids, lambda i: lower(i) IN ({_PLACEHOLDERS_SQL}))) > 0 THEN 'partial' ELSE 'identified' END AS identification FROM ids")
def identification(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = E.expression_ids(F.expr(_EXPRESSION_SQL))
    return _docs(spark, sf_dir).select("doc_id", E.identification(ids).alias("identification"))


@query(f"""WITH x AS (SELECT doc_id, {_EXPRESSION_SQL} AS e, {_IDS_SQL} AS ids FROM documents), words AS (SELECT doc_id, ids, unnest(ids) AS w, generate_subscripts(ids, 1) AS k FROM x), firsts AS (SELECT doc_id, w, min(k) AS k FROM words GROUP BY doc_id, w)
SELECT x.doc_id, (SELECT string_agg(w, ',' ORDER BY k) FROM firsts f WHERE f.doc_id = x.doc_id) AS ids,
CASE WHEN e LIKE 'mit AND%' THEN 'MIT AND (LicenseRef-scancode-free-unknown OR LicenseRef-scancode-' || regexp_extract(e, 'OR (.*)\\)', 1) || ')' WHEN e = 'unknown' THEN 'LicenseRef-scancode-unknown' WHEN e LIKE 'gpl%' THEN 'GPL-2.0-only WITH Classpath-exception-2.0' ELSE 'Apache-2.0 OR MIT OR Apache-2.0' END AS reported FROM x""".replace("\\\\", "\\"))
def expression_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.expr(_EXPRESSION_SQL)
    return _docs(spark, sf_dir).select("doc_id", F.array_join(E.expression_ids(e), ",").alias("ids"), E.rewrite(e, E.lookup(rules.REPORTING)).alias("reported"))


_FIRST_SQL = f"{_SURVIVORS_SQL}, per_file AS (SELECT doc_id, expression, arg_min(identification, (b_start, b_end, rule_id)) AS identification, count(*) AS n FROM matched WHERE NOT is_clue GROUP BY doc_id, expression)"


@query(f"WITH RECURSIVE {_FIRST_SQL}, paths AS (SELECT doc_id, {_PATH_SQL} AS path FROM documents) SELECT expression, arg_min(identification, doc_id) AS identification, bool_or(NOT contains(path, '/')) AS root, CAST(count(*) AS BIGINT) AS files, CAST(sum(n) AS BIGINT) AS matches FROM per_file JOIN paths USING (doc_id) GROUP BY expression")
def expression_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detected expressions; root if a legal file or readme at the root of the tree has them. Three of the four made paths are such."""
    rows = _docs(spark, sf_dir).select("doc_id", F.expr(_PATH_SQL).alias("path"))
    return detect.expression_rollup(_matches(spark, sf_dir), rows.where(policy.is_root_expression_file(F.col("path"))).select("doc_id"))


@query(f"WITH RECURSIVE {_FIRST_SQL}, flags AS (SELECT doc_id, bool_or(identification = 'identified') AS a, bool_or(identification = 'partial') AS b, bool_or(identification = 'NOASSERTION') AS c FROM per_file GROUP BY doc_id) SELECT CAST(count(*) AS BIGINT) AS files_with_detections, CAST(count(*) FILTER (WHERE a) AS BIGINT) AS files_identified, CAST(count(*) FILTER (WHERE b) AS BIGINT) AS files_partial, CAST(count(*) FILTER (WHERE c) AS BIGINT) AS files_noassertion FROM flags")
def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.identification_summary(_matches(spark, sf_dir))


@query(f"""WITH RECURSIVE {_SURVIVORS_SQL}, ranges AS (SELECT doc_id, b_start AS s, b_end AS e FROM matched WHERE kind IN ('text', 'notice')), seen AS (SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ranges),
islands AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM seen), merged AS (SELECT doc_id, island, max(e) - min(s) AS n FROM islands GROUP BY doc_id, island), covered AS (SELECT doc_id, sum(n) AS n FROM merged GROUP BY doc_id)
SELECT d.doc_id, round(CASE WHEN strlen(text) > 0 THEN coalesce(n, 0) / strlen(text) * 100 ELSE 0 END, 6) AS coverage FROM documents d LEFT JOIN covered c USING (doc_id)""")
def license_text_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = _docs(spark, sf_dir).select("doc_id", F.octet_length("text").cast("long").alias("bytes"))
    return detect.coverage(_matches(spark, sf_dir), lengths).select("doc_id", F.round("coverage", 6).alias("coverage"))


# --- paths; made of source and language, so that every document takes part



@query(f"""WITH p AS (SELECT doc_id, {_PATH_SQL} AS path FROM documents), n AS (SELECT *, lower(list_extract(string_split(path, '/'), -1)) AS name, list_transform(string_split(path, '/')[:-2], lambda x: lower(x)) AS dirs FROM p),
r AS (SELECT *, len(list_filter(dirs, lambda x: x IN ({', '.join(map(_quoted, policy.LEGAL_DIRECTORIES))}))) > 0 OR regexp_matches(name, '{policy.LEGAL_NAME}') AS lic, regexp_matches(name, '{policy.NOTICE_NAME}') AS note FROM n)
SELECT doc_id, path, CASE WHEN lic AND note THEN 'license,notice' WHEN lic THEN 'license' WHEN note THEN 'notice' ELSE '' END AS roles, len(string_split(path, '/')) = 1 AND (lic OR note OR regexp_matches(name, '^readme([.].*)?$')) AS is_root, regexp_matches(name, '^readme$|[.](md|markdown|mdown|mdx|mkd)$') AS markers FROM r""")
def legal_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir).select("doc_id", F.expr(_PATH_SQL).alias("path"))
    p = F.col("path")
    return rows.select("doc_id", "path", F.array_join(policy.legal_roles(p), ",").alias("roles"), policy.is_root_expression_file(p).alias("is_root"), policy.uses_document_markers(p).alias("markers"))


_DIR_SQL = "CASE lang WHEN 'en' THEN '.git' WHEN 'fr' THEN '.' || source WHEN 'de' THEN 'vendor' ELSE source END"
_SKIPS_SQL = ", ".join(_quoted(p) for p in policy.PROJECT_SKIPS)


@query(f"WITH d AS (SELECT doc_id, {_DIR_SQL} AS name FROM documents) SELECT doc_id, name, CASE WHEN name = '.git' THEN 'version-control' WHEN name IN ('src3', 'src4') THEN 'configured-directory' WHEN starts_with(name, '.') THEN 'hidden-directory' WHEN name IN ({_SKIPS_SQL}) THEN 'project-scope' END AS reason FROM d")
def skip_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir).select("doc_id", F.expr(_DIR_SQL).alias("name"))
    return rows.select("doc_id", "name", policy.skip_reason(F.col("name"), ("src3", "src4")).alias("reason"))


@query(f"WITH p AS (SELECT doc_id, {_PATH_SQL} || '/' || doc_id AS path FROM documents), n AS (SELECT *, row_number() OVER (ORDER BY path) AS k, count(*) OVER () AS n FROM p) SELECT doc_id, path, n > 500 AS truncated FROM n WHERE k <= 500")
def limit_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first files of a walk in lexical order, and whether there are more (500 is the feature's limit here)."""
    rows = _docs(spark, sf_dir).select("doc_id", F.concat(F.expr(_PATH_SQL), F.lit("/"), F.col("doc_id").cast("string")).alias("path"))
    more = rows.agg((F.count("*") > 500).alias("truncated"))
    return rows.orderBy("path").limit(500).crossJoin(F.broadcast(more))


_BLOCKS_SQL = r"""WITH t AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents),
pairs AS (SELECT doc_id, trim(unnest(lines[:-2]), ' ' || chr(9) || chr(13)) AS a, trim(unnest(lines[2:]), ' ' || chr(9) || chr(13)) AS b FROM t),
verdict AS (SELECT doc_id, a = '' OR b = '' AS blank, a = '' OR b = '' OR regexp_matches(a, '^[#=|]|[|]$') OR regexp_matches(b, '^[#=|]|[|]$|^([-*+>]|[0-9]+[.)])[ \t]') AS marked FROM pairs)
SELECT d.doc_id, coalesce(bool_or(blank), false) AS plain, coalesce(bool_or(marked), false) AS marked FROM documents d LEFT JOIN verdict v ON v.doc_id = d.doc_id GROUP BY d.doc_id"""


@query(_BLOCKS_SQL)
def block_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the whole text runs over a block boundary, without and with document markers."""
    rows = _docs(spark, sf_dir)
    whole = lambda marks: policy.crosses_block_boundary(F.col("text"), F.lit(0), F.octet_length("text"), F.lit(marks))
    return rows.select("doc_id", whole(False).alias("plain"), whole(True).alias("marked"))


# --- SPDX; a tag is appended to each text, so that every document takes part

_TAG_SQL = "CASE lang WHEN 'en' THEN 'MIT OR Apache-2.0' WHEN 'fr' THEN 'LicenseRef-' || source WHEN 'de' THEN 'GPL-2.0+' ELSE 'no-such-' || source END"
_RESOLVED_SQL = "CASE lang WHEN 'en' THEN 'MIT OR Apache-2.0' WHEN 'fr' THEN 'LicenseRef-scancode-unknown-spdx' WHEN 'de' THEN 'GPL-2.0-or-later' END"


def _resolver() -> E.Resolver:
    return E.Resolver.of_rules(rules.SPDX_KEYS, rules.REPORTING, [r[1] for r in rules.BUILTIN if not r[3] & rules.FALSE_POSITIVE])


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.concat("text", F.lit("\n/* SPDX-License-Identifier:  "), F.expr(_TAG_SQL), F.lit(" */\n")).alias("text"))


@query(f"SELECT doc_id, CAST(strlen(text) + 4 AS BIGINT) AS \"start\", CAST(strlen(text) + 4 + 26 + strlen({_TAG_SQL}) AS BIGINT) AS \"end\", {_TAG_SQL} AS raw, {_RESOLVED_SQL} AS expression, CASE lang WHEN 'fr' THEN 'NOASSERTION' ELSE 'identified' END AS identification FROM documents WHERE {_RESOLVED_SQL} IS NOT NULL")
def spdx_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spdx.find_tags(_tagged(spark, sf_dir), _resolver()).drop("license_ids")


# The misspelt tag, other ends of an expression, and its limit of 1,024 bytes
_ENDED_SQL = "CASE lang WHEN 'en' THEN '<!-- SPDX-License-Identifer: MIT OR ISC -->' WHEN 'fr' THEN '\r# xspdx-LICENSE-identifier:\tISC \rMIT' WHEN 'de' THEN '/*SPDX-License-Identifier:GPL-2.0+*/' ELSE '; SPDX-License-Identifier: ' || repeat(' ', 1019) || 'MIT AND ISC' END"


@query(f"""WITH t AS (SELECT doc_id, lang, strlen(text) + 1 AS n FROM documents) SELECT doc_id, CAST(n + CASE lang WHEN 'en' THEN 5 WHEN 'fr' THEN 4 ELSE 2 END AS BIGINT) AS "start", CAST(n + CASE lang WHEN 'en' THEN 39 WHEN 'fr' THEN 32 WHEN 'de' THEN 34 ELSE 2 + 24 + 1023 END AS BIGINT) AS "end",
CASE lang WHEN 'en' THEN 'MIT OR ISC' WHEN 'fr' THEN 'ISC' WHEN 'de' THEN 'GPL-2.0+' ELSE 'MIT' END AS raw, CASE lang WHEN 'en' THEN 'MIT OR ISC' WHEN 'fr' THEN 'ISC' WHEN 'de' THEN 'GPL-2.0-or-later' ELSE 'MIT' END AS expression FROM t""")
def spdx_endings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir).select("doc_id", F.concat("text", F.lit("\n"), F.expr(_ENDED_SQL.replace("\r", "\\r").replace("\t", "\\t"))).alias("text"))
    return spdx.find_tags(rows, _resolver()).select("doc_id", "start", "end", "raw", "expression")


@query(f"""WITH RECURSIVE {_SURVIVORS_SQL}, tagged AS (SELECT doc_id, '{spdx.RULE_ID}' AS rule_id, {_RESOLVED_SQL} AS expression, CASE lang WHEN 'fr' THEN 'NOASSERTION' ELSE 'identified' END AS identification, strlen(text) + 4 AS s, strlen(text) + 30 + strlen({_TAG_SQL}) AS e FROM documents WHERE {_RESOLVED_SQL} IS NOT NULL),
every AS (SELECT doc_id, rule_id, expression, identification, b_start, b_end FROM matched WHERE NOT is_clue UNION ALL SELECT doc_id, rule_id, expression, identification, s, e FROM tagged t WHERE NOT EXISTS (SELECT 1 FROM matched m WHERE m.doc_id = t.doc_id AND m.b_start < t.e AND t.s < m.b_end))
SELECT doc_id, expression, arg_min(identification, (b_start, b_end, rule_id)) AS identification, CAST(count(*) AS BIGINT) AS n, CAST(min(b_start) AS BIGINT) AS first_start, string_agg(rule_id, '|' ORDER BY b_start, b_end, rule_id) AS rule_ids FROM every GROUP BY doc_id, expression""")
def tag_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules and tags in one group of their expression."""
    return _detections(detect.matches(_tagged(spark, sf_dir), rules.builtin(spark), _resolver()))


@query(f"SELECT doc_id, {_TAG_SQL} AS raw, coalesce({_RESOLVED_SQL}, '') AS expression, CASE lang WHEN 'en' THEN 'MIT,Apache-2.0' WHEN 'fr' THEN 'LicenseRef-scancode-unknown-spdx' WHEN 'de' THEN 'GPL-2.0-or-later' ELSE '' END AS license_ids FROM documents")
def spdx_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir).select("doc_id", F.expr(_TAG_SQL).alias("raw"))
    return E.normalize(rows, "raw", _resolver()).select("doc_id", "raw", F.col("normalized.expression").alias("expression"), F.array_join("normalized.license_ids", ",").alias("license_ids"))


_WIDE_SQL = "CASE lang WHEN 'en' THEN '( MIT  OR  Apache-2.0 ) AND GPL-2.0+' WHEN 'fr' THEN 'GPL-2.0+ WITH Classpath-exception-2.0 OR MIT AND ISC' WHEN 'de' THEN 'MIT AND' ELSE '((DocumentRef-' || source || ':LicenseRef-x))' END"


@query(f"SELECT doc_id, {_WIDE_SQL} AS raw, CASE lang WHEN 'en' THEN '(MIT OR Apache-2.0) AND GPL-2.0-or-later' WHEN 'fr' THEN 'GPL-2.0-or-later WITH Classpath-exception-2.0 OR (MIT AND ISC)' WHEN 'de' THEN '' ELSE 'LicenseRef-scancode-unknown-spdx' END AS expression FROM documents")
def spdx_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir).select("doc_id", F.expr(_WIDE_SQL).alias("raw"))
    return E.normalize(rows, "raw", _resolver()).select("doc_id", "raw", F.col("normalized.expression").alias("expression"))


@query(f"WITH RECURSIVE {_SURVIVORS_SQL}, tags AS (SELECT doc_id, strlen(text) + 4 AS s, strlen(text) + 30 + strlen({_TAG_SQL}) AS e FROM documents WHERE {_RESOLVED_SQL} IS NOT NULL), wide AS (SELECT doc_id, s - 20 - strlen(doc_id::VARCHAR) AS s, e FROM tags) SELECT doc_id, CAST(s AS BIGINT) AS \"start\", CAST(e AS BIGINT) AS \"end\" FROM wide t WHERE NOT EXISTS (SELECT 1 FROM matched m WHERE m.doc_id = t.doc_id AND m.b_start < t.e AND t.s < m.b_end)")
def spdx_overlap_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags, widened to the left so that some reach into the text, that no rule match overlaps."""
    found = spdx.find_tags(_tagged(spark, sf_dir), _resolver())
    wide = found.withColumn("start", F.col("start") - 20 - F.length(F.col("doc_id").cast("string")))
    return spdx.drop_covered(wide, _matches(spark, sf_dir)).select("doc_id", "start", "end")


# --- gate and evaluation


@query(f"""WITH x AS (SELECT doc_id, {_EXPRESSION_SQL} AS e FROM documents), i AS (SELECT doc_id, list_filter(string_split(regexp_replace(lower(e), '[()]', ' ', 'g'), ' '), lambda w: w NOT IN ('', 'and', 'or', 'with')) AS ids FROM x)
SELECT doc_id, len(list_filter(ids, lambda w: w IN ('unknown', 'src3'))) > 0 AS denied, len(list_filter(ids, lambda w: w NOT IN ('mit', 'apache-2.0', 'free-unknown', 'src1'))) > 0 AS not_allowed FROM i""")
def policy_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.expr(_EXPRESSION_SQL)
    return _docs(spark, sf_dir).select("doc_id", gate.is_denied(e, deny=" Unknown, src3").alias("denied"), gate.is_denied(e, allow="MIT,apache-2.0,free-unknown, src1,").alias("not_allowed"))


_CASES_SQL = "SELECT CAST(doc_id AS VARCHAR) AS path, [lang, source, ''] AS expected, CASE lang WHEN 'en' THEN [lang, source] WHEN 'fr' THEN [source, 'x'] WHEN 'de' THEN CAST([] AS VARCHAR[]) ELSE [lang, source, 'y', 'y'] END AS actual, CASE WHEN source IN ('src1', 'src2') THEN [lang] ELSE CAST([] AS VARCHAR[]) END AS exact_expected, source = 'src7' AS skipped FROM documents"
_CASES_SPARK = "SELECT CAST(doc_id AS STRING) AS path, array(lang, source, '') AS expected, CASE lang WHEN 'en' THEN array(lang, source) WHEN 'fr' THEN array(source, 'x') WHEN 'de' THEN CAST(array() AS ARRAY<STRING>) ELSE array(lang, source, 'y', 'y') END AS actual, CASE WHEN source IN ('src1', 'src2') THEN array(lang) ELSE CAST(array() AS ARRAY<STRING>) END AS exact_expected, source = 'src7' AS skipped FROM {docs}"
_STAGE_SQL = f"""WITH c AS ({_CASES_SQL}), k AS (SELECT path, skipped, list_sort(list_distinct(list_filter(expected, lambda x: x <> ''))) AS x, list_sort(list_distinct(list_filter(actual, lambda x: x <> ''))) AS a, exact_expected AS q FROM c),
m AS (SELECT *, list_filter(x, lambda i: NOT list_contains(a, i)) AS missing, list_filter(a, lambda i: NOT list_contains(x, i)) AS extra FROM k), l AS (SELECT *, list_filter(missing, lambda i: list_contains(q, i)) AS lost FROM m),
s AS (SELECT path, skipped, missing, extra, CASE WHEN skipped THEN NULL WHEN len(missing) = 0 AND len(extra) = 0 THEN 'passed' WHEN len(missing) > 0 AND len(lost) = len(missing) THEN 'filter-suppressed' WHEN len(lost) > 0 THEN 'mixed' WHEN len(a) = 0 THEN 'no-exact-match' WHEN len(missing) > 0 AND len(extra) > 0 THEN 'wrong-exact-rule-set' WHEN len(missing) > 0 THEN 'partial-exact-rule-set' ELSE 'filter-retained' END AS stage FROM l)"""


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_CASES_SPARK, docs=_docs(spark, sf_dir))


@query(f"{_STAGE_SQL} SELECT path, skipped, stage FROM s")
def conformance_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.outcomes(_cases(spark, sf_dir)).select("path", "skipped", "stage")


@query(f"{_STAGE_SQL} SELECT CAST(count(*) AS BIGINT) AS cases, CAST(count(stage) AS BIGINT) AS evaluated, CAST(count(*) FILTER (WHERE stage = 'passed') AS BIGINT) AS passed, CAST(count(*) FILTER (WHERE skipped) AS BIGINT) AS skipped, round(100.0 * count(*) FILTER (WHERE stage = 'passed') / count(stage), 2) AS percent FROM s")
def conformance_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.rate(evaluate.outcomes(_cases(spark, sf_dir)))


@query(f"{_STAGE_SQL} SELECT path, array_to_string(missing, ',') AS missing, array_to_string(extra, ',') AS extra FROM s")
def set_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evaluate.outcomes(_cases(spark, sf_dir))
    return found.select("path", F.array_join(F.array_except("expected", "actual"), ",").alias("missing"), F.array_join(F.array_except("actual", "expected"), ",").alias("extra"))


# Expected licences of each document: those whose planted sentence it holds, and one that none has for a source.
_EXPECTED = {"Apache-2.0": "Apache License, Version 2.0", "MIT": "the MIT License", "GPL-3.0-only": "GNU General Public License, version 3", "CC-BY-NC-4.0": "CC BY-NC 4.0"}
_EXPECTED_SQL = ", ".join(f"CASE WHEN contains(text, '{t}') THEN '{e}' END" for e, t in _EXPECTED.items()) + ", CASE WHEN source = 'src3' THEN 'GPL-1.0-or-later' END"
_ROLLED_SQL = "SELECT profile, stage, CAST(count(*) AS BIGINT) AS cases, CAST(grouping(profile, stage) AS BIGINT) AS level FROM outcomes GROUP BY ROLLUP (profile, stage)"
_STAGED = "CASE WHEN len(missing) = 0 AND len(extra) = 0 THEN 'passed' WHEN len(missing) > 0 AND len(lost) = len(missing) THEN 'filter-suppressed' WHEN len(lost) > 0 THEN 'mixed' WHEN len(a) = 0 THEN 'no-exact-match' WHEN len(missing) > 0 AND len(extra) > 0 THEN 'wrong-exact-rule-set' WHEN len(missing) > 0 THEN 'partial-exact-rule-set' ELSE 'filter-retained' END"


@query(f"""WITH RECURSIVE {_STATES_SQL},
kept_by AS (SELECT doc_id, rule_index, 'raw' AS profile FROM found UNION ALL SELECT doc_id, rule_index, 'contained' FROM marked WHERE NOT is_contained UNION ALL SELECT doc_id, rule_index, 'overlapping' FROM states WHERE alive AND NOT late UNION ALL SELECT doc_id, rule_index, 'false positives' FROM states WHERE state = 'active'),
actual AS (SELECT profile, doc_id, list(DISTINCT r.reported) AS a FROM kept_by JOIN rules r USING (rule_index) WHERE r.reported <> '' GROUP BY ALL),
cases AS (SELECT p.profile, d.doc_id, list_filter([{_EXPECTED_SQL}], lambda x: x IS NOT NULL) AS x FROM documents d, (VALUES ('raw'), ('contained'), ('overlapping'), ('false positives')) p(profile)),
joined AS (SELECT c.profile, c.x, coalesce(b.a, []) AS a, coalesce(r.a, []) AS q FROM cases c LEFT JOIN actual b ON b.profile = c.profile AND b.doc_id = c.doc_id LEFT JOIN actual r ON r.profile = 'raw' AND r.doc_id = c.doc_id),
sets AS (SELECT *, list_filter(x, lambda i: NOT list_contains(a, i)) AS missing, list_filter(a, lambda i: NOT list_contains(x, i)) AS extra FROM joined), losses AS (SELECT *, list_filter(missing, lambda i: list_contains(q, i)) AS lost FROM sets),
outcomes AS (SELECT profile, {_STAGED} AS stage FROM losses) {_ROLLED_SQL}""")
def filter_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by filter configuration and stage: what each set of filters finds of the licences that are expected."""
    docs = _docs(spark, sf_dir)
    wanted = F.array_compact(F.array(*[F.when(F.col("text").contains(t), e) for e, t in _EXPECTED.items()], F.when(F.col("source") == "src3", "GPL-1.0-or-later")))
    cases = evaluate.profiles(match.hits(docs, rules.builtin(spark)), rules.builtin(spark), docs.select("doc_id", wanted.alias("expected")))
    return evaluate.profile(evaluate.outcomes(cases))


# A second run: other sources found all, nothing or one expression more; one source has gone and the cases of another are named anew
_CASES2_SQL = f"SELECT CASE WHEN path LIKE '%7' THEN path || '+' ELSE path END AS path, expected, CASE WHEN exact_expected <> [] THEN expected WHEN skipped THEN actual WHEN path LIKE '%3' THEN [] WHEN path LIKE '%4' THEN list_append(actual, 'z') ELSE actual END AS actual, exact_expected, skipped FROM ({_CASES_SQL}) WHERE path NOT LIKE '%9'"
_CASES2_SPARK = "SELECT CASE WHEN path LIKE '%7' THEN path || '+' ELSE path END AS path, expected, CASE WHEN size(exact_expected) > 0 THEN expected WHEN skipped THEN actual WHEN path LIKE '%3' THEN CAST(array() AS ARRAY<STRING>) WHEN path LIKE '%4' THEN array_append(actual, 'z') ELSE actual END AS actual, exact_expected, skipped FROM {cases} WHERE path NOT LIKE '%9'"
_STAGE2_SQL = _STAGE_SQL.replace(_CASES_SQL, _CASES2_SQL)
_BOTH_RUNS_SQL = f"WITH was_run AS ({_STAGE_SQL} SELECT s.*, k.x, k.a, list_sort(list_distinct(list_filter(k.q, lambda z: z <> ''))) AS q FROM s JOIN k USING (path)), now_run AS ({_STAGE2_SQL} SELECT s.*, k.x, k.a, list_sort(list_distinct(list_filter(k.q, lambda z: z <> ''))) AS q FROM s JOIN k USING (path))"


def _runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    cases = _cases(spark, sf_dir)
    return evaluate.outcomes(cases), evaluate.outcomes(spark.sql(_CASES2_SPARK, cases=cases))


@query(f"{_BOTH_RUNS_SQL} SELECT coalesce(a.path, b.path) AS path, a.stage AS was, b.stage AS now, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' WHEN a.stage = 'passed' THEN 'regression' WHEN b.stage = 'passed' THEN 'improvement' ELSE 'stage' END AS change FROM was_run a FULL JOIN now_run b ON a.path = b.path WHERE a.path IS NULL OR b.path IS NULL OR a.stage IS DISTINCT FROM b.stage")
def conformance_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every case whose stage differs between the two runs: regressions, improvements, other stages, added and removed cases."""
    before, after = _runs(spark, sf_dir)
    return evaluate.changes(before, after)


@query(f"""{_BOTH_RUNS_SQL}, n AS (SELECT (SELECT count(*) FROM was_run) AS a, (SELECT count(stage) FROM was_run) AS b, (SELECT count(*) FROM now_run) AS c, (SELECT count(stage) FROM now_run) AS d, (SELECT count(*) FROM was_run WHERE stage = 'passed') AS p, (SELECT count(*) FROM now_run WHERE stage = 'passed') AS q),
every AS (SELECT 'suite size changed from ' || a || '/' || b || ' to ' || c || '/' || d AS problem FROM n WHERE a <> c OR b <> d UNION ALL SELECT 'pass count fell from ' || p || ' to ' || q FROM n WHERE q < p
 UNION ALL SELECT CASE WHEN a.path IS NULL THEN 'new divergence: ' ELSE 'changed divergence: ' END || b.path FROM (SELECT * FROM now_run WHERE stage <> 'passed') b LEFT JOIN (SELECT * FROM was_run WHERE stage <> 'passed') a USING (path) WHERE a.path IS NULL OR a.stage <> b.stage OR a.x <> b.x OR a.a <> b.a OR a.q <> b.q),
numbered AS (SELECT problem, row_number() OVER (ORDER BY problem) AS place FROM every) SELECT place, CASE WHEN place <= 20 THEN problem ELSE 'more problems are left out' END AS problem FROM numbered WHERE place <= 21""")
def conformance_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 20 problems of the second run, which is the feature."""
    before, after = _runs(spark, sf_dir)
    return evaluate.problems(before, after)


@query(f"{_STAGE_SQL} SELECT path, list_sort(list_distinct(list_concat(x, a))) AS every, CASE WHEN len(a) = 0 THEN '(none)' WHEN len(a) <= 2 THEN array_to_string(a, ', ') ELSE array_to_string(a[:2], ', ') || ' ... (' || len(a) || ' total)' END AS shown FROM k")
def set_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All expressions of either side, and a short text of the found ones (two are shown here, 20 by default)."""
    found = evaluate.outcomes(_cases(spark, sf_dir))
    return found.select("path", F.array_sort(F.array_union("expected", "actual")).alias("every"), evaluate.sample_text(F.col("actual"), 2).alias("shown"))


@query("WITH t AS (SELECT source AS path, CASE lang WHEN 'fr' THEN 'de' ELSE lang END AS x FROM documents), a AS (SELECT source AS path, array_to_string(list_sort(list(DISTINCT lang)), ',') AS ours FROM documents GROUP BY source), b AS (SELECT path, array_to_string(list_sort(list(DISTINCT x)), ',') AS theirs FROM t GROUP BY path) SELECT path, coalesce(ours, '') AS ours, coalesce(theirs, '') AS theirs, coalesce(ours, '') = coalesce(theirs, '') AS agree FROM a FULL JOIN b USING (path)")
def tool_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sorted distinct languages of each source, as two tools tell them, one of which takes French for German."""
    docs = _docs(spark, sf_dir)
    ours = docs.select(F.col("source").alias("path"), F.col("lang").alias("expression"))
    theirs = docs.select(F.col("source").alias("path"), F.expr("CASE lang WHEN 'fr' THEN 'de' ELSE lang END").alias("expression"))
    found = evaluate.compare_tools(ours, theirs)
    return found.select("path", F.array_join("ours", ",").alias("ours"), F.array_join("theirs", ",").alias("theirs"), "agree")


_OTHER_SQL = "CASE lang WHEN 'en' THEN 'Apache-2.0 OR (GPL-2.0-or-later AND ' || source || ')' WHEN 'fr' THEN 'LicenseRef-scancode-mit' WHEN 'de' THEN 'isc AND' ELSE 'BSD-3-Clause AND DocumentRef-x:LicenseRef-y' END"


@query(f"SELECT doc_id, CASE lang WHEN 'en' THEN 'apache-2.0 OR (gpl-2.0-plus AND unknown-spdx)' WHEN 'fr' THEN 'mit' WHEN 'de' THEN 'isc AND' ELSE 'bsd-new AND unknown-spdx' END AS of_rules, CASE lang WHEN 'en' THEN 'apache-2.0 OR (gpl-2.0-plus AND ' || source || ')' WHEN 'fr' THEN 'LicenseRef-scancode-mit' WHEN 'de' THEN 'isc AND' ELSE 'bsd-new AND DocumentRef-x:LicenseRef-y' END AS comparable FROM documents")
def reverse_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reported expressions in the identifiers of the rules, and another tool's expressions made comparable."""
    rows = _docs(spark, sf_dir).select("doc_id", F.expr(_OTHER_SQL).alias("raw"))
    rows = evaluate.comparison_expression(rows, "raw", rules.SPDX_KEYS)
    return rows.select("doc_id", evaluate.rule_expression(F.col("raw"), rules.SPDX_KEYS).alias("of_rules"), "comparable")


@query(f"WITH p AS (SELECT doc_id, CASE WHEN lang = 'de' THEN './' ELSE '' END || {_PATH_SQL} AS path FROM documents) SELECT doc_id, path, NOT contains(regexp_replace(path, '^[.]/', ''), '/') AS compared FROM p")
def comparison_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Legal files and readmes at the root of a project (all made paths at the root are such)."""
    rows = _docs(spark, sf_dir).select("doc_id", F.concat(F.expr("CASE WHEN lang = 'de' THEN './' ELSE '' END"), F.expr(_PATH_SQL)).alias("path"))
    return rows.select("doc_id", "path", evaluate.is_comparison_file(F.col("path")).alias("compared"))


@query("""WITH m AS (SELECT source || '.LICENSE' AS file, source AS key, CASE WHEN source LIKE '%1%' THEN upper(source) WHEN source LIKE '%2' THEN 'SRC1' ELSE '' END AS spdx_key, list_sort(list(DISTINCT lang)) AS others FROM documents GROUP BY source),
c AS (SELECT file, key, 0 AS rank, 0 AS place, key AS spdx FROM m UNION ALL SELECT file, key, 1, 0, CASE WHEN spdx_key <> '' THEN spdx_key ELSE 'LicenseRef-scancode-' || key END FROM m UNION ALL SELECT file, key, 2, generate_subscripts(others, 1), unnest(others) FROM m)
SELECT lower(spdx) AS spdx_lower, arg_min(key, (rank, file, place)) AS key, any_value((SELECT CASE WHEN spdx_key <> '' THEN spdx_key ELSE 'LicenseRef-scancode-' || m.key END FROM m WHERE m.key = lower(spdx))) AS reporting_id FROM c GROUP BY 1""")
def spdx_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps of identifiers with their precedence, of licences made of the sources and languages."""
    metas = _docs(spark, sf_dir).groupBy("source").agg(F.sort_array(F.collect_set("lang")).alias("others"))
    metas = metas.select(F.concat("source", F.lit(".LICENSE")).alias("file"), F.col("source").alias("key"), F.expr("CASE WHEN source LIKE '%1%' THEN upper(source) WHEN source LIKE '%2' THEN 'SRC1' ELSE '' END").alias("spdx_key"), "others")
    keys, reported = rulefiles.mappings(metas)
    return keys.join(reported, F.col("spdx_lower") == F.col("key_lower"), "left").drop("key_lower")


@query(f"""WITH RECURSIVE {_SURVIVORS_SQL}, per AS (SELECT doc_id, expression, min((b_start, b_end, rule_id)) AS f, count(*) AS n FROM matched WHERE NOT is_clue GROUP BY doc_id, expression), dets AS (SELECT doc_id, string_agg(expression || ':' || n, ';' ORDER BY f, expression) AS detections FROM per GROUP BY doc_id), cl AS (SELECT doc_id, count(*) AS n FROM matched WHERE is_clue GROUP BY doc_id)
SELECT coalesce(d.doc_id, c.doc_id) AS doc_id, sha256(x.text) AS sha256, CAST(strlen(x.text) AS BIGINT) AS size, coalesce(detections, '') AS detections, CAST(coalesce(n, 0) AS BIGINT) AS clues FROM dets d FULL JOIN cl c ON c.doc_id = d.doc_id JOIN documents x ON x.doc_id = coalesce(d.doc_id, c.doc_id)""")
def report_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file records of a report: only of documents with a match, detections in order."""
    found = detect.results(_matches(spark, sf_dir)).join(_docs(spark, sf_dir), "doc_id")
    text = F.array_join(F.transform(F.coalesce("detections", F.array()), lambda d: F.concat(d["expression"], F.lit(":"), F.size(d["matches"]).cast("string"))), ";")
    return found.select("doc_id", F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("size"), text.alias("detections"), F.greatest(F.size("clues"), F.lit(0)).cast("long").alias("clues"))


@query(f"WITH {_CTE_FOUND}, l AS (SELECT DISTINCT doc_id, r.reported AS expression FROM found f JOIN rules r USING (rule_index) WHERE r.kind = 'notice') SELECT source, lang, quality, expression, CAST(count(*) AS BIGINT) AS documents, CAST(sum(n_chars) AS BIGINT) AS chars, CAST(grouping(source, lang, quality, expression) AS BIGINT) AS level FROM (SELECT doc_id, source, lang, n_chars, expression, CASE quality WHEN 1 THEN 'good' WHEN 0 THEN 'bad' END AS quality FROM l JOIN documents USING (doc_id) LEFT JOIN labels USING (doc_id)) GROUP BY CUBE (source, lang, quality, expression)")
def corpus_scale_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licensed documents by source, language, label and licence, with all subtotals."""
    notices = F.broadcast(rules.builtin(spark).where("kind = 'notice'").select("rule_index", F.col("reported_expression").alias("expression")))
    found = _candidates(spark, sf_dir).join(notices, "rule_index").select("doc_id", "expression").distinct()
    facts = _docs(spark, sf_dir).select("doc_id", "source", "lang", "n_chars").join(found, "doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return facts.cube("source", "lang", F.expr("CASE quality WHEN 1 THEN 'good' WHEN 0 THEN 'bad' END").alias("quality"), "expression").agg(F.count("*").alias("documents"), F.sum("n_chars").alias("chars"), F.grouping_id().alias("level"))
