"""Exact matching: whole texts, and passages by seed or by automaton, in one narrow pass over the documents.

Each document stays one row until its candidates are known: ``hits`` reads and tokenises a text once, and only documents with a
candidate go on, with their candidates in an array. No text and no token array is ever shuffled.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from weakref import WeakKeyDictionary

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausewright.functions.tokens import offsets, once, token_hash, tokens

MAX_CANDIDATES = 100_000
#: Dictionaries of at most so many rules are matched by seeds inside the JVM, larger ones by an automaton on the workers.
SEED_RULES = 500
HIT = "array<struct<rule_index:int,tok_start:int,tok_end:int>>"
_KINDS = pa.list_(pa.struct([("rule_index", pa.int32()), ("tok_start", pa.int32()), ("tok_end", pa.int32())]))


class Dictionary:
    """What matching needs of a rule table, collected once: a dictionary is small, 100,000 rules at most."""

    def __init__(self, rules: DataFrame):
        rows = sorted(rules.select("rule_index", "tokens", "expression", "flags").collect(), key=lambda r: r["rule_index"])
        self.facts = {r["rule_index"]: (r["expression"], r["flags"]) for r in rows}
        self.words = {r["rule_index"]: list(r["tokens"]) for r in rows if r["tokens"]}
        counts = Counter(w for words in self.words.values() for w in words)
        #: For each word that is the rarest of a rule: (rule, its place in the rule).
        self.seeds: dict[str, list[tuple[int, int]]] = {}
        self.whole: dict[str, list[int]] = {}
        for rule, words in self.words.items():
            place = min(range(len(words)), key=lambda i: (counts[words[i]], i))
            self.seeds.setdefault(words[place], []).append((rule, place))
            self.whole.setdefault(" ".join(words), []).append(rule)


_known: WeakKeyDictionary[DataFrame, Dictionary] = WeakKeyDictionary()


def dictionary(rules: DataFrame) -> Dictionary:
    if rules not in _known:
        _known[rules] = Dictionary(rules)
    return _known[rules]


def doc_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(F.col(key).alias("doc_id"), tokens(F.col(text)).alias("tokens")).withColumn("n_tokens", F.size("tokens"))


def same_text(words: DataFrame) -> DataFrame:
    """(doc_id, first, n_tokens): for each document with words the least id among those of the same words. The join is on a digest
    of the words, so that they are shuffled as 32 bytes; a digest that many documents share is pre-aggregated on its way."""
    keyed = words.where("n_tokens > 0").select("doc_id", "n_tokens", token_hash(F.col("tokens")).alias("digest"))
    first = keyed.groupBy("digest").agg(F.min("doc_id").alias("first"))
    return keyed.join(first, "digest").select("doc_id", "first", "n_tokens")


def _table(pairs: dict, value: str) -> Column:
    """A constant map of words to arrays of structs or numbers, written as SQL."""
    keys = ", ".join(_text(k) for k in pairs)
    return F.expr(f"map_from_arrays(array({keys}), array({', '.join(f'array({', '.join(v)})' for v in pairs.values())}))" if pairs else f"map('', CAST(array() AS {value}))")


def _text(word: str) -> str:
    return "'" + word.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _by_seed(docs: DataFrame, known: Dictionary) -> DataFrame:
    """Texts without a seed word fall out right after the tokeniser; in the others the rules of a seed are compared at its places."""
    seeds = _table({w: [f"named_struct('rule', {r}, 'place', {p}, 'n', {len(known.words[r])}, 'words', array({', '.join(map(_text, known.words[r]))}))" for r, p in found] for w, found in known.seeds.items()}, "array<struct<rule:int,place:int,n:int,words:array<string>>>")
    whole = _table({t: [str(r) for r in found] for t, found in known.whole.items()}, "array<int>")
    names = [F.lit(w) for w in known.seeds]
    rows = once(docs, "tokens", tokens(F.col("text"))).where(F.arrays_overlap("tokens", F.array(*names)))
    n = F.size("tokens")
    places = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.element_at("tokens", i + 1).isin(*known.seeds))

    def at(i: Column) -> Column:
        fits = lambda r: (i >= r["place"]) & (i - r["place"] + r["n"] <= n) & (F.slice("tokens", F.greatest(i - r["place"] + 1, F.lit(1)), r["n"]) == r["words"])
        found = F.filter(F.element_at(seeds, F.element_at("tokens", i + 1)), fits)
        return F.transform(found, lambda r: F.struct(r["rule"].alias("rule_index"), (i - r["place"]).alias("tok_start"), (i - r["place"] + r["n"]).alias("tok_end")))

    rows = once(rows, "equal", F.element_at(whole, F.array_join("tokens", " ")))
    equal = F.transform("equal", lambda r: F.struct(r.alias("rule_index"), F.lit(0).alias("tok_start"), n.alias("tok_end")))
    found = F.when(F.col("equal").isNotNull(), equal).otherwise(F.flatten(F.transform(places, at))).cast(HIT)
    rows = once(rows.withColumn("method", F.when(F.col("equal").isNotNull(), "hash").otherwise("exact")), "hits", found)
    return rows.where(F.size("hits") > 0).select("doc_id", "text", "method", "hits")


def _by_automaton(docs: DataFrame, known: Dictionary) -> DataFrame:
    """One pass over each token sequence with an Aho-Corasick automaton of all rules."""
    machine = ahocorasick.Automaton()
    for text, found in known.whole.items():
        machine.add_word(f" {text} ", (len(text) + 2, text.count(" ") + 1, found))
    machine.make_automaton()
    shared = docs.sparkSession.sparkContext.broadcast((machine, known.whole))
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("method", T.StringType()), T.StructField("hits", T.ArrayType(T.StructType([T.StructField(x, T.IntegerType()) for x in ("rule_index", "tok_start", "tok_end")])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, whole = shared.value
        for batch in batches:
            kept, methods, hits = [], [], []
            for k, joined in enumerate(batch.column(2)):
                words = joined.as_py()
                if words in whole:
                    n = words.count(" ") + 1
                    rows, method = [(i, 0, n) for i in whole[words]], "hash"
                else:
                    rows, method, at, token = [], "exact", 0, 0
                    text = f" {words} "
                    for end, (_, n, found) in machine.iter(text):
                        token += text.count(" ", at, end + 1)  # of the spaces up to here, one lies before the first token
                        at = end + 1
                        rows += [(i, token - 1 - n, token - 1) for i in found]
                if rows:
                    kept.append(k)
                    methods.append(method)
                    hits.append([dict(zip(("rule_index", "tok_start", "tok_end"), r, strict=True)) for r in rows])
            some = batch.take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(methods, pa.string()), pa.array(hits, _KINDS)], schema.names)

    return docs.select("doc_id", "text", F.array_join(tokens(F.col("text")), " ").alias("joined")).where("joined <> ''").mapInArrow(run, schema)


def hits(docs: DataFrame, rules: DataFrame, method: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, method, hits) of the documents with a candidate: every (rule, place) where a rule's tokens occur. A
    document that is a rule as a whole gets its hash matches only."""
    known = dictionary(rules)
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    if not known.words:
        return docs.limit(0).select("doc_id", "text", F.lit("exact").alias("method"), F.array().cast(HIT).alias("hits"))
    if method is None:
        method = "seed" if len(known.words) <= SEED_RULES else "automaton"
    return _by_seed(docs, known) if method == "seed" else _by_automaton(docs, known)


def candidates(found: DataFrame) -> DataFrame:
    """doc_id, rule_index, tok_start, tok_end and method, one row for each hit, and what else the hits hold (``placed``)."""
    more = [n for n in found.schema["hits"].dataType.elementType.names if n not in ("rule_index", "tok_start", "tok_end")]
    return found.select("doc_id", "method", F.inline("hits")).select("doc_id", "rule_index", "tok_start", "tok_end", "method", *more)


def over_limit(found: DataFrame, limit: int = MAX_CANDIDATES) -> DataFrame:
    """Documents with more candidates than are allowed, which is an error of that document; exactly ``limit`` is allowed."""
    return found.select("doc_id", F.size("hits").cast("long").alias("candidates")).where(F.col("candidates") > limit)


def within_limit(found: DataFrame, limit: int = MAX_CANDIDATES) -> DataFrame:
    """The documents that ``over_limit`` doesn't name."""
    return found.where(F.size("hits") <= limit)


def placed(found: DataFrame, matched: bool = False) -> DataFrame:
    """``hits`` without the text: each hit holds its bytes ``start`` and ``end`` in it, and those bytes as ``matched`` if asked for. So
    what comes after, in Python as well, has nothing of the size of a text."""
    rows = once(once(found, "parts", offsets(F.col("text"))), "sums", offsets.sums(F.col("parts")))
    begin = lambda h: offsets.end(h["tok_start"] + 1) - F.element_at("parts", h["tok_start"] + 1)["word"]
    hits = F.transform("hits", lambda h: F.struct(h["rule_index"].alias("rule_index"), h["tok_start"].alias("tok_start"), h["tok_end"].alias("tok_end"), begin(h).cast("long").alias("start"), offsets.end(h["tok_end"]).cast("long").alias("end")))
    if matched:
        data = lambda h: F.decode(F.substring(F.col("text").cast("binary"), (h["start"] + 1).cast("int"), (h["end"] - h["start"]).cast("int")), "UTF-8")
        hits = F.transform(hits, lambda h: F.struct(*[h[n].alias(n) for n in ("rule_index", "tok_start", "tok_end", "start", "end")], data(h).alias("matched")))
    return rows.select("doc_id", "method", hits.alias("hits"))


def located(found: DataFrame, matched: bool = False) -> DataFrame:
    """``candidates`` with their bytes ``start`` and ``end`` in the text, and those bytes as ``matched`` if asked for."""
    return candidates(placed(found, matched))
