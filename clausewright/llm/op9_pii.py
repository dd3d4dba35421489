"""Personal identifiers by bootstrapped contextual extraction.

1. Candidates: every run of a text that could be an identifier (an address with ``@``, a number of 7 digits or more with its
   separators, a long token of letters and digits; a name and ``=`` before it are not part of it), with its lexical patterns: the words left and right of it, alone and with
   its shape. Shape alone is no pattern: it can't tell a card number from any other number of 16 digits.
2. Seeds: candidates that a strict validator of a type accepts (mail address, IPv4 address, phone number with country code, card
   number with a correct check digit, a token assigned to a secret's name). Numbers that are plainly something else (dates, times,
   numbers written like a card's whose check digit is wrong) are negative seeds.
3. Spark scores the bipartite graph of patterns and instances for ``ROUNDS`` rounds. A pattern's confidence for a type is the
   mass of its instances of that type over that mass, the mass of other types and ``UNKNOWN`` (all) of the rest; only patterns that
   ``SUPPORT`` distinct seeds or accepted instances share count. An instance's score is 1 - prod(1 - confidence) over its patterns
   of confidence ``PATTERN_MIN`` or more. Seeds keep score 1.
4. Instances of score ``ACCEPT`` or more are identifiers, so numbers and tokens that no validator knows are found by pattern.

Defined results
* null or empty text: no rows; null ``doc_id``: found like any other, with null id; repeated rows: each reports its identifiers;
* two types of equal score: the first by name; overlapping candidates: addresses first, then the leftmost, in the order of the
  grammar; digits are those of any script; patterns are made of the words within ``CONTEXT`` characters of a candidate, and of
  the first ``WORD`` characters of each (the candidate itself is never cut);
* extra columns are ignored (``mask`` keeps them); an empty table gives no rows. Offsets count code points.
"""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausewright.llm import textvec
from clausewright.session import cut, require

ROUNDS = 3
SUPPORT = 5
UNKNOWN = 1.0
PATTERN_MIN, ACCEPT = 0.6, 0.8
#: Accepted spans of at most so many rows are broadcast to the texts; more are joined by shuffle.
BROADCAST_ROWS = 200_000
TYPES = ("card", "credential", "email", "ip", "phone")

#: Characters to each side of a candidate that its words are taken from.
CONTEXT, WORD = 80, 40
_SIDE = re.compile(r"""[^\s@<>"'|,;()\[\]{}]+""")
CANDIDATE = re.compile(
    r"""(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d)"""
    r"""|(?<![\w+])\+?\d{1,3}[ .-]?\(\d{2,4}\)[ .-]?\d{2,4}(?:[ .-]\d{2,4}){1,3}(?!\w)"""
    r"""|(?<!\w)\d{4}(?:[ -]\d{4}){3}(?!\w)"""
    r"""|[A-Za-z0-9_+/-]{16,}={0,2}(?![A-Za-z0-9_+/=-])|[A-Za-z0-9_+/-]{16,}"""
    r"""|(?<![\w+])\+?\d+(?:[ .:/-]\d+)*(?!\w)"""
)
_EMAIL = re.compile(r"[\w.+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}")
_PHONE = re.compile(r"\+\d{1,3}[ .-]?\(\d{2,4}\)[ .-]?\d{2,4}(?:[ .-]\d{2,4}){1,3}|\+\d{1,3}(?:[ .-]\d{2,4}){2,4}")
#: Written like a card number; numbers that begin with 00 may be phone numbers.
_CARD_LENGTH = re.compile(r"(?!00)\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5}")
_DATE = re.compile(r"\d{4}[-/.]\d{1,2}[-/.]\d{1,2}(?:[ T]\d{1,2}(?::\d{2}){1,2})?|\d{1,2}[-/.]\d{1,2}[-/.]\d{4}|\d{1,2}(?::\d{2}){1,2}")
_NAMED = r"(?:api[_-]?key|access[_-]?key|token|secret|passwd|password|auth)[\"']?\s*[:=]"
_SECRET = re.compile(_NAMED + r"\s*[\"']?$", re.I)
#: Texts without a match hold no candidate; neither Python nor the masking sees them.
SUSPECT = r"[\p{Nd}@]|(?i:" + _NAMED + ")"
_STRIP = ".,;:!?*#$%&"
OCCURRENCE = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text_hash", T.LongType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("instance", T.LongType()), T.StructField("seed", T.StringType()), T.StructField("masked", T.StringType()), T.StructField("patterns", T.ArrayType(T.LongType()))]
)


def luhn(digits: str) -> bool:
    odd = digits[-1::-2]
    even = digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def shape(value: str) -> str:
    """Digits d (four or more: their number), letters a, the rest as it is; what is left of an @ counts as one sign."""
    head, at, tail = value.rpartition("@")
    value = f"L@{re.sub(r'[^\W_]+', 'a', tail)}" if at else value
    if at:
        return value
    if re.fullmatch(r"[A-Za-z0-9_+/=-]{16,}", value) and re.search(r"[A-Za-z]", value):
        kind = "hex" if re.fullmatch(r"[0-9a-fA-F]+", value) else "token"
        return f"{kind}{len(value)}"
    return re.sub(r"\d+", lambda m: "d" if len(m[0]) < 4 else f"D{len(m[0])}", re.sub(r"[^\W\d_]+", "a", value))


def seed_type(value: str, left: str) -> str | None:
    """The type that a strict validator gives the candidate, 'other' for what is plainly no identifier, None for the unknown."""
    if "@" in value:
        return "email" if _EMAIL.fullmatch(value) else None
    if _SECRET.search(left) and len(value) >= 16:
        return "credential"
    if re.fullmatch(r"\d{1,3}(?:\.\d{1,3}){3}", value):
        try:
            return "ip" if not ipaddress.ip_address(value).is_unspecified else None
        except ValueError:
            return None
    if _DATE.fullmatch(value):
        return "other"
    if _PHONE.fullmatch(value):
        return "phone"
    digits = re.sub(r"[ -]", "", value)
    if re.fullmatch(r"[3-6]\d{12,18}", digits) and luhn(digits):
        return "card"
    return "other" if _CARD_LENGTH.fullmatch(value) and not luhn(digits) else None


def _word(text: str, last: bool) -> str:
    parts = text.split()
    if not parts:
        return "^" if last else "$"
    word = parts[-1] if last else parts[0]
    return re.sub(r"\d+", "0", word.lower())[:WORD]


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    """What surrounds each @ up to white space, brackets, quotes and the like; each sign is looked at once or twice."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and _SIDE.match(text[start - 1]):
            start -= 1
        right = _SIDE.match(text, at + 1)
        if start < at and right:
            yield start, right.end()
        done = right.end() if start < at and right else at + 1
        at = text.find("@", done)


def _places(text: str) -> Iterator[tuple[int, int]]:
    """Addresses, and between them all else that could be an identifier."""
    at = 0
    for start, end in _addresses(text):
        yield from (m.span() for m in CANDIDATE.finditer(text, at, start))
        yield start, end
        at = end
    yield from (m.span() for m in CANDIDATE.finditer(text, at))


def candidates(text: str) -> Iterator[tuple[int, int, str, str | None, list[str]]]:
    """(start, end, value, seed type, patterns) of every candidate, from left to right. Linear in the length of the text."""
    for begin, stop in _places(text):
        whole = text[begin:stop]
        value = whole.strip(_STRIP) if "@" in whole else whole
        digits = sum(c.isdigit() for c in value)
        named = len(value) >= 16 and bool(_SECRET.search(text[max(0, begin - CONTEXT) : begin]))
        if not value or ("@" not in value and not named and (digits < 7 if len(value) < 16 or not re.search("[A-Za-z]", value) else digits < 4)) and not re.fullmatch(r"\d+(?:\.\d+){3}", value):
            continue
        start = begin + whole.index(value)
        end = start + len(value)
        left, right = text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]
        form, before, after = shape(value), _word(left, True), _word(right, False)
        kind = form[0] if form[0] in "Lht" else "n"
        previous = _word(left.rstrip()[: len(left.rstrip()) - len(left.split()[-1])], True) if left.split() else "^"
        patterns = [f"LS {before} {form}", f"RS {after} {form}", f"LL {previous} {before} {kind}", f"LR {before} {after} {kind}"]
        yield start, end, value, seed_type(value, left), patterns


def mask_value(value: str) -> str:
    return value[0] + re.sub(r"\w", "*", value[1:-1]) + value[-1] if len(value) > 2 else "*" * len(value)


def occurrences(docs: DataFrame) -> DataFrame:
    """One row for each candidate. Texts without a digit, @ or secret's name are dropped by the scan and never reach Python."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signed = lambda s: xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass")) - (1 << 63)
        for batch in textvec.sliced(batches):
            out: dict[str, list] = {f.name: [] for f in OCCURRENCE}
            for doc, mark, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for start, end, value, seed, patterns in candidates(text):
                    row = (doc, mark, start, end, signed(value.lower()), seed, mask_value(value), [signed(p) for p in patterns])
                    for column, x in zip(out.values(), row, strict=True):
                        column.append(x)
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out.values(), kinds, strict=True)], list(out))

    rows = require(docs, {"doc_id": T.LongType(), "text": T.StringType()})
    return rows.where(F.col("text").rlike(SUSPECT)).select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, OCCURRENCE)


def score(found: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(instance, type, score) of every instance that has a score, after ``rounds`` rounds over the graph."""
    edges = cut(found.select("instance", F.explode("patterns").alias("pattern")).distinct(), "pattern-edges")
    seeds = cut(found.where("seed IS NOT NULL").groupBy("instance").agg(F.min("seed").alias("type")).withColumn("score", F.lit(1.0)), "seeds")
    known = seeds
    for _ in range(rounds):
        mass = edges.join(known, "instance", "left").groupBy("pattern", "type").agg(F.count("*").alias("n"), F.sum("score").alias("mass"))
        totals = mass.groupBy("pattern").agg(F.sum("n").alias("all"), F.sum(F.coalesce("mass", F.lit(0.0))).alias("known"))
        belief = mass.where("type IS NOT NULL AND type <> 'other'").join(totals, "pattern")
        confidence = F.col("mass") / (F.col("known") + UNKNOWN * F.greatest(F.col("all") - F.col("known"), F.lit(0.0)))
        belief = belief.where(F.col("mass") >= SUPPORT).select("pattern", "type", confidence.alias("confidence")).where(F.col("confidence") >= PATTERN_MIN)
        doubt = F.least(F.col("confidence"), F.lit(1 - 1e-9))
        reached = edges.join(belief, "pattern").groupBy("instance", "type").agg((1 - F.exp(F.sum(F.log(1 - doubt)))).alias("score"))
        fresh = reached.join(seeds.select("instance"), "instance", "left_anti")
        best = fresh.groupBy("instance").agg(F.max_by(F.struct("type", "score"), F.struct(F.col("score"), -F.ascii("type"), F.col("type"))).alias("b")).select("instance", "b.type", "b.score")
        known = cut(seeds.unionByName(best), "scores")
    return known


def identifiers(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, start, end, type, masked, score and is_seed of every identifier, with the hash of its text."""
    found = cut(occurrences(docs), "occurrences")
    accepted = score(found, rounds).where((F.col("score") >= ACCEPT) & (F.col("type") != "other"))
    return found.join(accepted, "instance").select("doc_id", "text_hash", "start", "end", "type", "masked", F.round("score", 6).alias("score"), F.coalesce(F.col("seed") == F.col("type"), F.lit(False)).alias("is_seed"))


def find(docs: DataFrame) -> DataFrame:
    return identifiers(docs).drop("text_hash")


def masked_text(text: str, spans: list[dict]) -> str:
    parts, at = [], 0
    for s in spans:
        parts += [text[at : s["start"]], "<", s["type"].upper(), ">"]
        at = s["end"]
    return "".join([*parts, text[at:]])


def mask(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with each identifier in ``text`` replaced by its type in angle brackets; other columns as they are."""
    spans = identifiers(docs).groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set(F.struct("start", "end", "type"))).alias("spans"))
    spans = cut(spans, "spans").alias("s")
    size = spans.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("spans")), F.lit(0)).alias("spans")).first()
    # columns go by place, so that no name of theirs meets one of ours
    names, text = [f"c{k}" for k in range(len(docs.columns))], f"c{docs.columns.index('text')}"
    held = docs.select(*[docs[c].alias(n) for c, n in zip(docs.columns, names, strict=True)], docs["doc_id"].cast("long").alias("id"), docs["text"].cast("string").alias("of"))
    if size["n"] + size["spans"] <= BROADCAST_ROWS:
        spans, rest = F.broadcast(spans), None
    else:  # only texts that may hold an identifier are shuffled
        suspect = F.coalesce(F.col("of").rlike(SUSPECT), F.lit(False))
        held, rest = held.where(suspect), held.where(~suspect)
    held = held.withColumn("hash", F.xxhash64("of")).alias("d")
    match = F.expr("d.hash = s.text_hash AND d.id <=> s.doc_id")
    kinds = docs.select(*[docs[c].alias(n) for c, n in zip(docs.columns, names, strict=True)]).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index(text)
        for batch in textvec.sliced(batches):
            fresh = [masked_text(t, s) for t, s in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist(), strict=True)]
            columns = batch.columns[: len(names)]
            columns[at] = pa.array(fresh, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    changed = held.join(spans, match).select(*names, "spans").mapInArrow(run, kinds)
    found = held.join(spans, match, "left_anti").select(*names).unionByName(changed)
    if rest is not None:
        found = found.unionByName(rest.select(*names))
    return found.toDF(*docs.columns)
