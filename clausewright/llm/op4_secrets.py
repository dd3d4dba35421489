"""Secret scan: two character Markov models, of random strings and of ordinary identifiers, compared by log-likelihood ratio.

Candidates are the maximal runs of ``ALPHABET`` characters of ``MIN_LENGTH`` or more. Both models are of order two with interpolated
back-off, trained from labelled samples: a table or list of (text, is_secret), of which at most ``MAX_PER_CLASS`` rows a class are
taken, or by default those that ``labelled_samples`` makes. Shorter strings hold too little to tell the classes apart and are never
reported. A candidate is a
secret if the ratio of its likelihoods exceeds ``THRESHOLD`` nats in all and ``PER_CHAR`` for each character.

Defined results
* null or empty text, or one without candidates: no rows; null ``doc_id``: scanned like any other, with null id;
* repeated rows: each reports its secrets; a string that occurs several times: one row for each place; ties can't occur;
* samples of one class only: ValueError; extra columns are ignored; an empty table gives no rows. Offsets count code points.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausewright.llm import textvec
from clausewright.session import require

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
MIN_LENGTH = 16
THRESHOLD, PER_CHAR = 10.0, 0.5
MAX_PER_CLASS = 20_000
CANDIDATE = rf"[A-Za-z0-9+/_=-]{{{MIN_LENGTH},}}"
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("llr", T.DoubleType()), T.StructField("redacted", T.StringType()), T.StructField("digest", T.StringType())])
_CODE = np.full(128, -1)
_CODE[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET))
_N = len(ALPHABET)

_WORDS = """get set make build find load save read write open close create delete update remove insert append count index value key name
type class object string number integer double float array list map table column row field record schema query result error message
request response client server session user account password token secret config option setting default parameter argument function
method module package import export public private static final abstract interface service manager handler factory provider
controller repository component template render view model data source target input output stream buffer cache memory storage file
path directory system process thread task job queue event listener callback async wait start stop init shutdown connect network
socket http json xml html style color width height size length offset position date time stamp year month day hour minute second
license document language quality partition executor driver cluster spark frame window aggregate shuffle broadcast batch
the and with this that from which there their about would these other into could than first very after most also should
nicht eine einer werden haben sich auch nach wird wurde zwischen gesellschaft entwicklung verantwortung geschwindigkeit
dans pour avec sont cette comme entre gouvernement developpement responsabilite international environnement
para como pero este sobre entre desarrollo responsabilidad administracion conocimiento organizacion
tion ing ment able ness ship keit heit schaft ung lich ation mente cion aux eur ique""".split()

_SYLLABLES = "the an on th er in ed ti ha re nd es en at ou ing ion ly ble ea is or st nt sh wh he un que para ver sch ung heit keit lich ein der die und eau eux ment ille ier oi ai ch eur pas dad cion mente ado ido rra lla os as".split()


def labelled_samples(n: int = 4000, seed: int = 5) -> list[tuple[str, bool]]:
    """n random strings (hexadecimal, base 32, base 58, base 64, mixed with key prefixes) and n ordinary identifiers."""
    rng = random.Random(seed)
    sets = ["0123456789abcdef", "0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", ALPHABET[:62], ALPHABET[:64], "abcdefghijklmnopqrstuvwxyz0123456789"]
    out = []
    for _ in range(n):
        chars = rng.choice(sets)
        body = "".join(rng.choice(chars) for _ in range(rng.randint(16, 64)))
        out.append((rng.choice(["", "", "", "", "sk-", "ghp_", "AKIA"]) + body, True))
        words = [rng.choice(_WORDS) for _ in range(rng.randint(2, 7))]
        style = rng.randrange(7)
        if style == 0:
            text = "".join(w.capitalize() for w in words)
        elif style == 1:
            text = words[0] + "".join(w.capitalize() for w in words[1:])
        elif style == 2:
            text = "_".join(words)
        elif style == 3:
            text = "-".join(words)
        elif style == 4:
            text = "_".join(words).upper()
        elif style == 5:
            text = "/".join(words)
        else:
            text = "".join(words)  # long words of prose
        if style == 6 and rng.random() < 0.5:
            text = "".join(rng.choice(_SYLLABLES) for _ in range(rng.randint(5, 12)))
        if rng.random() < 0.2:
            text += rng.choice(["", "_", "-"]) + str(rng.randint(0, 2050))
        if rng.random() < 0.1:
            text = rng.choice("=-_") * rng.randint(4, 40) + rng.choice(["", text])
        out.append((text, False))
    out += [("".join(rng.choice("0123456789") for _ in range(rng.randint(8, 24))), False) for _ in range(n // 4)]
    for year in range(1990, 2031):  # dates, versions and plain numbers are ordinary
        out += [(f"{year}-{m:02}-{d:02}", False) for m in (1, 6, 12) for d in (1, 15, 28)] + [(f"{year}{m:02}{d:02}", False) for m in (2, 7, 11) for d in (3, 19)]
    return out


class Markov:
    """log P of each character given the two before it; orders 2, 1 and 0 are interpolated by their counts."""

    def __init__(self, texts: Iterable[str], strength: float = 3.0):
        start = _N
        three = np.zeros((_N + 1, _N + 1, _N))
        for text in texts:
            a = b = start
            for c in codes(text):
                three[a, b, c] += 1
                a, b = b, c
        two, one = three.sum(axis=0), three.sum(axis=(0, 1))
        p0 = (one + 0.5) / (one.sum() + 0.5 * _N)
        p1 = (two + strength * p0) / (two.sum(axis=1, keepdims=True) + strength)
        self.log_p = np.log((three + strength * p1[None]) / (three.sum(axis=2, keepdims=True) + strength)).astype(np.float32)


def codes(text: str) -> np.ndarray:
    """Places in the alphabet; what is not in it is left out."""
    raw = np.frombuffer(text.encode("ascii", "ignore"), np.uint8)
    found = _CODE[raw]
    return found[found >= 0]


class Ratio:
    """log P(text | random) - log P(text | ordinary)."""

    def __init__(self, samples: Iterable[tuple[str, bool]]):
        samples = list(samples)
        if len({bool(secret) for _, secret in samples}) < 2:
            raise ValueError("labelled samples of both classes are needed")
        self.table = Markov(t for t, s in samples if s).log_p - Markov(t for t, s in samples if not s).log_p

    def __call__(self, text: str) -> float:
        c = codes(text)
        a = np.concatenate(([_N, _N], c[:-2])) if len(c) > 1 else np.full(len(c), _N)
        b = np.concatenate(([_N], c[:-1]))
        return float(self.table[a[: len(c)], b[: len(c)], c].sum())

    def is_secret(self, text: str) -> bool:
        r = self(text)
        return r > THRESHOLD and r > PER_CHAR * len(text)


def bounded(table: DataFrame, per_class: int = MAX_PER_CLASS) -> list[tuple[str, bool]]:
    """At most ``per_class`` rows of each class of a labelled table (text, is_secret), chosen by a hash; nulls are left out."""
    rows = require(table, {"text": T.StringType(), "is_secret": T.BooleanType()}).where("text IS NOT NULL AND is_secret IS NOT NULL")
    rank = F.row_number().over(Window.partitionBy("is_secret").orderBy(F.xxhash64("text"), "text"))
    return [(r["text"], r["is_secret"]) for r in rows.withColumn("rank", rank).where(F.col("rank") <= per_class).orderBy("is_secret", "rank").collect()]


def scan(docs: DataFrame, samples: DataFrame | Iterable[tuple[str, bool]] | None = None) -> DataFrame:
    """One row for each secret. Texts without a candidate are dropped by the scan and never reach Python."""
    if isinstance(samples, DataFrame):
        samples = bounded(samples)
    ratio = docs.sparkSession.sparkContext.broadcast(Ratio(labelled_samples() if samples is None else samples))
    pattern = re.compile(CANDIDATE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textvec.sliced(batches):
            out: dict[str, list] = {f.name: [] for f in SCHEMA}
            for doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for m in pattern.finditer(text):
                    if ratio.value.is_secret(m[0]):
                        row = (doc, m.start(), m.end(), round(ratio.value(m[0]), 3), m[0][:4] + "*" * (len(m[0]) - 4), hashlib.sha256(m[0].encode()).hexdigest())
                        for column, x in zip(out.values(), row, strict=True):
                            column.append(x)
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out.values(), kinds, strict=True)], list(out))

    rows = require(docs, {"doc_id": T.LongType(), "text": T.StringType()})
    return rows.where(F.col("text").rlike(CANDIDATE)).mapInArrow(run, SCHEMA)
