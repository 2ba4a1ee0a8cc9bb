"""The scan as a column: one Arrow call for a batch of texts, matches as an array of structs."""

from __future__ import annotations

import hashlib
import pickle
from dataclasses import dataclass

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from termsieve.config import FuzzyOptions, NormalizeOptions

from .matcher import Hit, Matcher
from .views import fold, normalizer

MATCHES = (
    "array<struct<term_index:int,term:string,matched_text:string,category:string,severity:string,match_type:string,start:int,end:int>>"
)
_FIELDS = [
    ("term_index", pa.int32()), ("term", pa.string()), ("matched_text", pa.string()), ("category", pa.string()),
    ("severity", pa.string()), ("match_type", pa.string()), ("start", pa.int32()), ("end", pa.int32()),
]
_workers: dict[str, Matcher] = {}


class Shipped:
    """A matcher sent to the executors once; each worker compiles it once for each mode."""

    def __init__(self, spark: SparkSession, matcher: Matcher):
        data = pickle.dumps(matcher)
        self.name = hashlib.sha256(data).hexdigest()
        self.data: Broadcast = spark.sparkContext.broadcast(data)


def _matcher(name: str, data: Broadcast) -> Matcher:
    if name not in _workers:
        if len(_workers) >= 4:
            _workers.clear()
        _workers[name] = pickle.loads(data.value)
    return _workers[name]


@dataclass(frozen=True)
class ScanCall:
    """The arguments of one scan."""

    mode: str
    overlap: str
    categories: tuple[str, ...] | None = None
    max_matches: int | None = None
    allowlist: tuple[str, ...] = ()

    def hits(self, m: Matcher, text: str) -> list[Hit]:
        return m.scan(text, self.mode, self.overlap, self.categories, self.max_matches, self.allowlist)


def masked(text: str, hits: list[Hit], char: str) -> str:
    """text with every code point of the hits, in order of start, replaced."""
    out, at = [], 0
    for h in hits:
        if h.end > at:
            start = max(h.start, at)
            out += [text[at:start], char * (h.end - start)]
            at = h.end
    return "".join([*out, text[at:]]) if out else text


def _arrays(m: Matcher, texts: list[str | None], found: list[list[Hit] | None]) -> pa.Array:
    cols: list[list] = [[] for _ in _FIELDS]
    offsets: list[int | None] = [0]
    for text, hits in zip(texts, found, strict=True):
        if hits is None:
            offsets[-1], at = None, offsets[-1]
            offsets.append(at)
            continue
        for h in hits:
            t = m.terms[h.term]
            said = text[h.start : h.end]
            kind = "exact" if said == t.term else "fuzzy" if h.fuzzy else "normalized"
            for c, v in zip(cols, (h.term, t.term, said, t.category, t.severity, kind, h.start, h.end), strict=True):
                c.append(v)
        offsets.append(len(cols[0]))
    values = pa.StructArray.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(cols, _FIELDS, strict=True)], [n for n, _ in _FIELDS])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def scan_column(shipped: Shipped, text: Column, call: ScanCall) -> Column:
    """The text's matches in order; null for a null text."""
    name, data = shipped.name, shipped.data

    @F.arrow_udf(MATCHES)
    def scan(texts: pa.Array) -> pa.Array:
        m, listed = _matcher(name, data), texts.to_pylist()
        return _arrays(m, listed, [None if t is None else call.hits(m, t) for t in listed])

    return scan(text)


def mask_column(shipped: Shipped, text: Column, call: ScanCall, char: str) -> Column:
    """The masked text alone, in time linear in text and matches."""
    name, data = shipped.name, shipped.data

    @F.arrow_udf("string")
    def mask(texts: pa.Array) -> pa.Array:
        m = _matcher(name, data)
        return pa.array([None if t is None else masked(t, call.hits(m, t), char) for t in texts.to_pylist()], pa.string())

    return mask(text)


def scan_and_mask_column(shipped: Shipped, text: Column, call: ScanCall, char: str) -> Column:
    """(matches, masked_text) from one scan."""
    name, data = shipped.name, shipped.data

    @F.arrow_udf(f"struct<matches:{MATCHES},masked_text:string>")
    def scan(texts: pa.Array) -> pa.Array:
        m, listed = _matcher(name, data), texts.to_pylist()
        found = [None if t is None else call.hits(m, t) for t in listed]
        hidden = pa.array([None if t is None else masked(t, h, char) for t, h in zip(listed, found, strict=True)], pa.string())
        return pa.StructArray.from_arrays([_arrays(m, listed, found), hidden], ["matches", "masked_text"])

    return scan(text)


def normalize_column(text: Column, options: NormalizeOptions | None = None, pinned: bool = False) -> Column:
    """The normal form. Pinned, it is worked out where it stands: filters on it aren't moved below aggregates, to more rows."""
    o = options or NormalizeOptions()

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        string = normalizer(o).string
        return pa.array([None if t is None else string(t) for t in texts.to_pylist()], pa.string())

    return (run.asNondeterministic() if pinned else run)(text)


def fold_column(text: Column, options: NormalizeOptions | None = None, fuzzy: FuzzyOptions | None = None) -> Column:
    o, f = options or NormalizeOptions(), fuzzy or FuzzyOptions()

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        view = normalizer(o).view
        return pa.array([None if t is None else fold(view(t), f).text for t in texts.to_pylist()], pa.string())

    return run(text)


def register(spark: SparkSession) -> None:
    """normalize_text(text) and fuzzy_fold_text(text) for SQL, with the default options."""

    @F.arrow_udf("string")
    def normalize_text(texts: pa.Array) -> pa.Array:
        string = normalizer(NormalizeOptions()).string
        return pa.array([None if t is None else string(t) for t in texts.to_pylist()], pa.string())

    @F.arrow_udf("string")
    def fuzzy_fold_text(texts: pa.Array) -> pa.Array:
        view = normalizer(NormalizeOptions()).view
        return pa.array([None if t is None else fold(view(t), FuzzyOptions()).text for t in texts.to_pylist()], pa.string())

    spark.udf.register("normalize_text", normalize_text)
    spark.udf.register("fuzzy_fold_text", fuzzy_fold_text)
