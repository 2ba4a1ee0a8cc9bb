"""Lexicons: from in-memory terms, the column-oriented JSON artifact, or Parquet; overrides beside them."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termsieve.config import LANGUAGES, SEVERITIES, LexiconLoadError
from termsieve.operators.scan import normalize_column

CATEGORY = "id string, display_name string, severity string, source_path string, source string, term_count long, default_enabled boolean, description string"
SOURCE = "path string, name string, category string, term_count long, sha256 string"
ENTRY = (
    "term_index int, id string, term string, normalized string, language string, category string, severity string, source string, "
    "source_path string, upstream_commit string, needs_review boolean, also_found_in array<string>"
)
_BLANKS = "\t\n\x0b\x0c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


@dataclass
class Lexicon:
    """Entries in term_index order, categories, sources, and what goes with them."""

    entries: DataFrame
    categories: DataFrame
    sources: DataFrame
    version: str = "inline"
    upstream_commit: str | None = None
    synced_at: str | None = None
    built_at: str = ""
    total_term_count: int = 0
    allowlist: tuple[str, ...] = ()
    custom_terms: tuple[tuple[str, str, str], ...] = ()
    again: Callable[[], Lexicon] = field(default=None, repr=False)

    def __post_init__(self):
        if self.again is None:
            self.again = lambda: self

    def check_size(self, most: int) -> int:
        n = self.entries.count()
        if n > most:
            raise LexiconLoadError(f"{n} terms; at most {most} can be compiled")
        return n

    def category_ids(self) -> list[str]:
        return [r["id"] for r in self.categories.select("id").collect()]

    def metadata(self) -> DataFrame:
        """One row: version, commit, times, counts, categories and sources."""
        struct = lambda df: F.struct(*df.columns)
        cats = self.categories.agg(F.array_sort(F.collect_list(struct(self.categories))).alias("categories"))
        srcs = self.sources.agg(F.array_sort(F.collect_list(struct(self.sources))).alias("sources"))
        count = self.entries.agg(F.count("*").alias("term_count"))
        text = lambda v: F.lit(v).cast("string")
        return count.crossJoin(cats).crossJoin(srcs).select(
            text(self.version).alias("version"), text(self.upstream_commit).alias("upstream_commit"), text(self.synced_at).alias("synced_at"),
            text(self.built_at).alias("built_at"), "term_count", F.lit(self.total_term_count).cast("long").alias("total_term_count"), "categories", "sources",
        )

    @classmethod
    def from_terms(cls, spark: SparkSession, terms: Iterable[object], allowlist: tuple[str, ...] = ()) -> Lexicon:
        """Strings or (term[, category[, severity]]); category `custom` and severity `medium` where missing."""
        rows = []
        for i, t in enumerate(terms):
            term, category, severity = (*((t,) if isinstance(t, str) else tuple(t)), None, None)[:3]
            category, severity = category or "custom", severity or "medium"
            if severity not in SEVERITIES:
                raise LexiconLoadError(f"unsupported severity: {severity}")
            rows.append((i, f"{category}:{i}", term, None, None, category, severity, "inline", "inline", None, False, None))
        entries = spark.createDataFrame(rows, ENTRY)
        counts: dict[str, list] = {}
        for r in rows:
            c = counts.setdefault(r[5], [r[6], 0])
            c[1] += 1
        cats = [(k, k, v[0], "inline", "inline", v[1], True, None) for k, v in sorted(counts.items())]
        return cls(entries, spark.createDataFrame(cats, CATEGORY), spark.createDataFrame([], SOURCE), total_term_count=len(rows), allowlist=tuple(allowlist))

    @classmethod
    def from_frames(cls, entries: DataFrame, categories: DataFrame, sources: DataFrame | None = None, **more) -> Lexicon:
        """Over DataFrames as they are, such as tables in Parquet; columns by the names of ENTRY, CATEGORY, SOURCE."""
        spark = entries.sparkSession
        total = more.pop("total_term_count", None)
        return cls(entries, categories, sources if sources is not None else spark.createDataFrame([], SOURCE), total_term_count=entries.count() if total is None else total, **more)


def read_whole(spark: SparkSession, path: str) -> str | None:
    """A text file's content, or None where there is none."""
    try:
        row = spark.read.text(path, wholetext=True).first()
    except AnalysisException:
        return None
    return row[0] if row is not None else ""


def check_artifact(value: object) -> dict:
    """The artifact if it has the fields of format 1."""
    if not isinstance(value, dict):
        raise LexiconLoadError("a lexicon has to be a JSON object")
    if value.get("formatVersion") != 1:
        raise LexiconLoadError(f"lexicons of format {value.get('formatVersion')} can't be read, only those of format 1")
    kinds = dict.fromkeys(("version", "builtAt", "terms", "categoryIndex", "severityIndex", "languageIndex", "flags"), str) | {"categories": list, "termCount": (int, float)}
    for name, kind in kinds.items():
        if not isinstance(value.get(name), kind) or isinstance(value.get(name), bool):
            raise LexiconLoadError(f"the lexicon lacks {name}, or it is of the wrong type")
    return value


def select_categories(requested: list[str] | tuple[str, ...] | None, categories: list[dict]) -> set[str] | None:
    """The ids to load, or None for all: `*` is all, nothing or `all` the enabled ones, else those named."""
    if requested and "*" in requested:
        return None
    if not requested or "all" in requested:
        enabled = {c["id"] for c in categories if c.get("defaultEnabled") is not False}
        return None if len(enabled) == len(categories) else enabled
    known = {c["id"] for c in categories}
    for c in requested:
        if c not in known:
            raise LexiconLoadError(f"unknown category: {c}")
    return set(requested)


def load_artifact(
    spark: SparkSession, path: str, categories: list[str] | None = None, include_needs_review: bool = False, min_term_length: int = 2,
    allowlist_path: str | None = None, custom_terms_path: str | None = None,
) -> Lexicon:
    """Read, validate and filter an artifact."""
    raw = read_whole(spark, path)
    if raw is None:
        raise LexiconLoadError("cannot read lexicon artifact")
    try:
        art = json.loads(raw)
    except ValueError as e:
        raise LexiconLoadError("lexicon artifact is not valid JSON") from e
    lexicon = lexicon_from_artifact(spark, art, categories, include_needs_review, min_term_length)
    lexicon.allowlist, lexicon.custom_terms = tuple(read_allowlist(spark, allowlist_path)), tuple(read_custom_terms(spark, custom_terms_path))
    lexicon.again = lambda: load_artifact(spark, path, categories, include_needs_review, min_term_length, allowlist_path, custom_terms_path)
    return lexicon


def lexicon_from_artifact(
    spark: SparkSession, value: object, categories: list[str] | None = None, include_needs_review: bool = False, min_term_length: int = 2
) -> Lexicon:
    """Validate and filter an artifact; columns are decoded and filtered by Spark."""
    art = check_artifact(value)
    listed = lambda v, sep: v.split(sep) if v else []
    total = len(listed(art["terms"], "\n"))
    if total != art["termCount"]:
        raise LexiconLoadError(f"the lexicon says it has {art['termCount']} terms, but has {total}")
    names = ("categoryIndex", "severityIndex", "languageIndex", "flags")
    for name in names:
        values = listed(art[name], ",")
        if total and len(values) != total:
            raise LexiconLoadError(f"{name} has {len(values)} values for {total} terms")
        if total and not all(v.strip().lstrip("-").isdigit() for v in values):
            raise LexiconLoadError(f"{name} holds something that is no number")
    cats = art["categories"]
    if total:
        for i, v in enumerate(listed(art["categoryIndex"], ",")):
            if not 0 <= int(v) < len(cats):
                raise LexiconLoadError(f"term {i} is in a category that the lexicon doesn't have")
    wanted = select_categories(categories, cats)
    one = spark.createDataFrame([(art["terms"], *(art[n] for n in names))], "terms string, category string, severity string, language string, flags string")
    numbers = [F.transform(F.split(n, ","), lambda v: v.cast("int")).alias(n) for n in ("category", "severity", "language", "flags")]
    rows = one.where("terms <> ''").select(F.posexplode(F.arrays_zip(F.split("terms", "\n").alias("term"), *numbers)).alias("term_index", "r")).select("term_index", "r.*")
    dim = spark.createDataFrame(
        [(i, c["id"], c.get("severity", "low"), c.get("source"), c.get("sourcePath")) for i, c in enumerate(cats)],
        "position int, category_id string, category_severity string, source string, source_path string",
    )
    also = {int(k): v for k, v in (art.get("alsoFoundIn") or {}).items() if v}
    more = spark.createDataFrame(sorted(also.items()), "term_index int, also_found_in array<string>")
    pick = lambda values, at: F.try_element_at(F.array(*[F.lit(v) for v in values]), F.when(at >= 0, at + 1).otherwise(len(values) + 1))
    kept = rows.join(F.broadcast(dim), rows.category == dim.position)
    if wanted is not None:
        kept = kept.where(F.col("category_id").isin(*sorted(wanted)) if wanted else F.lit(False))
    kept = kept.withColumn("needs_review", F.col("flags").bitwiseAND(1) == 1)
    if not include_needs_review:
        kept = kept.where(~F.col("needs_review"))
    kept = kept.where(F.length("term") >= min_term_length).withColumn("normalized", normalize_column(F.col("term"))).where("normalized <> ''")
    commit = art.get("upstreamCommit")
    entries = kept.join(more, "term_index", "left").select(
        "term_index", F.concat_ws(":", "category_id", "term_index").alias("id"), "term", "normalized",
        F.coalesce(pick(LANGUAGES, F.col("language")), F.lit("other")).alias("language"), F.col("category_id").alias("category"),
        F.coalesce(pick(SEVERITIES, F.col("severity")), F.col("category_severity")).alias("severity"), "source", "source_path",
        F.lit(commit).cast("string").alias("upstream_commit"), "needs_review", "also_found_in",
    )
    counts = entries.groupBy("category").agg(F.count("*").alias("loaded"))
    frame = spark.createDataFrame(
        [(c["id"], c.get("displayName"), c.get("severity"), c.get("sourcePath"), c.get("source"), 0, c.get("defaultEnabled") is not False, c.get("description")) for c in cats], CATEGORY
    )
    frame = frame.join(counts, frame.id == counts.category, "left").withColumn("term_count", F.coalesce("loaded", F.lit(0)).cast("long")).drop("loaded", "category")
    listed_sources = art.get("sources") if isinstance(art.get("sources"), list) else []
    sources = spark.createDataFrame([(s.get("path"), s.get("name"), s.get("category"), s.get("termCount"), s.get("sha256")) for s in listed_sources], SOURCE)
    return Lexicon(
        entries, frame, sources, art["version"], commit, art.get("syncedAt"), art["builtAt"], total
    )


def read_allowlist(spark: SparkSession, path: str | None) -> list[str]:
    """Lines without comments and blanks; nothing where there is no file."""
    raw = read_whole(spark, path) if path else None
    lines = (line.strip(_BLANKS) for line in (raw or "").split("\n"))
    return [line for line in lines if line and not line.startswith("#")]


def read_custom_terms(spark: SparkSession, path: str | None) -> list[tuple[str, str, str]]:
    """(term, category, severity) of a JSON list, or of a list under `terms`; what isn't a term is skipped."""
    raw = read_whole(spark, path) if path else None
    if raw is None:
        return []
    try:
        value = json.loads(raw.removeprefix("\ufeff"))
    except ValueError as e:
        raise LexiconLoadError(f"custom terms file is not valid JSON: {path}") from e
    items = value if isinstance(value, list) else value.get("terms") if isinstance(value, dict) else []
    out = []
    for item in items if isinstance(items, list) else []:
        record = {"term": item} if isinstance(item, str) else item
        if not isinstance(record, dict) or not isinstance(record.get("term"), str) or not record["term"].strip(_BLANKS):
            continue
        category, severity = record.get("category"), record.get("severity")
        out.append((record["term"].strip(_BLANKS), category if isinstance(category, str) and category else "custom", severity if severity in SEVERITIES else "medium"))
    return out


def read_character_table(spark: SparkSession, path: str) -> tuple[tuple[str, str], ...]:
    """Pairs for NormalizeOptions.simplified from lines `character<TAB>candidates`: the first candidate, where
    both are one code point and differ; `#` starts a comment."""
    lines = spark.read.text(path).where(~F.col("value").startswith("#"))
    pairs = lines.select(F.split("value", "\t").alias("p")).where("size(p) >= 2").select(F.col("p")[0].alias("a"), F.split(F.col("p")[1], " ")[0].alias("b"))
    return tuple((r["a"], r["b"]) for r in pairs.where("length(a) = 1 and length(b) = 1 and a <> b").orderBy("a").collect())
