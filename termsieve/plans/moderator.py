"""The moderator: verbs over DataFrames of texts."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termsieve.config import (
    MATCH_MODES, OVERLAPS, SEVERITIES, BatchEmptyError, BatchTooLargeError, DuplicateBatchIdError, InvalidMaskCharError, MatcherOptions, ModerationInputError, Policy,
    ScanOptions, check_mask_char,
)
from termsieve.functions.columns import fresh
from termsieve.functions.text import js_trim, utf16_length
from termsieve.operators import verdict
from termsieve.operators.matcher import WILDCARDS, Matcher, Term
from termsieve.operators.scan import ScanCall, Shipped, mask_column, scan_and_mask_column, scan_column
from termsieve.sources.terms import Lexicon

MAX_TERMS = 1_000_000


@dataclass(frozen=True)
class ModeratorOptions:
    """Defaults of a moderator; custom_terms are (term, category, severity), appended after the lexicon."""

    mode: str = "normalized"
    mask_char: str = "*"
    policy: Policy = field(default_factory=Policy)
    matcher: MatcherOptions = field(default_factory=MatcherOptions)
    custom_terms: tuple[tuple[str, str, str], ...] = ()


class Moderator:
    """Verbs over any DataFrame with a text column; every one is a narrow step and works on streams.

    The lexicon's terms are gathered at the driver, up to MAX_TERMS, and broadcast; texts never are.
    """

    def __init__(self, spark: SparkSession, lexicon: Lexicon, options: ModeratorOptions | None = None):
        self.spark = spark
        self.options = options or ModeratorOptions()
        _mode(self.options.mode)
        check_mask_char(self.options.mask_char)
        self.lexicon = lexicon
        self._build()

    def _build(self) -> None:
        self.lexicon.check_size(MAX_TERMS)
        rows = self.lexicon.entries.orderBy("term_index").select("term", "category", "severity", "normalized").collect()
        o = self.options
        terms = [Term(r["term"], r["category"], r["severity"], r["normalized"]) for r in rows]
        more = [*self.lexicon.custom_terms, *o.custom_terms]
        for _, _, severity in more:
            if severity not in SEVERITIES:
                raise ModerationInputError(f"unsupported severity: {severity}", "INVALID_SEVERITY")
        terms += [Term(*c) for c in more]
        allow = (*self.lexicon.allowlist, *o.matcher.allowlist)
        self.matcher = Matcher(terms, replace(o.matcher, allowlist=tuple(dict.fromkeys(allow))))
        self.shipped = Shipped(self.spark, self.matcher)
        self.known = {*self.lexicon.category_ids(), *(c for _, c, _ in more)}

    def reload(self) -> None:
        """Read the lexicon's source again and rebuild."""
        self.lexicon = self.lexicon.again()
        self._build()

    def warmup(self, mode: str) -> None:
        """Compile a mode at the driver, so that an error in it shows early."""
        self.matcher.compile(_mode(mode))

    # -- columns --------------------------------------------------------------------------

    def call(self, options: ScanOptions | None = None) -> ScanCall:
        """The scan that the options ask for, with this moderator's defaults."""
        o = options or ScanOptions()
        mode = _mode(o.mode or self.options.mode)
        overlap = o.overlap or self.options.matcher.overlap
        if overlap not in OVERLAPS:
            raise ModerationInputError(f"unsupported overlap: {overlap}", "INVALID_OVERLAP")
        unknown = [c for c in o.categories or () if c not in WILDCARDS and c not in self.known]
        if unknown:
            raise ModerationInputError("unknown category: " + ", ".join(unknown), "UNKNOWN_CATEGORY")
        return ScanCall(mode, overlap, o.categories, o.max_matches, tuple(o.allowlist))

    def matches_column(self, text: Column, options: ScanOptions | None = None) -> Column:
        return scan_column(self.shipped, text, self.call(options))

    def _text(self, df: DataFrame, text_col: str) -> Column:
        if not isinstance(df.schema[text_col].dataType, (T.StringType, T.NullType)):
            raise ModerationInputError("text must be a string", "INVALID_TEXT")
        return F.col(text_col).cast("string")

    # -- verbs ----------------------------------------------------------------------------

    def check(self, df: DataFrame, options: ScanOptions | None = None, text_col: str = "text") -> DataFrame:
        """df with matched, decision, risk_level, hit_count, unique_term_count, categories, matches,
        lexicon and, if asked for, masked_text.

        A null text has null in all of them but lexicon. Columns of df under these names are replaced.
        """
        o = options or ScanOptions()
        text = self._text(df, text_col)
        char = self.options.mask_char if o.mask_char is None else o.mask_char
        if o.mask:
            check_mask_char(char)
        m = F.col("matches")
        known = lambda c: F.when(m.isNotNull(), c)
        if o.mask:
            both = fresh(df, "found")
            found = df.withColumn(both, scan_and_mask_column(self.shipped, text, self.call(o), char))
            out = found.withColumns({"matches": F.col(both)["matches"], "masked_text": F.col(both)["masked_text"]}).drop(both)
        else:
            out = df.withColumn("matches", self.matches_column(text, o))
        new = {
            "matched": known(F.size(m) > 0),
            "decision": known(verdict.decide(m, self.options.policy)),
            "risk_level": known(verdict.risk_level(m)),
            "hit_count": known(verdict.hit_count(m)),
            "unique_term_count": known(F.size(verdict.unique_terms(m)).cast("long")),
            "categories": known(verdict.categories(m)),
        }
        out = out.withColumns(new)
        stamp = F.struct(F.lit(self.lexicon.version).alias("version"), F.lit(self.lexicon.upstream_commit).cast("string").alias("upstream_commit"))
        out = out.withColumn("lexicon", stamp)
        return out if o.return_matches else out.withColumn("matches", known(F.slice(m, F.lit(1), F.lit(0))))

    def find_all(self, df: DataFrame, options: ScanOptions | None = None, text_col: str = "text") -> DataFrame:
        """One row for each match: df's columns and the match's fields; texts without matches have none."""
        match = fresh(df, "match")
        found = df.withColumn(match, F.explode(self.matches_column(self._text(df, text_col), options)))
        own = [c for c in df.columns if c not in ("term_index", "term", "matched_text", "category", "severity", "match_type", "start", "end")]
        return found.select(*[F.col(f"`{c}`") for c in own], f"{match}.*")

    def contains(self, df: DataFrame, options: ScanOptions | None = None, text_col: str = "text") -> DataFrame:
        """df with contains: whether find_all would have a row."""
        o = replace(options or ScanOptions(), max_matches=1)
        return df.withColumn("contains", F.size(self.matches_column(self._text(df, text_col), o)) > 0)

    def find_first(self, df: DataFrame, options: ScanOptions | None = None, text_col: str = "text") -> DataFrame:
        """df with first_match: the leftmost, longest match or null; a limit on matches isn't applied."""
        o = replace(options or ScanOptions(), max_matches=1)
        return df.withColumn("first_match", F.try_element_at(self.matches_column(self._text(df, text_col), o), F.lit(1)))

    def find_unique_terms(self, df: DataFrame, options: ScanOptions | None = None, text_col: str = "text") -> DataFrame:
        return df.withColumn("unique_terms", verdict.unique_terms(self.matches_column(self._text(df, text_col), options)))

    def mask(self, df: DataFrame, options: ScanOptions | None = None, text_col: str = "text") -> DataFrame:
        o = options or ScanOptions()
        char = check_mask_char(self.options.mask_char if o.mask_char is None else o.mask_char)
        return df.withColumn("masked_text", mask_column(self.shipped, self._text(df, text_col), self.call(o), char))

    # -- batch contract ---------------------------------------------------------------------

    def check_batch(
        self, items: DataFrame, options: ScanOptions | None = None, max_text_length: int = 100_000, max_items: int | None = None
    ) -> tuple[DataFrame, DataFrame]:
        """(results, summary) for items (id, text[, item_index]).

        A missing id becomes the item's index as text: item_index, or else its place in the frame, which should
        then have an order of its own. A batch without items, with more than max_items, or with two items of one
        id fails as a whole, which takes a look at the ids, not at the texts. A bad text fails its item alone: it
        has success false and an error, others have data. text may be a variant, of which only strings are texts.
        summary scans the texts again; check_batch_observed counts while the results are read.
        """
        results = self._batch(items, options, max_text_length, max_items)
        return results, batch_summary(results)

    def check_batch_observed(
        self, items: DataFrame, options: ScanOptions | None = None, max_text_length: int = 100_000, max_items: int | None = None
    ) -> tuple[DataFrame, Observation]:
        """The results of check_batch, and an observation with the summary's counts once the results have been read."""
        summary = Observation("batch summary")
        return self._batch(items, options, max_text_length, max_items).observe(summary, *_counts()), summary

    def _batch(self, items: DataFrame, options: ScanOptions | None, max_text_length: int, max_items: int | None) -> DataFrame:
        kind = items.schema["text"].dataType
        if isinstance(kind, T.VariantType):
            is_null = F.col("text").isNull() | F.is_variant_null("text")
            is_text = F.schema_of_variant("text") == "STRING"
            text = F.try_variant_get("text", "$", "string")
        else:
            is_null, is_text = F.col("text").isNull(), F.lit(isinstance(kind, (T.StringType, T.NullType)))
            text = F.col("text").cast("string")
        numbered = _with_ids(items)
        total, most, twice = numbered.groupBy("id").count().agg(F.sum("count"), F.max("count"), F.max_by("id", "count")).first()
        if not total:
            raise BatchEmptyError('Field "items" must contain at least one item')
        if max_items is not None and total > max_items:
            raise BatchTooLargeError("Batch exceeds the configured maximum number of items", {"batchMaxItems": max_items})
        if most > 1:
            raise DuplicateBatchIdError(f"duplicate batch id: {twice}", {"duplicateId": twice})
        named = numbered.select("id", text.alias("text"), batch_error(text, is_null, F.coalesce(is_text, F.lit(False)), max_text_length).alias("code"))
        judged = self.check(named.withColumn("good", F.when(F.col("code").isNull(), F.col("text"))), options, "good")
        fields = [c for c in ("matched", "decision", "risk_level", "hit_count", "unique_term_count", "categories", "matches", "masked_text", "lexicon") if c in judged.columns]
        messages = F.create_map(*[F.lit(v) for p in BATCH_MESSAGES.items() for v in p])
        details = F.when(F.col("code") == "TEXT_TOO_LONG", F.create_map(F.lit("max_text_length"), F.lit(max_text_length)))
        good = F.col("code").isNull()
        return judged.select(
            "id", good.alias("success"), F.when(good, F.struct(*fields)).alias("data"),
            F.when(~good, F.struct(F.col("code").alias("code"), F.try_element_at(messages, F.col("code")).alias("message"), details.alias("details"))).alias("error"),
        )

    # -- metadata -----------------------------------------------------------------------------

    def metadata(self) -> DataFrame:
        return self.lexicon.metadata()

    def stats(self, modes: Iterable[str] = ("normalized",)) -> DataFrame:
        """For each mode: pattern_count, node_count, edge_count, skipped_terms and bytes of the automaton."""
        rows = []
        for mode in modes:
            c = self.matcher.compile(_mode(mode))
            size = c.machine.get_stats() if c.machine is not None else {"nodes_count": 1, "total_size": 0}
            nodes = max(1, size["nodes_count"])
            rows.append((mode, len(c.patterns), nodes, nodes - 1, c.skipped, size["total_size"]))
        return self.spark.createDataFrame(rows, "mode string, pattern_count long, node_count long, edge_count long, skipped_terms long, approximate_bytes long")


# Codes and messages of the batch contract, in the order of the tests.
BATCH_MESSAGES = {
    "TEXT_REQUIRED": 'Field "text" is required',
    "TEXT_NOT_STRING": 'Field "text" must be a string',
    "TEXT_EMPTY": 'Field "text" must not be empty',
    "TEXT_BLANK": 'Field "text" must contain at least one non-whitespace character',
    "TEXT_TOO_LONG": "Text exceeds the configured maximum length",
}


def batch_error(text: Column, is_null: Column, is_text: Column, max_text_length: int) -> Column:
    """The code of the first test that an item's text fails, or null; lengths are UTF-16 units."""
    return (
        F.when(is_null, "TEXT_REQUIRED").when(~is_text, "TEXT_NOT_STRING").when(text == "", "TEXT_EMPTY")
        .when(js_trim(text) == "", "TEXT_BLANK").when(utf16_length(text) > max_text_length, "TEXT_TOO_LONG")
    )


def _counts() -> list[Column]:
    return [
        F.count("*").alias("total"), F.count_if("success").alias("succeeded"), F.count_if(~F.col("success")).alias("failed"),
        F.count_if(F.coalesce(F.col("data")["matched"], F.lit(False))).alias("matched"),
    ]


def batch_summary(results: DataFrame) -> DataFrame:
    return results.agg(*_counts())


def _with_ids(items: DataFrame) -> DataFrame:
    """(id, text): ids as text, the index where an id is missing."""
    own = F.col("id").cast("string")
    if "item_index" in items.columns:
        return items.select(F.coalesce(own, F.col("item_index").cast("string")).alias("id"), "text")
    if items.where("id is null").isEmpty():
        return items.select(own.alias("id"), "text")
    # A row's place is its place in its partition and the rows of the partitions before; one count for each partition.
    placed = items.select(own.alias("id"), "text", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row"))
    before, ahead = [], 0
    for part, n in sorted(map(tuple, placed.groupBy("part").count().collect())):
        before.append((part, ahead - (part << 33)))
        ahead += n
    offsets = F.broadcast(items.sparkSession.createDataFrame(before, "at int, ahead long"))
    return placed.join(offsets, F.col("part") == F.col("at")).select(F.coalesce("id", (F.col("row") + F.col("ahead")).cast("string")).alias("id"), "text")


def _mode(mode: str) -> str:
    if mode not in MATCH_MODES:
        raise ModerationInputError(f"unsupported match mode: {mode}", "INVALID_MODE")
    return mode


def moderator_from_terms(spark: SparkSession, terms: Iterable[object], options: ModeratorOptions | None = None, allowlist: tuple[str, ...] = ()) -> Moderator:
    """A moderator over in-memory terms: strings, or (term, category, severity) with defaults for what is missing."""
    return Moderator(spark, Lexicon.from_terms(spark, terms, allowlist), options)


__all__ = ["InvalidMaskCharError", "Moderator", "ModeratorOptions", "batch_error", "batch_summary", "moderator_from_terms"]
