"""Text, range and term functions as Spark columns; offsets are code points, ranges half-open."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from termsieve.config import check_mask_char

from .arrays import cut, let, parts, running
from .tables import TRIM_CLASS

RANGES = "array<struct<start:int,end:int>>"
ISSUES = (
    "empty", "single-character", "too-long", "contains-whitespace", "control-character",
    "digits-only", "punctuation-only", "html-like", "normalizes-to-empty",
)
FATAL = ("empty", "normalizes-to-empty", "control-character", "punctuation-only", "too-long")
MAX_TERM_LENGTH = 128


def code_points(text: Column) -> Column:
    """The characters of a text, one code point each."""
    return F.filter(F.split(text, ""), lambda c: c != "")


def slice_code_points(text: Column, start: Column, end: Column) -> Column:
    """text[start:end] with both ends clamped to the text."""
    low = F.greatest(F.lit(0), F.least(start, F.length(text)))
    high = F.greatest(low, F.least(end, F.length(text)))
    return F.substring(text, (low + 1).cast("int"), (high - low).cast("int"))


def js_trim(text: Column) -> Column:
    """text without white space and byte-order marks at both ends."""
    return F.regexp_replace(text, f"^[{TRIM_CLASS}]+|[{TRIM_CLASS}]+$", "")


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def split_list(text: Column) -> Column:
    """The trimmed non-empty items of a comma list."""
    return F.filter(F.transform(F.split(text, ","), js_trim), lambda x: x != "")


def detect_language(term: Column) -> Column:
    """zh for any CJK, kana or hangul; en for Latin and nothing else beyond ASCII; else other."""
    cjk = r"[\x{3400}-\x{9fff}\x{f900}-\x{faff}\x{20000}-\x{3ffff}\x{3040}-\x{30ff}\x{ac00}-\x{d7af}]"
    latin = r"[A-Za-z\u00c0-\u024f]"
    other = r"[^\u0000-\u007f\u00c0-\u024f]"
    return F.when(term.rlike(cjk), "zh").when(term.rlike(latin) & ~term.rlike(other), "en").otherwise("other")


def inspect_term(term: Column, normalized: Column) -> Column:
    """What is odd about a cleaned term, in fixed order; an empty term is only `empty`."""
    space = rf"[{TRIM_CLASS}]"
    tests = [
        ("single-character", F.length(term) == 1),
        ("too-long", F.length(term) > MAX_TERM_LENGTH),
        ("contains-whitespace", term.rlike(r"[\t\n\r\x0B\f]") | term.rlike(space + "{2,}")),
        ("control-character", term.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]")),
        ("digits-only", term.rlike(r"\A[0-9]+\z")),
        ("punctuation-only", term.rlike(r"\A[\p{P}\p{S}]+\z")),
        ("html-like", term.rlike(r"(?i)<[^>]{1,20}>|&[a-z]{2,10};")),
        ("normalizes-to-empty", normalized == ""),
    ]
    found = F.filter(F.array(*[F.when(test, name) for name, test in tests]), lambda i: i.isNotNull())
    return F.when(term == "", F.array(F.lit("empty"))).otherwise(found)


def is_fatal(issues: Column) -> Column:
    return F.arrays_overlap(issues, F.array(*[F.lit(i) for i in FATAL]))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    """The file name without its last extension; a name that only starts with a dot keeps it."""
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def derive_category_id(path: Column) -> Column:
    """A category id from a file name."""
    slug = F.regexp_replace(F.lower(stem(path)), rf"[{TRIM_CLASS}_]+", "-")
    slug = F.regexp_replace(slug, r"[^\p{L}\p{N}-]+", "")
    slug = F.regexp_replace(F.regexp_replace(slug, "-{2,}", "-"), "^-|-$", "")
    return F.when(slug == "", "uncategorized").otherwise(slug)


def calendar_version(moment: Column) -> Column:
    """YYYY.MM.DD of a timestamp in the session's time zone, which should be UTC."""
    return F.date_format(moment, "yyyy.MM.dd")


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "high", 3).when(severity == "medium", 2).when(severity == "low", 1).otherwise(0)


def severity_name(rank: Column) -> Column:
    return F.when(rank == 3, "high").when(rank == 2, "medium").when(rank == 1, "low").otherwise("none")


def merge_ranges(ranges: Column) -> Column:
    """Ranges by start, overlapping and touching ones made one."""
    plain = F.transform(ranges, lambda r: F.struct(r["start"].cast("int").alias("start"), r["end"].cast("int").alias("end")))
    least = -(1 << 31)

    def opened(rs: Column) -> Column:
        # A range that starts after the end of all before it opens a new one, which ends where all before the next one do.
        reach = running(F.transform(rs, lambda r: r["end"]), F.greatest, least)
        firsts = F.filter(F.arrays_zip(rs.alias("r"), reach.alias("to")), lambda z: (z["r"]["start"] > z["to"]) | (z["to"] == least))
        return let(firsts, lambda f: closed(f, F.array_max(F.transform(rs, lambda r: r["end"]))))

    def closed(firsts: Column, last: Column) -> Column:
        ends = F.concat(F.transform(F.slice(firsts, F.lit(2), F.size(firsts)), lambda z: z["to"]), F.array(last))
        return F.transform(F.arrays_zip(firsts.alias("f"), ends.alias("end")), lambda z: F.struct(z["f"]["r"]["start"].alias("start"), z["end"].alias("end")))

    return F.when(F.size(ranges) > 0, let(F.array_sort(plain), opened)).when(ranges.isNotNull(), F.array().cast(RANGES))


def mask_ranges(text: Column, ranges: Column, mask_char: str = "*") -> Column:
    """text with every code point in the ranges replaced; its length in code points stays."""
    char = F.lit(check_mask_char(mask_char))

    def rebuilt(m: Column, pieces: Column) -> Column:
        n = F.length(text)
        clamp = lambda v: F.greatest(F.lit(0), F.least(v, n))
        opened = F.concat(F.array(F.lit(0)), F.transform(m, lambda r: clamp(r["end"])))
        said = F.transform(
            F.arrays_zip(m.alias("r"), F.slice(opened, F.lit(1), F.size(m)).alias("at")),
            lambda z: F.concat(
                cut(pieces, z["at"], F.greatest(z["at"], clamp(z["r"]["start"]))),
                F.repeat(char, F.greatest(F.lit(0), clamp(z["r"]["end"]) - clamp(z["r"]["start"]))),
            ),
        )
        return F.concat(F.array_join(said, ""), cut(pieces, F.element_at(opened, -1), n))

    return F.when(F.size(ranges) > 0, let(merge_ranges(ranges), lambda m: let(parts(text), lambda p: rebuilt(m, p)))).otherwise(text)


def stride_sample(index: Column, total: Column, count: int) -> Column:
    """Whether row index of total rows is in an even sample: index is floor(i * total / count) for some i."""
    step = index.cast("long") * count
    first = F.floor((step + total - 1) / total)
    return (F.floor(first * total / count) == index) & (first < count)
