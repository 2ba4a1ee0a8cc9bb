"""Options and errors."""

from __future__ import annotations

from dataclasses import dataclass, field

MATCH_MODES = ("exact", "normalized", "fuzzy")
SEVERITIES = ("low", "medium", "high")
LANGUAGES = ("zh", "en", "other")
OVERLAPS = ("leftmost-longest", "all")


class LexiconLoadError(Exception):
    """A lexicon artifact or override that can't be used."""


class InvalidMaskCharError(ValueError):
    """A mask that isn't one code point."""


class ModerationInputError(ValueError):
    """An argument that a call rejects; code says which."""

    def __init__(self, message: str, code: str):
        super().__init__(message)
        self.code = code


class BatchError(ValueError):
    """A batch that is rejected as a whole; code says why, details more."""

    code = "INVALID_REQUEST"

    def __init__(self, message: str, details: dict | None = None):
        super().__init__(message)
        self.details = details or {}


class DuplicateBatchIdError(BatchError):
    """Two items of a batch share an id."""

    code = "DUPLICATE_BATCH_ID"


class BatchEmptyError(BatchError):
    """A batch without items."""

    code = "BATCH_EMPTY"


class BatchTooLargeError(BatchError):
    """A batch of more items than allowed."""

    code = "BATCH_TOO_LARGE"


@dataclass(frozen=True)
class NormalizeOptions:
    """Steps of the normalized view; simplified: traditional to simplified characters, None for the table built in."""

    nfkc: bool = True
    lowercase: bool = True
    strip_invisible: bool = True
    simplify_chinese: bool = True
    unify_whitespace: bool = True
    strip_combining_marks: bool = True
    simplified: tuple[tuple[str, str], ...] | None = None


@dataclass(frozen=True)
class FuzzyOptions:
    """Steps of the fuzzy view; shorter folded terms than min_term_length take no part."""

    strip_separators: bool = True
    leetspeak: bool = True
    collapse_repeats: bool = False
    min_term_length: int = 3


@dataclass(frozen=True)
class Policy:
    """When matches block: by severity or category, from block_min_hit_count on; allow_categories never count."""

    block_severities: tuple[str, ...] = ("high",)
    block_categories: tuple[str, ...] = ()
    allow_categories: tuple[str, ...] = ()
    block_min_hit_count: int = 1


@dataclass(frozen=True)
class MatcherOptions:
    """What holds for every scan of a matcher; max_raw_matches bounds the occurrences looked at in a text, None doesn't."""

    normalize: NormalizeOptions = field(default_factory=NormalizeOptions)
    fuzzy: FuzzyOptions = field(default_factory=FuzzyOptions)
    word_boundary: bool = True
    overlap: str = "leftmost-longest"
    max_raw_matches: int | None = None
    allowlist: tuple[str, ...] = ()


@dataclass(frozen=True)
class ScanOptions:
    """What one call asks for; None takes the moderator's default, a negative max_matches is no limit."""

    mode: str | None = None
    overlap: str | None = None
    categories: tuple[str, ...] | None = None
    max_matches: int | None = None
    allowlist: tuple[str, ...] = ()
    return_matches: bool = True
    mask: bool = False
    mask_char: str | None = None


def check_mask_char(char: object) -> str:
    if not isinstance(char, str) or char == "":
        raise InvalidMaskCharError("mask_char must be a non-empty string")
    if len(char) != 1:
        raise InvalidMaskCharError("mask_char must be exactly one Unicode code point")
    return char
