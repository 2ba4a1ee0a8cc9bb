import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from termsieve.config import FuzzyOptions, NormalizeOptions
from termsieve.functions import tables
from termsieve.operators.views import View, _fold_one_by_one, fold, fold_string, normalize_string, normalizer

N = NormalizeOptions()


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("HeLLo World", "hello world"), ("ＡＢＣ１２３", "abc123"), ("ﬁle", "file"), ("①②③", "123"), ("㈱", "(株)"),
        ("a​b‌c‍d﻿e­e", "abcdee"), ("a⁠b", "ab"), ("a️b", "ab"), ("臺灣獨立", "台湾独立"), ("習近平", "习近平"),
        ("簡體字", "简体字"), ("a\tb\nc　d e", "a b c d e"), ("a  b", "a  b"), ("é", "é"), ("́abc", "abc"), ("", ""),
        ("ΟΔΟΣ", "οδοσ"), ("İ", "i̇"), ("a b", "ab"), ("x̀́̂", "x"),
    ],
)
def test_normalized(text, expected):
    assert normalize_string(text) == expected


def test_steps_can_be_switched_off():
    assert normalize_string("ABC", NormalizeOptions(lowercase=False)) == "ABC"
    assert normalize_string("臺灣", NormalizeOptions(simplify_chinese=False)) == "臺灣"
    assert normalize_string("a​b", NormalizeOptions(strip_invisible=False)) == "a​b"
    assert normalize_string("薴", NormalizeOptions(simplified=(("薴", "苧"), ("苧", "苎")))) == "苧"


def test_whole_table_of_simplified_characters_is_the_default():
    # Pairs as the reference's table has them, beyond the basic plane and outside the common ones too.
    pairs = {"電": "电", "話": "话", "黨": "党", "賭": "赌", "車": "车", "銀": "银", "藥": "药", "貓": "猫", "㑯": "㑔", "㗲": "𠵾", "薴": "苧", "苧": "苎"}
    assert {a: normalize_string(a) for a in pairs} == pairs
    assert normalize_string("".join(pairs)) == "".join(pairs.values())
    table = tables.common_simplified()
    assert len(table) == 3222 and all(len(a) == len(b) == 1 and a != b for a, b in table.items())


def test_origins():
    v = normalizer(N).view("a​①ＢC")
    assert (v.text, v.origin(0, 1), v.origin(1, 2), v.origin(2, 4), v.origin(0, 4)) == ("a1bc", (0, 1), (2, 3), (3, 5), (0, 5))
    v = normalizer(N).view("x㈱y")
    assert (v.text, v.origin(1, 4)) == ("x(株)y", (1, 2))
    v = normalizer(N).view("ab​cd")
    assert (v.origin(0, 2), v.origin(0, 3)) == ((0, 2), (0, 4))
    assert normalizer(N).view("").origin(0, 0) == (0, 0)
    assert normalizer(N).view("​").origin(0, 0) == (0, 0)


def test_folded():
    v = fold(normalizer(N).view("b-a-d w.o_r/d"), FuzzyOptions())
    assert v.text == "badword" and 3 in v.breaks and 1 in v.breaks
    assert [fold_string(t) for t in ("b4dw0rd", "l33t5p34k", "@ss", "baaad")] == ["badword", "leetspeak", "ass", "baaad"]
    assert fold_string("baaad", N, FuzzyOptions(collapse_repeats=True)) == "bad"
    assert fold_string("b4d-word", N, FuzzyOptions(leetspeak=False)) == "b4dword"
    assert fold_string("b4d-word", N, FuzzyOptions(strip_separators=False)) == "bad-word"
    v = fold(normalizer(N).view("xx b-a-d yy"), FuzzyOptions())
    assert (v.text, v.origin(2, 5)) == ("xxbadyy", (3, 8))
    for o in (FuzzyOptions(), FuzzyOptions(collapse_repeats=True)):
        v = fold(View("-a--b-"), o)
        assert [k in v.breaks for k in range(3)] == [True, True, True] and v.text == "ab"
        assert [k in fold(View("a-bc"), o).breaks for k in range(4)] == [False, True, False, False]
        assert 0 in fold(View("--"), o).breaks and 0 not in fold(View(""), o).breaks


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab-4!. ​é①", max_size=20))
def test_bulk_folding_agrees_with_one_by_one(text):
    view = normalizer(N).view(text)
    a, b = fold(view, FuzzyOptions()), _fold_one_by_one(view, FuzzyOptions())
    assert a.text == b.text
    assert all(a.origin(i, j) == b.origin(i, j) for i in range(len(a.text)) for j in range(i + 1, len(a.text) + 1))
    assert all((k in a.breaks) == (k in b.breaks) for k in range(len(a.text) + 1))


def one_by_one(text: str) -> str:
    """The view by the rules, without tables or shortcuts."""
    out: list[str] = []
    for c in text:
        if tables.is_invisible(c):
            continue
        if c in tables.WHITESPACE:
            out.append(" ")
        elif unicodedata.category(c) == "Mn":
            both = unicodedata.normalize("NFC", out[-1] + c) if out else ""
            if len(both) == 1:
                out[-1] = both
        else:
            out += [" " if x in tables.WHITESPACE else tables.common_simplified().get(x, x) for w in unicodedata.normalize("NFKC", c) for x in w.lower()]
    return "".join(out)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(blacklist_categories=["Cs"]), max_size=30))
def test_shortcuts_agree_with_the_rules(text):
    v = normalizer(N).view(text)
    assert v.text == one_by_one(text)
    assert all(0 <= a < b <= len(text) for a, b in (v.origin(i, i + 1) for i in range(len(v.text))))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(), min_size=1, max_size=30) | st.text(alphabet="aBéÉΣ臺台ＡﬁＢ①㈱\u0301\u200b\ud800😀 \n", min_size=1, max_size=30), st.booleans())
def test_long_texts_are_seen_as_short_ones(text, lowercase):
    n = normalizer(NormalizeOptions(lowercase=lowercase))
    a, b = n._long_view(text), n.view(text)
    assert a.text == b.text and all(a.origin(i, i + 1) == b.origin(i, i + 1) for i in range(len(a.text)))
    assert n.view(text * 300).text == n.view(text * 10).text * 30 or any(unicodedata.category(c) == "Mn" for c in text)
