import math
import random

from pyspark.sql import functions as F

from termsieve.llm.langid import fit, fold, held_out, ngrams, LangOptions, predict

SYLLABLES = {"aa": "ka lo mi tu ne".split(), "bb": "sch ein ung der zwi".split(), "cc": "eau que ré oui ça".split()}


def text(r, lang, n):
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 4))) for _ in range(n))


def test_learns_and_rejects(spark):
    r = random.Random(1)
    rows = [(i, text(r, lang, r.choice([2, 8, 60])), lang, "x") for i, lang in enumerate(r.choice(list(SYLLABLES)) for _ in range(900))]
    rows += [(5000, None, "aa", "x"), (5001, "", "aa", "x"), (5002, "123 !? \n", "aa", "x"), (5003, "ka lo " * 60_000, None, "x"), (None, "schein ungder", "bb", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    train = docs.where(~held_out())
    out = {x.doc_id: x for x in predict(docs, fit(train)).collect()}
    held = [x.doc_id for x in docs.where(held_out()).select("doc_id").collect()]
    assert 150 < len(held) < 350 and len(out) == len(rows)
    truth = {i: lang for i, _, lang, _ in rows}
    told = [i for i in held if truth[i] and i < 5000]
    assert sum(out[i].lang_pred == truth[i] for i in told) / len(told) > 0.97
    assert all((out[i].lang_pred, out[i].score, out[i].rejected) == ("und", 0.0, True) for i in (5000, 5001, 5002))
    assert out[5003].lang_pred == "aa" and out[None].lang_pred == "bb" and all(0 <= x.score <= 1 for x in out.values())
    assert sum(x.rejected for i, x in out.items() if i is None or i < 5000) < 15
    again = {x.doc_id: x for x in predict(docs.select("doc_id", "text"), fit(train)).collect()}
    assert all(again[i].lang_pred == out[i].lang_pred and again[i].score == out[i].score for i in out)


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "abc", None), (2, None, "aa")], "doc_id long, text string, lang string")
    assert {x.lang_pred for x in predict(docs, fit(docs)).collect()} == {"und"} and predict(docs.limit(0), fit(docs.limit(0))).count() == 0
    one = spark.createDataFrame([(i, "abc def", "aa") for i in range(9)], "doc_id long, text string, lang string")
    assert {(x.lang_pred, x.score) for x in predict(one, fit(one)).collect()} == {("aa", 1.0)}


def test_bytes():
    import numpy as np

    b = lambda s: np.frombuffer(s.encode(), np.uint8)
    assert fold(b("AbZ1é É×ß!")).tobytes().decode() == "abz é é×ß "
    assert [len(x) for x in ngrams(fold(b("abcd")), LangOptions())] == [3, 2, 1] and [len(x) for x in ngrams(fold(b("a")), LangOptions())] == [0, 0, 0]


def alone(text, m, o=LangOptions()):
    """The prediction for one text, n-gram by n-gram."""
    if text is None or not any(c.isalpha() for c in text):
        return "und", 0.0, True
    folded = "".join(c.lower() if c.isascii() and c.isalpha() else " " if c.isascii() else chr(ord(c) + 32) if "\u00c0" <= c <= "\u00de" and c != "\u00d7" else c for c in text).encode()
    sums, n = [0.0] * len(m.languages), 0
    for size in o.sizes:
        for i in range(len(folded) - size + 1):
            h = 0x9E3779B1 ^ size
            for b in folded[i : i + size]:
                h = ((h ^ b) * 0x01000193) & 0xFFFFFFFF
                h ^= h >> 15
            row = m.table[((h * 0x85EBCA6B & 0xFFFFFFFF) >> 12) % o.buckets]
            sums = [a + float(v) for a, v in zip(sums, row, strict=True)]
            n += 1
    z = [(a / max(n, 1) + float(b)) / m.temperature for a, b in zip(sums, m.bias, strict=True)]
    e = [math.exp(v - max(z)) for v in z]
    best = max(range(len(e)), key=lambda k: e[k])
    score = e[best] / sum(e)
    return m.languages[best], score, score < m.bound


def test_batches_against_one_text_at_a_time(spark):
    r = random.Random(3)
    rows = [(i, text(r, lang, r.choice([1, 3, 9, 40])), lang) for i, lang in enumerate(r.choice(list(SYLLABLES)) for _ in range(300))]
    m = fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    asked = [t for _, t, _ in rows] + [None, "", "a", "é", "ab", "12", "Ça ÉTÉ ß!", "x" * 400, "語 ka lo"] + [rows[0][1]] * 3
    docs = spark.createDataFrame([(i, t, "own") for i, t in enumerate(asked)], "doc_id long, text string, _letters string")
    out = predict(docs, m)
    assert out.columns == ["doc_id", "text", "_letters", "lang_pred", "score", "rejected"]
    for x in out.collect():
        name, score, low = alone(asked[x.doc_id], m)
        assert (x.lang_pred, x.rejected, x._letters) == (name, low, "own") and math.isclose(x.score, score, rel_tol=1e-6), asked[x.doc_id]
    apart = {x.doc_id: (x.lang_pred, x.score) for x in predict(docs.repartition(7, F.col("doc_id") % 7), m).collect()}
    assert apart == {x.doc_id: (x.lang_pred, x.score) for x in out.collect()}


def test_many_languages_are_learned(spark):
    r = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyz"
    own = {f"l{k:03d}": ["".join(r.choice(letters) for _ in range(3)) for _ in range(8)] for k in range(150)}
    said = lambda lang: " ".join(r.choice(own[lang]) + r.choice(own[lang]) for _ in range(30))
    rows = [(i, said(lang), lang) for i, lang in enumerate([x for x in own for _ in range(12)])] + [(90_000, "zz yy", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    m = fit(docs)
    assert m.languages == sorted(own)
    fresh_docs = spark.createDataFrame([(i, said(x), x) for i, x in enumerate(own)], "doc_id long, text string, lang string")
    assert sum(x.lang_pred == x.lang for x in predict(fresh_docs, m).collect()) >= 140


def test_windows_come_from_anywhere_in_a_text(spark):
    """Texts of which the first half is in a language of its own are told by their second half."""
    r = random.Random(5)
    rows = [(i, "zzz qqq " * 400 + text(r, lang, 900), lang) for i, lang in enumerate(r.choice(list(SYLLABLES)) for _ in range(300))]
    m = fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    docs = spark.createDataFrame([(i, text(r, x, 40), x) for i, x in enumerate(list(SYLLABLES) * 20)], "doc_id long, text string, lang string")
    assert sum(x.lang_pred == x.lang for x in predict(docs, m).collect()) >= 57
