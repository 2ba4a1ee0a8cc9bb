import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from termsieve.llm.boosting import boost, calibrated_bound
from termsieve.llm.pii import CONTEXT, GENERATORS, KINDS, _features, _features_py, PiiOptions, digest, find_pii, redact, trained, written_examples

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def digits(s):
    return re.sub("[^0-9]", "", s)


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base(t):
    t = t or ""
    return [
        *(("email", m.start(), m.end()) for m in EMAIL.finditer(t)), *(("ip", m.start(), m.end()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))),
        *(("card", m.start(), m.end()) for m in CARD.finditer(t) if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))),
        *(("phone", m.start(), m.end()) for m in PHONE.finditer(t) if 9 <= len(digits(m[0])) <= 15),
    ]


def test_fixed_formats(spark):
    r = random.Random(7)
    texts = ["".join(r.choice("a1.@+- (50_%") for _ in range(70)) for _ in range(1500)]
    texts += ["😀a@b.c_d@e.f g@h.i.j x@y", "1.2.3.4.5.6.7.8 300.1.1.1 000255.0.0.1", "4111 1111 1111 1111 4111-1111-1111-1112", "+1 (743) 555-3824,", "a" * 20_000 + "@", "1" * 50_000, "+1" + " " * 20_000, None, ""]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, email string")
    for row in digest(find_pii(df)).collect():
        want = base(texts[row.doc_id])
        assert row.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{e}" for k, a, e in want).encode()).hexdigest(), texts[row.doc_id]
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(w[0] == k for w in want) for k in ("email", "ip", "card", "phone")]
        assert set(filter(None, row.spans.split(","))) >= {f"{k}:{a}:{e}" for k, a, e in want}
    assert digest(find_pii(df.limit(0))).count() == 0


def test_trees_add_disguised_data_and_leave_plain_numbers(spark):
    texts = ["call me (743) 555-3824 today", "mail john [at] acme [dot] com", "on 2024-01-15 we met", "ISBN 978-3-1614-8410", "at home. Then", "see pages 12 34 56 78", "sum 123 456"]
    rows = digest(find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).orderBy("doc_id").collect()
    assert [r.spans for r in rows] == ["phone:8:22", "email:5:29", "", "", "", "", ""]


def test_what_is_found_does_not_depend_on_the_rest_of_the_text(spark):
    texts = [
        "write to anna at acme {dot} com", "mail anna at sub.acme dot com", "e-mail anna at acme.com", "mail anna at  acme .com", "write anna{at}acme.com", "mail bob at acme  dot com", "tel 12-345",
        "call 12 34", "call 555-12", "tel (12) 34", "card 123456789012", "pay 1-2-3-4-5-6-7-8-9-0-1-2-3", "he is at home. Then", "at 12.05", "no at all dot",
    ]
    rest = "\n# (743) 555-3824 #\njohn [at] acme [dot] com"
    df = spark.createDataFrame([(i, t + s) for i, t in enumerate(texts) for s in ("", rest)], "doc_id long, text string")
    found = {}
    for r in digest(find_pii(df)).collect():
        n = len(texts[r.doc_id])
        found.setdefault(r.doc_id, set()).add(tuple(x for x in r.spans.split(",") if x and int(x.split(":")[1]) < n))
    assert {texts[i]: f for i, f in found.items() if len(f) > 1} == {}
    assert found[0] == {("email:9:31",)} and found[1] == {("email:5:29",)} and found[6] == {("phone:4:10",)}


def added(t):
    """What the trees add, span by span and pair by pair."""
    model, bounds = trained(PiiOptions())
    found = []
    for kind, pattern in GENERATORS:
        for m in re.finditer(pattern, t, re.ASCII):
            x = _features_py(kind, m[0], t[max(0, m.start() - CONTEXT) : m.start()])
            p = 1 / (1 + np.exp(-model.margin(np.array([x]))[0]))
            if p >= bounds[kind]:
                found.append((m.start(), m.end(), -p, KINDS.index(kind), kind))
    fixed = [(a, e) for _, a, e in base(t)]
    better = lambda o, s: (o[1] - o[0], -o[2], -o[3]) > (s[1] - s[0], -s[2], -s[3])
    inside = lambda o, s: o[0] <= s[0] and o[1] >= s[1]
    return sorted((k, a, e) for a, e, p, r, k in found if not any(inside(f, (a, e)) for f in fixed) and not any(inside(o, (a, e)) and better(o, (a, e, p, r)) for o in found))


def test_added_spans_against_every_pair(spark):
    r = random.Random(17)
    parts = ["call ", "(743) 555-3824", "555-12", "card ", "4111 1111 1111 1111 ", "4111111111111111", "4111.1111.1111.1112", " 12", "-34", " 2024-01-15", "john [at] acme [dot] com", "anna at acme dot org", "a@b.cd", "1.2.3.4", "+1 (743) 555-3824", " ", "é", "😀", ". ", "tel: ", "visa: ", "id "]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(1, 14))) for _ in range(1200)]
    texts += [f"{t} # {u}" for t, u in zip(texts[:200], texts[200:400], strict=True)]
    rows = find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select("doc_id", "added").collect()
    got = {row.doc_id: sorted((s.kind, s.start, s.end) for s in row.added) for row in rows}
    assert all(got[i] == added(t) for i, t in enumerate(texts)), next((texts[i], got[i], added(texts[i])) for i in got if got[i] != added(texts[i]))
    assert sum(map(len, got.values())) > 500
    # Repeated rows give equal results.
    twice = spark.createDataFrame([(1, texts[0], 0), (1, texts[0], 0)], "doc_id long, text string, added int")
    assert len({tuple(x.spans for x in digest(find_pii(twice)).collect())}) == 1 and twice.count() == 2


def test_many_spans_in_one_text(spark):
    text = " ".join(f"call ({i % 1000:03d}) 555-{i:05d}" for i in range(50_000))
    found = find_pii(spark.createDataFrame([(1, text)], "doc_id long, text string")).cache()
    spans = digest(found).first().spans.split(",")
    assert len(spans) == 50_000 and spans[-1].endswith(str(len(text)))
    assert redact(found).first().text == " ".join(["call [PHONE]"] * 50_000)
    found.unpersist()


def test_trees_on_the_documents_own_data_in_disguise(spark):
    """Phone numbers and addresses of the shared documents, which this module didn't write, without what the fixed formats need."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    base_rows = find_pii(docs).where("size(phone) + size(email) > 0").select("doc_id", "text", "phone", "email").collect()
    hidden, count = [], 0
    for row in base_rows:
        text, moved = row.text, []
        for s in sorted([*row.phone, *row.email], key=lambda s: -s.start):
            said = re.sub(r"^\+1 ?", "", s.hit) if s.hit.startswith("+") else s.hit.replace("@", " [at] ").replace(".", " [dot] ")
            text = text[: s.start] + said + text[s.end :]
        count += len(row.phone) + len(row.email)
        hidden.append((row.doc_id, text))
    rows = find_pii(spark.createDataFrame(hidden, "doc_id long, text string")).select(F.size("added").alias("n"), (F.size("phone") + F.size("email")).alias("left")).collect()
    assert count > 100 and sum(r.n for r in rows) >= 0.9 * (count - sum(r.left for r in rows))
    clean = find_pii(docs).where("size(phone) + size(email) + size(card) + size(ip) = 0 and size(added) > 0").count()
    assert clean <= 0.001 * docs.count()


def test_features_agree_on_both_sides(spark):
    examples, _ = written_examples(400, 3)
    for kind in ("phone", "card", "email"):
        own = [e for e in examples if e[0] == kind]
        df = spark.createDataFrame([(h, b) for _, h, b in own], "hit string, before string")
        got = df.select("hit", "before", F.array(*_features(kind, F.col("hit"), F.col("before"))).alias("f")).collect()
        for r in got:
            assert list(r.f) == _features_py(kind, r.hit, r.before), (r.hit, r.before)


def test_boosting_and_its_expression(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(900, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    model = boost(x[:600], y[:600])
    assert (((model.margin(x[600:]) > 0) == (y[600:] > 0)).mean()) > 0.93
    df = spark.createDataFrame([tuple(map(float, v)) for v in x[:50]], "a double, b double, c double")
    p = [r[0] for r in df.select(model.probability([F.col("a"), F.col("b"), F.col("c")])).collect()]
    assert np.allclose(p, 1 / (1 + np.exp(-model.margin(x[:50]))))
    bound = calibrated_bound(model.margin(x[600:]), y[600:], 0.95)
    chosen = 1 / (1 + np.exp(-model.margin(x[600:]))) >= bound
    assert y[600:][chosen].mean() >= 0.95
    model, bounds = trained(PiiOptions())
    examples, y = written_examples(1500, 99)
    m = model.margin(np.array([_features_py(*e) for e in examples]))
    taken = np.array([1 / (1 + np.exp(-v)) >= bounds[e[0]] for v, e in zip(m, examples, strict=True)])
    assert y[taken].mean() > 0.97 and taken[y == 1].mean() > 0.7


def test_redaction(spark):
    texts = ["😀 a@b.cd and 1.2.3.4!", "none", None, "", "a +378282246310005 b", "x@y.z", "é" * 600 + "a@b.cd" + "😀" * 700 + " c@d.ef"]
    out = redact(find_pii(spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n int"))).orderBy("doc_id")
    assert out.columns == ["doc_id", "text", "n"]
    assert [r.text for r in out.collect()] == ["😀 [EMAIL] and [IP]!", "none", None, "", "a [PHONE] b", "[EMAIL]", "é" * 600 + "[EMAIL]" + "😀" * 700 + " [EMAIL]"]
