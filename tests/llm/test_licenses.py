import math
import random
import re

from termsieve.llm.license_scan import FILE, HINT, PARAGRAPH_END, SENTENCE_END, TEMPLATES, scan_licenses, words

ROWS = [
    ("a/LICENSE", TEMPLATES[1][1]), ("a/b/c/x.py", "code"), ("a/b/y.py", "# head\nLicensed under the Apache License, Version 2.0. And more words here."), ("z.py", "no"),
    ("a/b/COPYING", "This work is licensed under the GNU General Public License, version 3."), (None, "q"), ("LICENSE.txt", None), ("aa/k.py", None), ("a/k.py", "a license to kill"),
    ("d/LICENSE", "Released under the MIT License."), ("d/NOTICE", "Released under the MIT License."), ("d/e/f/g.txt", ""), ("z.py", "no"), ("m.txt", "Copyright and licence of this and that, in many words of other kinds"),
    ("w.c", "int x;\n\n" + TEMPLATES[17][1].replace(", ", ",\n") + "\n \nint y;"), ("g.c", TEMPLATES[19][1] + "\nint main"), ("v/COPYING.md", "Copyright 2001 somebody\n\n" + TEMPLATES[20][1].replace(". ", ".\n\n")), ("v/w/a.b", "none"),
]


def brute(rows):
    """By the definition, one file after the other."""
    n = len(rows)
    vocabulary = {w for _, t in TEMPLATES for w in words(t)}
    idf = {w: math.log((1 + n) / (1 + sum(w in words(t or "") for _, t in rows))) + 1 for w in vocabulary}

    def vector(ws):
        return {w: ws.count(w) * idf[w] for w in ws if w in idf}

    def cosine(a, b):
        norm = math.sqrt(sum(v * v for v in a.values())) * math.sqrt(sum(v * v for v in b.values()))
        return sum(v * b.get(w, 0) for w, v in a.items()) / norm if norm else 0.0

    def own(path, text):
        parts = [s for s in re.split(SENTENCE_END, text or "") + re.split(PARAGRAPH_END, text or "") if re.search(HINT, s)]
        if path and re.search(FILE, path):
            parts.append(text or "")
        found = [(-round(cosine(vector(words(s)), vector(words(t))), 9), name) for s in parts for name, t in TEMPLATES]
        found = [f for f in found if -f[0] >= 0.7]
        return min(found) if found else None

    judged = [own(p, t) for p, t in rows]
    folders = {}
    for (p, _), b in zip(rows, judged, strict=True):
        if p and re.search(FILE, p) and b:
            d = p.rpartition("/")[0]
            folders[d] = min(folders.get(d, (*b, p)), (*b, p))
    out = []
    for (p, _), b in zip(rows, judged, strict=True):
        if b:
            out.append((p, b[1], -b[0], "own", p))
            continue
        d, hit = p.rpartition("/")[0] if p else None, None
        while d is not None and hit is None:
            hit = folders.get(d)
            d = d.rpartition("/")[0] if d else None
        out.append((p, hit[1], -hit[0], "inherited", hit[2]) if hit else (p, None, 0.0, "none", None))
    return sorted(map(repr, out))


def test_as_by_the_definition(spark):
    df = spark.createDataFrame([(p, t, "x") for p, t in ROWS], "path string, text string, score string")
    got = [(r.path, r.licence, round(r.score, 9), r.scope, r.from_path) for r in scan_licenses(df).collect()]
    want = brute(ROWS)
    assert sorted(map(repr, got)) == want and sum("inherited" in w for w in want) >= 3


def test_without_files_or_rows(spark):
    df = spark.createDataFrame([("a.py", "x"), ("b.py", None)], "path string, text string")
    assert {r.scope for r in scan_licenses(df).collect()} == {"none"} and scan_licenses(df.limit(0)).count() == 0


def test_no_piece_that_reaches_the_threshold_is_passed_over(spark):
    """Notices in other words than the templates' usual phrases, and random words of the templates, each compared to all."""
    rng = random.Random(3)
    notices = ["Released under CC BY 4.0.", "x\nUnder the terms of the Mozilla Public, v. 2.0.\ny", "CC BY-NC 4.0", "This program is free software: you can redistribute it and/or modify it."]
    rows = [(f"n{i}.txt", t) for i, t in enumerate(notices)] + [(f"f{i}.txt", "the of and in it 4 mit under plain prose") for i in range(40)]
    for i in range(120):
        ws = words(rng.choice(TEMPLATES)[1])
        rows.append((f"r{i}.txt", " ".join(rng.sample(ws, rng.randint(1, len(ws))) + ["prose"] * rng.randint(0, 2))))
    df = spark.createDataFrame(rows, "path string, text string")
    got = [(r.path, r.licence, round(r.score, 9), r.scope, r.from_path) for r in scan_licenses(df).collect()]
    assert {p: lic for p, lic, *_ in got if p == "n0.txt"} == {"n0.txt": "cc-by-4.0"}
    assert sorted(map(repr, got)) == brute(rows) and 20 < sum(g[3] == "own" for g in got) < 120
    assert all(re.search(HINT, t) for _, t in rows), "brute leaves no piece out"


def test_repeated_rows_long_texts_and_the_operators_own_names(spark):
    long = "plain words of no licence. " * 40_000
    rows = [("a/LICENSE", "Released under the MIT License."), ("a/x", long), ("a/x", long), ("b/y", long + "\nReleased under the MIT License.")]
    names = ["_mine", "_folder", "_given", "_asks", "_salt", "less", "W"]
    df = spark.createDataFrame([(*r, *(f"{c}{i}" for c in names)) for i, r in enumerate(rows)], ["path", "text", *names])
    out = scan_licenses(df)
    assert out.columns == [*df.columns, "licence", "score", "scope", "from_path"]
    got = out.orderBy("less").collect()
    assert [(r.scope, r.licence) for r in got] == [("own", "mit"), ("inherited", "mit"), ("inherited", "mit"), ("own", "mit")]
    assert [[r[c] for c in names] for r in got] == [[f"{c}{i}" for c in names] for i in range(4)]
