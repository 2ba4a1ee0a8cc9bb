"""Personal data in whole texts: fixed formats, and boosted trees over generated candidates.

The fixed formats are e-mail and IP addresses, card numbers and international phone numbers.
Beyond them, generators that miss little propose overlapping spans: numbers grouped like phone
numbers without a country code, long numbers, and addresses in disguise. Boosted trees score each
from its format and the words before it; a threshold calibrated for precision selects. A selected
span that lies in another one adds nothing and goes; all others stay, so nothing that the trees
select is left uncovered. The trees are trained in numpy on examples written by a seeded
generator, and run as Spark expressions.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .boosting import Trees, boost, calibrated_bound
from .spans import by_kind, cut, empty, found, let, parts, running, tagged

KINDS = ("email", "ip", "card", "phone")
LOCAL = "[A-Za-z0-9._%+-]"
# Starting only where a run starts, or where the last match ended, keeps long runs linear.
EMAIL = rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

# Generators: kind of what they propose, pattern.
GENERATORS = (
    ("phone", r"(?<![0-9A-Za-z.+-])\(?[0-9]{2,5}\)?(?:[\x20./-]{1,2}[0-9]{2,5}){1,4}(?![0-9A-Za-z])"),
    ("card", r"(?<![0-9A-Za-z.+-])[0-9](?:[\x20.-]?[0-9]){11,18}(?![0-9A-Za-z])"),
    (
        "email",
        r"(?<![A-Za-z0-9])[A-Za-z0-9._%+-]{2,64}\x20?(?:\[at\]|\(at\)|\{at\}|\x20at\x20)\x20?[A-Za-z0-9-]{2,63}"
        r"(?:\x20?(?:\.|\[dot\]|\(dot\)|\{dot\}|\x20dot\x20)\x20?[A-Za-z]{2,12}){1,3}(?![A-Za-z0-9])",
    ),
)
CONTEXT = 32
HINTS = (
    r"(?:tel|telephone|phone|call|fax|mobile|cell|dial|sms)[^A-Za-z]*(?:\w+\W+)?$",
    r"(?:card|visa|mastercard|amex|credit|debit|payment|paid)\W*(?:\w+\W+)?$",
    r"(?:e-?mail|contact|write|reach|mail)\W*(?:\w+\W+)?$",
    r"(?:version|isbn|order|invoice|date|page|no|nr|id|ref|serial|build|model|since|from|between)[^A-Za-z]*$",
)
ENDINGS = r"(?i)(?:com|org|net|edu|gov|io|de|fr|es|uk|info)$"


@dataclass(frozen=True)
class PiiOptions:
    """precision: of the trees' selections on examples they weren't trained on; examples: how many are written."""

    precision: float = 0.99
    examples: int = 4000
    seed: int = 11


def _luhn(digits: Column) -> Column:
    order = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")
    worth = lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int"))
    return F.aggregate(F.transform(order, worth), F.lit(0), lambda a, v: a + v) % 10 == 0


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def base_spans(text: Column) -> dict[str, Column]:
    """The fixed formats: leftmost non-overlapping matches of each kind, without those that fail their test."""
    part = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
    ip_ok = lambda s: F.forall(F.split(s["hit"], r"\."), lambda p: (F.length(part(p)) <= 3) & (F.substring(part(p), 1, 3).cast("int") <= 255))
    card_ok = lambda s: let(_digits(s["hit"]), lambda d: F.length(d).between(13, 19) & _luhn(d))
    phone_ok = lambda s: F.length(_digits(s["hit"])).between(9, 15)
    return {
        "email": F.when(text.contains("@"), found(text, EMAIL)).otherwise(empty()),
        "ip": F.when(text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"), F.filter(found(text, IP), ip_ok)).otherwise(empty()),
        "card": F.when(text.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"), F.filter(found(text, CARD), card_ok)).otherwise(empty()),
        "phone": F.when(text.contains("+"), F.filter(found(text, PHONE), phone_ok)).otherwise(empty()),
    }


def _features_py(kind: str, hit: str, before: str) -> list[float]:
    """The same features as _features, for training."""
    d = re.sub("[^0-9]", "", hit)
    luhn = sum((int(c) if i % 2 == 0 else int(c) * 2 % 10 + int(c) // 5) for i, c in enumerate(reversed(d))) % 10 == 0
    return [
        float(KINDS.index(kind)), float(len(d)), float(luhn and len(d) > 0), float(len(re.findall("[0-9]+", hit))), float("(" in hit),
        float(len(hit)), float(len(set(d))), float(d[:1] or -1), float("/" in hit),
        *[float(bool(re.search(h, before.lower(), re.ASCII))) for h in HINTS],
        float(bool(re.search(r"[\[({](?:at|dot)", hit))), float(bool(re.search(ENDINGS, hit))), float(len(re.findall(" dot |[.]", hit))),
        float(len(re.search("[0-9]*$", hit)[0])),
    ]


def _features(kind: str, hit: Column, before: Column) -> list[Column]:
    one = lambda c: c.cast("double")
    d = _digits(hit)
    chars = F.filter(F.split(d, ""), lambda c: c != "")
    low = F.lower(before)
    return [
        F.lit(float(KINDS.index(kind))), one(F.length(d)), one(_luhn(d) & (F.length(d) > 0)), one(F.regexp_count(hit, F.lit("[0-9]+"))),
        one(hit.contains("(")), one(F.length(hit)), one(F.size(F.array_distinct(chars))),
        F.when(F.length(d) > 0, one(F.substring(d, 1, 1))).otherwise(F.lit(-1.0)), one(hit.contains("/")),
        *[one(low.rlike(h)) for h in HINTS],
        one(hit.rlike(r"[\[({](?:at|dot)")), one(hit.rlike(ENDINGS)), one(F.regexp_count(hit, F.lit(" dot |[.]"))),
        one(F.length(F.regexp_extract(hit, "[0-9]*$", 0))),
    ]


def written_examples(count: int, seed: int) -> tuple[list[tuple[str, str, str]], np.ndarray]:
    """(kind, hit, text before) and whether it is personal data."""
    r = random.Random(seed)
    num = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    words = ["the", "of", "in", "and", "we", "has", "on", "was", "le", "la", "der", "die", "el", "que", "shows"]

    def plain() -> str:
        return " ".join(r.choice(words) for _ in range(4)) + " "

    def card(good: bool) -> str:
        d = r.choice("3456") + num(14)
        check = next(c for c in "0123456789" if sum((int(v) if i % 2 == 0 else int(v) * 2 % 10 + int(v) // 5) for i, v in enumerate(reversed(d + c))) % 10 == 0)
        d += check if good else r.choice([c for c in "0123456789" if c != check])
        sep = r.choice(["", " ", "-", "."])
        return sep.join(d[i : i + 4] for i in range(0, 16, 4))

    name = lambda: r.choice(["anna", "john.smith", "m_lee", "info", "j.doe", "sales", "kim77"])
    host = lambda: r.choice(["example", "mail-host", "acme", "uni", "corp"])
    at, dot = (lambda: r.choice([" [at] ", "[at]", "(at)", " (at) ", "{at}", " at "])), (lambda: r.choice([" [dot] ", "[dot]", "(dot)", " dot ", "."]))
    yes = [
        lambda: ("phone", r.choice([f"({num(3)}) 555-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"0{num(3)} {num(3)} {num(4)}", f"({num(3)}) {num(3)}.{num(4)}"]),
                 plain() + r.choice(["call ", "Tel: ", "phone ", "fax: ", "mobile: ", "call me "])),
        lambda: ("phone", f"({num(3)}) {num(3)}-{num(4)}", plain()),
        lambda: ("card", card(True).replace(".", ""), plain() + r.choice(["card ", "visa: ", "credit card no ", "paid with card ", ""])),
        lambda: ("card", card(False).replace(".", ""), plain() + r.choice(["card ", "visa: ", "credit card number "])),
        lambda: ("email", name() + r.choice([" [at] ", "[at]", "(at)", "{at}"]) + host() + dot() + r.choice(["com", "org", "de", "net"]), plain() + r.choice(["mail ", "contact: ", "", "write to "])),
        lambda: ("email", name() + " at " + host() + " dot " + r.choice(["com", "org", "fr", "net"]), plain() + r.choice(["mail ", "reach me: ", "contact ", "e-mail "])),
    ]
    no = [
        lambda: ("phone", r.choice([f"{r.randint(1900, 2030)}-{num(2)}-{num(2)}", f"{num(2)}/{num(2)}/{num(4)}", f"{num(2)}.{num(2)}.{num(4)}"]), plain() + r.choice(["date ", "since ", "", "on "])),
        lambda: ("phone", f"{num(3)} {num(3)}", plain() + r.choice(["", "sum ", "no. "])),
        lambda: ("phone", " ".join(num(r.choice([2, 3, 4])) for _ in range(r.randint(2, 5))), plain() + r.choice(["", "values ", "page ", "from "])),
        lambda: ("phone", f"{num(3)}.{num(2)}.{num(3)}.{num(3)}", plain() + r.choice(["", "host ", "version "])),
        lambda: ("phone", card(r.random() < 0.5), plain()),
        lambda: ("phone", f"978-{num(1)}-{num(4)}-{num(4)}", plain() + r.choice(["isbn ", "ISBN: ", ""])),
        lambda: ("card", card(False), plain() + r.choice(["", "order ", "id ", "serial "])),
        lambda: ("card", num(r.choice([12, 13, 14, 17, 18, 19])), plain() + r.choice(["", "order ", "id ", "ref: "])),
        lambda: ("card", " ".join(num(3) for _ in range(r.randint(4, 6))), plain()),
        lambda: ("email", r.choice(["look", "was", "sat", "meet", "arrive"]) + " at " + r.choice(["home", "work", "noon", "school"]) + r.choice([". The", ". And", ". It", ". "+"Then"]), plain()),
        lambda: ("email", r.choice(["arrive", "bought"]) + " at " + r.choice(["acme", "station"]) + ". " + r.choice(["in", "we", "de", "es"]), plain()),
    ]
    out, y = [], []
    for i in range(count):
        good = i % 2
        out.append(r.choice(yes if good else no)())
        y.append(float(good))
    return out, np.array(y)


@lru_cache(maxsize=4)
def trained(o: PiiOptions) -> tuple[Trees, dict[str, float]]:
    """Trees, and for each proposed kind the probability from which a candidate is taken."""
    examples, y = written_examples(o.examples, o.seed)
    x = np.array([_features_py(*e) for e in examples])
    held = np.arange(len(y)) % 3 == 0
    model = boost(x[~held], y[~held])
    margin = model.margin(x)
    kinds = x[:, 0]
    bounds = {k: calibrated_bound(margin[held & (kinds == KINDS.index(k))], y[held & (kinds == KINDS.index(k))], o.precision) for k, _ in GENERATORS}
    return model, bounds


def _proposals(text: Column, pieces: Column, kind: str, pattern: str, model: Trees, bound: float) -> Column:
    rank = KINDS.index(kind)

    def scored(s: Column) -> Column:
        before = cut(pieces, F.greatest(s["start"] - CONTEXT, F.lit(0)), s["start"])
        features = let(before, lambda b: F.struct(*[c.alias(f"f{i}") for i, c in enumerate(_features(kind, s["hit"], b))]))
        count = len(_features(kind, F.lit(""), F.lit("")))
        p = let(features, lambda f: model.probability([f[f"f{i}"] for i in range(count)]))
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), p.alias("p"))

    return F.filter(F.transform(found(text, pattern), scored), lambda s: s["p"] >= bound)


def _uncovered(selected: Column, fixed: Column) -> Column:
    """The selected spans that lie in no fixed one and in no other selected one, by start.

    Of several with one extent the likelier stays, of equals the one whose kind comes first.
    """
    fields = ("start", "back", "late", "less", "rank", "kind", "end")
    row = lambda *values: F.struct(*[v.alias(n) for v, n in zip(values, fields, strict=True)])
    both = F.array_sort(
        F.concat(
            F.transform(fixed, lambda s: row(s["start"], -s["end"], F.lit(0), F.lit(0.0), F.lit(0), F.lit(""), s["end"])),
            F.transform(selected, lambda s: row(s["start"], -s["end"], F.lit(1), -s["p"], s["rank"], s["kind"], s["end"])),
        )
    )
    # By start, the longer first: a span lies in an earlier one if any of those reaches as far.
    reach = lambda spans: running(F.transform(spans, lambda s: s["end"]), F.greatest)
    free = lambda spans: F.filter(F.arrays_zip(spans.alias("s"), reach(spans).alias("to")), lambda z: (z["s"]["late"] == 1) & (z["to"] < z["s"]["end"]))
    out = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["rank"].alias("rank"), s["kind"].alias("kind"), (-s["less"]).alias("p"))
    return F.when(F.size(selected) > 0, let(both, lambda b: F.transform(free(b), lambda z: out(z["s"])))).otherwise(F.array().cast(SCORED))


SCORED = "array<struct<start:int,end:int,rank:int,kind:string,p:double>>"


def find_pii(docs: DataFrame, options: PiiOptions | None = None, text_col: str = "text") -> DataFrame:
    """docs with email, ip, card, phone: arrays of (start, end, hit); and added: (start, end, rank, kind, p).

    Offsets are code points. added holds what the trees select, by start, without spans that lie in
    a fixed one or in another selected one; of one extent the likelier stays. Spans may overlap in
    part. What is found in one place depends on nothing but the characters about it. Null and empty
    texts have empty arrays; texts are read whole. Every row gives one row, repeated rows too; other columns stay,
    except that columns under the five names are replaced. An empty table gives an empty result.
    """
    o = options or PiiOptions()
    model, bounds = trained(o)
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.withColumns(base_spans(text))
    fixed = F.concat(*[F.col(k) for k in KINDS])
    # What every proposal holds: two groups of digits or a card's first twelve; an address up to its first dot.
    number = text.rlike(r"[0-9]{2}\)?[\x20./-]{1,2}[0-9]{2}|[0-9](?:[\x20.-]?[0-9]){11}")
    at = text.rlike(r"[\[({]at[\])}]|\x20at\x20{1,2}[A-Za-z0-9-]{2,63}(?:\x20?[.\[({]|\x20{1,2}dot\x20)")
    nothing = F.array().cast(SCORED)

    def selected(pieces: Column) -> Column:
        lists = [
            F.when(at if kind == "email" else number, _proposals(text, pieces, kind, pattern, model, bounds[kind])).otherwise(nothing)
            for kind, pattern in GENERATORS
        ]
        return let(F.concat(*lists), lambda s: _uncovered(s, fixed))

    return out.withColumn("added", F.when(at | number, let(parts(text), selected)).otherwise(nothing))


def _marked(found_pii: DataFrame) -> tuple[Column, Column]:
    base = F.concat(*[tagged(F.col(k), k, i) for i, k in enumerate(KINDS)])
    more = F.transform("added", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["rank"].alias("rank"), s["kind"].alias("kind")))
    return base, F.concat(base, more)


def digest(found_pii: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the fixed formats, their digest, and all spans as text."""
    base, every = _marked(found_pii)
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    return found_pii.select(id_col, *counts, F.sha2(by_kind(base), 256).alias("base_sha256"), by_kind(every).alias("spans"))


def redact(found_pii: DataFrame, text_col: str = "text") -> DataFrame:
    """The input of find_pii with every span replaced by its kind in brackets; overlapping spans become one."""
    _, every = _marked(found_pii)
    text = F.coalesce(F.col(text_col), F.lit(""))
    ordered = F.array_sort(F.transform(every, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def opened(spans: Column) -> Column:
        # A span that starts at or after the end of all spans before it opens a new group.
        reach = running(F.transform(spans, lambda s: s["end"]), F.greatest)
        firsts = F.filter(F.arrays_zip(spans.alias("s"), reach.alias("to")), lambda z: z["s"]["start"] >= z["to"])
        return let(firsts, lambda f: closed(f, F.array_max(F.transform(spans, lambda s: s["end"]))))

    def closed(firsts: Column, last: Column) -> Column:
        # What all spans before a group reach is the end of the group before it.
        ends = F.concat(F.transform(F.slice(firsts, F.lit(2), F.size(firsts)), lambda z: z["to"]), F.array(last))
        starts = F.concat(F.array(F.lit(0)), ends)
        return let(
            F.transform(
                F.arrays_zip(firsts.alias("f"), F.slice(starts, F.lit(1), F.size(firsts)).alias("at"), ends.alias("end")),
                lambda z: F.struct(z["f"]["s"]["start"].alias("start"), z["end"].alias("end"), z["at"].alias("at"), z["f"]["s"]["kind"].alias("kind")),
            ),
            lambda g: let(parts(text), lambda pieces: rebuilt(g, pieces)),
        )

    def rebuilt(g: Column, pieces: Column) -> Column:
        said = F.transform(g, lambda s: F.concat(cut(pieces, s["at"], s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]")))
        return F.concat(F.array_join(said, ""), cut(pieces, F.element_at(g, -1)["end"], F.length(text)))

    changed = F.when(F.size(every) > 0, let(ordered, opened)).otherwise(F.col(text_col))
    return found_pii.withColumn(text_col, changed).drop(*KINDS, "added")
