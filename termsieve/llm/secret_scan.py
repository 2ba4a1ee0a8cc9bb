"""Secrets in whole texts: fixed formats, and a battery of randomness tests on long tokens.

For each long token the encoding is inferred from its characters. Under the hypothesis that the
token is random in that alphabet, three statistics are near standard normal: the chi-squared
statistic of its characters, the number of runs above and below the alphabet's middle, and the
serial correlation of neighbouring characters. A token that any test rejects is no secret. Against
the hypothesis that the token is written text, whose letters are uneven, the chi-squared statistic
is far too small; the longer the token, the clearer. These p-values go through a false-discovery
procedure within the document, weighted by the tokens' lengths.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spans import by_start, empty, found, let, normal_cdf, outside, tagged

ASSIGN = r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{16,}"
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DIGITS = UPPER + LOWER + "0123456789+/-_="


@dataclass(frozen=True)
class SecretOptions:
    """min_length: of tokens tested; battery: least two-sided p of each test; fdr: false-discovery rate.

    text_collision: the chance that two characters of written text agree, and text_excess: by how much at least it
    is above that of random ones, in parts of the latter, whatever the alphabet.
    """

    min_length: int = 20
    battery: float = 0.002
    fdr: float = 0.01
    text_collision: float = 0.066
    text_excess: float = 1.0


def _statistics(token: Column, o: SecretOptions) -> Column:
    """(n, p_text, p_least) of one token."""
    k = (
        F.when(token.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), 16.0)
        .when(token.rlike("^[A-Z2-7]+=*$"), 32.0)
        .when(token.rlike("^(?:[0-9a-z]+|[0-9A-Z]+)$"), 36.0)
        .when(token.rlike("^[0-9A-Za-z]+$"), 62.0)
        .otherwise(64.0)
    )
    chars = F.filter(F.split(token, ""), lambda c: c != "")
    first = F.struct(k.alias("k"), F.length(token).cast("double").alias("n"), chars.alias("chars"), token.alias("hit"))
    return let(first, lambda t: let(_placed_chars(t), lambda u: let(_scores(t, u), lambda z: _p_values(t, z, o))))


def _placed_chars(t: Column) -> Column:
    """The characters' distances from their mean position in the inferred alphabet, scaled to 0..1."""
    place = lambda c: (
        F.when(t["k"] == 16, F.instr(F.lit("0123456789abcdef"), F.lower(c)))
        .when(t["k"] == 32, F.instr(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567="), c))
        .when(t["k"] == 36, F.instr(F.lit("abcdefghijklmnopqrstuvwxyz0123456789"), F.lower(c)))
        .otherwise(F.instr(F.lit(DIGITS), c))
    )
    xs = F.transform(t["chars"], lambda c: place(c).cast("double") / t["k"])
    mean = lambda x: F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / t["n"]
    return let(xs, lambda x: let(mean(x), lambda m: F.transform(x, lambda v: v - m)))


def _scores(t: Column, dev: Column) -> Column:
    """Standard scores of the three tests, and the chi-squared statistic itself."""
    n, k = t["n"], t["k"]
    # What a character's removal shortens the token by is how often it stands there.
    squares = F.aggregate(
        F.transform(F.array_distinct(t["chars"]), lambda d: (n - F.length(F.replace(t["hit"], d, F.lit(""))))),
        F.lit(0.0), lambda a, c: a + c * c,
    )
    pairs = F.arrays_zip(F.slice(dev, F.lit(1), F.size(dev) - 1).alias("x"), F.slice(dev, F.lit(2), F.size(dev)).alias("y"))
    sums = F.struct(
        (squares * k / n - n).alias("chi"),
        F.aggregate(dev, F.lit(0.0), lambda a, x: a + x * x).alias("var"),
        F.aggregate(pairs, F.lit(0.0), lambda a, p: a + p["x"] * p["y"]).alias("cross"),
        F.aggregate(dev, F.lit(0.0), lambda a, x: a + (x >= 0).cast("double")).alias("up"),
        F.aggregate(pairs, F.lit(0.0), lambda a, p: a + ((p["x"] >= 0) != (p["y"] >= 0)).cast("double")).alias("changes"),
    )

    def scores(s: Column) -> Column:
        flat = 2 * s["up"] * (n - s["up"])
        spread = flat * (flat - n) / (n * n * (n - 1))
        return F.struct(
            s["chi"].alias("chi"),
            ((s["chi"] - (k - 1)) / F.sqrt(2 * (k - 1))).alias("even"),
            F.when(spread > 0, (s["changes"] - flat / n) / F.sqrt(spread)).otherwise(F.lit(8.0)).alias("runs"),
            F.when(s["var"] > 0, s["cross"] / s["var"] * F.sqrt(n)).otherwise(F.lit(8.0)).alias("serial"),
        )

    return let(sums, scores)


def _p_values(t: Column, z: Column, o: SecretOptions) -> Column:
    n, k = t["n"], t["k"]
    two_sided = lambda v: 2 * normal_cdf(-F.abs(v))
    # Too even a spread of characters is not held against a token.
    p_least = F.least(two_sided(F.greatest(z["even"], F.lit(0.0))), two_sided(z["runs"]), two_sided(z["serial"]))
    off = F.greatest(k * o.text_collision - 1, F.lit(o.text_excess)) * n
    p_text = normal_cdf((z["chi"] - (k - 1 + off)) / F.sqrt(2 * (k - 1) + 4 * off))
    return F.struct(n.alias("n"), p_text.alias("p_text"), p_least.alias("p_least"))


def _cases(token: Column) -> Column:
    """The token's letters as A and a by their case, without all else."""
    return F.translate(token, UPPER + LOWER + "0123456789+/-_=", "A" * 26 + "a" * 26)


def _random_tokens(text: Column, o: SecretOptions) -> Column:
    pattern = rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{o.min_length},}}"
    # A run with neither a digit nor six capitals before small letters is a word or a rule of dashes.
    worth = lambda s: s["hit"].rlike("[0-9]") & s["hit"].rlike("[A-Za-z]") | (F.regexp_count(_cases(s["hit"]), F.lit("Aa")) >= 6)
    tokens = F.filter(found(text, pattern), worth)
    tested = F.transform(
        tokens, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["hit"].alias("hit"), _statistics(s["hit"], o).alias("st"))
    )
    return let(tested, lambda ts: let(_weighted(ts), lambda ws: let(_bound(ws, o), lambda b: _accepted(ws, b, o))))


def _weighted(tested: Column) -> Column:
    """p-values against written text, divided by weights that follow the length and average 1."""
    total = F.aggregate(tested, F.lit(0.0), lambda a, t: a + t["st"]["n"])
    return let(
        total / F.greatest(F.size(tested), F.lit(1)),
        lambda mean: F.transform(
            tested,
            lambda t: F.struct(
                t["start"].alias("start"), t["end"].alias("end"), t["hit"].alias("hit"),
                t["st"]["p_least"].alias("p_least"), (t["st"]["p_text"] * mean / t["st"]["n"]).alias("p"),
            ),
        ),
    )


def _bound(weighed: Column, o: SecretOptions) -> Column:
    """The largest p-value that the step-up procedure accepts, or -1."""
    ps = F.array_sort(F.transform(weighed, lambda t: t["p"]))
    passed = F.transform(ps, lambda p, i: F.when(p <= (i + 1) * o.fdr / F.greatest(F.size(weighed), F.lit(1)), p).otherwise(F.lit(-1.0)))
    return F.aggregate(passed, F.lit(-1.0), lambda a, p: F.greatest(a, p))


def _accepted(weighed: Column, bound: Column, o: SecretOptions) -> Column:
    kept = F.filter(weighed, lambda t: (t["p"] <= bound) & (t["p_least"] >= o.battery))
    return F.transform(kept, lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), t["hit"].alias("hit")))


def find_secrets(docs: DataFrame, options: SecretOptions | None = None, text_col: str = "text") -> DataFrame:
    """docs with assign, access, hex_runs and random: arrays of (start, end, hit) in code points.

    The first three are the fixed formats; random holds what the tests add, without spans that lie
    in a fixed one. Null and empty texts have empty arrays; texts are read whole. Every row of docs
    gives one row, repeated rows too; other columns stay, except that columns under the four names
    are replaced. An empty table gives an empty result.
    """
    o = options or SecretOptions()
    text = F.coalesce(F.col(text_col), F.lit(""))
    low = F.lower(text)
    hint = low.contains(WORDS[0])
    for w in WORDS[1:]:
        hint = hint | low.contains(w)
    good = F.filter(found(text, ASSIGN), lambda s: F.length(F.regexp_extract(s["hit"], ASSIGN, 2)) >= 12)
    with_base = docs.withColumns(
        {
            "assign": F.when(hint, good).otherwise(empty()),
            "access": F.when(text.contains("AKIA"), found(text, ACCESS)).otherwise(empty()),
            "hex_runs": F.when(text.rlike(HEX), found(text, HEX)).otherwise(empty()),
        }
    )
    long_token = rf"[A-Za-z0-9+/_=-]{{{o.min_length}}}"
    added = outside(F.concat("assign", "access", "hex_runs"), _random_tokens(text, o))
    return with_base.withColumn("random", F.when(text.rlike(long_token), added).otherwise(empty()))


def digest(found_spans: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the fixed formats, their digest, and all spans as text."""
    base = F.concat(tagged(F.col("assign"), "assign", 0), tagged(F.col("access"), "access", 1), tagged(F.col("hex_runs"), "hex", 2))
    count = lambda c: F.size(c).cast("long")
    return found_spans.select(
        id_col, count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex_runs").alias("n_hex"),
        F.sha2(by_start(base), 256).alias("base_sha256"),
        by_start(F.concat(base, tagged(F.col("random"), "random", 3))).alias("spans"),
    )
