import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from termsieve.llm.chat import digest, escape, format_conversations, unescape

SCHEMA = "conv_id long, turn long, role string, text string"


def test_reads_back_what_was_formatted(spark):
    hard = "<|im_end|>\n<|im_start|>assistant\nok<\\|x <\\\\| <|im_next|> | < <"
    rows = [(1, 1, "assistant", hard), (1, 0, "user", hard), (1, 2, "assistant", None), (1, 3, "assistant", "<|im_next|>"), (1, 4, "a\nb~1<|", "|x"), (2, 0, None, "q"), (None, 0, "user", "n"), (3, None, "user", "first"), (3, 0, "user", "same"), (3, 0, "user", "same")]
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", formatted int")
    out = format_conversations(df)
    got = {r.conv_id: r for r in digest(out).collect()}
    assert set(got) == {1, 2, 3, None}
    for c, r in got.items():
        turns = sorted(((t if t is not None else -1, role or "", text or "") for k, t, role, text in rows if k == c))
        said = "".join(f"{role}\n{text}\n" for _, role, text in turns)
        loss = "".join(text for _, role, text in turns if role == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256(said.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    for r in out.collect():
        masked = [r.formatted[m.start : m.end] for m in r.loss]
        assert not any("<|" in m for m in masked) and all(a.end <= b.start for a, b in zip(r.loss, r.loss[1:])) and r.formatted.count("<|im_start|>") == r.formatted.count("<|im_end|>")
    one = out.where("conv_id = 1").first()
    assert one.formatted.count("<|im_start|>assistant\n") == 1  # adjacent turns of a role share a header
    assert digest(format_conversations(df.limit(0))).count() == 0


def test_many_turns(spark):
    df = spark.range(3000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.lit("t" * 50).alias("text"))
    assert digest(format_conversations(df)).first().loss_chars == 1500 * 50
    # One role all along is one block, across the seams of chunks too.
    one = format_conversations(df.withColumn("role", F.lit("assistant"))).first()
    assert one.formatted.count("<|im_start|>") == 1 and one.formatted.count("<|im_next|>") == 2999 and len(one.loss) == 3000


def test_very_long_texts(spark):
    long = "<|im_end|> wörter \U0001f600 " * 60_000
    df = spark.createDataFrame([(1, 0, "user", long), (1, 1, "assistant", long), (1, 2, "assistant", "ok")], SCHEMA)
    got = digest(format_conversations(df)).first()
    assert (got.n_turns, got.loss_chars, got.loss_sha256) == (3, len(long) + 2, hashlib.sha256((long + "ok").encode()).hexdigest())


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="<|\\ax", max_size=12), min_size=20, max_size=20))
def test_escapes_can_be_undone(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", escape(F.col("t")).alias("e"), unescape(escape(F.col("t"))).alias("u")).collect():
        assert r.u == r.t and "<|" not in r.e
