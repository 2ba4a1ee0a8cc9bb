import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from termsieve.llm.bpe import Encoder, encode_texts, load_vocabulary, merge_by_rank
from termsieve.llm.queries import vocabulary_path


@pytest.fixture(scope="module")
def both():
    path = vocabulary_path()
    return Tokenizer.from_file(path), Encoder(load_vocabulary(path))


def same(both, text):
    lib, own = both
    ids = lib.encode(text, add_special_tokens=False).ids
    mine = np.frombuffer(own.encode(text), "<u4").astype(np.int64)
    return ids == mine.tolist() and lib.decode(ids, skip_special_tokens=False).encode() == own.decode(mine)


def test_words_as_the_library(both):
    r = random.Random(2)
    names = [n.replace("</w>", "") for n in both[1].v.names if n.isascii()]
    for _ in range(4000):
        assert same(both, "".join(r.choice("abcdefghij"[: r.choice([2, 10])]) for _ in range(r.randint(1, 30))))
        assert same(both, "".join(r.choice(names) for _ in range(r.randint(1, 4))))


def test_texts_as_the_library(both):
    for text in ("", " ", "It's we'LL 'S don't!!'s 12 345", "a<|endoftext|>b <|startoftext|>", "<|ENDOFTEXT|>", "É\x85é́\x1cΣΑΣ İi", "日本語 한국어 \U0001f389", "x" * 30_000, "ab " * 20_000):
        assert same(both, text), text[:40]
    r = random.Random(3)
    pools = [range(0x20, 0x250), range(0x300, 0x370), range(0x300, 0x3000), range(0x1F300, 0x1F700), [0x20, 0x27, 0x3A3, 0x130, 0x1C, 0x85]]
    for _ in range(6000):
        assert same(both, "".join(chr(r.choice(r.choice(pools))) for _ in range(r.randint(1, 14))))


def test_kept_pieces_do_not_stand_in_for_normalized_words(both):
    # The lower case of U+0130 isn't composed again, the same characters as a text are.
    for text in ("i\u0307\u0319 x", "\u0130\u0319!", "\u0130\u0319", "i\u0307\u0319!"):
        assert same(both, text), ascii(text)


def test_merging_by_rank_is_what_the_backtracking_gives(both):
    own = both[1]
    ranks = {h: i for i, h in enumerate(own.v.halves) if h != (i, i)}
    r = random.Random(4)
    for _ in range(1500):
        word = "".join(r.choice("aeinrst") for _ in range(r.randint(1, 12)))
        word = word[:-1] + chr(ord(word[-1]) + 0x10000)
        assert own.encode_word(word) == merge_by_rank(word, own.index, ranks)


def test_rows(spark, both):
    df = spark.createDataFrame([(1, "Hello world", "x"), (2, None, None), (3, "", "y"), (None, "a", "z"), (1, "Hello world", "x")], "doc_id long, text string, ids string")
    out = encode_texts(df, vocabulary_path()).collect()
    ids = both[0].encode("Hello world", add_special_tokens=False).ids
    assert [r.n_tokens for r in out] == [2, 0, 0, 1, 2] and out[0].ids == ids and out[0].decoded == "hello</w> world</w>"
    assert out[0].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and out[1].decoded == "" and out[3].doc_id is None
    assert encode_texts(df.limit(0), vocabulary_path(), with_ids=False).count() == 0
