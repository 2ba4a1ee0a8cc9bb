import pytest

from termsieve.config import BatchEmptyError, BatchTooLargeError, DuplicateBatchIdError, FuzzyOptions, InvalidMaskCharError, MatcherOptions, ModerationInputError, Policy, ScanOptions
from termsieve.plans.moderator import ModeratorOptions, moderator_from_terms

from .terms import TERMS


def make(spark, **o):
    return moderator_from_terms(spark, TERMS, ModeratorOptions(**o))


@pytest.fixture(scope="module")
def base(spark):
    return make(spark)


def check(m, *texts, **o):
    df = m.spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    return m.check(df, ScanOptions(**o)).orderBy("i").collect()


def test_scenarios(base):
    filler = "正常内容" * 12_500
    texts = [
        "这段文本里有违规词出现", "this is a class of things assets passable grass assassin", "what an ass", "违规词 违规词 违规词", "这里有违规词，也有 badword，还有台湾独立",
        "这是敏感词汇的例子", "主張臺灣獨立的內容", "ｂａｄｗｏｒｄ", "quarterly ﬁnance report", "违​规‍词", "😀违规词", "b4dw0rd b-a-d-w-o-r-d 违 规 词 baaadwooord",
        "Hello 违规词 world!\nSecond line 😀 with badword.", filler + "违规词" + filler, '<p class="x">违规词</p>',
        "Contact spam@example.com or visit https://evil.example.com/path?a=1 (42 times)", "line one\n\n  违规词  \n\tfree money\r\nend", "", "   \n\t ", None,
    ]
    r = check(base, *texts, mask=True)
    spans = [[(m.term, m.start, m.end, m.match_type) for m in x.matches] if x.matches is not None else None for x in r]
    assert spans[0] == [("违规词", 6, 9, "exact")] and r[0].decision == "review"
    assert spans[1] == [] and r[1].decision == "allow" and r[1].risk_level == "none" and r[1].masked_text == texts[1]
    assert spans[2] == [("ass", 8, 11, "exact")]
    assert (r[3].hit_count, r[3].unique_term_count, [m.start for m in r[3].matches]) == (3, 1, [0, 4, 8])
    assert (r[4].unique_term_count, r[4].categories) == (3, ["test-basic", "test-en", "test-politics"])
    assert spans[5] == [("敏感词汇", 2, 6, "exact")] and r[5].masked_text == "这是****的例子"
    assert (spans[6][0][0], r[6].matches[0].matched_text, spans[6][0][3]) == ("台湾独立", "臺灣獨立", "normalized")
    assert (spans[7], r[7].matches[0].matched_text) == ([("badword", 0, 7, "normalized")], "ｂａｄｗｏｒｄ")
    assert (spans[8][0][0], r[8].matches[0].matched_text) == ("finance", "ﬁnance")
    assert spans[9] == [("违规词", 0, 5, "normalized")] and r[9].masked_text == "*****"
    assert spans[10][0][1:3] == (1, 4) and r[10].masked_text == "😀***"
    assert spans[11] == []
    assert r[12].masked_text == "Hello *** world!\nSecond line 😀 with *******."
    assert spans[13] == [("违规词", 50_000, 50_003, "exact")]
    assert spans[14][0][1] == 13 and r[14].masked_text == '<p class="x">***</p>'
    assert sorted(s[0] for s in spans[15]) == ["evil.example.com", "spam@example.com"]
    assert sorted(s[0] for s in spans[16]) == ["free money", "违规词"]
    assert r[17].matched is False and r[18].matched is False and r[17].decision == "allow"
    assert r[19].matched is None and r[19].matches is None and r[19].masked_text is None
    assert (r[0].lexicon.version, r[0].lexicon.upstream_commit) == ("inline", None)


def test_overlap_all(base):
    r = check(base, "这是敏感词汇的例子", overlap="all", mask=True)[0]
    assert [m.term for m in r.matches] == ["敏感词汇", "敏感"] and r.masked_text == "这是****的例子"


def test_fuzzy(spark):
    fuzzy = make(spark, mode="fuzzy")
    texts = ["违 规 词", "b-a-d-w-o-r-d", "b.a.d.w.o.r.d", "b_a_d_w_o_r_d", "b·a·d·w·o·r·d", "b4dw0rd is here", "baaadwooord", "badword", "😀 b-a-d-w-o-r-d"]
    r = check(fuzzy, *texts)
    assert [(x.matches[0].start, x.matches[0].end, x.matches[0].match_type) for x in r[:1]] == [(0, 5, "fuzzy")]
    assert all(x.matches[0].term == "badword" and x.matches[0].match_type == "fuzzy" for x in r[1:6])
    assert r[5].matches[0].matched_text == "b4dw0rd" and not r[6].matched and r[7].matches[0].match_type == "exact" and r[8].matches[0].start == 2
    collapsed = make(spark, mode="fuzzy", matcher=MatcherOptions(fuzzy=FuzzyOptions(collapse_repeats=True)))
    assert check(collapsed, "baaadwooord")[0].matches[0].matched_text == "baaadwooord"


def test_allowlist(spark, base):
    assert not check(make(spark, matcher=MatcherOptions(allowlist=("违规词",))), "这里有违规词")[0].matched
    r = check(make(spark, matcher=MatcherOptions(allowlist=("冰岛",))), "我想去冰岛旅游", "我想买冰")
    assert [x.matched for x in r] == [False, True]
    assert not check(base, "这里有违规词", allowlist=("违规词",))[0].matched
    # A suppressed long term lets a shorter one inside it come up.
    assert [m.term for m in check(base, "敏感词汇", allowlist=("词汇", "敏感词汇x"))[0].matches] == ["敏感词汇"]


def test_categories_and_custom_terms(spark, base):
    text = "这里有违规词，也有 badword"
    assert check(base, text, categories=("test-basic",))[0].categories == ["test-basic"]
    assert check(base, text, categories=("test-en",))[0].hit_count == 1
    assert not check(base, text, categories=("test-danger",))[0].matched
    assert check(base, text, categories=("*",))[0].hit_count == 2
    r = check(make(spark, custom_terms=(("业务禁词", "custom", "high"),)), "这是业务禁词")[0]
    assert (r.matches[0].category, r.matches[0].severity, r.decision, r.risk_level) == ("custom", "high", "block", "high")


def test_policies(spark, base):
    r = check(base, "敏感", "违规词", "爆炸物制造")
    assert [(x.decision, x.risk_level) for x in r] == [("review", "low"), ("review", "medium"), ("block", "high")]
    decide = lambda p, *t: [x.decision for x in check(make(spark, policy=p), *t)]
    assert decide(Policy(block_severities=("medium", "high")), "违规词") == ["block"]
    assert decide(Policy(block_severities=()), "爆炸物制造") == ["review"]
    assert decide(Policy(allow_categories=("test-basic",)), "违规词") == ["allow"]
    assert decide(Policy(block_categories=("test-basic",)), "违规词") == ["block"]
    assert decide(Policy(block_severities=("medium",), block_min_hit_count=3), "违规词", "违规词 违规词 违规词") == ["review", "block"]
    allowed = check(make(spark, policy=Policy(allow_categories=("test-basic",))), "违规词")[0]
    assert (allowed.matched, allowed.hit_count, allowed.risk_level) == (True, 1, "medium")


def test_other_verbs(spark, base):
    df = spark.createDataFrame([(1, "敏感词汇 违规词 敏感词汇"), (2, "完全干净的文本"), (3, None)], "i int, text string")
    one = lambda d: d.orderBy("i").collect()
    assert [r.contains for r in one(base.contains(df))][:2] == [True, False]
    assert [r.first_match and r.first_match.term for r in one(base.find_first(df))] == ["敏感词汇", None, None]
    assert base.find_all(df).count() == 3 and base.find_all(df, ScanOptions(max_matches=2)).count() == 2
    assert one(base.find_unique_terms(df))[0].unique_terms == ["敏感词汇", "违规词"]
    r = check(base, "违规词 违规词", return_matches=False)[0]
    assert (r.matches, r.hit_count, r.unique_term_count) == ([], 2, 1)
    none = check(base, "爆炸物制造", max_matches=0)[0]
    assert (none.decision, none.risk_level, none.hit_count) == ("allow", "none", 0)
    texts = spark.createDataFrame([("这里有违规词",)], "text string")
    assert base.mask(texts, ScanOptions(mask_char="#")).first().masked_text == "这里有###"
    assert base.mask(texts, ScanOptions(mask_char="🚫")).first().masked_text == "这里有🚫🚫🚫"
    stats = base.stats(["normalized", "fuzzy", "exact"]).collect()
    assert stats[0].pattern_count == 12 and stats[1].skipped_terms == 2 and stats[0].edge_count == stats[0].node_count - 1
    m = base.metadata().first()
    assert (m.term_count, m.total_term_count, len(m.categories)) == (12, 12, 7)


def test_rejections(spark, base):
    df = spark.createDataFrame([("违规词",)], "text string")
    with pytest.raises(InvalidMaskCharError, match="non-empty"):
        base.mask(df, ScanOptions(mask_char=""))
    with pytest.raises(InvalidMaskCharError, match="one Unicode code point"):
        base.mask(df, ScanOptions(mask_char="**"))
    for options, code in ((ScanOptions(categories=("nope",)), "UNKNOWN_CATEGORY"), (ScanOptions(mode="semantic"), "INVALID_MODE")):
        with pytest.raises(ModerationInputError) as e:
            base.check(df, options)
        assert e.value.code == code
    with pytest.raises(ModerationInputError) as e:
        base.check(spark.createDataFrame([(42,)], "text int"))
    assert e.value.code == "INVALID_TEXT"


def test_batch(spark, base):
    rows = [(0, "a", '"干净的文本"'), (1, "b", '"这里有违规词"'), (2, "c", '""'), (3, None, "42"), (4, "e", None)]
    items = spark.createDataFrame(rows, "item_index int, id string, j string").selectExpr("item_index", "id", "parse_json(j) as text")
    results, summary = base.check_batch(items)
    got = {r.id: r for r in results.collect()}
    assert {k: (v.success, v.error and v.error.code) for k, v in got.items()} == {
        "a": (True, None), "b": (True, None), "c": (False, "TEXT_EMPTY"), "3": (False, "TEXT_NOT_STRING"), "e": (False, "TEXT_REQUIRED"),
    }
    assert tuple(summary.first()) == (5, 2, 3, 1) and got["b"].data.decision == "review" and got["a"].error is None
    plain = spark.createDataFrame([("x", " 　\n"), ("y", "🎉" * 3), ("z", "ok")], "id string, text string")
    results, _ = base.check_batch(plain, max_text_length=5)
    assert {r.id: r.error and r.error.code for r in results.collect()} == {"x": "TEXT_BLANK", "y": "TEXT_TOO_LONG", "z": None}
    with pytest.raises(DuplicateBatchIdError):
        base.check_batch(spark.createDataFrame([("x", "1"), ("x", "2")], "id string, text string"))


def test_batches_that_fail_as_a_whole_and_default_ids(spark, base):
    schema = "id string, text string"
    results, summary = base.check_batch(spark.createDataFrame([(None, "a"), (None, "b")], schema))
    assert [r.id for r in results.collect()] == ["0", "1"] and summary.first().total == 2
    many = spark.createDataFrame([(None if i % 3 else f"own{i}", "违规词" if i % 2 else "x") for i in range(200)], schema).repartition(5).cache()
    ids = [r.id for r in many.collect()]
    results, seen = base.check_batch_observed(many)
    assert [r.id for r in results.collect()] == [str(i) if v is None else v for i, v in enumerate(ids)]
    assert seen.get == {"total": 200, "succeeded": 200, "failed": 0, "matched": 100}
    with pytest.raises(DuplicateBatchIdError) as e:
        base.check_batch(spark.createDataFrame([("same", "a"), ("same", "b")], schema))
    assert (e.value.code, e.value.details) == ("DUPLICATE_BATCH_ID", {"duplicateId": "same"})
    with pytest.raises(DuplicateBatchIdError):
        base.check_batch(spark.createDataFrame([("1", "a"), (None, "b")], schema))
    with pytest.raises(BatchEmptyError) as e:
        base.check_batch(spark.createDataFrame([], schema))
    assert e.value.code == "BATCH_EMPTY"
    with pytest.raises(BatchTooLargeError) as e:
        base.check_batch(spark.createDataFrame([(None, f"t{i}") for i in range(6)], schema), max_items=5)
    assert (e.value.code, e.value.details) == ("BATCH_TOO_LARGE", {"batchMaxItems": 5})
    shared, _ = base.check_batch(spark.createDataFrame([(None, "b4dw0rd"), (None, "badword")], schema), ScanOptions(mode="fuzzy", mask=True))
    got = shared.orderBy("id").collect()
    assert (got[0].data.matches[0].match_type, got[1].data.masked_text) == ("fuzzy", "*******")


def test_inner_names_do_not_clash(spark, base):
    df = spark.createDataFrame([("违规词", 1, 2, 3)], "text string, _found int, _match int, __match int")
    found = base.check(df, ScanOptions(mask=True)).first()
    assert (found._found, found.masked_text) == (1, "***") and base.find_all(df).first()._match == 2


def test_clashing_columns_and_empty_tables(spark, base):
    df = spark.createDataFrame([("违规词", 1, "kept")], "text string, matches int, term string")
    assert base.check(df).first().hit_count == 1 and base.find_all(df).first().term == "违规词"
    assert base.check(df.limit(0)).count() == 0 and base.find_all(df.limit(0)).count() == 0
