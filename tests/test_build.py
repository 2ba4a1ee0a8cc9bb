import json
import random
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from termsieve.config import LexiconLoadError
from termsieve.functions import text as T
from termsieve.plans.build import (
    build_lexicon, config_frame, diff_snapshots, in_order, lock_file, read_term_files, render_diff, render_report, round_trip_misses, snapshot, to_artifact, validate_artifact, write_build,
)
from termsieve.plans.moderator import Moderator, ModeratorOptions
from termsieve.sources.terms import load_artifact, read_allowlist, read_character_table, read_custom_terms

CONFIG = {
    "defaultSeverity": "low",
    "sources": {
        "Vocabulary/messy.txt": {"category": "messy", "displayName": "混乱词库", "severity": "medium"},
        "Vocabulary/danger.txt": {"category": "danger", "displayName": "危险", "severity": "high"},
    },
}
NOW = datetime(2026, 7, 29, 12, tzinfo=UTC)


def tree(root, files):
    for name, body in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(body if isinstance(body, bytes) else body.encode())
    return str(root)


def build(spark, root, files, config=CONFIG, local=None, **o):
    up = read_term_files(spark, tree(root / "up", files))
    more = read_term_files(spark, tree(root / "local", local), "local/") if local else None
    frame, default = config_frame(spark, config)
    return build_lexicon(spark, in_order(up, more), frame, default, now=NOW, **o)


def test_cleaning(spark, tmp_path):
    body = "﻿第一词\r\n\r\n  第二词  \n# comment\n第三词\n\n"
    r = build(spark, tmp_path, {"Vocabulary/messy.txt": body}, upstream_commit="abc123", synced_at="2026-01-01T00:00:00.000Z")
    assert [e.term for e in r.entries.orderBy("term_index").collect()] == ["第一词", "第二词", "第三词"]
    report, source = r.report.first(), r.sources.first()
    assert (report.empty_line_count, source.bom_stripped, source.crlf_line_count) == (4, True, 2)
    assert (report.upstream_commit, report.synced_at, report.version, report.built_at) == ("abc123", "2026-01-01T00:00:00.000Z", "2026.07.29", "2026-07-29T12:00:00.000Z")


def test_duplicates(spark, tmp_path):
    r = build(spark, tmp_path, {"Vocabulary/messy.txt": "重复词\n重复词\n独有词\n", "Vocabulary/danger.txt": "重复词\n危险词\n"})
    report = r.report.first()
    assert (report.term_count_before_dedupe, report.term_count_after_dedupe, report.duplicate_count, report.cross_source_duplicate_count) == (5, 3, 2, 1)
    assert r.entries.where("term = '重复词'").first().also_found_in == ["Vocabulary/messy.txt"]


def test_takeover_by_severity(spark, tmp_path):
    config = {"sources": {"V/a.txt": {"category": "broad", "severity": "low"}, "V/b.txt": {"category": "specific", "severity": "high"}}}
    r = build(spark, tmp_path, {"V/a.txt": "共有词\n只在广泛表\n", "V/b.txt": "共有词\n"}, config)
    e = r.entries.where("term = '共有词'").first()
    assert (e.category, e.severity, e.source_path, e.also_found_in, e.term_index) == ("specific", "high", "V/b.txt", ["V/a.txt"], 0)
    assert r.report.first().reassigned_count == 1
    assert {c.id: c.term_count for c in r.categories.collect()} == {"broad": 1, "specific": 1}
    assert [s.term_count for s in r.sources.orderBy("file_seq").collect()] == [2, 0]


def test_flags(spark, tmp_path):
    r = build(spark, tmp_path, {"Vocabulary/messy.txt": "单\n1989\nok词\nfree money\n???\na\tb"})
    kept = {e.term: e.needs_review for e in r.entries.collect()}
    assert set(kept) == {"单", "1989", "ok词", "free money", "a\tb"} and kept["单"] and not kept["ok词"]
    assert {f.term: f.issues for f in r.flagged.collect()} == {"单": ["single-character"], "1989": ["digits-only"], "???": ["punctuation-only"], "a\tb": ["contains-whitespace"]}
    assert r.report.first().single_character_term_count == 1


def test_derived_categories_local_files_and_order(spark, tmp_path):
    r = build(spark, tmp_path, {"Vocabulary/Unconfigured File.txt": "词\n词二\n", "B.TXT": "x1", "skip.md": "no"}, {"sources": {}}, {"house-rules.txt": "# c\n本地词\n"})
    assert [s.path for s in r.sources.orderBy("file_seq").collect()] == ["B.TXT", "Vocabulary/Unconfigured File.txt", "local/house-rules.txt"]
    c = r.categories.where("id = 'unconfigured-file'").first()
    assert (c.severity, c.default_enabled, c.display_name) == ("low", True, "Unconfigured File")
    e = r.entries.where("term = '本地词'").first()
    assert (e.source_path, e.category) == ("local/house-rules.txt", "house-rules")


def test_empty_tree(spark, tmp_path):
    art = to_artifact(build(spark, tmp_path, {"Vocabulary/messy.txt": "\n\n"}))
    assert (art["termCount"], art["terms"], art["categoryIndex"]) == (0, "", "")
    assert read_term_files(spark, str(tmp_path / "nowhere")).count() == 0


def test_attribution_agrees_with_reading_line_by_line(spark, tmp_path):
    r = random.Random(4)
    files = {f"f{i}.txt": "\n".join(r.choice(["aa", "bb", "cc", "dd", "ee", "AA", "x"]) for _ in range(12)) for i in range(6)}
    config = {"sources": {f"f{i}.txt": {"category": f"c{i % 4}", "severity": r.choice(["low", "medium", "high"])} for i in range(6)}}
    built = build(spark, tmp_path, files, config)
    rank = {"low": 1, "medium": 2, "high": 3}
    severity, own, cross, moved = {}, {}, 0, 0
    for path in sorted(files):
        c = config["sources"][path]
        severity.setdefault(c["category"], c["severity"])
        for term in files[path].split("\n"):
            if term not in own:
                own[term] = [c["category"], severity[c["category"]], path, set()]
            elif path != own[term][2] and path not in own[term][3]:
                cross += 1
                own[term][3].add(path)
                if rank[severity[c["category"]]] > rank[own[term][1]]:
                    own[term] = [c["category"], severity[c["category"]], path, own[term][3] - {path} | {own[term][2]}]
                    moved += 1
    assert {e.term: [e.category, e.severity, e.source_path, set(e.also_found_in)] for e in built.entries.collect()} == own
    assert [e.term for e in built.entries.orderBy("term_index").collect()] == list(own)
    report = built.report.first()
    assert (report.cross_source_duplicate_count, report.reassigned_count, report.normalized_collision_count) == (cross, moved, 1)


def test_artifact_round_trip(spark, tmp_path):
    r = build(spark, tmp_path, {"Vocabulary/messy.txt": "第一词\n单\nbadword\n", "Vocabulary/danger.txt": "第一词\n危险\n"}, upstream_commit="abc")
    out = str(tmp_path / "out")
    write_build(r, out)
    art = json.loads((tmp_path / "out/lexicon.json").read_text())
    assert art == to_artifact(r) and art["alsoFoundIn"] == {"0": ["Vocabulary/messy.txt"]}
    assert "| Raw term lines | 5 |" in (tmp_path / "out/build-report.md").read_text() == render_report(r)
    lex = load_artifact(spark, f"{out}/lexicon.json")
    e = {x.term: x for x in lex.entries.collect()}
    assert set(e) == {"第一词", "危险", "badword"} and lex.total_term_count == 4
    # Entries carry their category's first path, not the term's own.
    assert (e["第一词"].severity, e["第一词"].category, e["第一词"].id, e["第一词"].source_path) == ("high", "danger", "danger:0", "Vocabulary/danger.txt")
    assert {c.id: c.term_count for c in lex.categories.collect()} == {"danger": 2, "messy": 1}
    # A review flag alone doesn't admit single characters.
    assert load_artifact(spark, f"{out}/lexicon.json", include_needs_review=True).entries.count() == 3
    assert load_artifact(spark, f"{out}/lexicon.json", include_needs_review=True, min_term_length=1).entries.count() == 4
    assert load_artifact(spark, f"{out}/lexicon.json", categories=["messy"]).entries.count() == 1
    m = Moderator(spark, lex, ModeratorOptions())
    assert m.check(spark.createDataFrame([("危险!",)], "text string")).first().decision == "block"
    assert round_trip_misses(lex.entries, m).count() == 0 and m.metadata().first().upstream_commit == "abc"
    m.reload()
    assert validate_artifact(spark, art).count() == 0
    bad = art | {"terms": "a\na\n ", "flags": "0", "termCount": 4, "categoryIndex": "0,9,1,1"}
    messages = [x.message for x in validate_artifact(spark, bad, {"upstream": {"commit": "zzz"}, "files": []}).collect()]
    assert len(messages) == 9 or len(messages) == 8, messages


@pytest.mark.parametrize(
    "change",
    [{"formatVersion": 2}, {"terms": None}, {"categories": None}, {"termCount": "1"}, {"termCount": 3}, {"flags": "0"}, {"severityIndex": "x,y"}, {"categoryIndex": "0,7"}],
)
def test_corrupt_artifacts(spark, tmp_path, change):
    art = {
        "formatVersion": 1, "version": "1", "upstreamCommit": None, "syncedAt": None, "builtAt": "t", "termCount": 2, "categories": [{"id": "a", "displayName": "A", "severity": "low", "source": "s", "sourcePath": "p", "termCount": 2}],
        "sources": [], "terms": "ab\ncd", "categoryIndex": "0,0", "severityIndex": "0,2", "languageIndex": "1,1", "flags": "0,0", "alsoFoundIn": {},
    }
    path = tmp_path / "a.json"
    path.write_text(json.dumps(art))
    assert [e.severity for e in load_artifact(spark, str(path)).entries.orderBy("term_index").collect()] == ["low", "high"]
    path.write_text(json.dumps(art | change))
    with pytest.raises(LexiconLoadError):
        load_artifact(spark, str(path))


def test_selection_and_overrides(spark, tmp_path):
    cats = [{"id": i, "displayName": i, "severity": "low", "source": "s", "sourcePath": "p", "termCount": 1, "defaultEnabled": i != "b"} for i in "abc"]
    art = {"formatVersion": 1, "version": "1", "builtAt": "t", "termCount": 3, "categories": cats, "terms": "aa\nbb\ncc", "categoryIndex": "0,1,2", "severityIndex": "0,0,9", "languageIndex": "1,1,9", "flags": "0,0,0"}
    (tmp_path / "a.json").write_text(json.dumps(art))
    load = lambda *c: sorted(e.category for e in load_artifact(spark, str(tmp_path / "a.json"), list(c) or None).entries.collect())
    assert [load(), load("all"), load("all", "b"), load("*"), load("b", "c")] == [["a", "c"], ["a", "c"], ["a", "c"], ["a", "b", "c"], ["b", "c"]]
    with pytest.raises(LexiconLoadError, match="unknown category"):
        load("zzz")
    with pytest.raises(LexiconLoadError, match="cannot read"):
        load_artifact(spark, str(tmp_path / "none.json"))
    (tmp_path / "allow.txt").write_text("﻿one\r\n# no\n\n two \n")
    assert read_allowlist(spark, str(tmp_path / "allow.txt")) == ["one", "two"] and read_allowlist(spark, str(tmp_path / "no.txt")) == []
    (tmp_path / "c.json").write_text(json.dumps({"terms": [" x ", {"term": "y", "severity": "high", "category": "k"}, {"term": "z", "severity": "odd"}, 4, "", {"term": " "}]}))
    assert read_custom_terms(spark, str(tmp_path / "c.json")) == [("x", "custom", "medium"), ("y", "k", "high"), ("z", "custom", "medium")]
    (tmp_path / "c.json").write_text("{")
    with pytest.raises(LexiconLoadError, match="not valid JSON"):
        read_custom_terms(spark, str(tmp_path / "c.json"))
    (tmp_path / "t.txt").write_text("# c\n臺\t台 臺\n一\t一\n發\t发 髮\nab\tc\n")
    assert read_character_table(spark, str(tmp_path / "t.txt")) == (("發", "发"), ("臺", "台"))


def test_diff(spark, tmp_path):
    before = snapshot(read_term_files(spark, tree(tmp_path / "1", {"a.txt": "x\ny\n", "same.txt": "s", "gone.txt": "g\nx"})))
    after = snapshot(read_term_files(spark, tree(tmp_path / "2", {"a.txt": "y\nz\n", "same.txt": "s", "new.txt": "n\nz"})))
    d = diff_snapshots(before, after)
    assert {(f.path, f.change, f.added, f.removed) for f in d["files"].collect()} == {("a.txt", "changed", 1, 1), ("gone.txt", "removed", 0, 2), ("new.txt", "added", 2, 0)}
    assert {(t.term, t.change) for t in d["terms"].collect()} == {("z", "added"), ("n", "added"), ("x", "removed"), ("g", "removed")}
    assert "  - `a.txt`: +1 / -1 terms" in render_diff(d, None, "c")
    assert [f["termLines"] for f in lock_file(after, "c", "t")["files"]] == [2, 2, 1]


def test_text_functions(spark):
    one = lambda *c: tuple(spark.range(1).select(*c).first())
    slug = lambda s: T.derive_category_id(F.lit(s))
    assert one(*[slug(f"Vocabulary/{n}.txt").alias(str(i)) for i, n in enumerate(["Some Name", "政治类型", "COVID-19词库", "---"])]) == ("some-name", "政治类型", "covid-19词库", "uncategorized")
    assert one(*[T.detect_language(F.lit(t)) for t in ("敏感词", "badword", "bad word 2", "плохой", "中文english", "123", "𠀀", "é")]) == ("zh", "en", "en", "other", "zh", "other", "zh", "en")
    look = lambda t, n=None: T.inspect_term(F.lit(t), F.lit(t if n is None else n))
    assert one(look("正常词"), look("a"), look("x" * 200), look("<b>x</b>"), look("​", ""), look(""), look("a  b"), look("a\x01")) == (
        [], ["single-character"], ["too-long"], ["html-like"], ["single-character", "normalizes-to-empty"], ["empty"], ["contains-whitespace"], ["control-character"],
    )
    assert one(T.calendar_version(F.lit("2026-01-05 00:00:00").cast("timestamp")))[0] == "2026.01.05"
    assert one(T.utf16_length(F.lit("a🎉b")), T.slice_code_points(F.lit("a🎉b"), F.lit(1), F.lit(9)), T.slice_code_points(F.lit("abc"), F.lit(-3), F.lit(2))) == (4, "🎉b", "ab")
    assert one(T.split_list(F.lit(" a, ,b ,")))[0] == ["a", "b"]
    ranges = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in ((4, 6), (0, 2), (2, 3), (5, 9))])
    assert [tuple(r) for r in one(T.merge_ranges(ranges))[0]] == [(0, 3), (4, 9)]
    assert one(T.mask_ranges(F.lit("😀bcdef"), ranges), T.mask_ranges(F.lit("abc"), F.slice(ranges, 1, 0))) == ("***d**", "abc")
    kept = spark.range(10).where(T.stride_sample(F.col("id"), F.lit(10), 4)).collect()
    assert [r.id for r in kept] == [0, 2, 5, 7]
