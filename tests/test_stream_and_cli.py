import json

import pytest

from termsieve import cli
from termsieve.config import ScanOptions
from termsieve.operators.scan import register
from termsieve.plans.moderator import ModeratorOptions, moderator_from_terms
from termsieve.streaming.moderation import moderate_stream, read_texts, write_verdicts

from .terms import TERMS


def test_stream(spark, tmp_path):
    for i, batch in enumerate([["违规词", "clean"], ["爆炸物制造"]]):
        spark.createDataFrame([(i * 10 + k, t) for k, t in enumerate(batch)], "i int, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    m = moderator_from_terms(spark, TERMS, ModeratorOptions())
    verdicts = moderate_stream(m, read_texts(spark, str(tmp_path / "in"), "i int, text string"), ScanOptions(mask=True))
    assert verdicts.isStreaming
    write_verdicts(verdicts.select("i", "decision", "masked_text"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = {r.i: (r.decision, r.masked_text) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {0: ("review", "***"), 1: ("allow", "clean"), 10: ("block", "*****")}


def test_sql_functions(spark):
    register(spark)
    assert tuple(spark.sql("select normalize_text('ＡＢ　Ｃ'), fuzzy_fold_text('b-4-d')").first()) == ("ab c", "bad")


@pytest.fixture
def artifact(tmp_path):
    art = {
        "formatVersion": 1, "version": "2026.01.01", "upstreamCommit": "abc", "builtAt": "t", "termCount": 3,
        "categories": [{"id": "a", "displayName": "A", "severity": "low", "source": "s", "sourcePath": "p"}, {"id": "b", "displayName": "B", "severity": "high", "source": "s", "sourcePath": "p", "defaultEnabled": False}],
        "sources": [], "terms": "违规词\nbadword\n单", "categoryIndex": "0,1,0", "severityIndex": "0,2,0", "languageIndex": "0,1,0", "flags": "0,0,1",
    }
    path = tmp_path / "lexicon.json"
    path.write_text(json.dumps(art))
    return str(path)


def test_cli(spark, artifact, tmp_path):
    said: list[str] = []

    def run(*argv, text=""):
        said.clear()
        return cli.run([*argv, "--lexicon", artifact], spark, said.append, said.append, lambda: text)

    assert run("check", "这里有违规词") == 1 and "[3-6] 违规词 -> 违规词 (a, low, exact)" in said[0] and "masked: 这里有***" in said[0]
    assert run("check", "clean") == 0 and run("check", "badword") == 0 and run("check", "--categories", "*", "badword") == 1
    assert run("mask", "--mask-char", "#", text="违规词\n") == 1 and said == ["###\n"]
    assert run("check", "--json", "违规词") == 1 and json.loads(said[0])["decision"] == "review"
    assert run("check", "--quiet", "违规词") == 1 and said == []
    assert run("check", "--allowlist", "违规词", "违规词") == 0
    assert run("check", "--mode", "fuzzy", "违-规-词") == 1
    assert run("metadata") == 0 and "terms loaded: 1 of 3" in said[0] and "* b 0 high B" in said[0]
    (tmp_path / "t.txt").write_text("违规词", encoding="utf-8")
    assert run("check", "--file", str(tmp_path / "t.txt")) == 1
    for bad in (["--mode", "odd", "x"], ["--mask-char", "**", "x"], ["--categories", "zzz", "x"], ["--file", "/nowhere"], ["check"], ["--odd"]):
        assert run(*bad) == 2, bad
    assert cli.run(["check", "x", "--lexicon", "/nowhere.json"], spark, said.append, said.append) == 2
    assert cli.run(["--version"], spark, said.append) == 0
