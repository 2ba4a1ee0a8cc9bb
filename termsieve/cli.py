"""Command line: check, mask and metadata. Exit codes: 0 no match, 1 a match, 2 an error."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from termsieve.config import MATCH_MODES, OVERLAPS, InvalidMaskCharError, LexiconLoadError, MatcherOptions, ModerationInputError, ScanOptions
from termsieve.plans.moderator import Moderator, ModeratorOptions
from termsieve.sources.terms import load_artifact

CLEAN, MATCHED, ERROR = 0, 1, 2
VERSION = "0.1.0"


class _Parser(argparse.ArgumentParser):
    def error(self, message: str):
        raise ValueError(message)


def _parser() -> _Parser:
    p = _Parser(prog="termsieve", description="Keyword moderation. It finds terms; it doesn't judge meaning, intent or legality.")
    p.add_argument("words", nargs="*", metavar="command [text]", help="check, mask or metadata; then the text, without which --file or standard input is read")
    p.add_argument("--lexicon", help="lexicon artifact")
    p.add_argument("--file")
    p.add_argument("--mode", choices=MATCH_MODES)
    p.add_argument("--categories", help='comma-separated ids, "all" or "*"')
    p.add_argument("--overlap", choices=OVERLAPS)
    p.add_argument("--mask-char")
    p.add_argument("--allowlist", help="comma-separated terms")
    p.add_argument("--include-review", action="store_true")
    p.add_argument("--json", action="store_true")
    p.add_argument("--quiet", action="store_true")
    p.add_argument("--version", action="store_true")
    return p


def _items(value: str | None) -> list[str]:
    return [x.strip() for x in (value or "").split(",") if x.strip()]


def run(argv: list[str], spark: SparkSession | None = None, out=None, err=None, read=None) -> int:
    """Run one command; out, err and read stand in for the standard streams in tests."""
    out, err, read = out or sys.stdout.write, err or sys.stderr.write, read or sys.stdin.read
    try:
        a = _parser().parse_intermixed_args(argv)
        a.command, a.text = (a.words[0] if a.words else "check"), a.words[1:]
        if a.command not in ("check", "mask", "metadata"):
            raise ValueError(f"unknown command: {a.command}")
    except ValueError as e:
        err(f"{e}\n\n{_parser().format_usage()}")
        return ERROR
    if a.version:
        out(f"{VERSION}\n")
        return CLEAN
    try:
        if a.mask_char is not None and len(a.mask_char) != 1:
            raise InvalidMaskCharError("--mask-char must be exactly one character")
        if not a.lexicon:
            raise LexiconLoadError("no lexicon given")
        spark = spark or SparkSession.builder.appName("termsieve").getOrCreate()
        categories = _items(a.categories)
        lexicon = load_artifact(spark, a.lexicon, categories or None, a.include_review)
        matcher = MatcherOptions(overlap=a.overlap or "leftmost-longest", allowlist=tuple(_items(a.allowlist)))
        m = Moderator(spark, lexicon, ModeratorOptions(mode=a.mode or "normalized", mask_char=a.mask_char or "*", matcher=matcher))
        if a.command == "metadata":
            row = m.metadata().first().asDict(True)
            if a.json:
                out(json.dumps(row, ensure_ascii=False, indent=2) + "\n")
            elif not a.quiet:
                out(_metadata(row))
            return CLEAN
        if a.file:
            try:
                with open(a.file, encoding="utf-8") as f:
                    text = f.read()
            except OSError:
                raise ModerationInputError(f"cannot read file: {a.file}", "FILE") from None
        else:
            text = " ".join(a.text) if a.text else read().removesuffix("\n")
        if text == "":
            err(f"no text provided\n\n{_parser().format_usage()}")
            return ERROR
        r = m.check(spark.createDataFrame([(text,)], "text string"), ScanOptions(categories=tuple(categories) or None, mask=True)).drop("text").first().asDict(True)
    except (LexiconLoadError, ModerationInputError, InvalidMaskCharError) as e:
        err(("lexicon error: " if isinstance(e, LexiconLoadError) else "") + f"{e}\n")
        return ERROR
    if not a.quiet:
        if a.command == "mask":
            out(json.dumps({"masked_text": r["masked_text"], "hit_count": r["hit_count"]}, ensure_ascii=False, indent=2) + "\n" if a.json else r["masked_text"] + "\n")
        else:
            out(json.dumps(r, ensure_ascii=False, indent=2) + "\n" if a.json else _result(r))
    return MATCHED if r["matched"] else CLEAN


def _result(r: dict) -> str:
    lines = [f"matched: {str(r['matched']).lower()}  decision: {r['decision']}  risk: {r['risk_level']}  hits: {r['hit_count']}  unique terms: {r['unique_term_count']}"]
    if r["categories"]:
        lines.append("categories: " + ", ".join(r["categories"]))
    lines += [f"  [{m['start']}-{m['end']}] {m['term']} -> {m['matched_text']} ({m['category']}, {m['severity']}, {m['match_type']})" for m in r["matches"]]
    if r["matched"]:
        lines.append(f"masked: {r['masked_text']}")
    lines.append(f"lexicon: {r['lexicon']['version']} (upstream {r['lexicon']['upstream_commit'] or 'unknown'})")
    return "\n".join(lines) + "\n"


def _metadata(m: dict) -> str:
    lines = [
        f"lexicon version: {m['version']}", f"upstream commit: {m['upstream_commit'] or '(none)'}", f"synced at: {m['synced_at'] or '(unknown)'}", f"built at: {m['built_at']}",
        f"terms loaded: {m['term_count']} of {m['total_term_count']}", "modes: " + ", ".join(MATCH_MODES), "categories (* not in the default selection):",
    ]
    lines += [f"  {' ' if c['default_enabled'] else '*'} {c['id']} {c['term_count']} {c['severity']} {c['display_name']}" for c in m["categories"]]
    return "\n".join(lines) + "\n"


if __name__ == "__main__":
    sys.exit(run(sys.argv[1:]))
