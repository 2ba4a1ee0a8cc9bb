"""Building lexicons from raw term files: cleaning, flags, attribution, reports, diffs, validation."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termsieve.config import LANGUAGES, SEVERITIES
from termsieve.functions import text as T
from termsieve.operators.scan import normalize_column

SMALL = 100_000
_RANK_STEP = 1 << 40
CONFIG = "source_path string, category string, display_name string, severity string, default_enabled boolean, description string"
BOM = "\ufeff"


def small(df: DataFrame) -> DataFrame:
    """df marked for broadcast if it has at most SMALL rows."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


@dataclass
class BuildResult:
    """entries, categories, sources, flagged, issue_counts, and the report as one row."""

    entries: DataFrame
    categories: DataFrame
    sources: DataFrame
    flagged: DataFrame
    issue_counts: DataFrame
    report: DataFrame


def read_term_files(spark: SparkSession, root: str, prefix: str = "") -> DataFrame:
    """(source_path, content, sha256, bytes) of the .txt files below root; none where root is missing."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return spark.createDataFrame([], "source_path string, content binary, sha256 string, bytes long")
    base = fs.getFileStatus(path).getPath().toString().rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    # Paths come as URIs; what a URI escapes is compared unescaped.
    at = F.url_decode(F.replace(F.col("path"), F.lit("+"), F.lit("%2B")))
    plain = jvm.java.net.URI(base.replace(" ", "%20")).getPath() if ":" in base else base
    relative = F.substring_index(at, plain, -1)
    return files.where(F.lower(F.col("path")).endswith(".txt")).select(
        F.concat(F.lit(prefix), relative).alias("source_path"), "content", F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("long").alias("bytes")
    )


def in_order(upstream: DataFrame, local: DataFrame | None = None) -> DataFrame:
    """Files with file_seq: upstream before local, each in the order of their paths' parts."""
    both = upstream.withColumn("_late", F.lit(0))
    if local is not None:
        both = both.unionByName(local.withColumn("_late", F.lit(1)))
    # Files are few beside their lines; one window numbers them.
    return both.withColumn("file_seq", F.row_number().over(Window.orderBy("_late", F.split("source_path", "/"))) - 1).drop("_late")


def parse_files(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lines, counts) of files (file_seq, source_path, content, sha256).

    lines: (file_seq, source_path, line_no, term) without blanks and comments; counts adds
    raw_line_count, empty_line_count, bom_stripped and crlf_line_count to each file.
    """
    body = files.withColumn("_text", F.decode("content", "UTF-8"))
    body = body.withColumn("bom_stripped", F.startswith("_text", F.lit(BOM)))
    lines = body.select("file_seq", "source_path", F.posexplode(F.split(F.regexp_replace("_text", f"^{BOM}", ""), "\n", -1)).alias("_at", "line"))
    bare = F.regexp_replace("line", "\r$", "")
    lines = lines.select(
        "file_seq", "source_path", (F.col("_at") + 1).alias("line_no"), F.endswith("line", F.lit("\r")).alias("crlf"),
        T.js_trim(F.regexp_replace(bare, f"^{BOM}", "")).alias("term"),
    )
    skipped = (F.col("term") == "") | F.startswith("term", F.lit("#"))
    counts = lines.groupBy("file_seq").agg(
        F.count_if(~skipped).alias("raw_line_count"), F.count_if(skipped).alias("empty_line_count"), F.count_if("crlf").alias("crlf_line_count")
    )
    return lines.where(~skipped).drop("crlf"), body.drop("_text", "content").join(counts, "file_seq")


def attribute(lines: DataFrame, files: DataFrame, config: DataFrame, default_severity: str = "low") -> dict[str, DataFrame]:
    """Terms with their owners, from cleaned lines (file_seq, source_path, line_no, term).

    files: (file_seq, source_path[, more]); config: CONFIG. A category takes its severity and names
    from the first file mapped to it. A term's first line fixes its place, language and review flag.
    Each further file that has it counts as one cross-source duplicate; a file whose category is
    more severe than all before it takes the term over.
    """
    mapped = files.join(small(config), "source_path", "left").withColumn("category", F.coalesce("category", T.derive_category_id(F.col("source_path"))))
    named = mapped.select(
        "file_seq", "source_path", "category",
        F.struct(
            "file_seq", F.coalesce("display_name", T.stem(F.col("source_path"))).alias("display_name"), F.coalesce("severity", F.lit(default_severity)).alias("severity"),
            "source_path", T.base_name(F.col("source_path")).alias("source"), F.coalesce("default_enabled", F.lit(True)).alias("default_enabled"), "description",
        ).alias("info"),
    )
    categories = named.groupBy("category").agg(F.min_by("info", "file_seq").alias("info")).select(F.col("category").alias("id"), "info.*").drop("file_seq")
    owners = named.select("file_seq", "source_path", "category").join(categories.select(F.col("id").alias("category"), F.col("severity").alias("category_severity")), "category")
    owners = small(owners.withColumn("rank", T.severity_rank(F.col("category_severity"))))
    # One row for each term and file, then one for each term; numbers alone go through the aggregates.
    per_file = lines.groupBy("term", "file_seq").agg(F.min("line_no").alias("line_no"), F.count("*").alias("n"))
    per_file = per_file.join(owners.select("file_seq", "rank", "source_path"), "file_seq")
    highest = F.max(F.col("rank") * F.lit(_RANK_STEP) - F.col("file_seq"))
    firsts = [F.min(F.when(F.col("rank") == r, F.col("file_seq"))).alias(f"first_{r}") for r in range(4)]
    by_term = per_file.groupBy("term").agg(
        F.min("file_seq").alias("file_seq"), F.min_by("line_no", "file_seq").alias("line_no"), highest.alias("top"), *firsts,
        F.sum("n").alias("lines"), F.count("*").alias("files"), F.collect_set("source_path").alias("paths"),
    )
    # A file takes a term over if its severity is above that of all files before: where a rank turns up before all higher ones.
    never = F.lit(_RANK_STEP)
    later = lambda r: F.least(never, never, *[F.coalesce(F.col(f"first_{k}").cast("long"), never) for k in range(r + 1, 4)])
    rises = sum((F.coalesce(F.col(f"first_{r}") < later(r), F.lit(False)).cast("long") for r in range(4)), F.lit(0))
    rank = F.ceil(F.col("top") / _RANK_STEP)
    numbered = by_term.withColumns({"reassigned": rises - 1, "owner": (rank * _RANK_STEP - F.col("top")).cast("int")})
    owner = owners.select(F.col("file_seq").alias("owner"), "category", F.col("category_severity").alias("severity"), "source_path")
    first = owners.select("file_seq", F.col("source_path").alias("first_path"))
    grouped = numbered.join(owner, "owner").join(first, "file_seq")
    # Normal forms and flags depend on the term alone: they are worked out once for each, so filters on them stay above the aggregates.
    known = grouped.withColumn("normalized", normalize_column(F.col("term"), pinned=True)).withColumn("issues", T.inspect_term(F.col("term"), F.col("normalized")))
    odd = known.where(F.size("issues") > 0).select("term", "lines", "issues")
    flagged = lines.join(odd.drop("lines"), "term").select("term", "source_path", "file_seq", "line_no", "issues")
    terms = known.where(~T.is_fatal(F.col("issues"))).select(
        "term", "normalized", "issues", "file_seq", "line_no", "first_path", "category", "severity", "source_path", F.array_sort(F.array_remove("paths", F.col("source_path"))).alias("also_found_in"),
        "lines", "files", "reassigned", (F.size("issues") > 0).alias("needs_review"), T.detect_language(F.col("term")).alias("language"),
    )
    return {"categories": categories, "flagged": flagged, "odd": odd, "terms": terms, "mapped": mapped}


def count_issues(odd: DataFrame) -> DataFrame:
    """How many lines have each issue, from terms (lines, issues)."""
    return odd.select("lines", F.explode("issues").alias("issue")).groupBy("issue").agg(F.sum("lines").alias("n"))


def build_lexicon(
    spark: SparkSession, files: DataFrame, config: DataFrame | None = None, default_severity: str = "low", version: str | None = None,
    upstream_commit: str | None = None, synced_at: str | None = None, now: datetime | None = None,
) -> BuildResult:
    """Build from files (file_seq, source_path, content, sha256), as in_order() gives them."""
    now = now or datetime.now(UTC)
    config = config if config is not None else spark.createDataFrame([], CONFIG)
    lines, counts = parse_files(files)
    parts = attribute(lines, counts, config, default_severity)
    terms, odd = parts["terms"], parts["odd"]
    # Terms are numbered within their files, after the terms of the files before.
    sizes = terms.groupBy("file_seq").agg(F.count("*").alias("n"))
    ahead = sizes.select("file_seq", F.coalesce(F.sum("n").over(Window.orderBy("file_seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    inside = F.row_number().over(Window.partitionBy("file_seq").orderBy("line_no")) - 1
    entries = terms.withColumn("term_index", inside).join(ahead, "file_seq").withColumn("term_index", (F.col("term_index") + F.col("ahead")).cast("int")).drop("ahead")
    by_category = terms.groupBy("category").agg(F.count("*").alias("term_count"))
    categories = parts["categories"].join(by_category, F.col("id") == F.col("category"), "left").drop("category")
    categories = categories.withColumn("term_count", F.coalesce("term_count", F.lit(0)).cast("long"))
    accepted = terms.groupBy("file_seq").agg(F.count("*").alias("term_count"))
    sources = parts["mapped"].join(accepted, "file_seq", "left").select(
        "file_seq", F.col("source_path").alias("path"), T.base_name(F.col("source_path")).alias("name"), "category", "raw_line_count", "empty_line_count",
        F.coalesce("term_count", F.lit(0)).cast("long").alias("term_count"), "sha256", "bom_stripped", "crlf_line_count",
    )
    issue_counts = count_issues(odd)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    from_files = sources.agg(zero(F.sum("raw_line_count")).alias("raw_line_count"), zero(F.sum("empty_line_count")).alias("empty_line_count"))
    from_terms = terms.agg(
        F.count("*").alias("term_count_after_dedupe"), zero(F.sum(F.col("lines") - 1)).alias("duplicate_count"), zero(F.sum(F.col("files") - 1)).alias("cross_source_duplicate_count"),
        zero(F.sum("reassigned")).alias("reassigned_count"), (F.count("*") - F.count_distinct("normalized")).alias("normalized_collision_count"),
        F.count_if("needs_review").alias("needs_review_term_count"),
    )
    single = F.when(F.array_contains("issues", "single-character"), F.col("lines")).otherwise(0)
    from_issues = odd.agg(zero(F.sum(single)).alias("single_character_term_count"), zero(F.sum("lines")).alias("suspicious_term_count"))
    stamp = now.astimezone(UTC)
    text = lambda v: F.lit(v).cast("string")
    report = from_files.crossJoin(from_terms).crossJoin(from_issues).select(
        text(stamp.strftime("%Y-%m-%dT%H:%M:%S.") + f"{stamp.microsecond // 1000:03d}Z").alias("built_at"), text(version or stamp.strftime("%Y.%m.%d")).alias("version"),
        text(upstream_commit).alias("upstream_commit"), text(synced_at).alias("synced_at"), F.col("raw_line_count"), "empty_line_count",
        F.col("raw_line_count").alias("term_count_before_dedupe"), "term_count_after_dedupe", "duplicate_count", "cross_source_duplicate_count", "reassigned_count",
        "normalized_collision_count", "single_character_term_count", "suspicious_term_count", "needs_review_term_count",
    )
    return BuildResult(entries, categories, sources, parts["flagged"], issue_counts, report)


def to_artifact(result: BuildResult) -> dict:
    """The column-oriented artifact; Spark joins the columns, one row comes to the driver."""
    cats = [r.asDict() for r in result.categories.orderBy("id").collect()]
    report = result.report.first()
    position = F.create_map(*[F.lit(v) for i, c in enumerate(cats) for v in (c["id"], i)]) if cats else None
    code = lambda names, c: F.array_position(F.array(*[F.lit(n) for n in names]), c) - 1
    out = {"terms": "", "categoryIndex": "", "severityIndex": "", "languageIndex": "", "flags": ""}
    also: dict[str, list[str]] = {}
    if cats:
        e = result.entries.select(
            "term_index", "term", position[F.col("category")].alias("c"), code(SEVERITIES, F.col("severity")).alias("s"), code(LANGUAGES, F.col("language")).alias("l"),
            F.col("needs_review").cast("int").alias("f"), "also_found_in",
        )
        row = e.agg(F.array_sort(F.collect_list(F.struct("term_index", "term", "c", "s", "l", "f"))).alias("rows")).select(
            *[F.array_join(F.col(f"rows.{n}").cast("array<string>"), sep).alias(n) for n, sep in (("term", "\n"), ("c", ","), ("s", ","), ("l", ","), ("f", ","))]
        ).first()
        out = dict(zip(out, row, strict=True))
        also = {str(r["term_index"]): r["also_found_in"] for r in e.where(F.size("also_found_in") > 0).orderBy("term_index").collect()}
    names = {"id": "id", "displayName": "display_name", "severity": "severity", "description": "description", "sourcePath": "source_path", "source": "source", "termCount": "term_count", "defaultEnabled": "default_enabled"}
    sources = result.sources.orderBy("file_seq").collect()
    return {
        "formatVersion": 1, "version": report["version"], "upstreamCommit": report["upstream_commit"], "syncedAt": report["synced_at"], "builtAt": report["built_at"],
        "termCount": report["term_count_after_dedupe"],
        "categories": [{k: c[v] for k, v in names.items() if k != "description" or c[v]} for c in cats],
        "sources": [{"path": s["path"], "name": s["name"], "category": s["category"], "termCount": s["term_count"], "sha256": s["sha256"]} for s in sources],
        **out, "alsoFoundIn": also,
    }


# Headings, labels and notes of the report, and the columns they show.
REPORT_TITLE, REPORT_EMPTY = "# Lexicon build report", "No issues detected."
REPORT_TOTALS = (
    ("Raw term lines", "raw_line_count"), ("Empty or comment lines", "empty_line_count"), ("Terms before de-duplication", "term_count_before_dedupe"),
    ("Terms after de-duplication", "term_count_after_dedupe"), ("Duplicates removed", "duplicate_count"), ("Duplicates across source files", "cross_source_duplicate_count"),
    ("Terms re-assigned to a higher-severity category", "reassigned_count"), ("Normalized-form collisions", "normalized_collision_count"),
    ("Single-character terms", "single_character_term_count"), ("Suspicious terms (flagged)", "suspicious_term_count"), ("Terms kept but flagged for review", "needs_review_term_count"),
)
REPORT_KEPT_NOTE = (
    "Kept terms counts the terms a file contributed *first*. Terms an earlier file already",
    "contributed are counted there, unless they were re-assigned by severity.",
)


def _table(head: tuple[str, ...], rows: list) -> list[str]:
    line = lambda cells: "| " + " | ".join(map(str, cells)) + " |"
    return [line(head), line(["---"] * len(head)), *map(line, rows), ""]


def render_report(result: BuildResult) -> str:
    """The build report in Markdown; its rows are categories, files and issues, never terms."""
    r = result.report.first()
    code = lambda v: f"`{v}`"
    categories = [(code(c["id"]), c["display_name"], c["severity"], c["term_count"]) for c in result.categories.orderBy("id").collect()]
    sources = [(code(s["path"]), code(s["category"]), s["raw_line_count"], s["empty_line_count"], s["term_count"]) for s in result.sources.orderBy("file_seq").collect()]
    issues = [(i["issue"], i["n"]) for i in result.issue_counts.orderBy(F.desc("n"), "issue").collect()]
    return "\n".join(
        [
            REPORT_TITLE, "", f"- Built at: {r['built_at']}", f"- Lexicon version: {r['version']}", f"- Upstream commit: {r['upstream_commit'] or '(none)'}",
            f"- Upstream synced at: {r['synced_at'] or '(unknown)'}", "", "## Totals", "", *_table(("Metric", "Value"), [(label, r[c]) for label, c in REPORT_TOTALS]),
            "## Per category", "", *_table(("Category", "Display name", "Severity", "Terms"), categories),
            "## Per source file", "", *REPORT_KEPT_NOTE, "", *_table(("Source", "Category", "Raw lines", "Skipped lines", "Kept terms"), sources),
            "## Flagged term issues", "", *(_table(("Issue", "Count"), issues) if issues else [REPORT_EMPTY, ""]),
        ]
    ) + "\n"


def write_build(result: BuildResult, folder: str) -> None:
    """lexicon.json, metadata.json, build-report.json, review-needed.json, build-report.md, and the tables as Parquet."""
    spark = result.entries.sparkSession
    art = to_artifact(result)
    report = result.report.first().asDict()
    metadata = {k: art[k] for k in ("version", "upstreamCommit", "syncedAt", "builtAt", "termCount", "categories", "sources")}
    report["issue_counts"] = {r["issue"]: r["n"] for r in result.issue_counts.collect()}
    jvm = spark._jvm

    def put(name: str, pieces) -> None:
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
        for p in pieces:
            out.write(bytearray(p.encode("utf-8")))
        out.close()

    pretty = lambda v: json.dumps(v, ensure_ascii=False, indent=2)
    put("lexicon.json", [json.dumps(art, ensure_ascii=False) + "\n"])
    put("metadata.json", [pretty(metadata) + "\n"])
    put("build-report.json", [pretty(report) + "\n"])
    put("build-report.md", [render_report(result)])
    put("review-needed.json", _review_lines(result, report["built_at"]))
    for name in ("entries", "categories", "sources"):
        getattr(result, name).write.mode("overwrite").parquet(f"{folder}/tables/{name}")


def _review_lines(result: BuildResult, at: str):
    """The flagged lines as one JSON document, a partition of them at a time."""
    lines = result.flagged.orderBy("file_seq", "line_no").drop("file_seq")
    yield f'{{"generatedAt": {json.dumps(at)}, "count": {lines.count()}, "terms": ['
    for i, r in enumerate(lines.toLocalIterator()):
        yield (",\n" if i else "\n") + json.dumps(r.asDict(), ensure_ascii=False)
    yield "\n]}\n"


def snapshot(files: DataFrame) -> DataFrame:
    """(path, sha256, bytes, terms): each file's distinct cleaned terms."""
    numbered = files.withColumn("file_seq", F.lit(0))
    lines, _ = parse_files(numbered)
    terms = lines.groupBy("source_path").agg(F.array_sort(F.collect_set("term")).alias("terms"))
    return files.join(terms, "source_path", "left").select(F.col("source_path").alias("path"), "sha256", "bytes", F.coalesce("terms", F.array().cast("array<string>")).alias("terms"))


def diff_snapshots(before: DataFrame, after: DataFrame) -> dict[str, DataFrame]:
    """files: (path, change, added, removed) of added, removed and changed files; terms: (term, change), distinct.

    Files of equal checksum aren't compared.
    """
    b, a = before.select(*[F.col(c).alias(f"b_{c}") for c in before.columns]), after.select(*[F.col(c).alias(f"a_{c}") for c in after.columns])
    both = b.join(a, F.col("b_path") == F.col("a_path"), "full_outer")
    none = F.array().cast("array<string>")
    compared = both.where(~F.col("b_sha256").eqNullSafe(F.col("a_sha256"))).select(
        F.coalesce("a_path", "b_path").alias("path"), F.when(F.col("b_path").isNull(), "added").when(F.col("a_path").isNull(), "removed").otherwise("changed").alias("change"),
        F.array_except(F.coalesce("a_terms", none), F.coalesce("b_terms", none)).alias("plus"), F.array_except(F.coalesce("b_terms", none), F.coalesce("a_terms", none)).alias("minus"),
    )
    files = compared.select("path", "change", F.size("plus").cast("long").alias("added"), F.size("minus").cast("long").alias("removed"))
    each = compared.select(F.explode("plus").alias("term"), F.lit("added").alias("change")).unionAll(compared.select(F.explode("minus").alias("term"), F.lit("removed").alias("change")))
    return {"files": files, "terms": each.distinct()}


def render_diff(diff: dict[str, DataFrame], previous: str | None, current: str, sample: int = 40) -> str:
    """The diff in Markdown, with a bounded sample of terms."""
    out = ["# Upstream sync report", "", f"- Previous commit: {previous or '(none)'}", f"- New commit: {current}", "", "## Files", ""]
    for kind in ("added", "removed", "changed"):
        rows = diff["files"].where(F.col("change") == kind).orderBy("path").collect()
        out.append(f"- {kind.capitalize()} files: {len(rows)}")
        out += [f"  - `{r['path']}`" + (f": +{r['added']} / -{r['removed']} terms" if kind == "changed" else "") for r in rows]
    out += ["", "## Terms", ""]
    for kind in ("added", "removed"):
        terms = diff["terms"].where(F.col("change") == kind)
        n = terms.count()
        out.append(f"- {kind.capitalize()}: {n}")
        out += [f"  - {r['term']}" for r in terms.orderBy("term").limit(sample).collect()]
    return "\n".join(out) + "\n"


def lock_file(snap: DataFrame, commit: str, synced_at: str) -> dict:
    rows = snap.orderBy("path").select("path", "sha256", "bytes", F.size("terms").alias("n")).collect()
    return {"upstream": {"commit": commit}, "syncedAt": synced_at, "files": [{"path": r["path"], "sha256": r["sha256"], "bytes": r["bytes"], "termLines": r["n"]} for r in rows]}


def validate_artifact(spark: SparkSession, art: dict, lock: dict | None = None, snap: DataFrame | None = None, config: DataFrame | None = None) -> DataFrame:
    """(level, message) of what is wrong: columns, empties, duplicates, index range, lock, checksums, config."""
    terms = art["terms"].split("\n") if art["terms"] else []
    found: list[tuple[str, str]] = []
    if len(terms) != art["termCount"]:
        found.append(("error", f"termCount is {art['termCount']} but the artifact contains {len(terms)} terms"))
    for name in ("categoryIndex", "severityIndex", "languageIndex", "flags"):
        n = len(art[name].split(",")) if art[name] else 0
        if n != len(terms):
            found.append(("error", f'column "{name}" has {n} values but there are {len(terms)} terms'))
    indexes = art["categoryIndex"].split(",") if art["categoryIndex"] else []
    rows = spark.createDataFrame([(t, indexes[i] if i < len(indexes) else None) for i, t in enumerate(terms)], "term string, category string")
    at = F.col("category").try_cast("int")
    row = rows.agg(
        F.count_if(T.js_trim(F.col("term")) == "").alias("empty"), (F.count("*") - F.count_distinct("term")).alias("twice"),
        F.count_if(at.isNull() | (at < 0) | (at >= len(art["categories"]))).alias("outside"),
    ).first()
    for n, what in ((row["empty"], "empty term(s) in the artifact"), (row["twice"], "duplicated term(s) in the artifact"), (row["outside"], "term(s) reference an unknown category index")):
        if n:
            found.append(("error", f"{n} {what}"))
    for c in art["categories"]:
        if not isinstance(c.get("id"), str) or not c["id"]:
            found.append(("error", "a category has an empty id"))
        elif not re.fullmatch("[a-z0-9][a-z0-9-]*", c["id"]):
            found.append(("warning", f'category id "{c["id"]}" is not a lowercase kebab-case slug'))
    if lock is not None and art.get("upstreamCommit") != lock["upstream"]["commit"]:
        found.append(("error", "the artifact's upstream commit does not match the lock file"))
    out = spark.createDataFrame(found, "level string, message string")
    if snap is not None:
        recorded = [(f["path"], f["sha256"], "lock file") for f in (lock or {"files": []})["files"]] + [(s["path"], s["sha256"], "artifact") for s in art["sources"] if not s["path"].startswith("local/")]
        r = spark.createDataFrame(recorded, "path string, expected string, at string").join(snap.select("path", "sha256"), "path", "left")
        wrong = r.where(~F.col("sha256").eqNullSafe(F.col("expected")))
        out = out.unionAll(wrong.select(F.lit("error"), F.concat("path", F.when(F.col("sha256").isNull(), " is missing, recorded in the ").otherwise(" has changed since the "), "at")))
        if config is not None:
            odd = snap.join(config, snap.path == config.source_path, "left_anti").select(F.lit("warning"), F.concat("path", F.lit(" has no configured category")))
            gone = config.join(snap, snap.path == config.source_path, "left_anti").select(F.lit("warning"), F.concat("source_path", F.lit(" is configured but no longer exists")))
            out = out.unionAll(odd).unionAll(gone)
    if config is not None:
        ids = spark.createDataFrame([(c["id"],) for c in art["categories"]], "id string")
        unused = config.select("category").distinct().join(ids, F.col("category") == F.col("id"), "left_anti")
        out = out.unionAll(unused.select(F.lit("warning"), F.concat(F.lit("configured category produced no terms: "), "category")))
    return out


def round_trip_misses(entries: DataFrame, moderator, count: int = 500) -> DataFrame:
    """Of an even sample of entries, those that the moderator doesn't find between two words."""
    total = entries.count()
    sample = entries.where(T.stride_sample(F.col("term_index"), F.lit(total), count)) if total > count else entries
    usable = sample.where((F.length("term") >= 2) & ~F.col("term").rlike(r"[\t\n\r]|\s{2,}|^[0-9]+$"))
    texts = usable.select("term_index", "term", F.concat(F.lit("before "), "term", F.lit(" after")).alias("text"))
    return moderator.contains(texts).where("not contains").select("term_index", "term")


def config_frame(spark: SparkSession, config: dict) -> tuple[DataFrame, str]:
    """(CONFIG rows, default severity) of a category configuration."""
    rows = [(p, c.get("category"), c.get("displayName"), c.get("severity"), c.get("defaultEnabled"), c.get("description")) for p, c in (config.get("sources") or {}).items()]
    return spark.createDataFrame(rows, CONFIG), config.get("defaultSeverity") or "low"
