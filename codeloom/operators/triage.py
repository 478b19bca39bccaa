"""Triage of analysed files: flags, priorities, display order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.json import SCAN_REPORT

MAX_FILES = 200
SIZE_LIMIT = 102_400
# Parts of paths that are never scanned.
SKIPPED = ("node_modules/", ".git/", "vendor/", "__pycache__/", "dist/", "build/", ".min.js", ".min.css")


def in_tree(path: Column, kind: Column, size: Column, language: Column) -> Column:
    """Whether an entry of a listing is scanned: a file of a known language, small enough, in no skipped place."""
    skipped = F.lit(False)
    for part in SKIPPED:
        skipped = skipped | path.contains(part)
    return (kind == "blob") & (language != "") & (F.coalesce(size, F.lit(0)) < SIZE_LIMIT) & ~skipped


def first_files(files: DataFrame, order: str = "ord", limit: int = MAX_FILES) -> DataFrame:
    """The first files of a listing in its own order, and whether it was cut (a top-k, not a sort of all)."""
    total = files.agg((F.count(F.lit(1)) > limit).alias("truncated"))
    return files.orderBy(order).limit(limit).crossJoin(F.broadcast(total))


def flagged(complexity: Column, error_count: Column, style_score: Column) -> Column:
    return (complexity > 10) | (error_count > 0) | (style_score < 70)


def priority(complexity: Column, error_count: Column, style_score: Column) -> Column:
    over, under = F.greatest(F.lit(0), complexity - 10), F.floor(F.greatest(F.lit(0), 70 - style_score) / 10)
    return (3 * error_count + 2 * over + under).cast("int")


def triage(files: DataFrame) -> DataFrame:
    """files (errors array, complexity, style_score) with error_count, flagged, priority_score; missing values count as
    no complexity, no errors and a score of 100. One row in, one row out: nothing is joined back."""
    facts = {
        "complexity": F.coalesce("complexity", F.lit(0)).cast("int"),
        "error_count": F.coalesce(F.size("errors"), F.lit(0)).cast("int"),
        "style_score": F.coalesce("style_score", F.lit(100)).cast("int"),
    }
    given = [F.col(n) for n in ("complexity", "error_count", "style_score")]
    return files.withColumns(facts).withColumns({"flagged": flagged(*given), "priority_score": priority(*given)})


def review_targets(triaged: DataFrame, limit: int = 5) -> DataFrame:
    """The flagged files of highest priority, ties in input order: a top-k of all files, from which the others then go, so that
    no filter makes the optimiser compute the rules twice."""
    return triaged.orderBy(~F.col("flagged"), F.desc("priority_score"), "ord").limit(limit).where("flagged")


def flag_counts(triaged: DataFrame, *keys: str) -> DataFrame:
    return triaged.groupBy(*keys).agg(F.count_if("flagged").alias("n_flagged"), F.count_if(~F.col("flagged")).alias("n_clean"))


def security_columns(report: Column) -> dict[str, Column]:
    """Columns of an entry of a security report (functions.json.SCAN_REPORT), with defaults for what it lacks."""
    level = F.upper(F.coalesce(report.issue_severity, F.lit("LOW")))
    return {
        "line": F.coalesce(report.line_number, F.lit(0)), "code": F.coalesce(report.test_id, F.lit("B000")), "message": F.coalesce(report.issue_text, F.lit("Security issue")),
        "severity": F.when(level.isin("HIGH", "MEDIUM"), "error").otherwise("warning"), "bandit_severity": level,
        "bandit_confidence": F.upper(F.coalesce(report.issue_confidence, F.lit("LOW"))), "cwe": F.coalesce(report.issue_cwe.id.cast("string"), F.lit("")),
    }


def security_rows(reports: DataFrame, column: str, *keys: str) -> DataFrame:
    """One row per finding of security reports as JSON text."""
    parsed = reports.select(*keys, F.from_json(column, SCAN_REPORT)["results"].alias("_r"))
    found = parsed.select(*keys, F.posexplode_outer("_r").alias("_ord", "_i")).where("_ord is not null")
    return found.select(*keys, *[c.alias(n) for n, c in security_columns(F.col("_i")).items()])


def score_color(score: Column) -> Column:
    return F.when(score >= 80, "green").when(score >= 50, "yellow").otherwise("red")


def display(triaged: DataFrame) -> DataFrame:
    """Display columns without contents, in display order: flagged first, then by priority, ties in input order.

    A sort of all rows reads its input twice, to sample it; the few columns are shuffled first, so that what they are made of runs
    once, and the sort reads the shuffle's files."""
    fetch = F.coalesce("fetch_error", F.lit("")) if "fetch_error" in triaged.columns else F.lit("")
    shown = triaged.select(
        "ord", "path", "filename", "complexity", "error_count", "style_score", "flagged", "priority_score", fetch.alias("fetch_error"),
        score_color(F.col("style_score")).alias("score_color"),
        F.when(F.col("complexity") > 10, "red").when(F.col("complexity") > 5, "yellow").otherwise("green").alias("complexity_color"),
        F.when(F.col("error_count") > 0, "red").otherwise("green").alias("error_color"),
        F.when(F.col("flagged"), "FLAGGED").otherwise("CLEAN").alias("status_label"),
        F.when(F.col("flagged"), "red").otherwise("green").alias("status_color"),
    )
    return shown.repartition("path").orderBy(~F.col("flagged"), F.desc("priority_score"), "ord")


def first_open(triaged: DataFrame) -> DataFrame:
    """The file to open: the first with errors or a score below 70, else the first; only files with content count."""
    pressing = (F.col("error_count") > 0) | (F.col("style_score") < 70)
    return triaged.where(F.coalesce(F.length("code"), F.lit(0)) > 0).orderBy(~pressing, "ord").limit(1)


def editor_files(analysed: DataFrame) -> DataFrame:
    """What an editor opens of a scan: ord, name and code of files with content."""
    return analysed.where(F.length("code") > 0).select("ord", F.col("filename").alias("name"), "code")


def totals(analysed: DataFrame) -> DataFrame:
    """Issues of each kind per file and altogether; an error that is a style issue too counts in both."""
    kinds = ("errors", "style_issues", "security_issues", "complexity_issues")
    sizes = {f"n_{k}": F.coalesce(F.size(k), F.lit(0)).cast("int") if k in analysed.columns else F.lit(0) for k in kinds}
    return analysed.withColumns(sizes).withColumn("total_issues", sum((F.col(n) for n in sizes), F.lit(0)).cast("int"))


def complexity_issue_columns(name: Column, complexity: Column, rank: Column) -> dict[str, Column]:
    message = F.format_string("'%s' has cyclomatic complexity %d (rank %s) — consider refactoring", name, complexity, rank)
    severity = F.when(complexity > 20, "error").otherwise("warning")
    return {"code": F.concat(F.lit("CC-"), rank), "message": message, "severity": severity, "category": F.lit("complexity")}


def complexity_rank(complexity: Column) -> Column:
    """A to F, by the public scale of 5, 10, 20, 30 and 40."""
    out = F.lit("F")
    for top, rank in ((40, "E"), (30, "D"), (20, "C"), (10, "B"), (5, "A")):
        out = F.when(complexity <= top, rank).otherwise(out)
    return out
