"""Analysis of files, and the scan of a repository, as plans over the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.languages import chunk_language
from codeloom.functions.text import is_blank, split_lines
from codeloom.operators import prompts, python_code, python_lint, retrieval, rules, triage


#: What triage and its display need of the analysis of Python.
SHOWN = ("errors", "style_score", "complexity")


def analyse(files: DataFrame, columns: tuple[str, ...] = ()) -> DataFrame:
    """files (ord, path, filename, language, code) with ast_info, errors, style_issues, style_score, complexity, totals; of what Python
    files have, only the columns asked for (ast_info or complexity among them), if any are named, and then no totals.

    Python files go through the syntax tree, others through native rules, in one pass: each sees no text of the other's files."""
    is_python = F.coalesce(F.col("language") == "python", F.lit(False))
    given = files.withColumns({"_python": is_python, "_whole": F.col("code")})
    python = python_lint.with_lint(given.withColumn("code", F.when(F.col("_python"), F.col("_whole"))), *columns)
    found = [c for c in python.columns if c not in given.columns]
    python = python.select(*given.columns, *[F.col(n).alias(f"_found_{n}") for n in found])
    ruled = rules.with_rules(python.withColumn("code", F.when(~F.col("_python"), F.col("_whole"))))
    ruled = ruled.withColumns({"ast_info": python_code.stub(F.col("code")), "complexity": F.lit(0)})
    both = {n: F.when(F.col("_python"), F.col(f"_found_{n}")).otherwise(F.col(n) if n in ruled.columns else F.lit(None)).alias(n) for n in found}
    out = ruled.select(*[F.col("_whole").alias(c) if c == "code" else c for c in files.columns], *both.values())
    out = out if "complexity" in found else out.withColumn("complexity", F.col("ast_info.complexity"))
    return out if columns else triage.totals(out)


def scan(files: DataFrame, language_aware: bool = True, columns: tuple[str, ...] = ()) -> DataFrame:
    """Triaged files, with the columns of analyse. Without language_aware every file is taken for Python, so that most others have a syntax error."""
    given = files if language_aware else files.withColumn("language", F.lit("python"))
    return triage.triage(analyse(given, columns))


def index_chunks(files: DataFrame) -> DataFrame:
    """Chunks of files (path, code): Python by its syntax tree, others by windows of lines."""
    is_python = chunk_language(F.col("path")) == "python"
    base = files.select("path", "code").where(~is_blank(F.col("code"))).withColumn("_python", is_python)
    # each way sees the texts of its own files only
    base = base.withColumn("_own", F.when(F.col("_python"), F.col("code")))
    pieces = lambda code: python_code.pieces(code) if code else []
    base = base.withColumn("_pieces", python_code.python_column("_own", pieces, python_code.CHUNK))
    base = rules.computed_once(base, "_lines", split_lines(F.when(~F.col("_python"), F.col("code"))))
    chunks = F.when(F.col("_python"), F.col("_pieces")).otherwise(retrieval.windows(F.col("_lines")))
    return retrieval.chunk_rows(base, chunks).select("ord", "path", "id", "name", "code", "line", "kind", "text")


def review_prompts(triaged: DataFrame, limit: int = 5) -> DataFrame:
    """path, prompt of the review targets; the limit comes before anything costly."""
    targets = triage.review_targets(triaged, limit)
    info = F.col("ast_info")
    structure = prompts.structure_summary(info.line_count, F.size(info.functions), F.size(info.classes))
    parts = [prompts.issue_summary(F.slice("errors", 1, 10), "Errors/Warnings"), F.lit("Style Issues: None"), F.lit(""), F.lit("")]
    return targets.select("ord", "path", "priority_score", prompts.analysis_prompt(F.substring("code", 1, 4000), F.lit("python"), parts, structure).alias("prompt"))


def scan_report(reviews: DataFrame) -> DataFrame:
    """One text over reviews (ord, path, complexity, error_count, style_score, reply) of a few files, in order."""
    part = F.format_string("## 📄 `%s`\n> Complexity: %d | Errors: %d | Style: %d/100\n\n%s\n\n---\n", "path", "complexity", "error_count", "style_score", "reply")
    listed = reviews.agg(F.array_sort(F.collect_list(F.struct("ord", part.alias("part")))).alias("p"))
    return listed.select(F.array_join(F.transform("p", lambda x: x.part), "\n").alias("report"))


def progress_text(total: int, flagged: int, clean: int, sent: int, truncated: bool) -> str:
    """One line about a scan, for whoever waits for it; nothing where there were no files."""
    if not total:
        return ""
    cut = f", the first {triage.MAX_FILES} of the repository" if truncated else ""
    return f"{total} files checked{cut}: {flagged} need a look, {clean} do not. {sent} go to the model."
