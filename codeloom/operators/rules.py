"""Line and bracket rules of source text.

Every rule is an expression over the array of a file's lines, so that a file's issues are made where the file lies:
no rows are exploded, nothing is shuffled, and the cap on issues is a slice of an array.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.text import GAP, OTHER_BREAK, SPACE, is_blank, rstrip, split_lines, strip, text

LONGEST = 120
CAP = 50
PENALTY = 3
# Markers, the first of which counts for a line.
MARKERS = ("TODO", "FIXME", "HACK", "XXX")  # messages of the rules below are fixed values too
BRACKETS = (("(", ")"), ("[", "]"), ("{", "}"))
ISSUE = "struct<line:int,col:int,code:string,message:string,severity:string,category:string>"
NO_ISSUES = f"array<{ISSUE}>"


def issue(line: Column | int, col: Column | int, code: Column | str, message: Column | str, severity: Column | str, category: Column | str) -> Column:
    def lit(x: Column | str | int) -> Column:
        return x if isinstance(x, Column) else F.lit(x)

    return F.struct(
        lit(line).cast("int").alias("line"), lit(col).cast("int").alias("col"), lit(code).alias("code"), lit(message).alias("message"),
        lit(severity).alias("severity"), lit(category).alias("category"),
    )


def per_line(lines: Column, holds: Callable[[Column], Column], made: Callable[[Column, Column], Column]) -> Column:
    """made(line, number from 1) of each line that holds, in order."""
    every = F.transform(lines, lambda x, k: F.when(holds(x), made(x, k + 1)))
    return F.filter(every, lambda x: x.isNotNull())


def long_lines(lines: Column, longest: int = LONGEST) -> Column:
    message = lambda x: F.format_string(f"Line too long (%d > {longest} chars)", F.length(x))
    return per_line(lines, lambda x: F.length(x) > longest, lambda x, n: issue(n, longest + 1, "LINE_LEN", message(x), "warning", "style"))


def trailing_space(lines: Column) -> Column:
    return per_line(lines, lambda x: F.right(x, F.lit(1)).rlike(SPACE), lambda x, n: issue(n, F.length(rstrip(x)) + 1, "TRAIL_WS", "Trailing whitespace", "warning", "style"))


def bound(value: Column, made: Callable[[Column], Column]) -> Column:
    """made(value), with the value computed once, however often it is used."""
    return F.transform(F.array(value), made)[0]


def nets(code: Column) -> Column:
    """Opening less closing brackets of each kind of BRACKETS outside quotes, as an array. A quote runs to the next one of its kind, or
    to the end of the text; what is quoted is taken out, and what is left is counted by length."""
    bare = F.regexp_replace(text(code), r"\"[^\"]*(?:\"|\z)|'[^']*(?:'|\z)", "")
    without = lambda t, ch: F.length(F.replace(t, F.lit(ch), F.lit("")))
    return bound(bare, lambda t: F.array(*[without(t, b) - without(t, a) for a, b in BRACKETS]))


def bracket_nets(code: Column) -> dict[str, Column]:
    return {a: nets(code)[k] for k, (a, _) in enumerate(BRACKETS)}


def unbalanced(code: Column) -> Column:
    def found(net: Column) -> Column:
        made = [
            F.when(net[k] != 0, issue(0, 0, "UNBALANCED", F.format_string(f"Unbalanced bracket '{ch}' (net: %+d)", net[k]), "error", "error"))
            for k, (ch, _) in enumerate(BRACKETS)
        ]
        return F.filter(F.array(*made), lambda x: x.isNotNull())

    return bound(nets(code), found)


def marker(line: Column) -> Column:
    """The first of MARKERS in a line, in any case; null without."""
    upper = F.upper(line)
    return F.coalesce(*[F.when(upper.contains(m), F.lit(m)) for m in MARKERS])


def markers(lines: Column) -> Column:
    return per_line(lines, lambda x: marker(x).isNotNull(), lambda x, n: issue(n, 1, marker(x), F.concat(marker(x), F.lit(" marker found")), "info", "style"))


def where_any(holds: Column, issues: Column) -> Column:
    """The issues of a rule, whose lines are looked at only where a look at the whole text has found that some may hold."""
    return F.when(holds, issues).otherwise(F.array().cast(NO_ISSUES))


def generic_issues(code: Column, lines: Column) -> Column:
    """The rules of any language, cut after CAP issues in this order."""
    whole = text(code)
    trailing = where_any(whole.rlike(rf"{GAP}(?:[\n{OTHER_BREAK[1:]}|\z)"), trailing_space(lines))
    marked = where_any(marker(whole).isNotNull(), markers(lines))
    return F.slice(F.concat(long_lines(lines), trailing, unbalanced(code), marked), 1, CAP)


def script_issues(lines: Column) -> Column:
    """What JavaScript and TypeScript have besides, line by line, rules in order within a line."""
    rules = F.transform(
        lines,
        lambda x, k: F.array(
            F.when(x.rlike(rf"\A{SPACE}*var{SPACE}+"), issue(k + 1, 1, "NO_VAR", "Prefer 'let' or 'const' over 'var'", "warning", "style")),
            F.when(x.contains("console.log("), issue(k + 1, F.instr(x, "console.log("), "CONSOLE_LOG", "console.log() found — remove before production", "info", "style")),
            F.when(x.contains("==") & strip(x).rlike("[^=!<>]==[^=]"), issue(k + 1, 1, "LOOSE_EQ", "Use '===' (strict equality) instead of '=='", "warning", "style")),
        ),
    )
    return F.filter(F.flatten(rules), lambda x: x.isNotNull())


def by_line(issues: Column) -> Column:
    """Sorted by line; issues of a line keep their order."""
    keyed = F.transform(issues, lambda x, k: F.struct(x.line.alias("line"), k.alias("k"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda p: p.x)


def style_score(n_issues: Column) -> Column:
    """100 less three points an issue, 0 at least."""
    return F.greatest(F.lit(0), 100 - F.least(PENALTY * n_issues, F.lit(100))).cast("int")


def computed_once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """rows with a column that is made once, whatever reads it: the optimiser copies an expression into every filter and column
    above it, but not one that an explode of a single row gives (an outer one: of others the array's size is filtered first)."""
    return rows.select("*", F.explode_outer(F.array(value)).alias(name))


def issues_of(code: Column, lines: Column, script: Column) -> Column:
    """The issues of a text, rule by rule; none of a blank one."""
    none = F.array().cast(NO_ISSUES)
    return F.when(is_blank(code), none).otherwise(F.concat(generic_issues(code, lines), F.when(script, script_issues(lines)).otherwise(none)))


def with_rules(files: DataFrame) -> DataFrame:
    """files (code, language; languages other than Python) with line_count, errors, style_issues and style_score.

    errors are the issues of category error; they are style issues too. Blank files have none and score 100."""
    script = F.col("language").isin("javascript", "typescript")
    out = files.withColumn("_lines", split_lines(F.col("code"))).withColumn("line_count", F.size("_lines"))
    made = issues_of(F.col("code"), F.col("_lines"), script)
    out = computed_once(out, "_issues", made)
    return (
        out.withColumn("style_issues", by_line(F.col("_issues")))
        .withColumn("errors", F.filter("_issues", lambda x: x.category == "error"))
        .withColumn("style_score", style_score(F.size("_issues")))
        .drop("_lines", "_issues")
    )


def issue_rows(files: DataFrame, column: str, *keys: str) -> DataFrame:
    """One row per issue, with its number in the file from 0."""
    return exploded(files, column, "ord", *keys).select(*keys, "ord", "_i.*")


def exploded(files: DataFrame, column: str, ord_name: str, *keys: str) -> DataFrame:
    """keys, number from 0 and _i of each entry of an array column. The explode is an outer one whose empty row goes again: for
    any other the optimiser would filter by the size of the array first, and compute the array twice."""
    return files.select(*keys, F.posexplode_outer(column).alias(ord_name, "_i")).where(F.col(ord_name).isNotNull())


def style_check_rows(reports: DataFrame) -> DataFrame:
    """Issues from lines of a style checker: text "E501 too long", line, offset."""
    code = F.substring("text", 1, 4)
    severity = F.when(code.startswith("E"), "error").otherwise("warning")
    return reports.withColumns({"col": F.col("offset") + 1, "code": code, "message": strip(F.expr("substring(text, 6)")), "severity": severity, "category": F.lit("style")}).drop("text", "offset")
