"""How often each rule of a text holds, and where first and last, without its issues as rows.

Rules say what an issue is (operators.rules). Most texts are ASCII: of these a batch is looked at as Arrow arrays of texts and of lines, rule by
rule; every other text gets its issues from the rules' own expressions, which run on no ASCII one. Both give the same, which a test says."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.text import is_blank, split_lines, text
from codeloom.operators import rules

COUNT = "array<struct<code:string,n:int,first_line:int,last_line:int>>"
COUNTS = pa.list_(pa.struct([("code", pa.string()), ("n", pa.int32()), ("first_line", pa.int32()), ("last_line", pa.int32())]))
#: Codes in the order in which the cap counts them, and then those of scripts, which no cap takes.
CODES = ("LINE_LEN", "TRAIL_WS", "UNBALANCED", *rules.MARKERS, "NO_VAR", "CONSOLE_LOG", "LOOSE_EQ")
#: Characters of texts that are looked at together.
CHARS = 8 << 20
#: Ends of lines, what is not white space, and white space that ends no line, of ASCII.
BREAKS, SOLID, GAPS = r"\r\n|[\r\x0B\x0C\x1C-\x1E]", r"[^\t-\r\x1C-\x20]", "\t \x1f"
ANY_MARKER, LOOSE = f"(?i){'|'.join(rules.MARKERS)}", "[^=!<>]==[^=]"


def true_at(mask: pa.Array) -> np.ndarray:
    return np.flatnonzero(mask.to_numpy(zero_copy_only=False))


class Found:
    """Places (text, line) of each code, in order of texts and lines."""

    def __init__(self, n: int):
        self.n, self.rows, self.used = n, [], np.zeros(n, np.int64)

    def capped(self, owner: np.ndarray) -> np.ndarray:
        """Which issues of a rule the cap leaves, after those of the rules before; owner is ascending."""
        counts = np.bincount(owner, minlength=self.n)
        place = np.arange(len(owner)) - (np.cumsum(counts) - counts)[owner] + self.used[owner]
        self.used += counts
        return place < rules.CAP

    def add(self, code: str, owner: np.ndarray, line: np.ndarray) -> None:
        if len(owner):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            ends = np.r_[starts[1:], len(owner)]
            self.rows.append((owner[starts], np.full(len(starts), CODES.index(code)), ends - starts, line[starts], line[ends - 1]))

    def lists(self) -> pa.Array:
        owner, code, n, first, last = (np.concatenate(x) for x in zip(*self.rows, strict=True)) if self.rows else [np.zeros(0, np.int64)] * 5
        order = np.argsort(owner, kind="stable")
        ends = np.r_[0, np.cumsum(np.bincount(owner, minlength=self.n))].astype(np.int32)
        columns = [pa.array(CODES).take(pa.array(code[order]))] + [pa.array(x[order].astype(np.int32)) for x in (n, first, last)]
        return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(columns, [f.name for f in COUNTS.value_type]))


def bracket_nets(texts: pa.Array) -> np.ndarray:
    """Opening less closing brackets of each text and kind, without regard to quotes."""
    texts = texts.cast(pa.large_string())
    _, ends, values = texts.buffers()
    ends = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(values or b"", np.uint8)
    kinds = np.zeros((len(rules.BRACKETS), 256), np.int8)
    for k, (a, b) in enumerate(rules.BRACKETS):
        kinds[k, ord(a)], kinds[k, ord(b)] = 1, -1
    at = np.flatnonzero(kinds.any(axis=0)[raw])
    bounds, held = np.searchsorted(at, ends), raw[at]
    sums = [np.r_[0, np.cumsum(kind[held], dtype=np.int64)] for kind in kinds]
    return np.stack([s[bounds[1:]] - s[bounds[:-1]] for s in sums], axis=1)


def replaced(texts: pa.Array, which: str, pattern: str, by: str) -> pa.Array:
    """texts with a pattern replaced in those that hold another one."""
    holds = pc.match_substring_regex(texts, which)
    return pc.replace_with_mask(texts, holds, pc.replace_substring_regex(texts.filter(holds), pattern, by)) if holds.true_count else texts


def ascii_counts(codes: pa.Array, script: np.ndarray) -> pa.Array:
    """COUNTS of ASCII texts; null and blank texts have none. script: which are JavaScript or TypeScript."""
    found = Found(len(codes))
    codes = pc.if_else(pc.match_substring_regex(codes, SOLID), codes, "").fill_null("")
    lists = pc.split_pattern(pc.replace_substring_regex(replaced(codes, BREAKS, BREAKS, "\n"), r"\n\z", ""), "\n")
    lines, counts = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(codes)), counts)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts) + 1

    def put(code: str, at: np.ndarray) -> None:
        at = at[found.capped(owner[at])]
        found.add(code, owner[at], number[at])

    put("LINE_LEN", true_at(pc.greater(pc.binary_length(lines), rules.LONGEST)))
    put("TRAIL_WS", true_at(functools.reduce(pc.or_, [pc.ends_with(lines, c) for c in GAPS])))
    nets = bracket_nets(replaced(codes, "[\"']", r"\"[^\"]*(?:\"|\z)|'[^']*(?:'|\z)", ""))
    unbalanced = np.nonzero(nets)[0]
    unbalanced = unbalanced[found.capped(unbalanced)]
    found.add("UNBALANCED", unbalanced, np.zeros(len(unbalanced), np.int64))

    some = pc.match_substring_regex(codes, ANY_MARKER).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(some[owner])
    at = at[true_at(pc.match_substring_regex(lines.take(pa.array(at)), ANY_MARKER))]
    upper, mark = pc.ascii_upper(lines.take(pa.array(at))), np.full(len(lines), -1, np.int8)
    for k in reversed(range(len(rules.MARKERS))):  # the first of them counts, and is written last
        mark[at[true_at(pc.match_substring(upper, rules.MARKERS[k]))]] = k
    marked = np.flatnonzero(mark >= 0)
    marked = marked[found.capped(owner[marked])]
    for k, code in enumerate(rules.MARKERS):
        found.add(code, owner[at := marked[mark[marked] == k]], number[at])

    at = np.flatnonzero(script[owner])
    own = lines.take(pa.array(at))
    for code, pattern in (("NO_VAR", rf"\A[{GAPS}]*var[{GAPS}]"), ("CONSOLE_LOG", r"console\.log\("), ("LOOSE_EQ", LOOSE)):
        some = true_at(pc.match_substring_regex(own, pattern))
        if code == "LOOSE_EQ":  # which looks at lines without the white space around them
            some = some[true_at(pc.match_substring_regex(pc.utf8_trim(own.take(pa.array(some)), GAPS), LOOSE))]
        found.add(code, owner[at[some]], number[at[some]])
    return found.lists()


def counted(issues: pa.Array) -> pa.Array:
    """COUNTS of issues that the rules' expressions have found, already capped."""
    flat, found = issues.flatten(), Found(len(issues))
    owner, line, code = issues.value_parent_indices().to_numpy(), flat.field("line").to_numpy(), flat.field("code")
    for name in CODES:
        at = true_at(pc.equal(code, name))
        at = at[np.lexsort((line[at], owner[at]))]
        found.add(name, owner[at].astype(np.int64), line[at])
    return found.lists()


def counts(plain: pa.Array, script: pa.Array, other: pa.Array) -> pa.Array:
    """COUNTS of each row: of its ASCII text, or of its issues where it has none."""
    script, out, size = script.fill_null(False).to_numpy(zero_copy_only=False), [], pc.binary_length(plain).fill_null(0).to_numpy()
    part = np.cumsum(size, dtype=np.int64) // CHARS
    bounds = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True]) if len(part) else []
    for a, b in zip(bounds, bounds[1:], strict=False):
        out.append(ascii_counts(plain.slice(a, b - a), script[a:b]))
    made = pa.concat_arrays(out) if out else pa.array([], COUNTS)
    if other.null_count == len(other):
        return made
    return pc.if_else(other.is_valid(), counted(other), made)


def with_issue_counts(files: DataFrame) -> DataFrame:
    """files (code, language; languages other than Python) with issue_counts: code, n, first_line and last_line of what rules.with_rules
    finds in a file, one entry a code."""
    plain = F.octet_length(text(F.col("code"))) == F.length(text(F.col("code")))
    script = F.col("language").isin("javascript", "typescript")
    issues = rules.issues_of(F.col("code"), split_lines(F.col("code")), script)
    slim = F.transform(issues, lambda x: F.struct(x.line.alias("line"), x.code.alias("code")))
    made = F.arrow_udf(counts, COUNT)(F.when(plain, F.col("code")), script, F.when(~plain, slim))
    return files.withColumn("issue_counts", made)
