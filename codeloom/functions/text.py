"""Text primitives with the semantics of Unicode-aware line splitting and stripping, as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of Unicode, with the ASCII separators.
SPACE = r"[\x09-\x0D\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
#: Ends of lines.
BREAK = r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x85\u2028\u2029]"
OTHER_BREAK = r"[\r\x0B\x0C\x1C\x1D\x1E\x85\u2028\u2029]"
#: White space that ends no line.
GAP = r"[\x09\x1F\x20\xA0\u1680\u2000-\u200A\u202F\u205F\u3000]"


def text(value: Column | str) -> Column:
    """The text, empty for null."""
    return F.coalesce(F.col(value) if isinstance(value, str) else value, F.lit(""))


def split_lines(code: Column) -> Column:
    """Lines without their ends; an end at the end opens no further line, and an empty text has none."""
    cut = F.regexp_replace(text(code), rf"(?:{BREAK})\z", "")
    # most texts know one end only, which is found faster
    short = F.when(text(code).endswith("\n"), F.left(text(code), F.length(text(code)) - 1)).otherwise(text(code))
    lines = F.when(text(code).rlike(OTHER_BREAK), F.split(cut, BREAK)).otherwise(F.split(short, "\n"))
    return F.when(text(code) == "", F.array().cast("array<string>")).otherwise(lines)


def rstrip(value: Column) -> Column:
    return F.regexp_replace(value, rf"{SPACE}+\z", "")


def strip(value: Column) -> Column:
    return F.regexp_replace(value, rf"\A{SPACE}+|{SPACE}+\z", "")


def is_blank(code: Column) -> Column:
    return ~text(code).rlike(SPACE.replace("[", "[^", 1))


def tokens(value: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(text(value)), F.lit("[a-z0-9]+"), F.lit(0))


def editor_lines(code: Column) -> Column:
    """Lines as an editor numbers them: one more than there are newlines."""
    return F.size(F.split(text(code), "\n"))


def safe_name(value: Column, longest: int = 60) -> Column:
    """A collection name: other characters than letters, digits, _ and - become _."""
    return F.substring(F.regexp_replace(text(value), "[^a-zA-Z0-9_-]", "_"), 1, longest)


# What counts as a type in TypeScript, in the order in which it is taken out. The result has to be the same text.
TYPE_PATTERNS = (
    r":\s*[A-Za-z<>\[\]|&]+(?=[\s,)=;{])",  # annotation
    r"<[A-Za-z,\s]+>(?=\()",  # generic call
    r"\binterface\s+\w+\s*\{[^}]*\}",
    r"\btype\s+\w+\s*=\s*[^;]+;",
)


def without_types(code: Column) -> Column:
    """TypeScript without what TYPE_PATTERNS match."""
    out = text(code)
    for pattern in TYPE_PATTERNS:
        out = F.regexp_replace(out, pattern, "")
    return out


def to_base64(value: Column) -> Column:
    """The base64 of a text's UTF-8, in one line, which the function alone does not give."""
    return F.regexp_replace(F.base64(value.cast("binary")), r"\s", "")


def data_uri(value: Column, kind: str = "image/png") -> Column:
    """Bytes as an address that holds them."""
    return F.concat(F.lit(f"data:{kind};base64,"), to_base64(value))


def from_base64(value: Column) -> Column:
    """The text of base64 as listings carry it, broken into lines; null where it is no base64 or no UTF-8."""
    return F.try_validate_utf8(F.try_to_binary(F.regexp_replace(value, r"\s", ""), F.lit("base64")).cast("string"))


def terminal_text(stdout: Column, stderr: Column, returncode: Column, timed_out: Column) -> Column:
    """What a terminal shows of a finished run."""
    failed = F.concat(
        F.when(stderr != "", F.concat(F.lit("\n--- stderr ---\n"), stderr)).otherwise(""),
        F.when(~timed_out, F.concat(F.lit("\n[Process exited with code "), returncode.cast("string"), F.lit("]"))).otherwise(""),
    )
    quiet = F.when(stdout != "", "").when(stderr != "", stderr).otherwise("(no output)")
    return F.concat(stdout, F.when(returncode != 0, failed).otherwise(quiet))
