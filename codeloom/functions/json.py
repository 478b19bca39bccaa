"""JSON with defaults, and recovery of an object from a model's reply."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codeloom.functions.text import strip, text

SCAN_REPORT = (
    "struct<results:array<struct<line_number:int,test_id:string,issue_text:string,issue_severity:string,"
    "issue_confidence:string,issue_cwe:struct<id:int>>>>"
)
REVIEW = (
    "struct<summary:string,complexity_analysis:string,optimizations:array<struct<title:string,description:string,before:string,"
    "after:string,impact:string>>,best_practices:array<string>,positive_aspects:array<string>>"
)


def valid_json(value: Column) -> Column:
    """The text if it is JSON, else null. The parser stops at the end of a value; that nothing follows it shows where the
    text stands for one element of an array and one member of an object."""
    element = F.concat(F.lit("["), value, F.lit("]"))
    member = F.concat(F.lit('{"v":'), value, F.lit("}"))
    single = F.try_parse_json(element).isNotNull() & (F.json_array_length(element) == 1) & F.try_parse_json(member).isNotNull()
    return F.when(single, value)


def recovered_json(reply: Column) -> Column:
    """JSON text of a reply: all of it, or a fenced object, or what lies between the first { and the last }; null without."""
    whole = strip(text(reply))
    # fixed value: the pattern of a fence decides which object of several is found
    fenced = F.nullif(F.regexp_extract(whole, r"```(?:json)?\s*(\{[\s\S]*?\})\s*```", 1), F.lit(""))
    braces = F.nullif(F.regexp_extract(whole, r"\{[\s\S]*\}", 0), F.lit(""))
    return F.coalesce(valid_json(whole), valid_json(fenced), valid_json(braces))


def review(reply: Column) -> Column:
    """A reply as a record; null where no JSON is found."""
    return F.from_json(recovered_json(reply), REVIEW)
