"""Classification of repository URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codeloom.functions.languages import basename
from codeloom.functions.text import strip, text

# The forms of URLs, tried in this order.
RAW = r"\Ahttps://raw\.githubusercontent\.com/([^/]+)/([^/]+)/([^/]+)/([^\n]+)"
PLACE = r"\Ahttps://github\.com/([^/]+)/([^/]+)/(blob|tree)/([^/]+)/([^\n]+)"
BARE = r"\Ahttps://github\.com/([^/]+)/([^/#?]+?)(?:\.git)?/?\n?\z"
FIELDS = ("type", "owner", "repo", "branch", "path", "filename", "subdir", "error")


def parse_url(url: Column) -> Column:
    """struct of FIELDS: a single_file (raw and blob URLs), a repo (tree and bare URLs), or unknown with an error."""
    given = strip(text(url))
    full = F.when(given.startswith("http"), given).otherwise(F.concat(F.lit("https://"), given))

    def made(**known: Column | str) -> Column:
        cells = {k: v if isinstance(v, Column) else F.lit(v) for k, v in known.items()}
        return F.struct(*[cells.get(f, F.lit(None).cast("string")).alias(f) for f in FIELDS])

    raw = lambda k: F.regexp_extract(given, RAW, k)
    place = lambda k: F.regexp_extract(given, PLACE, k)
    bare = lambda k: F.regexp_extract(full, BARE, k)
    quote = F.when(full.contains("'") & ~full.contains('"'), '"').otherwise("'")
    return (
        F.when(given.rlike(RAW), made(type="single_file", owner=raw(1), repo=raw(2), branch=raw(3), path=raw(4), filename=basename(raw(4))))
        .when(place(3) == "blob", made(type="single_file", owner=place(1), repo=place(2), branch=place(4), path=place(5), filename=basename(place(5))))
        .when(place(3) == "tree", made(type="repo", owner=place(1), repo=place(2), branch=place(4), subdir=place(5)))
        .when(full.rlike(BARE), made(type="repo", owner=bare(1), repo=bare(2), branch="main"))
        .otherwise(made(type="unknown", error=F.concat(F.lit("Cannot parse GitHub URL: "), quote, full, quote)))
    )
