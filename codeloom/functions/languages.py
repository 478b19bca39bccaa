"""File extensions and the languages they stand for."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extension -> language.
TREE_LANGUAGES = {
    "py": "python", "js": "javascript", "ts": "typescript", "jsx": "javascript", "tsx": "typescript", "java": "java",
    "c": "c", "cpp": "cpp", "cc": "cpp", "h": "c", "go": "go", "rs": "rust", "rb": "ruby", "php": "php", "swift": "swift",
    "kt": "kotlin", "cs": "csharp", "sh": "bash", "bash": "bash", "html": "html", "css": "css", "json": "json",
    "yaml": "yaml", "yml": "yaml", "md": "markdown", "sql": "sql",
}
CHUNK_LANGUAGES = {"py": "python", "js": "javascript", "ts": "typescript", "jsx": "javascript", "tsx": "typescript"}
UPLOAD_LANGUAGES = {k: v for k, v in TREE_LANGUAGES.items() if k not in ("h", "bash", "yaml", "yml")}
EDITOR_LANGUAGES = {
    "py": "python", "js": "javascript", "ts": "typescript", "jsx": "javascript", "tsx": "typescript", "java": "java", "cpp": "cpp",
    "c": "c", "go": "go", "rs": "rust", "rb": "ruby", "php": "php", "cs": "csharp", "swift": "swift",
}


def extension(path: Column) -> Column:
    """What follows the last dot, lower-cased; empty without a dot."""
    return F.when(path.contains("."), F.lower(F.substring_index(path, ".", -1))).otherwise("")


def language(path: Column, known: dict[str, str], otherwise: Column | str = "") -> Column:
    """The language of a path's extension, looked up in a literal map."""
    other = otherwise if isinstance(otherwise, Column) else F.lit(otherwise)
    names = F.create_map(*[F.lit(x) for x in chain(*known.items())])
    return F.coalesce(F.try_element_at(names, extension(path)), other)


def tree_language(path: Column) -> Column:
    return language(path, TREE_LANGUAGES)


def chunk_language(path: Column) -> Column:
    return language(path, CHUNK_LANGUAGES, "other")


def upload_language(path: Column, current: Column | str) -> Column:
    return language(path, UPLOAD_LANGUAGES, current)


def editor_language(path: Column) -> Column:
    return language(path, EDITOR_LANGUAGES, "python")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)
