"""Discovery of files, ignore rules, line and JSON sources."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest file that is indexed.
MOST_BYTES = 1 << 20


def pattern_lines(text: str) -> list[str]:
    """Lines of a pattern file without blanks and comments."""
    return [x.strip() for x in text.splitlines() if x.strip() and not x.strip().startswith("#")]


def glob_regex(pattern: str) -> str:
    """A gitignore-style glob as a regex over /-separated relative paths."""
    anchored = pattern.startswith("/") or "/" in pattern.rstrip("/")
    body, out, i = pattern.strip("/"), "", 0
    while i < len(body):
        if body.startswith("**/", i):
            out, i = out + "(.*/)?", i + 3
        elif body.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            out, i = out + {"*": "[^/]*", "?": "[^/]"}.get(body[i], re.escape(body[i])), i + 1
    return ("^" if anchored else "(^|/)") + out + ("/" if pattern.endswith("/") else "(/|$)")


class IgnoreRules:
    """Ordered rules, the last that matches decides; `!` takes a path back."""

    def __init__(self, patterns: Iterable[str]):
        self.rules = [(not p.startswith("!"), glob_regex(p.lstrip("!"))) for p in pattern_lines("\n".join(patterns))]

    def matches(self, path: Column) -> Column:
        out = F.lit(False)
        for ignore, regex in self.rules:
            out = F.when(path.rlike(regex), F.lit(ignore)).otherwise(out)
        return out


# What is never indexed; names of files with patterns at a folder's root (of the last two the first that is there).
DEFAULT_IGNORES = ("__pycache__/", "*.pyc", ".git/", "node_modules/", ".venv/", "venv/", ".tox/", "*.egg-info/", "dist/", "build/", ".mypy_cache/", ".pytest_cache/", ".ruff_cache/")
IGNORE_FILES, ENVIRONMENT = ((".gitignore",), (".weftignore", ".codesearchignore")), "WEFTLINE_EXCLUDE"


def ignore_patterns(root: str, settings: Iterable[str] = ()) -> list[str]:
    """Patterns of five sources in order, so that later ones win: built in, .gitignore, the own file, settings, the environment (commas)."""
    out = list(DEFAULT_IGNORES)
    for names in IGNORE_FILES:
        there = [p for n in names if (p := Path(root) / n).is_file()]
        out += pattern_lines(there[0].read_text(errors="replace")) if there else []
    return [*out, *settings, *(x.strip() for x in os.environ.get(ENVIRONMENT, "").split(",") if x.strip())]


def merged(first: dict, then: dict) -> dict:
    """Two nested settings as one: of both the later one's values, level by level."""
    return {k: merged(first[k], then[k]) if isinstance(first.get(k), dict) and isinstance(then.get(k), dict) else then.get(k, first.get(k)) for k in {**first, **then}}


def discover(spark: SparkSession, root: str, extensions: Sequence[str], ignore: IgnoreRules | None = None, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(file_path, content, size_bytes) of text files below root. Invalid UTF-8 becomes replacement characters.

    Only files with one of the extensions are listed and read: the names are matched before any content is.
    """
    either = ",".join("".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in e.lstrip(".")) for e in extensions)
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{{{either}}}").load(root)
    base = F.regexp_replace(F.lit(root.rstrip("/")), r"^\w+:/*", "/")
    path = F.regexp_replace(F.regexp_replace("path", r"^\w+:/*", "/"), F.concat(F.lit("^"), base, F.lit("/")), "")
    rows = raw.where(F.col("length") <= most_bytes).select(path.alias("file_path"), F.expr("try_validate_utf8(cast(content as string))").alias("valid"), "content", F.col("length").alias("size_bytes"))
    if ignore is not None:
        rows = rows.where(~ignore.matches(F.col("file_path")))
    text = F.coalesce("valid", F.expr("make_valid_utf8(cast(content as string))"))
    return rows.select("file_path", text.alias("content"), "size_bytes").where(F.trim("content") != "")


def failures(spark: SparkSession, root: str, extensions: Sequence[str], most_bytes: int = MOST_BYTES) -> DataFrame:
    """(file_path, error) of files that discover leaves out or mends: too large, or not UTF-8."""
    either = ",".join(e.lstrip(".") for e in extensions)
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{{{either}}}").load(root)
    error = F.when(F.col("length") > most_bytes, F.concat(F.lit("larger than "), F.lit(str(most_bytes)), F.lit(" bytes"))).when(F.expr("try_validate_utf8(cast(content as string))").isNull(), "not UTF-8: mended")
    return raw.select(F.regexp_replace("path", r"^\w+:/*", "/").alias("file_path"), error.alias("error")).where("error is not null")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a JSON-lines file; blank and malformed lines are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
