"""What git knows of a working copy: its files, changes since a commit, and how far an index is behind. Calls end after ten seconds."""

from __future__ import annotations

import subprocess
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import incremental as I

SECONDS = 10


def _git(root: str, *args: str) -> str | None:
    """Output of a git command; None where it fails, takes too long or there is no git."""
    try:
        done = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, timeout=SECONDS, check=False)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return done.stdout if done.returncode == 0 else None


def listed(root: str) -> list[str] | None:
    """Paths that git tracks, and those it neither tracks nor ignores; None without a repository."""
    out = _git(root, "ls-files", "-z", "--cached", "--others", "--exclude-standard")
    return None if out is None else sorted({x for x in out.split("\0") if x})


def known(files: DataFrame, root: str) -> DataFrame:
    """The files (file_path) that git lists; all of them without a repository."""
    names = listed(root)
    if names is None:
        return files
    own = files.sparkSession.createDataFrame([(n,) for n in names], "file_path string")
    return files.join(own, "file_path", "left_semi")


def changed(spark: SparkSession, root: str, since: str) -> DataFrame | None:
    """(file_path, change) of `git diff --name-status` since a commit; None where git can't tell."""
    out = _git(root, "diff", "--name-status", since)
    if out is None:
        return None
    lines = spark.createDataFrame([(x,) for x in out.splitlines() if x.strip()], "line string")
    return lines.select(I.git_status(F.col("line")).alias("g")).select(F.col("g.path").alias("file_path"), "g.change")


def selected(files: DataFrame, changes: DataFrame) -> DataFrame:
    """(file_path, change) of all files: as git has it, unchanged for the others; deleted ones that are not among the files too."""
    return files.select("file_path").join(changes, "file_path", "full").select("file_path", F.coalesce("change", F.lit("unchanged")).alias("change"))


@dataclass
class Staleness:
    is_stale: bool
    commits_behind: int
    uncommitted: bool
    last_commit: str | None
    current_commit: str | None


def current_commit(root: str) -> str | None:
    out = _git(root, "rev-parse", "HEAD")
    return out.strip() if out else None


def merging(root: str) -> bool:
    """Whether a merge or a rebase is going on."""
    out = _git(root, "rev-parse", "--absolute-git-dir")
    return bool(out) and any((Path(out.strip()) / n).exists() for n in ("MERGE_HEAD", "rebase-merge", "rebase-apply"))


def staleness(root: str, last_commit: str | None) -> Staleness:
    """How far the last indexed commit is behind; -1 commits where that can't be told."""
    now = current_commit(root)
    if now is None:
        return Staleness(True, -1, False, last_commit, None)
    dirty = _git(root, "diff-index", "--quiet", "HEAD") is None
    if last_commit is None:
        return Staleness(True, -1, dirty, None, now)
    if last_commit == now:
        return Staleness(dirty, 0, dirty, last_commit, now)
    count = _git(root, "rev-list", "--count", f"{last_commit}..HEAD")
    return Staleness(True, int(count) if count else -1, dirty, last_commit, now)
