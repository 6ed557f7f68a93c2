"""Incremental loads of the code-hosting staging tables, and of the commits mart on top.

A run reads the landed records above the table's high-water mark, takes and flattens the newest
per key, and upserts them. The mark filters raw records, in the scan and before any payload is parsed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.incremental import load_increment, loaded_mark, newer_rows, upsert
from tidemark.plans import repository_activity as repo

MARK = "_sdc_extracted_at"


@dataclass(frozen=True)
class Staging:
    stage: Callable[[DataFrame], DataFrame]
    key: str


# The key that each staging table is merged by.
STAGINGS = {
    "commits": Staging(repo.stage_commits, "sha"),
    "request_commits": Staging(repo.stage_request_commits, "pull_request_commit_sk"),
    "branches": Staging(repo.stage_branches, "branch_sk"),
    "repositories": Staging(repo.stage_repositories, "repo_sk"),
}


def unread_records(path: str, landed: DataFrame, full_refresh: bool = False) -> DataFrame:
    """Landed records that the table at ``path`` has not taken yet."""
    mark = None if full_refresh else loaded_mark(landed.sparkSession, path, MARK)
    return newer_rows(landed, MARK, mark)


def stage_increment(path: str, landed: DataFrame, name: str, full_refresh: bool = False) -> None:
    """One run of a staging table: a record replaces the row of its key, whatever that row holds."""
    staging = STAGINGS[name]
    rows = staging.stage(unread_records(path, landed, full_refresh))
    upsert(path, rows, staging.key, full_refresh=full_refresh, marks=[MARK])


def commits_mart_increment(path: str, staged: DataFrame, full_refresh: bool = False) -> None:
    """One run of the commits mart, on commit time: rows that changed below the mark are not read again."""
    load_increment(path, repo.commits_mart(staged), "sha", "commit_timestamp", [F.desc("commit_timestamp")], full_refresh=full_refresh)
