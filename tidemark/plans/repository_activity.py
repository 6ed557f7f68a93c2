"""Code-hosting data: landed JSON records to staging tables and marts.

Each ``stage_*`` takes landed records (``data`` plus the extraction columns) and
gives one typed row per key; each ``*_mart`` takes staging rows.  Newest rows are
chosen before the payload is flattened: only the key and the order columns are
parsed for all records, the wide flattening runs on the survivors.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.calendar import calendar_columns, utc_wall_time
from tidemark.functions.keys import both_known_and_differ, label, surrogate_key
from tidemark.functions.text import change_type, first_int
from tidemark.operators.activity import Activity, activity_mart
from tidemark.operators.dedupe import latest_rows
from tidemark.operators.flatten import flatten_payload
from tidemark.operators.quality import Check, NotNull, Relationship, Unique, filled
from tidemark.operators.ranking import ROWS_PER_RANGE
from tidemark.sources.readers import EXTRACTION_COLUMNS

_COMPLETE = "_complete"

# Output column -> (path in the payload, kind).
PROFILE_LEAVES = {
    "id": "int",
    "login": "text",
    "avatar_url": "text",
    "profile_url": "text",
    "type": "text",
    "is_site_admin": "bool",
}
PROFILE_PATHS = {"profile_url": "html_url", "is_site_admin": "site_admin"}


def _profile(side: str) -> dict[str, tuple[str, str]]:
    """Columns of the hosting profile of an ``author`` or a ``committer``."""
    return {
        f"github_{side}_{name}": (f"{side}.{PROFILE_PATHS.get(name, name)}", kind)
        for name, kind in PROFILE_LEAVES.items()
    }


COMMIT_DETAILS = {
    "commit_message": ("commit.message", "text"),
    "comment_count": ("commit.comment_count", "int"),
    "git_author_name": ("commit.author.name", "text"),
    "git_author_email": ("commit.author.email", "text"),
    "git_author_timestamp": ("commit.author.date", "timestamp"),
    "git_committer_name": ("commit.committer.name", "text"),
    "git_committer_email": ("commit.committer.email", "text"),
    "git_committer_timestamp": ("commit.committer.date", "timestamp"),
    "tree_sha": ("commit.tree.sha", "text"),
    "tree_url": ("commit.tree.url", "text"),
    "is_verified": ("commit.verification.verified", "bool"),
    "verification_reason": ("commit.verification.reason", "text"),
    "verified_at": ("commit.verification.verified_at", "timestamp"),
    **_profile("author"),
    **_profile("committer"),
}

COMMIT_LEAVES = {
    "org": ("org", "text"),
    "repo": ("repo", "text"),
    "repo_id": ("repo_id", "int"),
    "node_id": ("node_id", "text"),
    "sha": ("sha", "text"),
    "commit_api_url": ("url", "text"),
    "commit_github_url": ("html_url", "text"),
    "commit_timestamp": ("commit_timestamp", "timestamp"),
    **COMMIT_DETAILS,
}

REQUEST_COMMIT_LEAVES = {
    "org": ("org", "text"),
    "repo": ("repo", "text"),
    "repo_id": ("repo_id", "int"),
    "pull_request_number": ("pull_number", "int"),
    "sha": ("sha", "text"),
    "node_id": ("node_id", "text"),
    "commit_api_url": ("url", "text"),
    "commit_github_url": ("html_url", "text"),
    "comments_api_url": ("comments_url", "text"),
    **COMMIT_DETAILS,
}

BRANCH_LEAVES = {
    "org": ("org", "text"),
    "repo": ("repo", "text"),
    "repo_id": ("repo_id", "int"),
    "branch_name": ("name", "text"),
    "is_protected": ("protected", "bool"),
    "commit_sha": ("commit.sha", "text"),
    "commit_api_url": ("commit.url", "text"),
}

REPOSITORY_LEAVES = {
    "repo_id": ("id", "int"),
    "node_id": ("node_id", "text"),
    "org": ("org", "text"),
    "repo_name": ("name", "text"),
    "repo_slug": ("repo", "text"),
    "full_name": ("full_name", "text"),
    "repo_github_url": ("html_url", "text"),
    "git_url": ("git_url", "text"),
    "ssh_url": ("ssh_url", "text"),
    "clone_url": ("clone_url", "text"),
    "homepage_url": ("homepage", "text"),
    "is_private": ("private", "bool"),
    "is_fork": ("fork", "bool"),
    "is_archived": ("archived", "bool"),
    "is_disabled": ("disabled", "bool"),
    "description": ("description", "text"),
    "visibility": ("visibility", "text"),
    "primary_language": ("language", "text"),
    "default_branch": ("default_branch", "text"),
    "repo_size_kb": ("size", "int"),
    "stargazers_count": ("stargazers_count", "int"),
    "watchers_count": ("watchers_count", "int"),
    "forks_count": ("forks_count", "int"),
    "open_issues_count": ("open_issues_count", "int"),
    "subscribers_count": ("subscribers_count", "int"),
    "network_count": ("network_count", "int"),
    "created_at": ("created_at", "timestamp"),
    "updated_at": ("updated_at", "timestamp"),
    "pushed_at": ("pushed_at", "timestamp"),
    "owner_login": ("owner.login", "text"),
    "owner_id": ("owner.id", "int"),
    "owner_type": ("owner.type", "text"),
    "owner_github_url": ("owner.html_url", "text"),
    "owner_avatar_url": ("owner.avatar_url", "text"),
    "owner_is_site_admin": ("owner.site_admin", "bool"),
}


def _newest(
    landed: DataFrame, leaves: Mapping, keys: Sequence[str], order: Sequence[Column], also: Sequence[str] = (), complete: Column | None = None
) -> DataFrame:
    """Newest record per key, then all its leaves; ``complete`` tells, by the early leaves, which keys' newest records stay.

    What ``order`` leaves tied goes by sequence, then by a hash of the payload, so that a task
    that runs again picks the same record. Early leaves are kept, not parsed again. The verdict is a column
    of its own: as a filter on leaves it would be moved below the parser, and every payload parsed twice.
    """
    early = {name: leaves[name] for name in (*keys, *also)}
    verdict = F.lit(True) if complete is None else complete
    keyed = flatten_payload(landed, early, keep=["data", *EXTRACTION_COLUMNS]).withColumn(_COMPLETE, verdict)
    newest = latest_rows(keyed, keys, [*order, F.desc("_sdc_sequence"), F.desc(F.xxhash64("data"))]).where(_COMPLETE)
    late = {name: leaf for name, leaf in leaves.items() if name not in early}
    return flatten_payload(newest, late, keep=[*EXTRACTION_COLUMNS, *early]).select(*EXTRACTION_COLUMNS, *leaves)


def _commit_derivations(rows: DataFrame, day_of: str) -> DataFrame:
    return rows.withColumns(
        {
            **calendar_columns(utc_wall_time(rows, day_of), "commit"),
            "is_merge_commit": both_known_and_differ(F.col("git_author_email"), F.col("git_committer_email")),
            "commit_type": change_type(F.col("commit_message")),
        }
    )


def stage_commits(landed: DataFrame) -> DataFrame:
    """One row per sha: latest commit time, then latest extraction."""
    rows = _newest(
        landed,
        COMMIT_LEAVES,
        ["sha"],
        [F.desc("commit_timestamp"), F.desc("_sdc_extracted_at")],
        also=["commit_timestamp"],
        complete=filled(["sha"]),
    )
    rows = rows.withColumn("pull_request_number", first_int(F.col("commit_message")))
    return _commit_derivations(rows, "commit_timestamp")


def stage_request_commits(landed: DataFrame) -> DataFrame:
    """One row per commit of a pull request; its day is the author's."""
    keys = ["org", "repo", "repo_id", "pull_request_number", "sha"]
    rows = _newest(landed, REQUEST_COMMIT_LEAVES, keys, [F.desc("_sdc_extracted_at")], complete=filled(keys))
    rows = rows.withColumns(
        {
            "pull_request_commit_sk": surrogate_key(keys, ["/", ":", ":pr:", ":"]),
            "full_repo_name": label("org", "repo"),
            "dbt_updated_at": F.current_timestamp(),
        }
    )
    return _commit_derivations(rows, "git_author_timestamp")


def stage_branches(landed: DataFrame) -> DataFrame:
    keys = ["org", "repo", "repo_id", "branch_name"]
    rows = _newest(landed, BRANCH_LEAVES, keys, [F.desc("_sdc_extracted_at")], complete=filled(["branch_name", "org", "repo"]))
    return rows.withColumns(
        {
            "branch_sk": surrogate_key(keys, ["/", ":", ":"]),
            "full_repo_name": label("org", "repo"),
            "dbt_updated_at": F.current_timestamp(),
        }
    )


def stage_repositories(landed: DataFrame) -> DataFrame:
    """One row per repository id: last touched, then last extracted.

    Without a full name the key falls back to the organisation alone.
    """
    touched = F.coalesce("updated_at", "pushed_at", "created_at")
    rows = _newest(
        landed,
        REPOSITORY_LEAVES,
        ["repo_id"],
        [touched.desc(), F.desc("_sdc_extracted_at")],
        also=["updated_at", "pushed_at", "created_at", "org", "repo_name", "repo_slug"],
        complete=filled(["repo_id", "org"], not_blank=[F.coalesce("repo_name", "repo_slug")]),
    )
    rows = rows.withColumns(
        {
            "repo_sk": surrogate_key(["repo_id", F.coalesce("full_name", "org")], [":"]),
            "repo": F.coalesce("repo_name", "repo_slug"),
            "owner_is_site_admin": F.coalesce("owner_is_site_admin", F.lit(False)),
            "dbt_updated_at": F.current_timestamp(),
        }
    ).withColumn("full_repo_name", label("org", "repo"))
    return rows.drop("repo_name", "repo_slug")


# Columns of the marts, in order.
PROFILE_COLUMNS = [*_profile("author"), *_profile("committer")]
GIT_COLUMNS = [
    "git_author_name", "git_author_email", "git_author_timestamp",
    "git_committer_name", "git_committer_email", "git_committer_timestamp",
]
CALENDAR_COLUMNS = [
    "commit_date", "commit_week", "commit_month", "commit_quarter", "commit_year",
    "commit_day_of_week", "commit_hour",
]
COMMIT_MART = [
    "sha", "org", "repo", "repo_id", "node_id", "commit_api_url", "commit_github_url",
    "commit_timestamp", "commit_message", "pull_request_number", "commit_type",
    *GIT_COLUMNS, "is_merge_commit", "is_verified", "verification_reason",
    "tree_sha", "tree_url", *PROFILE_COLUMNS, *CALENDAR_COLUMNS,
]
REQUEST_COMMIT_MART = [
    "pull_request_commit_sk", "org", "repo", "repo_id", "full_repo_name", "pull_request_number",
    "sha", "node_id", "commit_api_url", "commit_github_url", "comments_api_url",
    "commit_message", "comment_count", "commit_type", "is_merge_commit",
    *GIT_COLUMNS, "tree_sha", "tree_url", "is_verified", "verification_reason", "verified_at",
    *PROFILE_COLUMNS, *CALENDAR_COLUMNS, "_sdc_extracted_at", "dbt_updated_at",
]
BRANCH_MART = [
    "branch_sk", "org", "repo", "repo_id", "full_repo_name", "branch_name", "is_protected",
    "commit_sha", "commit_api_url", "_sdc_extracted_at",
]
REPOSITORY_MART = [
    "repo_sk", "repo_id", "node_id", "org", "repo", "full_name", "full_repo_name",
    "repo_github_url", "git_url", "ssh_url", "clone_url", "homepage_url",
    "is_private", "is_fork", "is_archived", "is_disabled",
    "description", "visibility", "primary_language", "default_branch",
    "repo_size_kb", "stargazers_count", "watchers_count", "forks_count",
    "open_issues_count", "subscribers_count", "network_count",
    "created_at", "updated_at", "pushed_at",
    "owner_login", "owner_id", "owner_type", "owner_github_url", "owner_avatar_url",
    "owner_is_site_admin", "_sdc_extracted_at", "dbt_updated_at",
]


def commits_mart(staged: DataFrame) -> DataFrame:
    return staged.select(
        *COMMIT_MART, label("org", "repo").alias("full_repo_name"), F.current_timestamp().alias("dbt_updated_at")
    )


def request_commits_mart(staged: DataFrame) -> DataFrame:
    return staged.select(*REQUEST_COMMIT_MART)


def branches_mart(staged: DataFrame) -> DataFrame:
    return staged.select(
        *BRANCH_MART,
        (F.col("branch_name") == "main").alias("is_main_branch"),
        F.current_timestamp().alias("dbt_updated_at"),
    )


def repositories_mart(staged: DataFrame) -> DataFrame:
    return staged.select(*REPOSITORY_MART)


# Commit types with a column of their own, and the mart's shares.
COUNTED_TYPES = ["fix", "feature", "docs", "refactor", "test", "chore", "performance", "other"]
SHARES = {
    "fix_commits_pct": "fix_commits",
    "feature_commits_pct": "feature_commits",
    "docs_commits_pct": "docs_commits",
    "refactor_commits_pct": "refactor_commits",
    "verification_rate_pct": "verified_commits",
    "merge_commit_pct": "merge_commits",
}
COMMITTER_MART = {
    "github_author_id": "committer_id",
    "github_author_login": "github_login",
    "git_author_name": "committer_name",
    "git_author_email": "committer_email",
    "github_author_avatar_url": "avatar_url",
    "github_author_profile_url": "profile_url",
    "github_author_type": "account_type",
    "first_at": "first_commit_at",
    "last_at": "last_commit_at",
}
COMMITTER_COLUMNS = [
    "committer_id", "github_login", "committer_name", "committer_email",
    "avatar_url", "profile_url", "account_type", "is_site_admin",
    "total_commits", "repos_contributed_to", "active_days", "days_active_span",
    "first_commit_at", "last_commit_at",
    *[f"{kind}_commits" for kind in COUNTED_TYPES],
    "verified_commits", "unverified_commits", "merge_commits", "pr_commits", "unique_prs",
    "commits_last_30_days", "commits_last_90_days", "commits_last_180_days", "commits_last_365_days",
    "active_days_last_30", "active_days_last_90", "active_days_last_365",
    "weekend_commits", "weekday_commits", "business_hours_commits", "off_hours_commits",
    "most_active_hour", "most_active_day_of_week",
    "avg_commits_per_active_day", "max_commits_in_day", "days_since_last_commit", "activity_status",
    *SHARES,
    "commits_per_active_day", "avg_commits_per_day_in_span",
    "rank_by_total_commits", "rank_by_recent_activity",
]


def committer_activity() -> Activity:
    verified = F.coalesce(F.col("is_verified"), F.lit(False))
    return Activity(
        actor="github_author_id",
        ts="commit_timestamp",
        noun="commits",
        counts={
            **{f"{kind}_commits": F.col("commit_type") == kind for kind in COUNTED_TYPES},
            "verified_commits": verified,
            "unverified_commits": ~verified,
            "merge_commits": F.col("is_merge_commit"),
            "pr_commits": F.col("pull_request_number").isNotNull(),
        },
        any_of={"is_site_admin": F.col("github_author_is_site_admin")},
        distincts={"repos_contributed_to": F.col("repo"), "unique_prs": F.col("pull_request_number")},
        modes={"git_author_email": F.col("git_author_email")},
        latest={
            name: F.col(name)
            for name in (
                "github_author_login",
                "github_author_avatar_url",
                "github_author_profile_url",
                "github_author_type",
                "git_author_name",
            )
        },
        latest_ties=[F.col("sha")],
        percents=SHARES,
    )


def committers_mart(
    staged: DataFrame, as_of: Column | None = None, rows_per_range: int = ROWS_PER_RANGE
) -> DataFrame:
    """One row per commit author; ``as_of`` (a UTC wall time) replaces now."""
    mart = activity_mart(staged, committer_activity(), as_of, rows_per_range)
    return (
        mart.withColumnsRenamed(COMMITTER_MART)
        .select(*COMMITTER_COLUMNS, F.current_timestamp().alias("dbt_updated_at"))
        .orderBy(F.desc("total_commits"), "committer_id")
    )


# Columns that must be filled, and columns that must be unique.
REQUIRED = {
    "branches": ["branch_sk", "org", "repo", "repo_id", "branch_name", "commit_sha"],
    "commits": ["sha", "commit_timestamp", "git_author_email"],
    "committers": ["committer_id", "total_commits", "first_commit_at", "last_commit_at"],
    "request_commits": ["pull_request_commit_sk", "org", "repo", "repo_id", "pull_request_number", "sha"],
    "repositories": ["repo_sk", "repo_id", "org", "repo"],
}
UNIQUE = {
    "branches": ["branch_sk"],
    "commits": ["sha"],
    "committers": ["committer_id"],
    "request_commits": ["pull_request_commit_sk"],
    "repositories": ["repo_sk", "repo_id"],
}


def mart_checks() -> list[Check]:
    """Checks the marts are built with; an unknown author is only a warning."""
    return [
        *[NotNull(table, column) for table, columns in REQUIRED.items() for column in columns],
        *[Unique(table, column) for table, columns in UNIQUE.items() for column in columns],
        Relationship("commits", "github_author_id", "committers", "committer_id", severity="warn"),
    ]
