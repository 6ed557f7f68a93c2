"""Landed JSON records, their staging tables and marts, derived from ``events``.

Every event is landed as a commit in two extractions; only the later one, which
carries the final message, may survive staging.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.checks.activity import k_of, newest
from tidemark.checks.registry import QUERIES, SQL, Tables, query
from tidemark.operators.incremental import read_target
from tidemark.operators.quality import NotNull, Unique, run_checks
from tidemark.plans import repository_activity as repo
from tidemark.plans.incremental_staging import commits_mart_increment, stage_increment
from tidemark.session import scratch_path
from tidemark.sources.readers import read_landing
from tidemark.sources.sinks import write_landing, write_table

EXTRACTED = "2024-02-01 00:00:00"


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def text_of(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


# Records whose payloads one task makes: some hundred times the bytes that the table's files hold of them.
LANDED_PER_TASK = 100_000


def land(records: DataFrame, **leaves: Column) -> DataFrame:
    """Two extractions of every record, an hour apart; ``_version`` tells them apart.

    Records are dealt evenly while they are small, so that a task's payloads are bounded however few files the table has.
    """
    dealt = records.repartition(max(1, -(-records.count() // LANDED_PER_TASK)))
    versions = dealt.withColumn("_version", F.explode(F.array(F.lit(0), F.lit(1))))
    at = F.timestamp_add("HOUR", F.col("_version"), F.lit(EXTRACTED).cast("timestamp"))
    return versions.select(
        F.to_json(F.struct(*[c.alias(name) for name, c in leaves.items()])).alias("data"),
        at.alias("_sdc_extracted_at"),
        at.alias("_sdc_received_at"),
        at.alias("_sdc_batched_at"),
        F.lit(None).cast("timestamp").alias("_sdc_deleted_at"),
        F.col("_version").cast("bigint").alias("_sdc_sequence"),
        F.lit(1).cast("bigint").alias("_sdc_table_version"),
    )


def commit_leaves() -> dict[str, Column]:
    user, kind, k = F.col("user_id"), F.col("event_type"), k_of()
    head = (
        F.when(kind == "click", F.lit("feat:x"))
        .when(kind == "error", F.lit("Fix(core) y"))
        .when(kind == "view", F.lit("docs: z"))
        .when(kind == "signup", F.lit("perf:p"))
        .otherwise(F.lit("[WIP] other"))
    )
    final = text_of(head, " #", k, " of #1")
    email = F.when(F.col("value") > 5, text_of("u", user, "@", kind))
    person = {"id": user, "login": text_of("login", user, kind), "avatar_url": text_of("a/", user),
              "html_url": text_of("h/", user), "type": F.lit("User"), "site_admin": F.col("value") > 300}
    author = F.struct(*[c.alias(n) for n, c in person.items()])
    return {
        "sha": text_of("s", F.col("event_id")),
        "org": text_of("org", F.length(kind)),
        "repo": text_of("repo", F.length(kind), "-", F.length("props")),
        # A quoted number: still a number after the safe cast.
        "repo_id": text_of(F.length(kind), F.length("props")),
        "node_id": text_of("n", F.col("event_id")),
        "url": text_of("api/", F.col("event_id")),
        "html_url": text_of("web/", F.col("event_id")),
        "commit_timestamp": iso(F.col("ts")),
        "commit": F.struct(
            F.when(F.col("_version") == 1, final).otherwise(F.lit("build:draft")).alias("message"),
            k.alias("comment_count"),
            F.struct(text_of("name", user).alias("name"), email.alias("email"), iso(F.col("ts")).alias("date")).alias("author"),
            F.struct(
                F.lit("hub").alias("name"),
                F.when(kind == "view", F.lit("noreply")).otherwise(email).alias("email"),
                F.date_format("ts", "yyyy-MM-dd").alias("date"),
            ).alias("committer"),
            F.struct(text_of("t", F.col("event_id")).alias("sha"), F.lit(None).cast("string").alias("url")).alias("tree"),
            F.struct(
                F.when(k < 60, F.when(k < 30, F.lit("true")).otherwise(F.lit("yes"))).alias("verified"),
                F.lit("valid").alias("reason"),
                iso(F.col("ts")).alias("verified_at"),
            ).alias("verification"),
        ),
        # Cheap events have no hosting account.
        "author": F.when(F.col("value") > 2, author),
        "committer": author,
    }


_K = "TRY_CAST(json_extract_string(props, '$.k') AS BIGINT)"
_EMAIL = "CASE WHEN value > 5 THEN 'u' || CAST(user_id AS VARCHAR) || '@' || event_type END"
_COMMITS = f"""
c0 AS (SELECT *, {_K} AS k, {_EMAIL} AS mail,
  CASE event_type WHEN 'click' THEN 'feat:x' WHEN 'error' THEN 'Fix(core) y' WHEN 'view' THEN 'docs: z' WHEN 'signup' THEN 'perf:p'
    ELSE '[WIP] other' END AS head FROM events),
commits AS (SELECT 's' || CAST(event_id AS VARCHAR) AS sha, 'org' || CAST(length(event_type) AS VARCHAR) AS org,
  'repo' || CAST(length(event_type) AS VARCHAR) || '-' || CAST(length(props) AS VARCHAR) AS repo,
  CAST(CAST(length(event_type) AS VARCHAR) || CAST(length(props) AS VARCHAR) AS BIGINT) AS repo_id,
  'n' || CAST(event_id AS VARCHAR) AS node_id, 'api/' || CAST(event_id AS VARCHAR) AS commit_api_url,
  'web/' || CAST(event_id AS VARCHAR) AS commit_github_url, ts AS commit_timestamp,
  head || ' #' || CAST(k AS VARCHAR) || ' of #1' AS commit_message, k AS comment_count, k AS pull_request_number,
  CASE event_type WHEN 'click' THEN 'feature' WHEN 'error' THEN 'fix' WHEN 'signup' THEN 'performance' ELSE 'other' END AS commit_type,
  'name' || CAST(user_id AS VARCHAR) AS git_author_name, mail AS git_author_email, ts AS git_author_timestamp,
  'hub' AS git_committer_name, CASE WHEN event_type = 'view' THEN 'noreply' ELSE mail END AS git_committer_email,
  CAST(NULL AS TIMESTAMP) AS git_committer_timestamp,
  (event_type = 'view' AND mail IS NOT NULL) AS is_merge_commit,
  CASE WHEN k < 30 THEN TRUE END AS is_verified, 'valid' AS verification_reason, ts AS verified_at,
  't' || CAST(event_id AS VARCHAR) AS tree_sha, CAST(NULL AS VARCHAR) AS tree_url,
  CASE WHEN value > 2 THEN user_id END AS github_author_id,
  CASE WHEN value > 2 THEN 'login' || CAST(user_id AS VARCHAR) || event_type END AS github_author_login,
  CASE WHEN value > 2 THEN 'a/' || CAST(user_id AS VARCHAR) END AS github_author_avatar_url,
  CASE WHEN value > 2 THEN 'h/' || CAST(user_id AS VARCHAR) END AS github_author_profile_url,
  CASE WHEN value > 2 THEN 'User' END AS github_author_type,
  CASE WHEN value > 2 THEN value > 300 END AS github_author_is_site_admin,
  user_id AS github_committer_id, 'login' || CAST(user_id AS VARCHAR) || event_type AS github_committer_login,
  'a/' || CAST(user_id AS VARCHAR) AS github_committer_avatar_url, 'h/' || CAST(user_id AS VARCHAR) AS github_committer_profile_url,
  'User' AS github_committer_type, value > 300 AS github_committer_is_site_admin,
  CAST(ts AS DATE) AS commit_date, CAST(date_trunc('week', ts) AS DATE) AS commit_week,
  CAST(date_trunc('month', ts) AS DATE) AS commit_month, CAST(date_trunc('quarter', ts) AS DATE) AS commit_quarter,
  CAST(date_trunc('year', ts) AS DATE) AS commit_year, CAST(dayofweek(ts) + 1 AS BIGINT) AS commit_day_of_week,
  CAST(hour(ts) AS BIGINT) AS commit_hour FROM c0)"""


def without_zone(df: DataFrame) -> DataFrame:
    """Times as UTC wall times, and no audit column, for comparison."""
    df = df.drop("dbt_updated_at")
    zoned = [f.name for f in df.schema if f.dataType.simpleString() == "timestamp"]
    return df.withColumns({name: F.col(name).cast("timestamp_ntz") for name in zoned})


def landed_commits(t: Tables) -> DataFrame:
    return land(t.events, **commit_leaves())


@query(
    "commits_mart",
    f"""WITH {_COMMITS} SELECT * EXCLUDE (comment_count, verified_at), org || '/' || repo AS full_repo_name FROM commits""",
)
def _commits_mart(t: Tables) -> DataFrame:
    return without_zone(repo.commits_mart(repo.stage_commits(landed_commits(t))))


@query(
    "request_commits_mart",
    f"""WITH {_COMMITS} SELECT * EXCLUDE (commit_timestamp),
    org || '/' || repo || ':' || CAST(repo_id AS VARCHAR) || ':pr:' || CAST(pull_request_number AS VARCHAR) || ':' || sha AS pull_request_commit_sk,
    org || '/' || repo AS full_repo_name, commit_api_url || '/c' AS comments_api_url, TIMESTAMP '2024-02-01 01:00:00' AS _sdc_extracted_at
    FROM commits""",
)
def _request_commits_mart(t: Tables) -> DataFrame:
    return without_zone(repo.request_commits_mart(repo.stage_request_commits(landed_request_commits(t.events))))


def landed_request_commits(events: DataFrame) -> DataFrame:
    leaves = commit_leaves()
    del leaves["commit_timestamp"]
    leaves |= {"pull_number": k_of(), "comments_url": text_of("api/", F.col("event_id"), "/c")}
    return land(events, **leaves)


def _branches_sql(version: str) -> str:
    """The branches of the given version, an SQL expression."""
    return f"""SELECT 'o' || CAST(c_nationkey AS VARCHAR) AS org, c_mktsegment AS repo, CASE WHEN c_acctbal > 0 THEN c_custkey END AS repo_id,
    CASE WHEN c_acctbal > 5000 THEN 'main' ELSE c_name END AS branch_name, CASE WHEN c_acctbal > 0 THEN c_acctbal > 9000 END AS is_protected,
    'sha' || CAST({version} AS VARCHAR) || '-' || CAST(c_custkey AS VARCHAR) AS commit_sha, 'u' AS commit_api_url,
    'o' || CAST(c_nationkey AS VARCHAR) || '/' || c_mktsegment || ':' || coalesce(CAST(CASE WHEN c_acctbal > 0 THEN c_custkey END AS VARCHAR), '')
      || ':' || CASE WHEN c_acctbal > 5000 THEN 'main' ELSE c_name END AS branch_sk,
    'o' || CAST(c_nationkey AS VARCHAR) || '/' || c_mktsegment AS full_repo_name,
    TIMESTAMP '{EXTRACTED}' + to_hours({version}) AS _sdc_extracted_at, c_acctbal > 5000 AS is_main_branch
    FROM customer"""


@query("branches_mart", _branches_sql("1"))
def _branches_mart(t: Tables) -> DataFrame:
    return without_zone(repo.branches_mart(repo.stage_branches(landed_branches(t.customer))))


def landed_branches(customer: DataFrame) -> DataFrame:
    balance = F.col("c_acctbal")
    return land(
        customer,
        org=text_of("o", F.col("c_nationkey")),
        repo=F.col("c_mktsegment"),
        repo_id=F.when(balance > 0, F.col("c_custkey")),
        name=F.when(balance > 5000, F.lit("main")).otherwise(F.col("c_name")),
        protected=F.when(balance > 0, balance > 9000),
        commit=F.struct(text_of("sha", F.col("_version"), "-", F.col("c_custkey")).alias("sha"), F.lit("u").alias("url")),
    )


def _repositories_sql(version: str) -> str:
    """The repositories of the given version, an SQL expression."""
    return f"""SELECT p_partkey AS repo_id, 'n' || CAST(p_partkey AS VARCHAR) AS node_id, p_brand AS org,
    CASE WHEN p_size > 10 THEN p_name ELSE 'slug' END AS repo, CASE WHEN p_size > 20 THEN p_brand || '/' || p_name END AS full_name,
    p_brand || '/' || CASE WHEN p_size > 10 THEN p_name ELSE 'slug' END AS full_repo_name,
    CAST(p_partkey AS VARCHAR) || ':' || CASE WHEN p_size > 20 THEN p_brand || '/' || p_name ELSE p_brand END AS repo_sk,
    'h' AS repo_github_url, 'g' AS git_url, 's' AS ssh_url, 'c' AS clone_url, CAST(NULL AS VARCHAR) AS homepage_url,
    p_size > 30 AS is_private, p_size < 5 AS is_fork, CAST(NULL AS BOOLEAN) AS is_archived, FALSE AS is_disabled,
    p_type AS description, 'public' AS visibility, 'SQL' AS primary_language, 'main' AS default_branch,
    CAST(p_size AS BIGINT) AS repo_size_kb, CAST(p_size AS BIGINT) * ({version} + 1) AS stargazers_count, CAST(1 AS BIGINT) AS watchers_count, CAST(2 AS BIGINT) AS forks_count,
    CAST(3 AS BIGINT) AS open_issues_count, CAST(NULL AS BIGINT) AS subscribers_count, CAST(4 AS BIGINT) AS network_count,
    TIMESTAMP '2020-01-01 00:00:00' AS created_at, CASE WHEN p_size > 25 THEN TIMESTAMP '2024-01-01 00:00:00' + to_hours({version}) END AS updated_at,
    TIMESTAMP '2023-01-01 02:30:00' + to_hours({version}) AS pushed_at,
    'own' AS owner_login, p_partkey AS owner_id, 'Organization' AS owner_type, 'oh' AS owner_github_url, 'oa' AS owner_avatar_url,
    FALSE AS owner_is_site_admin, TIMESTAMP '{EXTRACTED}' + to_hours({version}) AS _sdc_extracted_at
    FROM part"""


@query("repositories_mart", _repositories_sql("1"))
def _repositories_mart(t: Tables) -> DataFrame:
    return without_zone(repo.repositories_mart(repo.stage_repositories(landed_repositories(t.part))))


def landed_repositories(part: DataFrame) -> DataFrame:
    size, version = F.col("p_size"), F.col("_version")
    return land(
        part,
        id=F.col("p_partkey"),
        node_id=text_of("n", F.col("p_partkey")),
        name=F.when(size > 10, F.col("p_name")),
        repo=F.lit("slug"),
        full_name=F.when(size > 20, text_of(F.col("p_brand"), "/", F.col("p_name"))),
        org=F.col("p_brand"),
        html_url=F.lit("h"), git_url=F.lit("g"), ssh_url=F.lit("s"), clone_url=F.lit("c"),
        private=size > 30, fork=size < 5, disabled=F.lit("FALSE"),
        description=F.col("p_type"), visibility=F.lit("public"), language=F.lit("SQL"), default_branch=F.lit("main"),
        size=size, stargazers_count=size * (version + 1),
        watchers_count=F.lit(1), forks_count=F.lit(2), open_issues_count=F.lit(3), network_count=F.lit(4),
        created_at=F.lit("2020-01-01T00:00:00Z"),
        updated_at=F.when(size > 25, text_of("2024-01-01T0", version, ":00:00Z")),
        # With a zone of its own: the later version is the later instant.
        pushed_at=text_of("2023-01-01T0", version + 4, ":30:00.0+02:00"),
        owner=F.struct(
            F.lit("own").alias("login"), F.col("p_partkey").alias("id"), F.lit("Organization").alias("type"),
            F.lit("oh").alias("html_url"), F.lit("oa").alias("avatar_url"),
        ),
    )


# Versions that an incremental load ends with: rows that the second extraction leaves out stay as first loaded.
CUT = "2024-01-15 00:00:00"
_EARLY = f"commit_timestamp <= TIMESTAMP '{CUT}'"
_EARLY_VIEW = f"git_committer_email = 'noreply' AND git_author_timestamp <= TIMESTAMP '{CUT}'"
def _drafts(early: str, *more: str) -> str:
    """Replaced columns of commits that are as the first extraction has them where ``early`` holds."""
    replaced = [f"CASE WHEN {early} THEN 'build:draft' ELSE commit_message END AS commit_message", f"CASE WHEN {early} THEN 'build' ELSE commit_type END AS commit_type"]
    return f"REPLACE ({', '.join([*replaced, *more])})"


def is_early(ts: Column) -> Column:
    return ts <= F.lit(CUT).cast("timestamp_ntz")


def staged_twice(t: Tables, name: str, first: DataFrame, second: DataFrame, after=lambda path: None) -> str:
    """Land two extractions as JSON lines, load each in a run of its own; the staging table's path."""
    landing, path = scratch_path(t.spark, "landing"), scratch_path(t.spark, name)
    for records in (first, second):
        write_landing(records, landing)
        stage_increment(path, read_landing(t.spark, landing), name)
        after(path)
    return path


def extraction(landed: DataFrame, version: int) -> DataFrame:
    return landed.where(F.col("_sdc_sequence") == version)


@query(
    "commits_incremental",
    f"""WITH {_COMMITS} SELECT * EXCLUDE (comment_count, verified_at)
    {_drafts(_EARLY, f"CASE WHEN {_EARLY} THEN NULL ELSE pull_request_number END AS pull_request_number")},
    org || '/' || repo AS full_repo_name FROM commits""",
)
def _commits_incremental(t: Tables) -> DataFrame:
    """Staging by extraction time, the mart by commit time: commits known to the mart stay as first loaded."""
    early = is_early(F.col("ts"))
    first = extraction(land(t.events.where(early), **commit_leaves()), 0)
    mart = scratch_path(t.spark, "mart")
    staged_twice(
        t, "commits", first, extraction(landed_commits(t), 1),
        lambda path: commits_mart_increment(mart, read_target(t.spark, path)),
    )
    return without_zone(read_target(t.spark, mart))


@query(
    "request_commits_incremental",
    f"""WITH {_COMMITS} SELECT * EXCLUDE (commit_timestamp) {_drafts(_EARLY_VIEW)},
    org || '/' || repo || ':' || CAST(repo_id AS VARCHAR) || ':pr:' || CAST(pull_request_number AS VARCHAR) || ':' || sha AS pull_request_commit_sk,
    org || '/' || repo AS full_repo_name, commit_api_url || '/c' AS comments_api_url,
    TIMESTAMP '{EXTRACTED}' + to_hours(CASE WHEN {_EARLY_VIEW} THEN 0 ELSE 1 END) AS _sdc_extracted_at FROM commits""",
)
def _request_commits_incremental(t: Tables) -> DataFrame:
    """Early views are not extracted again and stay drafts."""
    leaves, early = landed_request_commits, is_early(F.col("ts"))
    first = extraction(leaves(t.events.where(early)), 0)
    second = extraction(leaves(t.events.where(~(early & (F.col("event_type") == "view")))), 1)
    path = staged_twice(t, "request_commits", first, second)
    return without_zone(repo.request_commits_mart(read_target(t.spark, path)))


_BRANCH_VERSION = "CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END"


@query("branches_incremental", _branches_sql(_BRANCH_VERSION))
def _branches_incremental(t: Tables) -> DataFrame:
    """Only customers with a positive balance are extracted twice."""
    first, second = extraction(landed_branches(t.customer), 0), extraction(landed_branches(t.customer.where("c_acctbal > 0")), 1)
    path = staged_twice(t, "branches", first, second)
    return without_zone(repo.branches_mart(read_target(t.spark, path)))


_REPOSITORY_VERSION = "CASE WHEN p_size <= 25 OR p_size > 40 THEN 1 ELSE 0 END"


@query("repositories_incremental", _repositories_sql(_REPOSITORY_VERSION))
def _repositories_incremental(t: Tables) -> DataFrame:
    """Parts of middle size are extracted once; large ones are new in the second extraction."""
    first = extraction(landed_repositories(t.part.where("p_size <= 40")), 0)
    second = extraction(landed_repositories(t.part.where("p_size <= 25 OR p_size > 40")), 1)
    path = staged_twice(t, "repositories", first, second)
    return without_zone(repo.repositories_mart(read_target(t.spark, path)))


@query(
    "committers_mart",
    f"""WITH {_COMMITS},
c AS (SELECT * FROM commits WHERE github_author_id IS NOT NULL),
now_at AS (SELECT max(ts) AS t FROM events),
mails AS (SELECT github_author_id AS id, git_author_email AS committer_email FROM (SELECT *, row_number() OVER (PARTITION BY github_author_id ORDER BY n DESC, git_author_email) AS rn
  FROM (SELECT github_author_id, git_author_email, count(*) AS n FROM c WHERE git_author_email IS NOT NULL GROUP BY ALL)) WHERE rn = 1),
latest AS (SELECT github_author_id AS id, github_author_login AS github_login, git_author_name AS committer_name, github_author_avatar_url AS avatar_url,
  github_author_profile_url AS profile_url, github_author_type AS account_type
  FROM (SELECT *, row_number() OVER (PARTITION BY github_author_id ORDER BY commit_timestamp DESC, sha DESC) AS rn FROM c) WHERE rn = 1),
hours AS (SELECT github_author_id AS id, commit_hour AS most_active_hour FROM (SELECT *, row_number() OVER (PARTITION BY github_author_id ORDER BY n DESC, commit_hour) AS rn
  FROM (SELECT github_author_id, commit_hour, count(*) AS n FROM c GROUP BY ALL)) WHERE rn = 1),
dows AS (SELECT github_author_id AS id, commit_day_of_week AS most_active_day_of_week FROM (SELECT *, row_number() OVER (PARTITION BY github_author_id ORDER BY n DESC, commit_day_of_week) AS rn
  FROM (SELECT github_author_id, commit_day_of_week, count(*) AS n FROM c GROUP BY ALL)) WHERE rn = 1),
days AS (SELECT github_author_id AS id, avg(n) AS avg_commits_per_active_day, max(n) AS max_commits_in_day
  FROM (SELECT github_author_id, commit_date, count(*) AS n FROM c GROUP BY ALL) GROUP BY ALL),
base AS (SELECT github_author_id AS id, max(coalesce(github_author_is_site_admin, FALSE)) AS is_site_admin, count(*) AS total_commits,
  count(DISTINCT repo) AS repos_contributed_to, count(DISTINCT commit_date) AS active_days,
  min(commit_timestamp) AS first_commit_at, max(commit_timestamp) AS last_commit_at,
  CAST(trunc((floor(epoch_us(max(commit_timestamp)) / 1000000) - floor(epoch_us(min(commit_timestamp)) / 1000000)) / 86400) AS BIGINT) AS days_active_span,
  CAST(trunc((floor(epoch_us(max(t)) / 1000000) - floor(epoch_us(max(commit_timestamp)) / 1000000)) / 86400) AS BIGINT) AS days_since_last_commit,
  {", ".join(f"count(*) FILTER (commit_type = '{k}') AS {k}_commits" for k in repo.COUNTED_TYPES)},
  count(*) FILTER (coalesce(is_verified, FALSE)) AS verified_commits, count(*) FILTER (NOT coalesce(is_verified, FALSE)) AS unverified_commits,
  count(*) FILTER (coalesce(is_merge_commit, FALSE)) AS merge_commits, count(pull_request_number) AS pr_commits,
  count(DISTINCT pull_request_number) AS unique_prs,
  {", ".join(f"count(*) FILTER (commit_timestamp >= t - INTERVAL {n} DAY) AS commits_last_{n}_days" for n in (30, 90, 180, 365))},
  {", ".join(f"count(DISTINCT CASE WHEN commit_timestamp >= t - INTERVAL {n} DAY THEN commit_date END) AS active_days_last_{n}" for n in (30, 90, 365))},
  count(*) FILTER (commit_day_of_week IN (1, 7)) AS weekend_commits, count(*) FILTER (commit_day_of_week BETWEEN 2 AND 6) AS weekday_commits,
  count(*) FILTER (commit_hour BETWEEN 9 AND 17) AS business_hours_commits, count(*) FILTER (commit_hour < 9 OR commit_hour > 17) AS off_hours_commits
  FROM c, now_at GROUP BY github_author_id)
SELECT id AS committer_id, * EXCLUDE (id),
  CASE WHEN commits_last_30_days > 0 THEN 'Very Active' WHEN commits_last_90_days > 0 THEN 'Active' WHEN commits_last_180_days > 0 THEN 'Moderately Active'
    WHEN commits_last_365_days > 0 THEN 'Less Active' ELSE 'Inactive' END AS activity_status,
  {", ".join(f"round(100.0 * (CAST({count} AS DOUBLE) / total_commits), 2) AS {name}" for name, count in repo.SHARES.items())},
  round(CAST(total_commits AS DOUBLE) / nullif(active_days, 0), 2) AS commits_per_active_day,
  round(CAST(total_commits AS DOUBLE) / greatest(days_active_span, 1), 2) AS avg_commits_per_day_in_span,
  row_number() OVER (ORDER BY total_commits DESC, id) AS rank_by_total_commits,
  row_number() OVER (ORDER BY commits_last_90_days DESC, id) AS rank_by_recent_activity
FROM base LEFT JOIN latest USING (id) LEFT JOIN mails USING (id) LEFT JOIN hours USING (id) LEFT JOIN dows USING (id) LEFT JOIN days USING (id)""",
)
def _committers_mart(t: Tables) -> DataFrame:
    """From a stored staging table, as the mart reads several columns of it more than once."""
    path = scratch_path(t.spark, "staged")
    write_table(repo.stage_commits(landed_commits(t)), path)
    staged = t.spark.read.parquet(path)
    return without_zone(repo.committers_mart(staged, newest(t.events, "ts")))


def report_sql(tables: dict[str, str], checks: list) -> str:
    """What ``run_checks`` must give for tables of the given SQL."""
    rows = []
    for c in checks:
        name = f"m_{c.table}"
        if isinstance(c, NotNull):
            kind, failed = "not_null", f"(SELECT count(*) FROM {name} WHERE {c.column} IS NULL)"
        elif isinstance(c, Unique):
            kind, failed = "unique", f"(SELECT count(*) FROM (SELECT 1 FROM {name} WHERE {c.column} IS NOT NULL GROUP BY {c.column} HAVING count(*) > 1))"
        else:
            kind, failed = "relationships", f"(SELECT count(*) FROM {name} WHERE {c.column} NOT IN (SELECT {c.parent_column} FROM m_{c.parent}))"
        rows.append(f"SELECT '{c.table}' AS table_name, '{kind}' AS check_name, '{c.column}' AS column_name, '{c.severity}' AS severity, {failed} AS failures")
    parts = ", ".join(f"m_{n} AS ({q})" for n, q in tables.items())
    return f"""WITH {parts} SELECT *, CASE WHEN failures = 0 THEN 'pass' WHEN severity = 'warn' THEN 'warn' ELSE 'fail' END AS status
    FROM ({' UNION ALL '.join(rows)})"""


_MARTS = ("commits", "request_commits", "branches", "repositories", "committers")


@query("mart_check_report", report_sql({n: SQL[f"{n}_mart"] for n in _MARTS}, repo.mart_checks()))
def _mart_check_report(t: Tables) -> DataFrame:
    """All checks of all marts, each mart written once."""
    marts = {}
    for name in _MARTS:
        path = scratch_path(t.spark, name)
        write_table(QUERIES[f"{name}_mart"](t.spark, t.folder), path)
        marts[name] = t.spark.read.parquet(path)
    return run_checks(marts, repo.mart_checks())
