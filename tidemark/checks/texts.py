"""Text mining over pages, documents and derived names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.checks.profiling import _CODE, code_texts
from tidemark.checks.registry import Tables, query
from tidemark.functions.text import comments, excerpt, first_of, html_to_text, normalise_sql, options_map
from tidemark.operators import textmine as tm
from tidemark.operators.fingerprint import text_fingerprint

_WS = r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
_TEXT = rf"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>', '', 'g'),
  '(?is)<style\b.*?</style>', '', 'g'), '<[^>]+>', ' ', 'g'), '{_WS}+', ' ', 'g'))"""


@query("html_to_text", f"SELECT page_id, url, {_TEXT} AS text FROM pages")
def _html_to_text(t: Tables) -> DataFrame:
    return t.pages.select("page_id", "url", html_to_text(F.col("html")).alias("text"))


@query(
    "html_excerpt",
    f"""SELECT page_id, length(text) AS n_chars, CASE WHEN length(text) > 5000 THEN substr(text, 1, 5000) || '...' ELSE text END AS excerpt
    FROM (SELECT page_id, {_TEXT} AS text FROM pages)""",
)
def _html_excerpt(t: Tables) -> DataFrame:
    """The report form of a page: its length and its first 5000 characters."""
    pages = t.pages.select("page_id", html_to_text(F.col("html")).alias("text"))
    return pages.select("page_id", F.length("text").cast("bigint").alias("n_chars"), excerpt(F.col("text"), 5000).alias("excerpt"))


_COMMON = ", ".join(f"'{w}'" for w in tm.COMMON_WORDS)


def _found(column: str) -> str:
    return rf"regexp_extract_all({column}, '\b([A-Z][a-z]+(?:{_WS}+[A-Z][a-z]+){{0,2}})\b', 1)"


@query(
    "terms",
    f"""SELECT DISTINCT doc_id, term FROM (SELECT doc_id, unnest({_found('text')}) AS term FROM documents)
    WHERE length(term) > 3 AND term NOT IN ({_COMMON})""",
)
def _terms(t: Tables) -> DataFrame:
    return tm.terms(t.documents, "doc_id", "text")


@query(
    "corpus_terms",
    f"""SELECT term, count(DISTINCT doc_id) AS n_texts FROM (SELECT doc_id, unnest({_found('text')}) AS term FROM documents)
    WHERE length(term) > 3 AND term NOT IN ({_COMMON}) GROUP BY term""",
)
def _corpus_terms(t: Tables) -> DataFrame:
    return tm.corpus_terms(t.documents, "text")


@query(
    "page_terms",
    f"""SELECT DISTINCT page_id, term FROM (SELECT page_id, unnest({_found('text')}) AS term FROM (SELECT page_id, {_TEXT} AS text FROM pages))
    WHERE length(term) > 3 AND term NOT IN ({_COMMON})""",
)
def _page_terms(t: Tables) -> DataFrame:
    return tm.terms(t.pages.select("page_id", html_to_text(F.col("html")).alias("text")), "page_id", "text")


_NAME = """CASE event_type WHEN 'click' THEN 'fct_shop_orders' WHEN 'error' THEN 'stg_' || event_type WHEN 'view' THEN 'total_' || CAST(user_id AS VARCHAR)
  WHEN 'signup' THEN 'Net_Revenue' ELSE 'churned_users' END"""


def names(t: Tables) -> DataFrame:
    """A table- or column-like name per event."""
    kind = F.col("event_type")
    name = (
        F.when(kind == "click", F.lit("fct_shop_orders"))
        .when(kind == "error", F.concat(F.lit("stg_"), kind))
        .when(kind == "view", F.concat(F.lit("total_"), F.col("user_id").cast("string")))
        .when(kind == "signup", F.lit("Net_Revenue"))
        .otherwise(F.lit("churned_users"))
    )
    return t.events.select("event_id", name.alias("name"))


@query(
    "metric_names",
    f"""SELECT event_id, name FROM (SELECT event_id, {_NAME} AS name FROM events) WHERE regexp_matches(name, '(?i)^(total|sum|avg|count|max|min)_')
    OR regexp_matches(name, '(?i)_(total|sum|avg|count|amount|revenue|cost|value)$') OR regexp_matches(name, '(?i)^(mrr|arr|ltv|cac|arpu|churn)')""",
)
def _metric_names(t: Tables) -> DataFrame:
    return names(t).where(tm.is_metric_name(F.col("name")))


@query(
    "domains",
    f"""SELECT event_id, replace(nullif(regexp_extract(name, '^(fct|dim|int|stg)_(.+)$', 2), ''), '_', ' ') AS domain,
    CASE WHEN len(string_split(name, '_')) > 2 THEN string_split(name, '_')[2] END AS second_token
    FROM (SELECT event_id, {_NAME} AS name FROM events)""",
)
def _domains(t: Tables) -> DataFrame:
    name = F.col("name")
    return names(t).select("event_id", tm.domain_of(name).alias("domain"), tm.second_token(name).alias("second_token"))


_INDUSTRY = """CASE WHEN bool_or(w IN ('orders', 'products', 'cart', 'checkout', 'inventory', 'shipment')) THEN 'E-commerce'
  WHEN bool_or(w IN ('subscription', 'mrr', 'churn', 'activation', 'trial', 'seats')) THEN 'SaaS'
  WHEN bool_or(w IN ('transactions', 'payments', 'accounts', 'balance', 'ledger')) THEN 'Finance'
  WHEN bool_or(w IN ('campaigns', 'leads', 'conversions', 'attribution', 'channels')) THEN 'Marketing' ELSE 'General' END"""
_WORD = """CASE event_type WHEN 'click' THEN CASE WHEN value > 150 THEN 'Orders' ELSE 'clicks' END WHEN 'error' THEN CASE WHEN value > 80 THEN 'Churn' ELSE 'errors' END
  WHEN 'view' THEN CASE WHEN value > 60 THEN 'LEDGER' ELSE 'views' END WHEN 'signup' THEN 'Leads' END"""


def words(t: Tables) -> DataFrame:
    """A business word per event, which depends on its type and value."""
    kind, value = F.col("event_type"), F.col("value")
    word = (
        F.when(kind == "click", F.when(value > 150, "Orders").otherwise("clicks"))
        .when(kind == "error", F.when(value > 80, "Churn").otherwise("errors"))
        .when(kind == "view", F.when(value > 60, "LEDGER").otherwise("views"))
        .when(kind == "signup", "Leads")
    )
    return t.events.select("event_id", "user_id", word.alias("word"))


@query(
    "vocabulary_class",
    f"""SELECT user_id, {_INDUSTRY} AS industry FROM (SELECT user_id, lower({_WORD}) AS w FROM events) GROUP BY user_id""",
)
def _vocabulary_class(t: Tables) -> DataFrame:
    return tm.vocabulary_by_key(words(t), ["user_id"], "word")


@query(
    "vocabulary_of_row",
    f"""SELECT event_id, {_INDUSTRY} AS industry FROM (SELECT event_id, unnest([lower({_WORD}), 'Balance sheet']) AS w FROM events) GROUP BY event_id""",
)
def _vocabulary_of_row(t: Tables) -> DataFrame:
    listed = F.array(F.col("word"), F.lit("Balance sheet"))
    return words(t).select("event_id", F.coalesce(tm.vocabulary_of(listed), F.lit("General")).alias("industry"))


@query(
    "comments",
    f"""SELECT doc_id, unnest(['note ' || source, source]) AS comment FROM documents""",
)
def _comments(t: Tables) -> DataFrame:
    return code_texts(t).select("doc_id", F.explode(comments(F.col("code"))).alias("comment"))


_IN_LINE = r"[^\n\r\x{2028}\x{2029}]"


@query(
    "page_comments",
    rf"""SELECT page_id, unnest(list_concat(regexp_extract_all(html, '--{_WS}*({_IN_LINE}+)', 1),
    regexp_extract_all(html, '(?s)/\*{_WS}*(.*?){_WS}*\*/', 1))) AS comment FROM pages""",
)
def _page_comments(t: Tables) -> DataFrame:
    """Comment bodies of whole pages, as they would be found in code."""
    return t.pages.select("page_id", F.explode(comments(F.col("html"))).alias("comment"))


_PLAIN = rf"""lower(trim(regexp_replace(regexp_replace(regexp_replace(body, '--{_IN_LINE}*', '', 'g'), '(?s)/\*.*?\*/', '', 'g'), '{_WS}+', ' ', 'g')))"""


@query(
    "body_hashes",
    f"""SELECT kind, id, length({_PLAIN}) AS n_chars, sha256({_PLAIN}) AS body_hash FROM
    (SELECT 'document' AS kind, doc_id AS id, text AS body FROM documents UNION ALL SELECT 'page', page_id, html FROM pages)""",
)
def _body_hashes(t: Tables) -> DataFrame:
    """Fingerprints of whole document texts and pages."""
    documents = t.documents.select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.col("text").alias("body"))
    bodies = documents.union(t.pages.select(F.lit("page"), "page_id", "html"))
    n_chars = F.length(normalise_sql(F.col("body"))).cast("bigint").alias("n_chars")
    return bodies.select("kind", "id", n_chars, text_fingerprint(F.col("body")).alias("body_hash"))


@query(
    "page_options",
    rf"""WITH parts AS (SELECT page_id, unnest(string_split(html, ',')) AS part, generate_subscripts(string_split(html, ','), 1) AS n FROM pages),
    pairs AS (SELECT page_id, n, regexp_extract(part, '(?s)(\w+)\s*=\s*(.+)', 1) AS key, regexp_extract(part, '(?s)(\w+)\s*=\s*(.+)', 2) AS value FROM parts)
    SELECT page_id, key, arg_max(regexp_replace(regexp_replace(value, '{_WS}+$', ''), '(?s)^[''"](.*).$', '\1'), n) AS value
    FROM pairs WHERE key != '' GROUP BY page_id, key""",
)
def _page_options(t: Tables) -> DataFrame:
    """Whatever reads as ``key = value`` in whole pages."""
    return t.pages.select("page_id", F.explode(options_map(F.col("html"))))


@query("first_words", """SELECT doc_id, array_to_string(string_split(text, ' ')[1:10], '|') AS words FROM documents""")
def _first_words(t: Tables) -> DataFrame:
    """A list excerpt: the first ten words of a text."""
    return t.documents.select("doc_id", F.array_join(first_of(F.split("text", " "), 10), "|").alias("words"))


@query(
    "comment_terms",
    f"""SELECT doc_id, unnest(CASE WHEN lang IN ('en', 'de') THEN ['Net Revenue', 'This Table', 'Gross Margin', 'The Data'] ELSE ['Net Revenue', 'This Table'] END) AS term FROM documents""",
)
def _comment_terms(t: Tables) -> DataFrame:
    note = F.when(F.col("lang").isin("en", "de"), F.lit("/* by Gross Margin\n of The Data */")).otherwise(F.lit("Not Seen"))
    code = t.documents.select("doc_id", "lang", F.concat(F.lit("SELECT 1 -- the Net Revenue, in This Table\n"), note).alias("code"))
    return tm.comment_terms(code, "doc_id", "code")
