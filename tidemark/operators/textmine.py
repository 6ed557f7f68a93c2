"""Business terms, domains and metrics out of texts and names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import WHITE_SPACE, comments

# A term is one to three capitalised words, longer than three
# characters and not one of the common words.
TERM = rf"(?<![A-Za-z0-9_])([A-Z][a-z]+(?:{WHITE_SPACE}+[A-Z][a-z]+){{0,2}})(?![A-Za-z0-9_])"
TERM_MIN_LENGTH = 4
COMMON_WORDS = [
    "The", "This", "That", "With", "From", "Into", "Table", "Model",
    "Column", "Data", "Query", "Select", "Where", "Group", "Order",
]

# Names that look like metrics.
METRIC_NAMES = [
    r"(?i)^(total|sum|avg|count|max|min)_",
    r"(?i)_(total|sum|avg|count|amount|revenue|cost|value)$",
    r"(?i)^(mrr|arr|ltv|cac|arpu|churn)",
]

# Prefixes of layered table names.
LAYER_PREFIX = r"^(fct|dim|int|stg)_(.+)$"

# Vocabularies of an industry, in order of precedence.
VOCABULARIES = [
    ("E-commerce", ["orders", "products", "cart", "checkout", "inventory", "shipment"]),
    ("SaaS", ["subscription", "mrr", "churn", "activation", "trial", "seats"]),
    ("Finance", ["transactions", "payments", "accounts", "balance", "ledger"]),
    ("Marketing", ["campaigns", "leads", "conversions", "attribution", "channels"]),
]
NO_VOCABULARY = "General"


def term_array(text: Column) -> Column:
    """Distinct terms of one text."""
    found = F.regexp_extract_all(text, F.lit(TERM), F.lit(1))
    kept = F.filter(found, lambda t: (F.length(t) >= TERM_MIN_LENGTH) & ~t.isin(*COMMON_WORDS))
    return F.array_distinct(kept)


def terms(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term), one row per distinct term of a text; no shuffle."""
    return df.select(key, F.explode(term_array(F.col(text))).alias("term"))


def corpus_terms(df: DataFrame, text: str) -> DataFrame:
    """Distinct terms of all texts with the number of texts they are in."""
    found = df.select(F.explode(term_array(F.col(text))).alias("term"))
    return found.groupBy("term").agg(F.count("*").alias("n_texts"))


def comment_terms(df: DataFrame, key: str, text: str) -> DataFrame:
    """Distinct terms of a code text's comments."""
    found = F.flatten(F.transform(comments(F.col(text)), term_array))
    return df.select(key, F.explode(F.array_distinct(found)).alias("term"))


def is_metric_name(name: Column) -> Column:
    found = F.lit(False)
    for pattern in METRIC_NAMES:
        found = found | name.rlike(pattern)
    return found


def domain_of(name: Column) -> Column:
    """``fct_orders`` gives ``orders``; NULL without a known prefix."""
    rest = F.regexp_extract(name, LAYER_PREFIX, 2)
    return F.translate(F.nullif(rest, F.lit("")), "_", " ")


def second_token(name: Column) -> Column:
    """Second part of a name with more than two parts."""
    parts = F.split(name, "_")
    return F.when(F.size(parts) > 2, parts[1])


def vocabulary_of(words: Column) -> Column:
    """First vocabulary that holds one of the words of an array, in any case."""
    lowered = F.transform(words, F.lower)
    result = F
    for name, vocabulary in VOCABULARIES:
        result = result.when(F.arrays_overlap(lowered, F.array(*map(F.lit, vocabulary))), F.lit(name))
    return result.otherwise(F.lit(NO_VOCABULARY))


def vocabulary_by_key(words: DataFrame, keys: Sequence[str], term: str) -> DataFrame:
    """The same for words in rows: one flag per vocabulary, combined on the map side."""
    flags = [F.max(F.coalesce(F.lower(F.col(term)).isin(*vocabulary), F.lit(False))).alias(f"_v{i}") for i, (_, vocabulary) in enumerate(VOCABULARIES)]
    result = F
    for i, (name, _) in enumerate(VOCABULARIES):
        result = result.when(F.col(f"_v{i}"), F.lit(name))
    return words.groupBy(*keys).agg(*flags).select(*keys, result.otherwise(F.lit(NO_VOCABULARY)).alias("industry"))
