"""Show data: flat text tables to typed staging tables and marts.

Casts are strict here: a malformed number or time is an error, not a NULL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.keys import blank_to_null
from tidemark.functions.parsing import json_array_size
from tidemark.operators.aggregates import labelled_count
from tidemark.operators.quality import Check, NotNull, Unique


def stage_characters(source: DataFrame) -> DataFrame:
    return source.select(
        F.col("id").cast("int").alias("character_id"),
        "name", "status", "species", "gender",
        "origin_name", "origin_url", "location_name", "location_url",
        F.col("image").alias("image_url"),
        F.col("url").alias("character_url"),
        F.col("created").cast("timestamp").alias("created_at"),
        blank_to_null(F.col("type")).alias("character_type"),
    )


def stage_episodes(source: DataFrame) -> DataFrame:
    return source.select(
        F.col("id").cast("int").alias("episode_id"),
        "name",
        "air_date",
        F.col("episode").alias("episode_code"),
        F.col("url").alias("episode_url"),
        F.col("created").cast("timestamp").alias("created_at"),
        json_array_size(F.col("characters"), strict=True).alias("character_count"),
    )


def stage_locations(source: DataFrame) -> DataFrame:
    return source.select(
        F.col("id").cast("int").alias("location_id"),
        "name",
        "dimension",
        F.col("url").alias("location_url"),
        F.col("created").cast("timestamp").alias("created_at"),
        blank_to_null(F.col("type")).alias("location_type"),
        json_array_size(F.col("residents"), strict=True).alias("resident_count"),
    )


def character_status(characters: DataFrame) -> DataFrame:
    return labelled_count(characters, "status", "unknown", "character_count")


def episode_character_counts(episodes: DataFrame) -> DataFrame:
    return episodes.select("episode_id", "episode_code", "character_count", "created_at")


def episode_summary(episodes: DataFrame) -> DataFrame:
    return episodes.select("episode_id", "episode_code", "name", "air_date", "character_count")


def location_summary(locations: DataFrame) -> DataFrame:
    return locations.select("location_id", "name", "location_type", "dimension", "resident_count")


# Key column of every table; it must be filled and unique.
KEYS = {
    "characters": "character_id",
    "episodes": "episode_id",
    "locations": "location_id",
    "episode_character_counts": "episode_id",
    "episode_summary": "episode_id",
    "location_summary": "location_id",
}


def catalog_checks() -> list[Check]:
    return [
        *[check(table, key) for table, key in KEYS.items() for check in (NotNull, Unique)],
        NotNull("character_status", "status"),
    ]
