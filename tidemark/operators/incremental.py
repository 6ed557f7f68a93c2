"""High-water marks and upserts into a versioned parquet table.

A table is a folder of parquet folders and of manifests. Each load writes one new folder, a delta
of the batch's size, and then one new manifest that names all folders in force; nothing that a
manifest names is ever changed. Readers take the newest manifest, so a reader, a refresh or a
run that dies in between never meets half a table.

The base is sorted and cut into ranges of keys. A delta's rows know their ranges, and Bloom filters of the
ranges' keys tell which of them may hold an older row: reading joins only these with the deltas and
takes all others as they are; folding rewrites only ranges that deltas fell into, and cuts those that have grown.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from datetime import date, datetime, timedelta, timezone
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.dedupe import latest_rows
from tidemark.operators.ranges import FEW_BOUNDS, RANGE, assign_ranges, bitmaps_needed, bloom_filters, compare_ranges, cut_ranges, may_hold
from tidemark.session import dropped_checkpoints, freed_shuffles, read_marker, storage_path

# Deltas are folded into the base beyond this number, or this part of the base's rows.
MOST_DELTAS = 16
DELTA_PART = 0.25
# Rows a key range aims at; one with twice as many is cut.
ROWS_PER_RANGE = 4_000_000
# Keys whose places in a Bloom filter one task sorts.
FILTERED_PER_TASK = 500_000
# Versions whose folders stay for readers that have already resolved them, and the least age of what is deleted:
# no reader or writer may take longer.
KEPT_VERSIONS = 2
LEAST_AGE = timedelta(hours=6)
# A manifest that cannot be read is another writer's that is being written; beyond this age, one that died.
WRITING = timedelta(minutes=10)
_MANIFEST = "manifest-"
_SEQUENCE = "_delta"


def high_water(target: DataFrame | None, column: str):
    """Largest value already loaded; None for a missing or an empty target."""
    if target is None:
        return None
    return target.agg(F.max(column)).first()[0]


def newer_rows(source: DataFrame, column: str, mark, lookback: timedelta | None = None) -> DataFrame:
    """Rows strictly above the mark; all rows when there is no mark yet.

    The mark is a literal, so the filter reaches the file scan and skips row
    groups.  With an event-time column, rows that arrive late are lost by design;
    ``lookback`` re-reads that much before the mark.
    """
    if mark is None:
        return source
    if lookback is not None:
        mark = mark - lookback
    value = F.lit(mark).cast(source.schema[column].dataType)
    return source.where(F.col(column) > value)


def merge_rows(
    target: DataFrame, batch: DataFrame, key: str | Sequence[str], newer_by: str | None = None
) -> DataFrame:
    """Target with matched keys replaced by the batch row and the others added.

    A NULL key matches nothing.  With ``newer_by`` a batch row only replaces a
    target row that is not newer in that column; a NULL there never replaces a
    value.  The batch must hold a key once.
    """
    keys = [key] if isinstance(key, str) else list(key)
    if newer_by is not None:
        held = target.select(*keys, F.col(newer_by).alias("_held"))
        older = F.coalesce(F.col(newer_by) < F.col("_held"), F.col(newer_by).isNull() & F.col("_held").isNotNull())
        batch = batch.join(held, keys, "left").where(~older).select(*batch.columns)
    kept = target.join(batch.select(*keys), keys, "left_anti")
    return kept.unionByName(batch)


def _manifests(spark: SparkSession, path: str) -> list[int]:
    fs, folder = storage_path(spark, path)
    if not fs.exists(folder):
        return []
    names = [status.getPath().getName() for status in fs.listStatus(folder)]
    return sorted(int(n[len(_MANIFEST) : -len(".json")]) for n in names if n.startswith(_MANIFEST) and n.endswith(".json"))


def _manifest_path(path: str, version: int) -> str:
    return f"{path}/{_MANIFEST}{version:012d}.json"


def _parsed(text: str) -> dict | None:
    try:
        return json.loads(text)
    except json.JSONDecodeError:
        return None


def manifest(spark: SparkSession, path: str) -> dict | None:
    """The newest complete version: schema, keys, version column, ranges and deltas in force, and marks."""
    for version in reversed(_manifests(spark, path)):
        content = _parsed(read_marker(spark, _manifest_path(path, version)))
        if content is not None:
            return content
    return None


def _age(status) -> timedelta:
    return datetime.now() - datetime.fromtimestamp(status.getModificationTime() / 1000)


def next_version(spark: SparkSession, path: str, before: dict | None) -> int:
    """The version after the newest; a fresh one that cannot be read yet belongs to a writer at work."""
    versions = _manifests(spark, path)
    newest = versions[-1] if versions else 0
    if newest > (before["version"] if before else 0):
        fs, file = storage_path(spark, _manifest_path(path, newest))
        if _age(fs.getFileStatus(file)) < WRITING:
            raise RuntimeError(f"version {newest} of {path} is being published by another writer")
    return newest + 1


def publish(spark: SparkSession, path: str, content: dict) -> None:
    """One manifest, created only if no other writer has created that version; half a text is no manifest."""
    fs, final = storage_path(spark, _manifest_path(path, content["version"]))
    # Stores create a file without overwriting in one step; a local disk only by a call of its own.
    local = fs.getUri().getScheme() == "file"
    mine = not local or spark._jvm.java.io.File(final.toUri().getPath()).createNewFile()
    try:
        stream = fs.create(final, local) if mine else None
    except Py4JJavaError:
        if not fs.exists(final):
            raise
        stream = None
    if stream is None:
        raise RuntimeError(f"version {content['version']} of {path} was published by another writer")
    stream.write(bytearray(json.dumps(content), "utf-8"))
    stream.close()


def vacuum(spark: SparkSession, path: str, keep: int = KEPT_VERSIONS, least_age: timedelta = LEAST_AGE) -> None:
    """Deletes manifests before the last ``keep`` and folders that none of those names, if older than ``least_age``.

    The age keeps the folder of a writer that has not published yet, and those of readers of versions just replaced.
    """
    fs, folder = storage_path(spark, path)
    versions = _manifests(spark, path)
    kept = [_parsed(read_marker(spark, _manifest_path(path, v))) for v in versions[-keep:]]
    named = {name for content in kept if content for name in _folders(content)}
    for v in versions[:-keep]:
        file = storage_path(spark, _manifest_path(path, v))[1]
        if _age(fs.getFileStatus(file)) >= least_age:
            fs.delete(file, True)
        else:
            named.update(_folders(_parsed(read_marker(spark, _manifest_path(path, v))) or {"ranges": [], "deltas": [], "bounds": None}))
    for status in fs.listStatus(folder):
        name = status.getPath().getName()
        if status.isDirectory() and name not in named and _age(status) >= least_age:
            fs.delete(status.getPath(), True)


def _folders(content: dict) -> list[str]:
    """All folders that a version reads: bases with their filters, bounds, deltas."""
    bases = {r["folder"].split("/")[0] for r in content["ranges"]}
    filters = {_filters(base) for base in bases} if len(content["ranges"]) > 1 else set()
    bounds = {content["bounds"]} - {None}
    return sorted(bases | filters | bounds | {d["name"] for d in content["deltas"]})


def _filters(base: str) -> str:
    return base.replace("base-", "bloom-")


def _bytes(spark: SparkSession, path: str) -> int:
    fs, folder = storage_path(spark, path)
    return fs.getContentSummary(folder).getLength()


def _schema(content: dict) -> T.StructType:
    return T.StructType.fromJson(content["schema"])


def _with_range(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema, T.StructField(RANGE, T.LongType())])


def _read_ranges(spark: SparkSession, path: str, content: dict, positions: Sequence[int]) -> DataFrame | None:
    folders = [f"{path}/{content['ranges'][k]['folder']}" for k in positions]
    return spark.read.schema(_schema(content)).parquet(*folders) if folders else None


def _newest(spark: SparkSession, path: str, content: dict) -> DataFrame:
    """The newest delta row per key, with its range."""
    reader = spark.read.schema(_with_range(_schema(content)))
    deltas = [reader.parquet(f"{path}/{d['name']}").withColumn(_SEQUENCE, F.lit(k)) for k, d in enumerate(content["deltas"])]
    order = [F.desc(_SEQUENCE)]
    if content["newer_by"]:
        order.insert(0, F.desc_nulls_last(content["newer_by"]))
    return latest_rows(reduce(DataFrame.unionByName, deltas), content["keys"], order).drop(_SEQUENCE)


def touched_ranges(content: dict) -> tuple[list[int], list[int]]:
    """Ranges that may hold an older row of a delta's key, and those that delta rows fell into."""
    hit = sorted({k for d in content["deltas"] for k in d["hit"]})
    fell = sorted({int(k) for d in content["deltas"] for k in d["rows"]})
    return hit, fell


def _folded(spark: SparkSession, path: str, content: dict) -> DataFrame:
    every = range(len(content["ranges"]))
    if not content["deltas"]:
        return _read_ranges(spark, path, content, every)
    hit, _ = touched_ranges(content)
    newest = _newest(spark, path, content).drop(RANGE)
    held = _read_ranges(spark, path, content, hit)
    clean = _read_ranges(spark, path, content, [k for k in every if k not in set(hit)])
    merged = newest if held is None else merge_rows(held, newest, content["keys"], content["newer_by"])
    return merged if clean is None else clean.unionByName(merged)


def read_target(spark: SparkSession, path: str) -> DataFrame | None:
    """The table as last published; None before the first load."""
    content = manifest(spark, path)
    return None if content is None else _folded(spark, path, content)


def conform(batch: DataFrame, schema: T.StructType) -> DataFrame:
    """The batch under the table's schema: the same columns, cast as an INSERT would.

    A column too many or too few is refused, so is a type of another family; a number beyond the stored
    type's range fails the load instead of being stored wrong.
    """
    extra, absent = set(batch.columns) - set(schema.names), set(schema.names) - set(batch.columns)
    if extra or absent:
        raise ValueError(f"the batch has other columns than the table: {sorted(extra)} too many, {sorted(absent)} missing")

    def family(kind: T.DataType) -> object:
        if isinstance(kind, T.NumericType):
            return T.NumericType
        if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            return T.DateType
        return kind

    for field in schema:
        given = batch.schema[field.name].dataType
        if not isinstance(given, T.NullType) and family(given) != family(field.dataType):
            raise ValueError(f"column {field.name} is {given.simpleString()}, the table holds {field.dataType.simpleString()}")
    # Checked casts, whatever the session's setting for overflow.
    def stored(field: T.StructField) -> Column:
        value, cast = F.col(f"`{field.name}`"), F.col(f"`{field.name}`").try_cast(field.dataType)
        if batch.schema[field.name].dataType == field.dataType:
            return value
        wrong = value.isNotNull() & cast.isNull()
        return F.when(wrong, F.raise_error(F.lit(f"a value of {field.name} does not fit the table"))).otherwise(cast).alias(field.name)

    return batch.select(*(stored(f) for f in schema))


def encode_mark(value, kind: T.DataType | None = None) -> list | None:
    """A mark for the manifest; its kind tells how to read it. An instant is kept as such, whatever the driver's zone."""
    if value is not None and isinstance(kind, T.TimestampType):
        value = value.astimezone(timezone.utc)
    if value is None:
        return None
    return ["datetime", value.isoformat()] if isinstance(value, datetime) else ["date", value.isoformat()] if isinstance(value, date) else ["plain", value]


def decode_mark(mark: list | None):
    if mark is None:
        return None
    kind, value = mark
    return {"datetime": datetime.fromisoformat, "date": date.fromisoformat}.get(kind, lambda v: v)(value)


def _marks(added: DataFrame, columns: Sequence[str], before: dict) -> dict:
    """Marks after rows were added: their largest values come from these rows alone."""
    if not columns:
        return before
    found, schema = added.agg(*(F.max(c).alias(c) for c in columns)).first(), added.schema
    out = dict(before)
    for c in columns:
        new = found[c]
        if new is not None and isinstance(schema[c].dataType, T.TimestampType):
            new = new.astimezone(timezone.utc)  # an instant, whatever the driver's zone
        values = [v for v in (new, decode_mark(before.get(c))) if v is not None]
        out[c] = encode_mark(max(values)) if values else None
    return out


def _write_base(spark: SparkSession, path: str, content: dict, rows: DataFrame, sizes: dict[int, int]) -> dict:
    """Writes ranges anew and returns the content that names them; ``rows`` hold ``_key_range``.

    ``sizes`` bounds their rows from above: ranges beyond twice the aim are cut. Bounds are written again only if
    ranges were cut, filters for the new folder alone.
    """
    keys, aim = content["keys"], content["rows_per_range"]
    pieces = {k: -(-n // aim) for k, n in sizes.items() if n > 2 * aim}
    name = f"base-{uuid.uuid4().hex}"
    most = max([1, *pieces.values()])
    if not pieces and len(content["ranges"]) == 1:
        # A single range has no order to keep: its rows are written by the tasks that have them.
        rows.drop(RANGE).write.parquet(f"{path}/{name}/{RANGE}=0")
    else:
        with dropped_checkpoints(spark):
            cut = cut_ranges(rows, keys, pieces, aim, sum(sizes.values()))
            # Left as it is where no range is cut: rows are then known to be sorted by it, and not sorted again.
            placed = cut.withColumn(RANGE, F.col(RANGE) * most + F.col("_piece")) if pieces else cut
            placed.drop("_piece").write.partitionBy(RANGE).parquet(f"{path}/{name}")
    # Types by schema: folder names alone would decide them.
    written = spark.read.schema(_with_range(_schema(content))).parquet(f"{path}/{name}")
    found = {r[RANGE]: r["n"] for r in written.groupBy(RANGE).agg(F.count("*").alias("n")).collect()}
    ranges, places = [], []
    for position in range(max([len(content["ranges"]), *(k + 1 for k in sizes)])):
        if position not in sizes:
            ranges.append(content["ranges"][position])
            places.append((position, 0, len(ranges) - 1))
            continue
        parts = [p for p in range(pieces.get(position, 1)) if position * most + p in found] or [0]
        for p in parts:
            key = position * most + p
            if key in found:
                entry = {"folder": f"{name}/{RANGE}={key}", "rows": found[key], "bitmaps": bitmaps_needed(found[key])}
            else:  # an empty range keeps its folder, so that it can be read
                entry = {"folder": f"{name}/{RANGE}={key}", "rows": 0, "bitmaps": 1}
                spark.createDataFrame([], _schema(content)).write.parquet(f"{path}/{entry['folder']}")
            places.append((position, p, len(ranges)))
            ranges.append(entry)
    after = {**content, "ranges": ranges}
    if len(ranges) > len(content["ranges"]) and len(ranges) > 1:
        moved = spark.createDataFrame(places, "_old bigint, _piece bigint, position bigint")
        lows = written.groupBy(RANGE).agg(F.min(F.struct(*keys)).alias("_low")).select(
            F.floor(F.col(RANGE) / most).alias("_old"), (F.col(RANGE) % most).alias("_piece"), "_low.*"
        )
        bounds = lows.where("_piece > 0")
        if content["bounds"]:
            bounds = bounds.unionByName(_bounds(spark, path, content).select(F.col("position").alias("_old"), F.lit(0).cast("bigint").alias("_piece"), *keys))
        after["bounds"] = f"bounds-{uuid.uuid4().hex}"
        bounds.join(moved, ["_old", "_piece"]).select("position", *keys).coalesce(1).write.parquet(f"{path}/{after['bounds']}")
    if len(ranges) > 1:
        needed = [(int(e["folder"].split("=")[1]), e["bitmaps"]) for e in ranges if e["folder"].startswith(name)]
        # Dealt in key order, so that a task has few ranges' bitmaps and a bounded number of places; one row per range is broadcast.
        dealt = written.select(RANGE, *keys).repartitionByRange(-(-max(1, sum(found.values())) // FILTERED_PER_TASK), RANGE, *keys)
        sized = dealt.join(F.broadcast(spark.createDataFrame(needed, f"{RANGE} bigint, bitmaps bigint")), RANGE)
        made = bloom_filters(sized, keys, RANGE, "bitmaps")
        folder = F.concat(F.lit(f"{name}/{RANGE}="), F.col(RANGE).cast("string"))
        made.select(folder.alias("folder"), "bitmap", "bits").write.parquet(f"{path}/{_filters(name)}")
    return after


def _base_rows(content: dict) -> int:
    return sum(r["rows"] for r in content["ranges"])


def _bounds(spark: SparkSession, path: str, content: dict) -> DataFrame | None:
    if not content["bounds"]:
        return None
    schema = T.StructType([T.StructField("position", T.LongType()), *(_schema(content)[k] for k in content["keys"])])
    return spark.read.schema(schema).parquet(f"{path}/{content['bounds']}")


def _write_delta(spark: SparkSession, path: str, content: dict, batch: DataFrame) -> dict | None:
    """Writes a batch as a delta whose rows know their ranges; None if it is empty."""
    name, keys, schema = f"delta-{uuid.uuid4().hex}", content["keys"], _schema(content)
    draft = f"{path}/{name}"
    many = len(content["ranges"]) > 1
    ordered = len(content["ranges"]) > FEW_BOUNDS + 1
    if many and not ordered:
        compare_ranges(batch, keys, _bounds(spark, path, content)).write.parquet(f"{path}/{name}")
    elif many:
        draft = f"{path}/draft-{uuid.uuid4().hex}"
        batch.write.parquet(draft)
        stored = spark.read.schema(schema).parquet(draft)
        with dropped_checkpoints(spark):
            assigned = assign_ranges(stored, keys, _bounds(spark, path, content), stored.count() + len(content["ranges"]))
            assigned.write.parquet(f"{path}/{name}")
    else:
        batch.withColumn(RANGE, F.lit(0).cast("bigint")).write.parquet(draft)
    delta = spark.read.schema(_with_range(schema)).parquet(f"{path}/{name}")
    rows = {r[RANGE]: r["n"] for r in delta.groupBy(RANGE).agg(F.count("*").alias("n")).collect()}
    hit = sorted(rows)
    fs, _ = storage_path(spark, path)
    if ordered:
        fs.delete(storage_path(spark, draft)[1], True)
    # A delta that is folded at once is not probed: all ranges that it fell into count as hit.
    if many and sum(rows.values()) <= DELTA_PART * _base_rows(content):
        entries = [(k, content["ranges"][k]["folder"], content["ranges"][k]["bitmaps"]) for k in rows]
        if entries:
            known = delta.select(RANGE, *keys).join(spark.createDataFrame(entries, f"{RANGE} bigint, folder string, bitmaps bigint"), RANGE)
            bases = sorted({folder.split("/")[0] for _, folder, _ in entries})
            filters = spark.read.schema("folder string, bitmap bigint, bits binary").parquet(*(f"{path}/{_filters(b)}" for b in bases))
            wanted = {folder: k for k, folder, _ in entries}
            hit = sorted(wanted[r["folder"]] for r in may_hold(known, keys, filters, "folder", "bitmaps").collect())
    if not rows:
        fs.delete(storage_path(spark, f"{path}/{name}")[1], True)
        return None
    return {"name": name, "rows": {str(k): n for k, n in sorted(rows.items())}, "hit": hit}


def upsert(
    path: str,
    batch: DataFrame,
    key: str | Sequence[str],
    newer_by: str | None = None,
    full_refresh: bool = False,
    marks: Sequence[str] = (),
    rows_per_range: int | None = None,
) -> None:
    """Insert or replace rows by key in the table at ``path``.

    Rows with a NULL in their key are left out: they could match nothing, and a replayed batch would add
    them again.  Keys, schema, ``newer_by`` and ``rows_per_range`` are fixed by the first load; a batch that does not
    fit is refused before anything is written.  What is written is the batch, plus now and then the
    ranges it fell into; what is read is the batch, bounds and filters.  The same batch twice changes nothing.
    ``marks`` names columns whose largest loaded value the manifest keeps. A load's shuffle files go with each step.
    """
    with freed_shuffles(batch.sparkSession):
        _upsert(path, batch, key, newer_by, full_refresh, marks, rows_per_range)


def _upsert(
    path: str, batch: DataFrame, key: str | Sequence[str], newer_by: str | None, full_refresh: bool, marks: Sequence[str], rows_per_range: int | None
) -> None:
    spark = batch.sparkSession
    keys = [key] if isinstance(key, str) else list(key)
    before = manifest(spark, path)
    version = next_version(spark, path, before)
    if before is not None and not full_refresh:
        if before["keys"] != keys or before["newer_by"] != newer_by:
            raise ValueError(f"the table is keyed by {before['keys']} and newer by {before['newer_by']}")
        batch = conform(batch, _schema(before))
    batch = batch.dropna(subset=keys)
    if before is None or full_refresh:
        content = {
            "version": version, "schema": batch.schema.jsonValue(), "keys": keys, "newer_by": newer_by, "ranges": [], "bounds": None, "deltas": [],
            "rows_per_range": rows_per_range or ROWS_PER_RANGE, "marks": {},
        }
        # Written once as it comes: it may be dear to compute, and only then its rows are known.
        base = f"base-{uuid.uuid4().hex}"
        first = f"{base}/{RANGE}=0"
        batch.write.parquet(f"{path}/{first}")
        stored = spark.read.schema(batch.schema).parquet(f"{path}/{first}")
        rows = stored.count()
        if rows > 2 * content["rows_per_range"]:
            content = _write_base(spark, path, content, stored.withColumn(RANGE, F.lit(0).cast("bigint")), {0: rows})
            content["marks"] = _marks(stored, marks, {})
            fs, folder = storage_path(spark, f"{path}/{base}")
            fs.delete(folder, True)
        else:
            content["ranges"] = [{"folder": first, "rows": rows, "bitmaps": 1}]
            content["marks"] = _marks(stored, marks, {})
    else:
        delta = _write_delta(spark, path, before, batch)
        if delta is None:
            return
        content = {**before, "version": version, "deltas": [*before["deltas"], delta]}
        content["marks"] = _marks(spark.read.schema(_schema(before)).parquet(f"{path}/{delta['name']}"), marks, before["marks"])
    publish(spark, path, content)
    grown = sum(n for d in content["deltas"] for n in d["rows"].values())
    if len(content["deltas"]) > MOST_DELTAS or grown > DELTA_PART * _base_rows(content):
        compact(spark, path)


def compact(spark: SparkSession, path: str) -> None:
    """Folds the deltas into the ranges they fell into; rows stay the same, so do all other ranges' files."""
    with freed_shuffles(spark):
        _fold(spark, path)


def _fold(spark: SparkSession, path: str) -> None:
    content = manifest(spark, path)
    if not content or not content["deltas"]:
        return
    _, fell = touched_ranges(content)
    newest = _newest(spark, path, content)
    held = [_read_ranges(spark, path, content, [k]).withColumn(RANGE, F.lit(k).cast("bigint")) for k in fell]
    if len(fell) > 1:
        # All at once; a row's range is the folder it lies in.
        entries = [(k, content["ranges"][k]["folder"]) for k in fell]
        folder = F.regexp_extract("_metadata.file_path", rf"/(base-[0-9a-f]+/{RANGE}=[0-9]+)/[^/]*$", 1)
        placed = _read_ranges(spark, path, content, fell).withColumn("_folder", folder)
        held = [placed.join(F.broadcast(spark.createDataFrame(entries, f"{RANGE} bigint, _folder string")), "_folder").drop("_folder")]
    merged = merge_rows(held[0], newest.select(*held[0].columns), content["keys"], content["newer_by"])
    sizes = {k: content["ranges"][k]["rows"] + sum(d["rows"].get(str(k), 0) for d in content["deltas"]) for k in fell}
    after = _write_base(spark, path, content, merged, sizes)
    publish(spark, path, {**after, "version": next_version(spark, path, content), "deltas": []})
    vacuum(spark, path)


def loaded_mark(spark: SparkSession, path: str, column: str):
    """Largest loaded value of the column, from the manifest; None before the first load.

    Only a table that was loaded without this mark is scanned for it.
    """
    content = manifest(spark, path)
    if content is None:
        return None
    if column in content["marks"]:
        return decode_mark(content["marks"][column])
    return high_water(_folded(spark, path, content), column)


def load_increment(
    path: str,
    source: DataFrame,
    key: str | Sequence[str],
    mark_column: str,
    order: Sequence[Column],
    lookback: timedelta | None = None,
    newer_by: str | None = None,
    full_refresh: bool = False,
    rows_per_range: int | None = None,
) -> None:
    """One incremental run: rows above the mark, newest per key, upserted.

    The first run, a full refresh and an empty target load everything.  The mark comes from the manifest, so a run
    does not scan the table; rows without a complete key are left out before the newest are taken.
    """
    keys = [key] if isinstance(key, str) else list(key)
    mark = None if full_refresh else loaded_mark(source.sparkSession, path, mark_column)
    rows = newer_rows(source, mark_column, mark, lookback).dropna(subset=keys)
    upsert(path, latest_rows(rows, keys, order), keys, newer_by, full_refresh, [mark_column], rows_per_range)
