from __future__ import annotations

import time
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from conftest import plan, rows
from pyspark.sql import functions as F

from tidemark.operators import incremental as inc
from tidemark.operators import ranges
from tidemark.session import cut_lineage, dropped_checkpoints, freed_shuffles, path_exists, scratch_path, shared_folder
from tidemark.sources.readers import Sources, query, read_landing, sample_rows
from tidemark.streaming.upsert import stream_upsert

DDL = "key int, event int, ingest int"
FIRST = [(1, 5, 90), (2, 10, 100)]
BATCH = [(2, 11, 101), (3, 9, 102), (4, 12, 103), (4, 12, 104)]


def table(spark, data, ddl=DDL):
    return spark.createDataFrame(data, ddl)


@pytest.fixture
def path(spark):
    return scratch_path(spark, "target")


def load(spark, path, data, mark, **options):
    inc.load_increment(path, table(spark, data), "key", mark, [F.desc("event"), F.desc("ingest")], **options)
    return sorted(rows(inc.read_target(spark, path)))


@pytest.mark.parametrize(
    "mark, expected",
    [
        ("ingest", [(1, 5, 90), (2, 11, 101), (3, 9, 102), (4, 12, 104)]),
        # The late key 3 is lost on event time.
        ("event", [(1, 5, 90), (2, 11, 101), (4, 12, 104)]),
    ],
)
def test_marks(spark, path, mark, expected):
    load(spark, path, FIRST, mark)
    assert load(spark, path, FIRST + BATCH, mark) == expected
    assert load(spark, path, FIRST + BATCH, mark) == expected


def test_empty_target_loads_all(spark, path):
    assert load(spark, path, [], "ingest") == []
    assert load(spark, path, FIRST, "ingest") == FIRST


def test_full_refresh(spark, path):
    load(spark, path, FIRST, "ingest")
    assert load(spark, path, BATCH[:1], "ingest", full_refresh=True) == [(2, 11, 101)]


def test_lookback(spark):
    df = spark.createDataFrame([(datetime(2024, 1, d),) for d in (1, 2, 3)], "at timestamp_ntz")
    mark = datetime(2024, 1, 2)
    assert inc.newer_rows(df, "at", mark).count() == 1
    assert inc.newer_rows(df, "at", mark, timedelta(hours=1)).count() == 2
    assert inc.newer_rows(df, "at", None).count() == 3


def test_mark_reaches_the_scan(spark, path):
    spark.range(100).write.parquet(path)
    text = plan(inc.newer_rows(spark.read.parquet(path), "id", 42))
    assert "GreaterThan(id,42)" in text


def wide_rows(spark, n):
    return spark.range(n).selectExpr("CAST(id AS INT) AS key", "1 AS event", "1 AS ingest", "sha2(CAST(id AS STRING), 256) AS payload")


def test_a_small_batch_writes_little(spark, path):
    """A thousandth of the keys, spread over all of them: bytes written follow the batch, not the table."""
    inc.upsert(path, wide_rows(spark, 100_000), "key")
    before = inc._bytes(spark, path)
    for k in range(3):
        inc.upsert(path, wide_rows(spark, 100_000).where(F.col("key") % 1000 == 7).withColumn("event", F.lit(2 + k)), "key")
    assert inc._bytes(spark, path) - before < 0.05 * before
    got = inc.read_target(spark, path)
    assert got.count() == 100_000 and got.where("event = 4").count() == 100
    assert rows(got.where("key = 1007").select("event")) == [(4,)]


def test_deltas_are_folded_and_old_folders_go(spark, path):
    inc.upsert(path, table(spark, [(k, 0, 0) for k in range(10)]), "key")
    for k in range(2 * inc.MOST_DELTAS):
        inc.upsert(path, table(spark, [(k % 12, k, k)]), "key")
    content = inc.manifest(spark, path)
    assert len(content["deltas"]) <= inc.MOST_DELTAS
    assert inc.read_target(spark, path).count() == 12
    inc.compact(spark, path)
    inc.vacuum(spark, path, keep=1, least_age=timedelta(0))
    fs, folder = inc.storage_path(spark, path)
    assert sorted(s.getPath().getName() for s in fs.listStatus(folder) if s.isDirectory()) == inc._folders(inc.manifest(spark, path))


def ranged(spark, path, n=20_000, **options):
    inc.upsert(path, wide_rows(spark, n), "key", rows_per_range=1000, **options)
    return inc.manifest(spark, path)


def test_a_read_joins_only_touched_ranges(spark, path):
    """A thousandth of the keys, all near one another: one or two of twenty ranges are joined, the others are read as they are."""
    first = ranged(spark, path)
    assert 15 <= len(first["ranges"]) <= 25 and sum(r["rows"] for r in first["ranges"]) == 20_000
    change = wide_rows(spark, 20_000).where("key BETWEEN 7000 AND 7019").withColumn("event", F.lit(9))
    inc.upsert(path, change, "key")
    content = inc.manifest(spark, path)
    hit, fell = inc.touched_ranges(content)
    assert 1 <= len(hit) <= 2 and hit == fell
    joined = inc._read_ranges(spark, path, content, hit)
    assert len(joined.inputFiles()) <= 4 < len(inc._read_ranges(spark, path, content, range(len(content["ranges"]))).inputFiles())
    assert joined.count() <= 2 * 2000
    got = inc.read_target(spark, path)
    assert got.count() == 20_000 and rows(got.where("event = 9").selectExpr("min(key)", "max(key)", "count(*)")) == [(7000, 7019, 20)]


def test_new_keys_touch_no_range(spark, path):
    """Keys between the others: the filters know that no range holds them, so nothing is joined."""
    inc.upsert(path, wide_rows(spark, 20_000).withColumn("key", F.col("key") * 2), "key", rows_per_range=1000)
    added = wide_rows(spark, 20_000).where("key % 4000 = 1").withColumn("key", F.col("key") * 2 + 1).withColumn("event", F.lit(9))
    inc.upsert(path, added, "key")
    hit, fell = inc.touched_ranges(inc.manifest(spark, path))
    assert len(fell) == 5 and len(hit) <= 2
    got = inc.read_target(spark, path)
    assert got.count() == 20_005 and got.where("event = 9 AND key % 2 = 1").count() == 5


def test_folding_rewrites_only_touched_ranges(spark, path):
    first = ranged(spark, path)
    inc.upsert(path, wide_rows(spark, 20_000).where("key IN (3, 19990)").withColumn("event", F.lit(9)), "key")
    inc.compact(spark, path)
    after = inc.manifest(spark, path)
    same = {r["folder"] for r in first["ranges"]} & {r["folder"] for r in after["ranges"]}
    assert len(after["ranges"]) == len(first["ranges"]) and len(same) == len(first["ranges"]) - 2 and not after["deltas"]
    # Every range still holds its own keys, sorted from its bound on.
    lows = [r["key"] for r in inc._bounds(spark, path, after).orderBy("position").collect()]
    for k, (low, high) in enumerate(zip([-1, *lows], [*lows, 10**9])):
        got = inc._read_ranges(spark, path, after, [k]).agg(F.min("key"), F.max("key")).first()
        assert low <= got[0] and got[1] < high
    assert rows(inc.read_target(spark, path).where("event = 9").select("key").orderBy("key")) == [(3,), (19990,)]


def test_a_range_that_grows_is_cut(spark, path, monkeypatch):
    """Rising keys: only the last range grows and is cut, all others keep their files; random later changes still match."""
    monkeypatch.setattr(inc, "MOST_DELTAS", 2)
    first = ranged(spark, path, 5000)
    for k in range(5, 9):
        inc.upsert(path, wide_rows(spark, 1000 * (k + 1)).where(F.col("key") >= 1000 * k), "key")
    inc.compact(spark, path)
    after = inc.manifest(spark, path)
    assert len(after["ranges"]) > len(first["ranges"]) and max(r["rows"] for r in after["ranges"]) <= 2000
    assert [r["folder"] for r in after["ranges"]][: len(first["ranges"]) - 1] == [r["folder"] for r in first["ranges"]][:-1]
    inc.upsert(path, wide_rows(spark, 9000).where("key % 977 = 5").withColumn("event", F.lit(9)), "key")
    got = inc.read_target(spark, path)
    assert got.count() == got.select("key").distinct().count() == 9000 and got.where("event = 9").count() == 10


def test_ranges_of_composite_text_keys_equal_a_plain_merge(spark, path):
    """Many random batches with repeats, older rows and new keys against merges of whole tables."""
    ddl = "a string, b int, event int, v int"
    def batch(seed, n):
        r = F.xxhash64("id", F.lit(seed))
        return spark.range(n).select(F.concat(F.lit("k"), (F.pmod(r, F.lit(40))).cast("string")).alias("a"), F.pmod(F.shiftright(r, 9), F.lit(60)).cast("int").alias("b"), F.pmod(F.shiftright(r, 20), F.lit(50)).cast("int").alias("event"), F.lit(seed).alias("v")).dropDuplicates(["a", "b"])
    want = None
    for seed, n in enumerate((1500, 30, 200, 1)):
        new = spark.createDataFrame(rows(batch(seed, n)), ddl)
        inc.upsert(path, new, ["a", "b"], newer_by="event", rows_per_range=100)
        want = new if want is None else spark.createDataFrame(rows(inc.merge_rows(want, new, ["a", "b"], "event")), ddl)
        assert sorted(rows(inc.read_target(spark, path))) == sorted(rows(want))
        if seed == 1:
            inc.compact(spark, path)
            assert sorted(rows(inc.read_target(spark, path))) == sorted(rows(want))
    assert len(inc.manifest(spark, path)["ranges"]) > 5


def test_of_two_writers_one_publishes(spark, path):
    inc.upsert(path, table(spark, FIRST), "key")
    content = {**inc.manifest(spark, path), "version": 2}
    outcomes = []
    def publish(k):
        try:
            inc.publish(spark, path, {**content, "marks": {"writer": ["plain", k]}})
            outcomes.append(k)
        except RuntimeError:
            pass
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(publish, range(4)))
    assert len(outcomes) == 1 and inc.manifest(spark, path)["marks"]["writer"] == ["plain", outcomes[0]]


def test_half_a_manifest_is_none(spark, path):
    """A writer at work is left alone; one that died is passed over."""
    inc.upsert(path, table(spark, FIRST), "key")
    fs, file = inc.storage_path(spark, inc._manifest_path(path, 2))
    stream = fs.create(file, False)
    stream.write(bytearray(b'{"version": 2, "sch'))
    stream.close()
    assert sorted(rows(inc.read_target(spark, path))) == FIRST
    with pytest.raises(RuntimeError, match="another writer"):
        inc.upsert(path, table(spark, BATCH[:1]), "key")
    fs.setTimes(file, 0, -1)
    inc.upsert(path, table(spark, BATCH[:1]), "key")
    assert inc.manifest(spark, path)["version"] >= 3 and inc.read_target(spark, path).count() == 2


def test_young_folders_stay(spark, path):
    inc.upsert(path, table(spark, FIRST), "key")
    spark.range(3).write.parquet(f"{path}/delta-unpublished")
    inc.upsert(path, table(spark, BATCH[:2]), "key", full_refresh=True)
    inc.vacuum(spark, path, keep=1)
    assert path_exists(spark, f"{path}/delta-unpublished")
    inc.vacuum(spark, path, keep=1, least_age=timedelta(0))
    assert not path_exists(spark, f"{path}/delta-unpublished")


def test_null_keys_are_left_out_and_a_replay_adds_nothing(spark, path):
    batch = table(spark, [(None, 1, 1), (None, 2, 2), (1, 1, 1)])
    for _ in range(3):
        inc.upsert(path, batch, "key")
        assert rows(inc.read_target(spark, path)) == [(1, 1, 1)]
    assert load(spark, path + "-2", [(None, 1, 1)] * 10 + [(5, 1, 1)], "ingest") == [(5, 1, 1)]


@pytest.mark.parametrize(
    "ddl, data, error",
    [
        ("key int, event int, ingest int, w int", [(1, 1, 1, 1)], "too many"),
        ("key int, event int", [(1, 1)], "missing"),
        ("key int, event string, ingest int", [(1, "x", 1)], "event is string"),
        ("key int, event int, ingest bigint", [(1, 1, 2**40)], "does not fit"),
    ],
)
def test_a_batch_that_does_not_fit_is_refused(spark, path, ddl, data, error):
    inc.upsert(path, table(spark, FIRST), "key")
    with pytest.raises(Exception, match=error):
        inc.upsert(path, table(spark, data, ddl), "key")
    assert sorted(rows(inc.read_target(spark, path))) == FIRST


def test_wider_types_are_stored_as_the_table_holds_them(spark, path):
    inc.upsert(path, table(spark, [(k, 0, 0) for k in range(50)]), "key")
    inc.upsert(path, table(spark, [(k, 1, 1) for k in range(5)], "key bigint, event bigint, ingest int"), "key")
    got = inc.read_target(spark, path)
    assert got.dtypes == [("key", "int"), ("event", "int"), ("ingest", "int")]
    assert got.count() == 50 and got.where("event = 1").count() == 5


def test_other_keys_are_refused(spark, path):
    inc.upsert(path, table(spark, FIRST), "key")
    with pytest.raises(ValueError, match="keyed by"):
        inc.upsert(path, table(spark, FIRST), ["key", "event"])
    with pytest.raises(ValueError, match="newer by"):
        inc.upsert(path, table(spark, FIRST), "key", newer_by="event")


def test_newer_by_over_many_deltas(spark, path):
    inc.upsert(path, table(spark, [(1, 5, 0), (2, 5, 0), (3, None, 0)]), "key", newer_by="event")
    for batch in ([(1, 4, 1), (2, 6, 1), (3, None, 1)], [(1, None, 2), (2, 5, 2), (4, 1, 2)], [(2, 6, 3), (4, None, 3)]):
        inc.upsert(path, table(spark, batch), "key", newer_by="event")
    assert sorted(rows(inc.read_target(spark, path))) == [(1, 5, 0), (2, 6, 3), (3, None, 1), (4, 1, 2)]


def test_the_mark_is_kept_and_survives_compaction(spark, path):
    load(spark, path, FIRST, "ingest")
    load(spark, path, FIRST + BATCH, "ingest")
    inc.compact(spark, path)
    assert inc.manifest(spark, path)["marks"] == {"ingest": ["plain", 104]}
    at = spark.createDataFrame([(1, datetime(2024, 1, 2, 3, 4, 5, 6))], "key int, at timestamp_ntz")
    inc.load_increment(path + "-t", at, "key", "at", [F.desc("at")])
    assert inc.decode_mark(inc.manifest(spark, path + "-t")["marks"]["at"]) == datetime(2024, 1, 2, 3, 4, 5, 6)


def test_readers_keep_their_version(spark, path):
    inc.upsert(path, table(spark, FIRST), "key")
    reader = inc.read_target(spark, path)
    inc.upsert(path, table(spark, BATCH[:2]), "key", full_refresh=True)
    assert sorted(rows(reader)) == FIRST
    assert sorted(rows(inc.read_target(spark, path))) == sorted(BATCH[:2])


def test_newer_only(spark):
    target = table(spark, [(1, 5, 0), (2, 5, 0), (3, None, 0)])
    batch = table(spark, [(1, 4, 1), (2, 5, 1), (3, 1, 1), (4, 1, 1)])
    merged = inc.merge_rows(target, batch, "key", newer_by="event")
    assert sorted(rows(merged)) == [(1, 5, 0), (2, 5, 1), (3, 1, 1), (4, 1, 1)]
    assert sorted(rows(inc.merge_rows(target, batch, "key"))) == [(1, 4, 1), (2, 5, 1), (3, 1, 1), (4, 1, 1)]


@pytest.mark.parametrize("refresh", [False, True])
def test_a_load_that_dies_changes_nothing(spark, path, monkeypatch, refresh):
    load(spark, path, FIRST, "ingest")
    with monkeypatch.context() as m:
        m.setattr(inc, "publish", lambda *_: (_ for _ in ()).throw(RuntimeError("driver lost")))
        with pytest.raises(RuntimeError):
            inc.upsert(path, table(spark, [(2, 50, 200)]), "key", full_refresh=refresh)
    assert sorted(rows(inc.read_target(spark, path))) == FIRST
    inc.upsert(path, table(spark, [(3, 1, 1)]), "key")
    assert sorted(rows(inc.read_target(spark, path))) == [*FIRST, (3, 1, 1)]


def test_a_second_writer_is_refused(spark, path):
    inc.upsert(path, table(spark, FIRST), "key")
    with pytest.raises(RuntimeError, match="another writer"):
        inc.publish(spark, path, inc.manifest(spark, path))


def test_composite_key(spark, path):
    ddl = "a int, b string, v int"
    inc.upsert(path, table(spark, [(1, "x", 1), (1, "y", 1)], ddl), ["a", "b"])
    inc.upsert(path, table(spark, [(1, "x", 2), (2, "x", 2)], ddl), ["a", "b"])
    assert sorted(rows(inc.read_target(spark, path).select("a", "b", "v"))) == [(1, "x", 2), (1, "y", 1), (2, "x", 2)]


def test_stream_equals_batch(spark, path):
    source, offsets = scratch_path(spark, "source"), scratch_path(spark, "offsets")

    def run():
        stream_upsert(spark, source, DDL, path, "key", [F.desc("event"), F.desc("ingest")], offsets).awaitTermination()
        return sorted(rows(inc.read_target(spark, path)))

    table(spark, FIRST).write.parquet(source)
    assert run() == FIRST
    table(spark, BATCH).write.mode("append").parquet(source)
    expected = [(1, 5, 90), (2, 11, 101), (3, 9, 102), (4, 12, 104)]
    assert run() == expected
    # Nothing new: the offsets are the mark.
    assert run() == expected


def test_replayed_batch_changes_nothing(spark, path):
    inc.upsert(path, table(spark, FIRST), "key")
    for _ in range(2):
        inc.upsert(path, table(spark, BATCH[:2]), "key")
    assert sorted(rows(inc.read_target(spark, path))) == [(1, 5, 90), (2, 11, 101), (3, 9, 102)]


def test_sources_and_readers(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "raw" / "t"))
    sources = Sources({"raw": str(tmp_path / "raw")}, {"raw": ("t",)})
    assert sources.read(spark, "raw", "t").count() == 3
    with pytest.raises(KeyError):
        sources.read(spark, "raw", "u")
    with pytest.raises(KeyError):
        sources.read(spark, "rare", "t")
    (tmp_path / "land").mkdir()
    (tmp_path / "land" / "a.json").write_text('{"data": "{\\"a\\": 1}", "_sdc_sequence": 5}\n')
    assert read_landing(spark, str(tmp_path / "land")).select("data", "_sdc_sequence").first() == ('{"a": 1}', 5)
    spark.range(10).createOrReplaceTempView("numbers")
    assert query(spark, "SELECT * FROM numbers WHERE id > ? AND id < ?", 3, 6).count() == 2
    assert query(spark, "SELECT * FROM numbers WHERE id = :n", n=3).count() == 1
    assert 0 < sample_rows(spark.range(1000), 0.1, seed=1).count() < 300


def test_filters_of_few_ranges_are_made_by_many_tasks(spark, path, monkeypatch):
    """A task sorts a bounded number of keys' places, however many keys a range holds."""
    seen, made = [], inc.bloom_filters

    def watched(rows, *rest):
        seen.append([r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()])
        return made(rows, *rest)

    monkeypatch.setattr(inc, "FILTERED_PER_TASK", 100)
    monkeypatch.setattr(inc, "bloom_filters", watched)
    inc.upsert(path, spark.range(2000).withColumnRenamed("id", "key"), "key", rows_per_range=500)
    assert len(inc.manifest(spark, path)["ranges"]) > 1
    assert len(seen[0]) > 10 and sum(seen[0]) == 2000 and max(seen[0]) <= 200
    assert inc.read_target(spark, path).count() == 2000


def test_a_fold_is_written_by_many_tasks(spark, path, monkeypatch):
    """However many rows a range aims at, a task sorts a bounded number of them."""
    monkeypatch.setattr(ranges, "WRITTEN_PER_TASK", 500, raising=False)
    inc.upsert(path, wide_rows(spark, 8000), "key", rows_per_range=3000)
    inc.upsert(path, wide_rows(spark, 8000).where("key % 2 = 0").withColumn("event", F.lit(9)), "key")
    content = inc.manifest(spark, path)
    assert 2 <= len(content["ranges"]) <= 4 and not content["deltas"]
    files = inc._read_ranges(spark, path, content, range(len(content["ranges"]))).groupBy(F.col("_metadata.file_path")).count()
    assert files.count() >= 16 and files.agg(F.max("count")).first()[0] <= 1000
    assert rows(inc.read_target(spark, path).groupBy("event").count(), "event") == [(1, 4000), (9, 4000)]


def test_a_single_range_is_folded_in_no_order(spark, path, monkeypatch):
    monkeypatch.setattr(inc, "cut_ranges", None)
    for k in range(3):
        inc.upsert(path, wide_rows(spark, 3000).where(f"key >= {1000 * k}").withColumn("event", F.lit(k)), "key")
    content = inc.manifest(spark, path)
    assert len(content["ranges"]) == 1 and content["ranges"][0]["rows"] == 3000 and not content["deltas"]
    assert rows(inc.read_target(spark, path).groupBy("event").count(), "event") == [(0, 1000), (1, 1000), (2, 1000)]


@pytest.mark.parametrize("few", [0, 64])
def test_large_batches_are_neither_sorted_nor_probed(spark, path, monkeypatch, few):
    """Few bounds are compared with each row, many are put in order with the rows; what is folded at once needs no filters."""
    called = []
    for name in ("may_hold", "assign_ranges"):
        monkeypatch.setattr(inc, name, lambda *args, name=name, real=getattr(inc, name): called.append(name) or real(*args))
    monkeypatch.setattr(inc, "FEW_BOUNDS", few, raising=False)
    ddl = "a string, b int, event int"
    first = spark.range(3000).selectExpr("CONCAT('k', id % 40) AS a", "CAST(id AS INT) AS b", "0 AS event")
    inc.upsert(path, first, ["a", "b"], rows_per_range=200)
    batch = spark.createDataFrame(rows(first.where("b % 2 = 0").withColumn("event", F.lit(1))) + [("", -1, 1), ("z", 1, 1)], ddl)
    inc.upsert(path, batch, ["a", "b"])
    assert called == (["assign_ranges"] if few == 0 else [])
    content = inc.manifest(spark, path)
    assert not content["deltas"] and len(content["ranges"]) > 5
    lows = [tuple(r) for r in inc._bounds(spark, path, content).orderBy("position").select("a", "b").collect()]
    for k, (low, high) in enumerate(zip([("", -9), *lows], [*lows, ("~", 0)])):
        assert all(low <= (r["a"], r["b"]) < high for r in inc._read_ranges(spark, path, content, [k]).collect())
    assert rows(inc.read_target(spark, path).groupBy("event").count(), "event") == [(0, 1500), (1, 1502)]


def test_loads_leave_no_shuffle_files_and_no_checkpoints(spark, path):
    """A first load that is cut into ranges, a batch that is ordered with many bounds, and a fold that cuts ranges again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    folder, checkpoints, chosen = Path(spark.conf.get("spark.local.dir", "/tmp")), Path(shared_folder(spark).removeprefix("file:")), spark.conf.get(key)
    shuffled = lambda: set(folder.glob("blockmgr-*/*/shuffle_*.data"))
    kept = lambda: set(checkpoints.glob("rdd-*")) | set(checkpoints.glob("*/rdd-*"))
    batches = [wide_rows(spark, 20_000).where(c).repartition(3) for c in ("key % 2 = 0", "key % 100 = 1", "true")]
    before, checkpointed = shuffled(), kept()
    wide_rows(spark, 100).repartition(3).write.format("noop").mode("overwrite").save()
    stay = shuffled() - before
    if not stay:
        pytest.skip("shuffle files of this session are not to be seen")
    for batch in batches:
        inc.upsert(path, batch, "key", rows_per_range=100)
    assert len(inc.manifest(spark, path)["ranges"]) > ranges.FEW_BOUNDS + 1 and not inc.manifest(spark, path)["deltas"]
    for _ in range(50):
        if not (left := shuffled() - before - stay):
            break
        time.sleep(0.1)
    assert not left and kept() <= checkpointed and spark.conf.get(key) == chosen
    assert inc.read_target(spark, path).count() == 20_000


def test_blocks_that_free_files_may_nest_and_run_at_once(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    chosen = spark.conf.get(key)

    def nested(k):
        with freed_shuffles(spark), dropped_checkpoints(spark):
            with dropped_checkpoints(spark):
                inner = cut_lineage(spark.range(k + 1)).count()
            outer = cut_lineage(spark.range(10))
            with freed_shuffles(spark):
                time.sleep(0.05 * (k % 3))
            assert spark.conf.get(key) == "true" and outer.count() == 10
            return inner

    with ThreadPoolExecutor(4) as pool:
        assert list(pool.map(nested, range(8))) == list(range(1, 9))
    assert spark.conf.get(key) == chosen
