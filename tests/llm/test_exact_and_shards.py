"""Exact dedup and sharding against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest
from cases import awkward, frame, row
from compare import assert_same
from pyspark.sql import functions as F

from lumenframe.llm import exact_dedup, queries, sharding


def groups(rows):
    out = defaultdict(list)
    for r in rows:
        out[r[1] or ""].append(r[0])
    return out


@pytest.mark.parametrize("hasher", [exact_dedup.text_key, lambda t: F.length(t) % 3, lambda t: F.lit(7).cast("long")])
@pytest.mark.parametrize("capacity", [2, 65_536])
def test_groups_whatever_the_keys(spark, hasher, capacity):
    rows = awkward()
    got = exact_dedup.exact_groups(frame(spark, rows), lambda t: hasher(t).cast("long"), capacity).collect()
    assert len(got) == len(rows)
    by = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups(rows).items()}
    for r in got:
        ids = by[r.text_sha256]
        assert r.group_size == len(ids)
        assert r.keep_id == max((i for i in ids if i is not None), default=None)
    assert Counter(r.text_sha256 for r in got if r.kept) == Counter(list(by))


def test_directory_splits_until_no_bucket_is_overfull(spark):
    keys = spark.range(3000).select(F.xxhash64("id").alias("key"))
    (level,) = exact_dedup.directory(keys, 50)
    assert level.bits > 5 and level.slots.count() == 2**level.bits == level.slots.select("slot").distinct().count()
    assert level.slots.select("child").distinct().count() < 2**level.bits
    sizes = exact_dedup.located(keys, [level]).groupBy("bucket").count().collect()
    assert max(r["count"] for r in sizes) <= 50 and sum(r["count"] for r in sizes) == 3000


def test_keys_that_begin_alike_take_more_levels(spark):
    keys = spark.range(100).select(F.col("id").alias("key"))
    levels = exact_dedup.directory(keys, 7)
    assert [x.first for x in levels] == [0, 16, 32, 48]
    sizes = exact_dedup.located(keys, levels).groupBy("bucket").count().collect()
    assert len(sizes) > 14 and max(r["count"] for r in sizes) <= 7 and sum(r["count"] for r in sizes) == 100


def test_rows_are_found_through_the_directory(spark):
    """With slots that lead to other buckets no row finds its text."""
    docs = frame(spark, [row(i, f"text {i}") for i in range(200)])
    index = exact_dedup.build_index(docs, capacity=20)
    assert index.entries.select("bucket").distinct().count() > 4
    assert exact_dedup.probed(index).where("keep_id = doc_id").count() == 200
    (level,) = index.levels
    wrong = exact_dedup.Level(level.slots.withColumn("slot", 2**level.bits - 1 - F.col("slot")), level.first, level.bits)
    assert exact_dedup.probed(exact_dedup.Index(index.entries, [wrong], index.rows)).where("keep_id IS NOT NULL").count() == 0


def test_rows_move_only_through_the_directory(spark):
    """Texts aren't dealt by anything but their bucket, except hot keys' rows, and no Python runs."""
    docs = frame(spark, [row(i, f"text {i % 900}") for i in range(1000)] + [row(2000 + i, "often") for i in range(300)])
    rows = exact_dedup.keyed(docs)
    place = exact_dedup.build_directory(rows, 50)
    assert [r.key for r in place.hot.collect()] == [rows.where("text = 'often'").first().key]
    plan = exact_dedup.answered(rows, place, F.count("*").alias("n"))._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
    assert [re.findall(r"(\w+)#", d) for d in dealt] == [["bucket"], ["bucket", "key", "text"]]
    assert "Python" not in plan and "Arrow" not in plan


def test_colliding_keys_are_told_apart_by_bytes(spark):
    """Keys of 5 bits: chains of many texts in buckets that split at least twice."""
    texts = [f"text {i % 200}" for i in range(600)]
    hasher = lambda t: F.shiftleft(F.pmod(F.xxhash64(t), F.lit(32)), 59)
    docs = frame(spark, [row(i, t) for i, t in enumerate(texts)])
    index = exact_dedup.build_index(docs, hasher, 2)
    assert index.levels[0].bits >= 4 and index.entries.select("bucket").distinct().count() > 8
    chains = index.entries.groupBy("bucket", "key").agg(F.count("*").alias("n"), F.min("links").alias("low"), F.max("links").alias("high"), F.max("link").alias("last")).collect()
    assert max(r.n for r in chains) > 2 and all(r.n == r.low == r.high == r.last + 1 for r in chains)
    want = {i: (max(j for j in range(600) if texts[j] == t), texts.count(t)) for i, t in enumerate(texts)}
    assert {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_groups(docs, hasher, 2).collect()} == want
    assert sorted(r.doc_id for r in exact_dedup.drop_copies(docs, hasher, 2).collect()) == sorted({k for k, _ in want.values()})


@pytest.mark.parametrize("hot", [1, 100])
def test_stage_keeps_one_whole_row_of_each_text(spark, hot, monkeypatch):
    monkeypatch.setattr(exact_dedup, "HOT_ROWS", hot)
    rows = awkward()
    docs = frame(spark, rows)
    got = exact_dedup.drop_copies(docs)
    assert got.columns == docs.columns
    kept = [tuple(r) for r in got.collect()]
    assert all(r in rows for r in kept)
    assert sorted(r[1] or "" for r in kept) == sorted(groups(rows))
    best = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups(rows).items()}
    assert all(r[0] == best[r[1] or ""] for r in kept)


def test_stage_of_repeated_and_null_ids(spark):
    rows = [row(1, "a", "de"), row(1, "a", "en"), row(1, "a", "en"), row(None, "b"), row(None, "b"), row(2, None), row(3, "")]
    got = exact_dedup.drop_copies(frame(spark, rows)).collect()
    assert sorted((str(r.doc_id), str(r.text), r.lang) for r in got) == [("1", "a", "en"), ("3", "", "en"), ("None", "b", "en")]


def test_empty_tables(spark):
    docs = frame(spark, [])
    assert exact_dedup.exact_groups(docs).count() == exact_dedup.drop_copies(docs).count() == sharding.assign(docs).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_as_duckdb(name, spark, duck, sf_dir):
    assert_same(queries.QUERIES[name](spark, sf_dir), duck.sql(queries.ORACLES[name]))


def test_shards_move_rows_only_into_the_new_one(spark, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS_IN_CELL", 50)
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    got = sharding.assign(docs).toPandas()
    assert ((got.grown_shard == got.shard) | (got.grown_shard == 16)).all()
    assert 150 < (got.grown_shard == 16).sum() < 330
    for _, part in got.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))


def test_weights_decide_the_shares(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("text"))
    n = Counter(r.shard for r in sharding.assign(docs, (1.0, 2.0, 0.0, 3.0)).collect())
    assert n[2] == 0 and abs(n[0] - 1000) < 150 and abs(n[3] - 3000) < 250
    with pytest.raises(ValueError):
        sharding.rendezvous(F.col("doc_id"), (0.0,))


def test_shards_of_awkward_rows(spark):
    rows = awkward()
    got = sharding.assign(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    want = Counter((r[0], len((r[1] or "").encode()) + 1) for r in rows)
    assert Counter((r.doc_id, r.size) for r in got) == want
    assert sorted((r.shard, r.slot) for r in got) == sorted((s, i) for s, k in Counter(r.shard for r in got).items() for i in range(k))


def test_null_id_rows_are_not_lost(spark):
    docs = frame(spark, [row(None, "a"), row(None, "a"), row(1, "b")])
    got = exact_dedup.exact_groups(docs).collect()
    assert len(got) == 3 and sum(r.kept for r in got) == 2
