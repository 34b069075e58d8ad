"""The decision store's key index, and recent repeats dropped by stream state."""

import json
import os

from dunwright.sources.key_index import KeyIndex
from dunwright.sources.store import ParquetStore
from dunwright.streaming import decisions
from tests.conftest import explain
from tests.test_validation import VALID


def keys_of(spark, keys):
    return spark.createDataFrame([(k,) for k in keys], "key string")


def found(index, spark, store, keys, own=("new", 0)):
    hits = index.lookup(keys_of(spark, keys), store.commits(), own)
    return {r.key for r in hits.join(keys_of(spark, keys), "key", "left_semi").collect()}


def test_lookup_among_a_thousand_batches(spark, tmp_path):
    """A lookup reads the prefixes it holds, and nothing but filters for keys that are new."""
    store = ParquetStore(spark, str(tmp_path))
    index = store.keys
    rows = spark.range(20_000).selectExpr(
        "concat('event|k', id) key", "'s' stream", "id div 20 batch_id", index._prefix,
        "concat('g', id div 20) group")
    rows.repartition(4, "group").write.partitionBy("group").parquet(f"{index.root}/recent")
    (rows.select("stream", "batch_id", "group").distinct().selectExpr(
        "stream", "batch_id", "1L done", "group key_group").coalesce(2)
     .write.partitionBy("stream", "batch_id").parquet(store.path("commits")))
    assert index.compact_if_due(store.commits())
    manifest = index.manifest()
    assert manifest.covered == {"s": 998} and len(manifest.generations) == 1
    assert not index.compact_if_due(store.commits())

    assert found(index, spark, store, ["event|k5", "event|k19999", "event|x", "model|m|1"]) == \
        {"event|k5", "event|k19999"}
    assert found(index, spark, store, ["event|k19999", "event|k7"], own=("s", 999)) == {"event|k7"}
    hits = index.lookup(keys_of(spark, ["event|k5"]), store.commits(), ("new", 0))
    prefix = keys_of(spark, ["event|k5"]).selectExpr(index._prefix).first().prefix
    plan = explain(hits)
    pruned = [line for line in plan.split("\n") if "PartitionFilters" in line and "generation" in line]
    assert len(pruned) == 1 and f"= {prefix})" in pruned[0]
    assert sum("/recent/" in f for f in hits.inputFiles()) <= 2  # the last batch's group

    # new keys: the filters rule out nearly every folder
    asked = keys_of(spark, [f"event|new{i}" for i in range(16)]).selectExpr("key", index._prefix)
    folders = index._candidates(asked, manifest, "true")
    assert sum(map(len, folders.values())) <= 2
    # every stored key passes them
    stored = rows.selectExpr("key", "prefix")
    assert {p for ps in index._candidates(stored, manifest, "true").values() for p in ps} == set(range(16))


def test_generations_merge_and_half_a_compaction_is_not_read(spark, tmp_path):
    store = ParquetStore(spark, str(tmp_path))
    index = KeyIndex(spark, store.keys.root, prefixes=2, compact_every=1, most_generations=1)
    commits = []
    as_frame = lambda: spark.createDataFrame(commits, "stream string, batch_id bigint, key_group string")
    for n in range(4):
        commits.append(("s", n, index.add(keys_of(spark, [f"k{n}", f"shared{n}"]), "s", n)))
        assert index.compact_if_due(as_frame()) == (n > 0)
    assert len(index.manifest().generations) == 1 and index.manifest().covered == {"s": 2}
    index._write_generation(index._recent([commits[3][2]]))  # a compaction that ended before its manifest
    hits = index.lookup(keys_of(spark, ["k0", "k2", "k3", "k9"]), as_frame(), ("t", 0))
    got = [r.key for r in hits.collect() if r.key in ("k0", "k2", "k3", "k9")]
    assert sorted(got) == ["k0", "k2", "k3"]
    assert index.lookup(keys_of(spark, []), as_frame(), ("t", 0)).count() == 0
    empty = ParquetStore(spark, str(tmp_path / "other"))
    assert empty.known_keys(keys_of(spark, ["a"]), ("s", 0)).count() == 0


def event(key, payment, **more):
    return json.dumps({**VALID, "payment_id": payment, "idempotency_key": key, **more})


def test_the_feed_is_ordered_by_arrival_not_by_name(spark, tmp_path):
    feed = tmp_path / "feed"
    feed.mkdir()
    for name, payment, at in (("b", "p1", 1000), ("a", "p2", 2000)):
        (feed / f"{name}.json").write_text(event("k", payment))
        os.utime(feed / f"{name}.json", (at, at))
    store = ParquetStore(spark, str(tmp_path / "store"))
    jobs = decisions.DecisionStream(store, received_at="timestamp '2024-02-01 00:00:00'")
    jobs.run(decisions.read_event_stream(spark, str(feed)), str(tmp_path / "c")).awaitTermination()
    assert [r.payment_id for r in store.read("payment_events").collect()] == ["p1"]


def test_state_drops_repeats_and_forgets(spark, tmp_path):
    """Repeats of a window never reach the batch; the store answers for older ones; state shrinks."""
    feed = tmp_path / "feed"
    feed.mkdir()
    store = ParquetStore(spark, str(tmp_path / "store"))

    def run(recent, name, *events):
        (feed / name).write_text("\n".join(events))
        jobs = decisions.DecisionStream(store, received_at="timestamp '2024-02-01 00:00:00'", recent=recent)
        query = jobs.run(decisions.read_event_stream(spark, str(feed)), str(tmp_path / f"c-{recent[0]}"))
        query.awaitTermination()
        return query

    run("9 days", "1", event("k1", "p1"), event("k1", "p0"), event("k2", "p2"), '{"broken": 1}')
    run("9 days", "2", event("k1", "p9"), event("k3", "p3"), event("k3", "p3"), '{"broken": 1}')
    incoming = spark.read.parquet(store.path("incoming")).filter("is_valid and batch_id > 0")
    assert [r.payment_id for r in incoming.collect()] == ["p3"]
    assert {(r.idempotency_key, r.payment_id) for r in store.read("payment_events").collect()} == {
        ("k1", "p0"), ("k2", "p2"), ("k3", "p3")}
    assert decisions.quarantined(store).count() == 2

    many = [event(f"m{i}", f"q{i}") for i in range(40)]
    run("1 second", "3", *many)
    run("1 second", "4", event("k5", "p5"), *many[:5])
    last = run("1 second", "5", event("k6", "p6"))
    rows = [p.stateOperators[0].numRowsTotal for p in last.recentProgress if p.stateOperators]
    assert rows and rows[-1] <= 10
    keys = [r.idempotency_key for r in store.read("payment_events").collect()]
    assert len(keys) == len(set(keys)) == 45
