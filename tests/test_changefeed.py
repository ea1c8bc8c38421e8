"""The change feed against a plain replay."""

import random
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from lectern.operators.changefeed import DeleteVectorTable, apply_feed, instant_micros, shelf_images, shelf_state
from lectern.session import work_path

FEED = "arrival bigint, change_id bigint, op string, entity string, account_id bigint, book_id string, h string, base_hash string, text string, title string, position_h string, position_frac double, updated_at string, received_at timestamp_ntz, extra string"


def feed(n, seed=1):
    rng = random.Random(seed)
    start = datetime(2023, 1, 1, tzinfo=timezone.utc)
    changes = []
    for k in range(n):
        entity = rng.choice(["edit", "edit", "entry"])
        at = start + timedelta(minutes=rng.randrange(40))
        form = rng.choice([at.isoformat(), at.strftime("%Y-%m-%dT%H:%M:%SZ"), at.astimezone(timezone(timedelta(hours=2))).isoformat(), at.strftime("%Y-%m-%d %H:%M:%S"), at.strftime("%Y-%m-%dT%H:%M:%S")])
        frac = rng.choice([None, 0.0, 0.5, 1.0, 1.2, -0.1]) if entity == "entry" else None
        changes.append([k, rng.choice(["insert", "update", " Update", "DELETE"]), entity, rng.choice([1, 1, 1, 2]), rng.choice("ab"), rng.choice("xyz") if entity == "edit" else None, f"t{k}", frac, form, at])
    sent = changes + [c for c in changes if rng.random() < 0.4]
    rng.shuffle(sent)
    return [(a, k, op, e, acc, b, h, None, t, None, None, f, form, None, None) for a, (k, op, e, acc, b, h, t, f, form, _) in enumerate(sent)], {c[0]: c[9] for c in changes}


def replay(rows, at):
    first = {}
    for r in rows:
        if r[1] not in first or r[0] < first[r[1]][0]:
            first[r[1]] = r
    edits, entries = {}, {}
    for r in sorted(first.values(), key=lambda r: (at[r[1]], r[0])):
        op, key = r[2].strip().lower(), (r[4], r[5])
        if r[3] == "edit":
            if op == "delete":
                edits.pop((*key, r[6]), None)
            else:
                edits[(*key, r[6])] = r[1]
        elif op == "delete":
            entries.pop(key, None)
            edits = {k: v for k, v in edits.items() if k[:2] != key}
        elif r[11] is not None and 0 <= r[11] <= 1:
            entries[key] = r[1]
    return {("edit", *k, v) for k, v in edits.items()} | {("entry", *k, "", v) for k, v in entries.items()}


def found(df):
    return {tuple(r) for r in df.select("entity", "account_id", "book_id", "h", "change_id").collect()}


def test_feed_equals_replay_in_any_split(spark):
    for seed, commits in ((1, 1), (2, 3), (3, 4)):
        rows, at = feed(120, seed)
        df = spark.createDataFrame(rows, FEED).repartition(3)
        assert found(apply_feed(df, commits)) == replay(rows, at)


def test_empty_feed_and_broken_rows(spark):
    empty = spark.createDataFrame([], FEED)
    assert apply_feed(empty).count() == 0
    rows = [(1, 1, None, "edit", 1, "a", "x", *[None] * 5, "2023-01-01", None, None), (2, 2, "insert", "edit", 1, "a", None, *[None] * 5, "no time", None, None), (3, None, "insert", "edit", 1, "a", "x", *[None] * 5, "2023-01-01", None, None), (4, 4, "insert", "edit", 1, "a", None, *[None] * 5, "2023-01-01", None, None)]
    assert found(apply_feed(spark.createDataFrame(rows, FEED))) == {("edit", 1, "a", "", 4)}


def test_superseded_rows_are_bits_not_rewrites(spark):
    store = DeleteVectorTable(spark, work_path(spark, "t"), ["k"], ["at"])
    for step in range(3):
        store.apply(spark.range(100).select(F.col("id").alias("k"), F.lit(step).alias("at"), F.lit(f"v{step}").alias("v")))
    store.apply(spark.createDataFrame([(5, 0, "late")], "k bigint, at int, v string"))
    live = store.read()
    assert live.count() == 100 and live.select("v").distinct().collect()[0].v == "v2"
    assert store.vectors().select(F.sum(F.bitmap_count("bits"))).collect()[0][0] == 200
    parts = [spark.read.parquet(f"{store.path}/data/{n:06d}").count() for n in range(4)]
    assert parts == [100, 100, 100, 0]


def test_instants(spark):
    texts = ["2023-05-01T12:00:00Z", "2023-05-01T14:00:00.000+02:00", "2023-05-01 12:00:00", "2023-05-01T12:00:00.000000", None, "", "x"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(instant_micros(F.col("t"))).collect()]
    assert len(set(got[:4])) == 1 and got[4:] == [None, None, None]


def test_stream_commits_like_a_batch(spark, tmp_path):
    from lectern.streaming.edits import feed_stream

    rows, at = feed(60, 5)
    rows = list({r[1]: r for r in sorted(rows, reverse=True)}.values())
    for k in range(2):
        spark.createDataFrame(rows[k::2], FEED).write.parquet(str(tmp_path / "in" / f"b{k}"))
    stream = spark.readStream.schema(FEED).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    store = DeleteVectorTable(spark, work_path(spark, "s"), ["kind", "account_id", "book_id", "h"], ["at", "arrival"])
    feed_stream(stream, store, str(tmp_path / "cp")).awaitTermination()
    assert store.commits > 1
    assert found(shelf_state(store.read())) == replay(rows, at) == found(shelf_state(shelf_images(spark.createDataFrame(rows, FEED)).groupBy("kind", "account_id", "book_id", "h").agg(F.max(F.struct("at", "arrival", "change_id", "gone", "text", "position_h", "position_frac")).alias("i")).select("kind", "account_id", "book_id", "h", "i.*")))


def test_a_store_is_opened_resumed_and_retried(spark, monkeypatch):
    """Killed in the middle of a commit and started again by another instance: the same state."""
    from lectern.operators import changefeed as cf

    rows, at = feed(90, 8)
    rows = sorted(rows)
    path = work_path(spark, "kill")
    open_ = lambda: DeleteVectorTable(spark, path, ["kind", "account_id", "book_id", "h"], ["at", "arrival"], buckets=4)
    parts = [spark.createDataFrame(rows[k : k + 30], FEED) for k in range(0, len(rows), 30)]
    for k, part in enumerate(parts):
        store = open_()
        assert store.commits == k
        if k == 1:
            with monkeypatch.context() as m:
                m.setattr(cf.Commits, "mark", lambda self, label="": (_ for _ in ()).throw(RuntimeError("killed")))
                try:
                    cf.deliver(store, part, f"batch{k}")
                except RuntimeError:
                    pass
            store = open_()
            assert store.commits == 1
        cf.deliver(store, part, f"batch{k}")
        cf.deliver(open_(), part, f"batch{k}")
    assert open_().commits == len(parts) and found(shelf_state(open_().read())) == replay(rows, at)


def test_a_commit_reads_only_its_buckets(spark):
    store = DeleteVectorTable(spark, work_path(spark, "b"), ["k"], ["at"], buckets=8)
    store.apply(spark.range(200).select(F.col("id").alias("k"), F.lit(1).alias("at")))
    one = spark.createDataFrame([(5, 2)], "k bigint, at int")
    held = store._held(one, "index", ["k"], ["k", "at"], "file string, pos bigint")
    assert held.select("bucket").distinct().count() == 1 and held.filter("k = 5").count() == 1
    pruned = held._jdf.queryExecution().toString().split("PartitionFilters: [")[1].split("]")[0]
    assert "bucket" in pruned and "commit" in pruned
