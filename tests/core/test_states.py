import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from rosterlake.operators.rollups import DailyRollup
from rosterlake.operators.writing import upsert
from rosterlake.sources import files
from rosterlake.sources.bucketed import BucketedTable
from rosterlake.streaming import tracking

START = datetime(2024, 5, 1, tzinfo=timezone.utc)


def some_events(rng, n, hours):
    steps = ["view", "click", "signup", "purchase", "error", "other"]
    at = sorted(rng.uniform(0, hours) for _ in range(n))
    late = sorted(range(n), key=lambda i: at[i] + rng.uniform(0, 1.5))  # up to an hour and a half out of order
    rows = [(i, f"k{rng.randrange(6)}", rng.choice(steps), START + timedelta(hours=at[i])) for i in range(n)]
    return [rows[i] for i in late]


def write(spark, rows, folder):
    spark.createDataFrame(rows, "id long, key string, kind string, ts timestamp").coalesce(1).write.mode("append").parquet(str(folder))


def follow(spark, folder, checkpoint, initial=None):
    out = []
    events = spark.readStream.schema("id long, key string, kind string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(folder))
    states = tracking.track(events, "key", "kind", "ts", "id", 4, "2 hours", initial=initial)
    states.writeStream.foreachBatch(lambda batch, number: out.extend(batch.collect())).outputMode("update").option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start().awaitTermination()
    return out


def plain(r):
    return (r.key, r.status, r.updated, r.started, r.percent, tuple((s.status, s.at) for s in r.steps))


def twin(spark, rows, as_of):
    events = spark.createDataFrame(rows, "id long, key string, kind string, ts timestamp")
    found = tracking.runs(events, "key", "kind", "ts", "id", 4, as_of)
    return tracking.told(found, "key").collect(), found


def check(out, want):
    """Expired runs are those of the twin; of the open ones the last word of each key is the twin's latest."""
    assert sorted(plain(r) for r in out if r.expired) == sorted(plain(r) for r in want if r.expired)
    last = {}
    for r in out:
        if not r.expired:
            last[r.key] = r
    open_runs = {}
    for r in sorted((r for r in want if not r.expired), key=lambda r: r.updated):
        open_runs[r.key] = r
    assert open_runs and {k: plain(last[k]) for k in open_runs} == {k: plain(r) for k, r in open_runs.items()}


@pytest.fixture
def rocks(spark):
    tracking.prepare(spark)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_stream_equals_its_batch_twin_over_a_restart(rocks, tmp_path):
    rows = some_events(random.Random(3), 120, 60)
    parts = [rows[i : i + 40] for i in range(0, 120, 40)]
    write(rocks, parts[0], tmp_path / "in")
    out = follow(rocks, tmp_path / "in", tmp_path / "check")
    for part in parts[1:]:
        write(rocks, part, tmp_path / "in")
    out += follow(rocks, tmp_path / "in", tmp_path / "check")  # goes on from the checkpoint
    as_of = max(r[3] for r in rows) - timedelta(hours=2)
    want, _ = twin(rocks, rows, as_of)
    check(out, want)
    assert any(r.expired for r in want) and any(r.status == "error" and r.percent == 0 for r in out)


def test_stream_begins_with_a_batch_state(rocks, tmp_path):
    rows = some_events(random.Random(4), 80, 30)
    old, new = rows[:50], rows[50:]
    _, found = twin(rocks, old, max(r[3] for r in old) - timedelta(hours=2))
    expired = tracking.told(found.where("expired"), "key").collect()
    write(rocks, new, tmp_path / "in")
    out = follow(rocks, tmp_path / "in", tmp_path / "check", initial=tracking.open_runs(found, "key"))
    want, _ = twin(rocks, rows, max(r[3] for r in rows) - timedelta(hours=2))
    assert sorted(plain(r) for r in [*expired, *out] if r.expired) == sorted(plain(r) for r in want if r.expired)


def rows_of(table):
    return sorted(map(tuple, table.read().collect()))


def test_bucketed_table_rewrites_only_what_it_must(spark, tmp_path):
    rng = random.Random(5)
    rules = {"name": "fill", "n": "add"}
    frame = lambda rows: spark.createDataFrame(rows, "id long, name string, n long")
    table = BucketedTable(spark, str(tmp_path), ["id"], "id long, name string, n long", buckets=8)
    assert table.read().count() == 0
    state = frame([(i, f"a{i}", 1) for i in range(100)])
    table.upsert(state, rules, 1)
    files = lambda: {(str(f), f.stat().st_mtime_ns) for f in tmp_path.rglob("data/**/*.parquet")}
    before = files()
    new = frame([(3, None, 5), (500, "new", 7)])
    table.upsert(new, rules, 2)
    assert before < files() and len(list((tmp_path / "data/batch=2").glob("bucket=*"))) <= 2
    want = upsert(state, new, ["id"], rules)
    assert rows_of(table) == sorted(map(tuple, want.collect()))
    table.upsert(new, rules, 2)  # replayed: nothing is added twice
    assert rows_of(table) == sorted(map(tuple, want.collect()))
    more = frame([(rng.randrange(600), "m", 1) for _ in range(40)]).groupBy("id").agg(F.first("name").alias("name"), F.sum("n").alias("n"))
    table.upsert(more, rules, 3)
    want = sorted(map(tuple, upsert(want, more, ["id"], rules).collect()))
    assert rows_of(table) == want and table.vacuum(keep=1) > 0 and rows_of(table) == want


def test_bucketed_children_are_replaced(spark, tmp_path):
    table = BucketedTable(spark, str(tmp_path), ["parent"], "parent long, place int", buckets=4)
    frame = lambda rows: spark.createDataFrame(rows, "parent long, place int")
    table.replace(frame([(1, 0), (2, 0), (3, 0)]), frame([(1, 0), (1, 1), (2, 0), (3, 0)]), "parent", 1)
    table.replace(frame([(1, 0), (3, 0), (9, 0)]), frame([(3, 5)]), "parent", 2)
    assert rows_of(table) == [(2, 0), (3, 5)]


def test_stream_into_a_bucketed_table(rocks, tmp_path):
    """The stream's rows are upserted by batch number, so that a batch may run again."""
    rows = some_events(random.Random(6), 60, 20)
    for i in range(0, 60, 20):
        write(rocks, rows[i : i + 20], tmp_path / "in")
    table = BucketedTable(rocks, str(tmp_path / "table"), ["key"], "key string, status string, updated timestamp", buckets=4)
    events = rocks.readStream.schema("id long, key string, kind string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    rules = {"status": "replace", "updated": "replace"}

    def keep(batch, number):
        latest = batch.groupBy("key").agg(F.max_by("status", "updated").alias("status"), F.max("updated").alias("updated")).persist()
        for _ in range(2):
            table.upsert(latest, rules, number)

    states = tracking.track(events, "key", "kind", "ts", "id", 100, "2 hours")
    states.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    want = {k: (kind, ts) for _, k, kind, ts in sorted(rows, key=lambda r: (r[3], r[0]))}
    assert {r.key: r.status for r in table.read().collect()} == {k: v[0] for k, v in want.items()}


def test_rollup_with_increments_and_late_rows(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i, rng.choice(["a", "b", None]), START + timedelta(days=rng.randrange(40), hours=rng.randrange(24)), rng.choice([None, 1.5, 2.25, 10.0]), rng.randrange(70_000)) for i in range(600)]
    frame = lambda some: spark.createDataFrame(some, "id long, kind string, ts timestamp, value double, user long")
    rollup = DailyRollup(spark, str(tmp_path), ["kind"], buckets=4)
    rng.shuffle(rows)  # every batch is late for days of the one before
    done = []
    for batch in range(3):
        part = rows[batch * 200 : batch * 200 + 200] + done[:20] * (batch == 2)  # members that come again count once
        done += part
        for _ in range(1 + (batch == 1)):  # one batch runs twice
            rollup.add(frame(part), F.col("ts"), {"value": F.col("value")}, {"user": F.col("user")}, batch)
        for days in (7, 30):
            last = (START + timedelta(days=35)).date()
            here = [r for r in done if last - timedelta(days=days) < r[2].date() <= last]
            got = {(r.kind, r.measure): (r.n, r.total, r.members) for r in rollup.window(str(last), days).collect()}
            for kind in {r[1] for r in here}:
                own = [r for r in here if r[1] == kind]
                values = [r[3] for r in own if r[3] is not None]
                assert got[kind, "value"] == (len(values), sum(values), None)
                assert got[kind, "user"] == (len(own), 0, len({r[4] for r in own}))


def test_a_hot_parent_is_cut_in_pages(spark):
    n = 200_000
    rows = spark.range(n).select(F.when(F.col("id") % 10 < 8, 1).otherwise(F.col("id") % 100 + 2).alias("parent"), (F.col("id") * 7919 % n).alias("turn"), F.lit("x").alias("note"))
    rows = rows.union(spark.createDataFrame([(None, 1, "y")], rows.schema))
    pages = files.nest_pages(rows, "parent", ["turn"], 1000, parts=16)
    told = pages.select("parent", "page", F.size("items").alias("n"), F.get("items", F.lit(0))["turn"].alias("first"), F.element_at("items", -1)["turn"].alias("last")).collect()
    hot = sorted((r.page, r.n, r.first, r.last) for r in told if r.parent == 1)
    assert sum(r.n for r in told) == n and max(r.n for r in told) == 1000
    assert [h[0] for h in hot] == list(range(160)) and all(h[1] == 1000 for h in hot)
    assert all(a[3] < b[2] for a, b in zip(hot, hot[1:]))
