"""Ids in crowded milliseconds, sketches by bucket, rates of windows, bytes per micro-batch, maintained buckets."""

import math
import random

from pyspark.sql import functions as F

from embertide.operators import ids
from embertide.operators import metrics as mt
from embertide.operators import percentiles
from embertide.operators import readings as rd
from embertide.sources import topics
from embertide.sources.buckets import BucketedSink, MaintainedBuckets
from test_streaming import instants, rows_of


def test_crowded_ids_equal_one_window(spark):
    """A third of all rows in one millisecond of one machine; the numbers are those of a plain count."""
    rng = random.Random(5)
    rows = []
    for n in range(6_000):
        ms = 5_000 if n % 3 == 0 else 4_000 + rng.randint(0, 3_000)
        rows.append((n, None if n % 50 == 7 else n % 2, ms if n % 17 else ms + 3 * ids.SLICE_MS))
    df = spark.createDataFrame(rows, "k long, m int, ms long").select(
        "k", "m", F.timestamp_millis(F.col("ms") + 1_700_000_000_000).alias("ts")).repartition(5)
    machine = F.coalesce("m", F.lit(9))
    split = ids.assign_ids(df, "ts", machine, F.lit(1), ["k"], hot_rows=300)
    got = rows_of(split, "k", "id")
    assert got == rows_of(ids.assign_ids(df, "ts", machine, F.lit(1), ["k"]), "k", "id")
    assert len({i for _, i in got}) == len(rows)
    place, want = {}, {}
    for k, m, ms in sorted(rows, key=lambda r: (9 if r[1] is None else r[1], r[2], r[0])):
        m = 9 if m is None else m
        place[m] = max(place.get(m, -1) + 1, (ms + 1_700_000_000_000) * 256)
        want[k] = place[m]
    assert [((i >> 23) + 1672531200000) * 256 + (i & 255) for _, i in got] == [want[k] for k, _ in got]


def test_rollup_windows_are_near_the_exact_percentiles(spark):
    rng = random.Random(2)
    rows = [("a" if n % 3 else "b", n // 10, rng.gauss(50, 20) if n % 40 else None) for n in range(20_000)]
    df = spark.createDataFrame(rows, "k string, s long, v double").withColumn("ts", F.timestamp_seconds("s"))
    rolled = percentiles.rollup(df, ["k"], "v", "ts", "5 minutes").cache()
    for start, end in ((None, None), (300, 1200)):
        stamp = lambda s: None if s is None else f"1970-01-01T00:{s // 60:02d}:00Z"
        found = percentiles.from_rollup(rolled, ["k"], (0.5, 0.95), stamp(start), stamp(end)).collect()
        for r in found:
            values = sorted(v for k, s, v in rows if k == r.k and v is not None
                            and (start is None or start <= s < end))
            assert r.n == len(values)
            for p, got in ((0.5, r.p50), (0.95, r.p95)):
                below = sum(v < got for v in values) / len(values)
                assert abs(below - p) < 0.01


def panel_rate(samples, end, seconds):
    """The rate of a window (end - seconds, end] as a dashboard draws it; None below two samples."""
    inside = [(t, v) for t, v in samples if end - seconds < t <= end]
    if len(inside) < 2 or inside[0][0] == inside[-1][0]:
        return None
    growth = sum(b - a if b >= a else b for (_, a), (_, b) in zip(inside, inside[1:]))
    span = inside[-1][0] - inside[0][0]
    distance = span / (len(inside) - 1)
    head, tail = inside[0][0] - (end - seconds), end - inside[-1][0]
    if growth > 0:
        head = min(head, span * inside[0][1] / growth)
    reach = span + sum(gap if gap < distance * 1.1 else distance / 2 for gap in (head, tail))
    return growth * reach / span / seconds


def test_edge_rates_with_resets_inside_windows(spark):
    rng = random.Random(7)
    samples, value = [], 0.0
    for t in sorted(rng.sample(range(1, 4000), 150)):
        value = rng.randint(0, 3) if rng.random() < 0.1 else value + rng.randint(0, 9)
        samples.append((t, float(value)))
    df = spark.createDataFrame([("x", *s) for s in samples], "series string, t long, value double").select(
        "series", "value", F.timestamp_seconds("t").alias("ts"))
    got = {r.t: r.per_second for r in mt.edge_rates(df, ["series"], 300, 60).select(
        F.unix_seconds("window_end").alias("t"), "per_second").collect()}
    for end in range(60, 4320, 60):
        want = panel_rate(samples, end, 300)
        assert (end in got) == (want is not None)
        assert want is None or math.isclose(got[end], want, rel_tol=1e-9, abs_tol=1e-12)


def test_bytes_bound_a_micro_batch(spark, tmp_path):
    """One large file among small ones: no micro-batch exceeds the bound by more than that file."""
    folder = tmp_path / "t"
    sizes = []
    for n in range(6):
        count = 3_000 if n == 2 else 50
        path = str(folder / topics.SENSOR_TOPIC)
        spark.range(count).select(F.lit("d").alias("key"), F.lit("x" * 100).alias("value")).coalesce(1).write.mode(
            "append").json(path)
    files = sorted((folder / topics.SENSOR_TOPIC).glob("*.json"), key=lambda f: f.stat().st_size)
    bound = 3 * files[0].stat().st_size
    topic = topics.Topic(topics.SENSOR_TOPIC, "json", str(folder), bytes_per_trigger=bound)
    run = topic.read(spark).writeStream.foreachBatch(lambda df, n: sizes.append(df.count())).option(
        "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert run.awaitTermination(300) and run.exception() is None
    assert sum(sizes) == 3_250 and len(sizes) >= 3
    assert max(sizes) <= 3_000 + 3 * 50 and sorted(sizes)[-2] <= 3 * 50


def test_maintained_buckets_equal_a_whole_aggregate(spark, inputs, tmp_path):
    """Days late, repeated and in three micro-batches; a crash after the marks changes nothing."""
    data = instants(inputs.sensor_data.select("id", "device_id", "sensor_type", "value", "ts"))
    kept = MaintainedBuckets(spark, str(tmp_path / "r"), str(tmp_path / "b"), "7 hours", 16)
    sink = BucketedSink(str(tmp_path / "r"), kept)
    parts = [data.where(F.pmod(F.xxhash64("id"), F.lit(3)) == n) for n in range(3)]
    kept.mark(parts[0], 0)  # killed before the rows were stored
    for number, part in enumerate(parts):
        sink(part, number)
        sink(part, number)
    want = rd.bucketed(data, "7 hours")
    columns = ["device_id", "sensor_type", "bucket", "min_value", "max_value"]
    assert rows_of(kept.read(), *columns) == rows_of(want, *columns)
    assert kept.refresh() == 0
    untouched = kept.table.manifest.live()
    sink(parts[0].limit(1).withColumn("id", F.lit(10**9).cast("long")), 9)
    assert len(set(untouched) - set(kept.table.manifest.live())) <= 1
