"""The order-dependent operators against plain loops, sliced and unsliced."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from embertide.operators import ordered
from embertide.operators import suppression as sp
from test_streaming import rows_of

times = st.lists(st.integers(0, 400), min_size=1, max_size=60)
keyed = st.lists(
    st.tuples(st.sampled_from("ab"), st.integers(0, 300), st.integers(0, 9)),
    min_size=1, max_size=150,
)


def frame(spark, rows, schema="k string, s long, v long"):
    numbered = [(n, *r) for n, r in enumerate(rows)]
    made = spark.createDataFrame(numbered, f"id long, {schema}")
    return made.withColumn("ts", F.timestamp_seconds(F.lit(1704067200) + F.col("s"))).repartition(3)


def loop(rows, window):
    """Ids accepted per key by the definition."""
    last, kept = {}, []
    for n, (k, s, _) in sorted(enumerate(rows), key=lambda r: (r[1][0], r[1][1], r[0])):
        if window <= 0 or k not in last or s - last[k] >= window:
            last[k] = s
            kept.append(n)
    return sorted(kept)


@settings(max_examples=300, deadline=None)
@given(times, st.integers(0, 60), st.integers(0, 60))
def test_transition_equals_running_the_slice(values, size, back):
    rows = np.sort(np.asarray(values, np.int64))
    upper, exits, at = ordered.transition(rows, size)
    for state in (None, int(rows[0]) - back, int(rows[0])):
        last = state
        for t in rows.tolist():
            if size <= 0 or last is None or t - last >= size:
                last = t
        found = 0 if state is None else int(np.searchsorted(upper, state + size))
        got = exits[found] if found < len(upper) else state
        assert got == last
    assert [int(rows[i]) for i in at] == exits


@settings(max_examples=6, deadline=None)
@given(rows=keyed, window=st.sampled_from([0, 7, 40, 1000]), target=st.sampled_from([2, 10]))
def test_first_anchored_equals_loop(spark, rows, window, target):
    df = frame(spark, rows)
    expected = [(n,) for n in loop(rows, window)]
    assert rows_of(ordered.first_anchored(df, ["k"], "ts", "id", [window]), "id") == expected
    slices = ordered.hot_slices(df, ["k"], "ts", target, 5)
    sliced = ordered.first_anchored(df, ["k"], "ts", "id", [window], slices)
    assert rows_of(sliced, "id") == expected


@settings(max_examples=4, deadline=None)
@given(rows=keyed, target=st.sampled_from([2, 8]))
def test_two_windows_equal_two_loops(spark, rows, target):
    first = loop(rows, 15)
    second = loop([rows[n] for n in first], 50)
    df = frame(spark, rows)
    expected = sorted((first[n],) for n in second)
    assert rows_of(ordered.first_anchored(df, ["k"], "ts", "id", [15, 50]), "id") == expected
    slices = ordered.hot_slices(df, ["k"], "ts", target, 5)
    sliced = ordered.first_anchored(df, ["k"], "ts", "id", [15, 50], slices)
    assert rows_of(sliced, "id") == expected


@settings(max_examples=4, deadline=None)
@given(rows=keyed, target=st.sampled_from([2, 8]))
def test_lag_equals_unsliced(spark, rows, target):
    df = frame(spark, rows)
    order = ["ts", "id"]
    plain = rows_of(ordered.lag_by(df, ["k"], order, "v", "p").fillna(-1), "id", "p")
    slices = ordered.hot_slices(df, ["k"], "ts", target, 5)
    sliced = rows_of(ordered.lag_by(df, ["k"], order, "v", "p", slices).fillna(-1), "id", "p")
    assert sliced == plain


@settings(max_examples=4, deadline=None)
@given(rows=keyed, target=st.sampled_from([2, 8]))
def test_suppression_state_machine(spark, rows, target):
    agents = ("water", "foam", "gas")
    active, expected = {}, []
    for n, (k, s, v) in sorted(enumerate(rows), key=lambda r: (r[1][0], r[1][1], r[0])):
        wanted = agents[v % 3]
        if k not in active or s - active[k][0] >= 60:
            active[k] = (s, wanted)
            expected.append((n, "activated"))
        else:
            expected.append((n, "updated" if active[k][1] == wanted else "rejected"))
    df = frame(spark, rows).select(
        F.col("id").alias("request_id"), F.col("k").alias("device_id"), "ts",
        F.element_at(F.array(*[F.lit(a) for a in agents]), (F.col("v") % 3 + 1).cast("int"))
        .alias("suppression_type"),
    )
    assert rows_of(sp.decide(df, 60), "request_id", "outcome") == sorted(expected)
    slices = ordered.hot_slices(df, ["device_id"], "ts", target, 5)
    assert rows_of(sp.decide(df, 60, slices), "request_id", "outcome") == sorted(expected)


def test_many_batches_and_one_large_key(spark):
    """State carries over Arrow batches; one key holds a third of the rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    try:
        rows = [("hot" if n % 3 == 0 else f"k{n % 97}", (n * 37) % 20_000, n % 10)
                for n in range(9_000)]
        df = frame(spark, rows)
        expected = [(n,) for n in loop(rows, 300)]
        assert rows_of(ordered.first_anchored(df, ["k"], "ts", "id", [300]), "id") == expected
        slices = ordered.hot_slices(df, ["k"], "ts", 400, 60)
        assert [r.k for r in slices.collect()] == ["hot"]
        sliced = ordered.first_anchored(df, ["k"], "ts", "id", [300], slices)
        assert rows_of(sliced, "id") == expected
        tagged = ordered.with_slice(df, ["k"], "ts", slices)
        assert tagged.groupBy("k", "_slice").count().where("_slice IS NOT NULL").agg(
            F.max("count")
        ).first()[0] <= 400
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_no_large_key_means_no_slices(spark):
    assert ordered.hot_slices(frame(spark, [("a", 1, 1)]), ["k"], "ts", 5) is None


def test_exact_window_edge(spark):
    rows = [("a", 0, 0), ("a", 299, 0), ("a", 300, 0), ("a", 599, 0), ("a", 600, 0)]
    out = ordered.first_anchored(frame(spark, rows), ["k"], "ts", "id", [300])
    assert rows_of(out, "id") == [(0,), (2,), (4,)]


def test_large_join_key_is_split(spark):
    """The adaptive skew join applies although the aggregation reuses the join's keys."""
    from embertide.operators import metrics as mt

    assert spark.conf.get("spark.sql.adaptive.forceOptimizeSkewedJoin") == "true"
    small = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
             "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
             "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
             "spark.sql.adaptive.coalescePartitions.enabled": "false",
             "spark.sql.autoBroadcastJoinThreshold": "-1",
             "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    for name, value in small.items():
        spark.conf.set(name, value)
    try:
        ops = spark.range(0, 60_000, 1, 8).select(
            F.when(F.col("id") % 3 != 1, F.concat(F.lit("d"), F.col("id") % 500)).otherwise("hot")
            .alias("device_id"),
            F.lit("c").alias("counter_name"),
            F.when(F.col("id") == 10, "SET").otherwise("INC").alias("op"),
            F.lit(1).cast("long").alias("amount"), F.col("id").alias("seq"),
        )
        out = mt.counter_values(ops)
        got = {r.device_id: r.value for r in out.collect()}
        assert got["hot"] == 1 + len([n for n in range(11, 60_000) if n % 3 == 1])
        assert "skew=true" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        for name in small:
            spark.conf.unset(name)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(-50, 900), min_size=1, max_size=120, unique=True), st.sampled_from([1, 3, 10, 50, 200]),
       st.lists(st.integers(0, 200), max_size=4), st.sampled_from([1, 7, 40]))
def test_bands_give_the_chain_and_what_enters_a_slice(values, width, cuts, slice_us):
    """Cut at any offsets, the bands' exits lead the walk over the same rows as the loop."""
    from embertide.operators import bands as bd

    rows = np.array(sorted(values), np.int64)
    band = np.searchsorted(sorted(cuts), rows % width, side="right")
    used = np.unique(band)
    visits = bd.walk([bd.band_exits(rows[band == b], width) for b in used])
    got = sorted(int(t) for k, entry, left in visits.tolist() for t in bd.accepted_at(
        rows[band == used[k]], width, np.full(left - entry, entry), np.arange(entry, left)))
    chain = []
    for t in rows.tolist():
        if not chain or t - chain[-1] >= width:
            chain.append(t)
    assert got == chain
    slices = np.unique(rows // slice_us)
    before = {}
    for k, entry, at, number in bd.asked(visits, slices, slice_us, width).tolist():
        t = int(bd.accepted_at(rows[band == used[k]], width, np.array([entry]), np.array([at]))[0])
        if t < number * slice_us:
            before[number] = max(before.get(number, t), t)
    for number in slices.tolist():
        early = [t for t in chain if t < number * slice_us]
        assert before.get(number) == (early[-1] if early else None)


def test_a_summary_is_bounded_by_slots_not_rows():
    """200,000 rows inside a few windows: a band tells one number per window."""
    from embertide.operators import bands as bd

    rng = np.random.default_rng(1)
    rows = np.unique(rng.integers(0, 3_000_000, 200_000))
    slots, exits = bd.band_exits(rows, 1_000_000)
    assert len(slots) == len(exits) == 3
    slots, _ = bd.band_exits(rows[rows % 1_000_000 < 1000], 1_000_000)
    assert len(slots) <= 3


def test_one_time_shared_by_a_third_of_the_rows(spark):
    rows = [("hot", 1000 if n % 3 == 0 else (n * 7) % 3000, 0) for n in range(3_000)]
    df = frame(spark, rows)
    slices = ordered.hot_slices(df, ["k"], "ts", 200, 5)
    out = ordered.first_anchored(df, ["k"], "ts", "id", [900], slices)
    assert rows_of(out, "id") == [(n,) for n in loop(rows, 900)]
