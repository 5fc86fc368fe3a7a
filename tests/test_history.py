"""As-of joins and intervals against plain look-ups."""

import random

import pytest

from docweave.operators import history


def plain_as_of(rows, versions, strict):
    out = []
    for key, t, name in rows:
        able = [(vt, nth, v) for vk, vt, nth, v in versions if vk == key and key is not None and t is not None and vt is not None and (vt < t if strict else vt <= t)]
        out.append((name, max(able)[2] if able else None))
    return sorted(out)


@pytest.mark.parametrize("partitions", [1, 4, 13])
@pytest.mark.parametrize("strict", [False, True])
def test_as_of(spark, partitions, strict):
    """A hot key with most rows is cut by time, ties and nulls included."""
    rng = random.Random(partitions)
    key = lambda: rng.choice(["hot"] * 6 + ["a", "b", "c", None])
    rows = [(key(), rng.choice([None, *range(60)]), i) for i in range(700)]
    versions = [(key(), rng.choice([None, *range(0, 60, 3)]), i, f"v{i}") for i in range(150)]
    left = spark.createDataFrame([(*r, "x", 1) for r in rows], "key string, t long, name int, version string, part int").repartition(3)
    right = spark.createDataFrame([(*v, 5) for v in versions], "key string, vt long, nth int, v string, part int").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        out = history.as_of(left, right, "key", "t", "vt", ["nth"], "found", strict, partitions)
        assert out.columns == [*left.columns, "found"]
        assert sorted((r.name, r.found and r.found.v) for r in out.collect()) == plain_as_of(rows, versions, strict)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_hot_key_is_cut(spark):
    rows = spark.range(4000).selectExpr("'hot' AS k", "id AS t", "id AS n")
    versions = spark.range(1).selectExpr("'hot' AS k", "5L AS vt", "0 AS nth")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = history.as_of(rows, versions, "k", "t", "vt", ["nth"], partitions=16)
        # one version, met in the first partition, is handed to all others
        assert out.where("version IS NOT NULL").count() == 3995
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_intervals_and_states(spark):
    rng = random.Random(2)
    versions = list({(rng.choice("ab"), rng.randrange(30), i) for i in range(60)})
    frame = spark.createDataFrame([(k, f"2024-01-{1 + t:02d}", i) for k, t, i in versions], "k string, d string, i int").selectExpr("k", "cast(d AS date) AS t", "i")
    got = {(r.k, r.valid_from.day - 1): (r.i, r.valid_to and r.valid_to.day - 1) for r in history.intervals(frame, "k", "t", ["i"], 5).collect()}
    want = {}
    for k in "ab":
        times = sorted({t for kk, t, _ in versions if kk == k})
        want |= {(k, t): (max(i for kk, tt, i in versions if (kk, tt) == (k, t)), later) for t, later in zip(times, [*times[1:], None], strict=True)}
    assert got == want
    for day in (1, 9, 30):
        state = {r.k: r.i for r in history.state_at(frame, "k", "t", f"2024-01-{day:02d}", ["i"]).collect()}
        assert state == {k: i for (k, t), (i, to) in want.items() if t < day and (to is None or to >= day)}
    assert history.intervals(frame.where("false"), "k", "t", ["i"]).count() == 0 and history.as_of(frame, frame.where("false"), "k", "t", "t", ["i"]).where("version IS NULL").count() == frame.count()
