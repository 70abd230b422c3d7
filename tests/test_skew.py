"""Numbering, look-back and bounded histories against brute force on skewed groups."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from millrace.operators.feeds import drop_unchanged, last_n, merge_feed, newest_per_key
from millrace.operators.ordering import number_by_id, previous, row_index
from millrace.operators.sizing import measured

from plans import plan_text

N = 4000


@pytest.fixture(scope="module")
def rows():
    """Group a holds a third of all rows; a third of those share one time."""
    rng = random.Random(7)
    made = []
    for i in range(N):
        group = "a" if rng.random() < 0.34 else rng.choice("bcdefgh")
        time = 500 if group == "a" and rng.random() < 0.33 else rng.randrange(1000)
        made.append((group, time, i, rng.choice(["OK", "OK", "WARNING"])))
    return made


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "g string, t int, id bigint, s string").repartition(13)


def by_group(rows, order):
    groups = defaultdict(list)
    for r in sorted(rows, key=order):
        groups[r[0]].append(r)
    return groups


@pytest.mark.parametrize("size", [1, 7, 100, 10**6])
def test_number_by_id(df, rows, size):
    got = number_by_id(df, ["g"], "id", "n", rows_per_bucket=size).collect()
    want = {
        r: i for group in by_group(rows, lambda r: r[2]).values() for i, r in enumerate(group)
    }
    assert {(r.g, r.t, r.id, r.s): r.n for r in got} == want and len(got) == N


def test_number_by_sparse_and_negative_ids(spark):
    ids = [*range(-25, 25), 10**15, -(10**15), 10**6]
    df = spark.createDataFrame([("a", i) for i in ids], "g string, id bigint")
    want = {i: n for n, i in enumerate(sorted(ids))}
    for size in (1, 10, 10**6):
        assert {r.id: r.n for r in number_by_id(df, ["g"], "id", "n", size).collect()} == want
    assert number_by_id(df.where("1 = 0"), ["g"], "id", "n").count() == 0


WIDTHS = [1, 10, 333, 10**6]


def bucket(width):
    return F.floor(F.col("t") / width)


@pytest.mark.parametrize("width", WIDTHS)
def test_row_index(df, rows, width):
    got = row_index(df, ["g"], ["t", "id"], "n", bucket(width)).collect()
    want = {
        r: i
        for group in by_group(rows, lambda r: (r[1], r[2])).values()
        for i, r in enumerate(group)
    }
    assert {(r.g, r.t, r.id, r.s): r.n for r in got} == want and len(got) == N


def test_row_index_without_group_and_with_null_group(spark, df):
    whole = row_index(df, [], ["id"], "n", F.floor(F.col("id") / 100))
    assert whole.where("n != id").count() == 0 and whole.count() == N
    holed = df.withColumn("g", F.when(F.col("g") != "a", F.col("g")))
    numbered = row_index(holed, ["g"], ["t", "id"], "n", bucket(50))
    assert numbered.count() == N
    nulls = numbered.where("g IS NULL")
    assert nulls.select("n").distinct().count() == nulls.count() == nulls.agg(F.max("n")).first()[0] + 1


@pytest.mark.parametrize("width", WIDTHS)
def test_previous_and_changes(df, rows, width):
    back = previous(df, ["g"], ["t", "id"], ["s"], "p", bucket(width)).collect()
    kept = drop_unchanged(df, ["g"], ["t", "id"], ["s"], bucket(width)).collect()
    want, changed = {}, set()
    for group in by_group(rows, lambda r: (r[1], r[2])).values():
        for before, now in zip([None, *group], group):
            want[now] = before and before[3]
            if before is None or before[3] != now[3]:
                changed.add(now)
    assert {(r.g, r.t, r.id, r.s): (r.p and r.p.s) for r in back} == want
    assert {tuple(r) for r in kept} == changed and len(kept) == len(changed)


def test_full_rows_are_shuffled_once(spark, df):
    kept = drop_unchanged(df, ["g"], ["t", "id"], ["s"], bucket(10))
    kept.collect()
    text = plan_text(kept).split("Initial Plan")[0]
    assert sum("Exchange hashpartitioning" in line for line in text.splitlines()) <= 3
    assert "rangepartitioning" not in text


def test_null_values_are_values(spark):
    rows = [("a", 1, None), ("a", 2, None), ("a", 3, "x"), ("a", 4, None)]
    df = spark.createDataFrame(rows, "g string, t int, s string")
    assert [r.t for r in drop_unchanged(df, ["g"], ["t"], ["s"], F.col("t")).orderBy("t").collect()] == [1, 3, 4]


def test_last_n(df, rows):
    got = last_n(df, ["g"], [F.col("t").desc(), F.col("id").desc()], 5)
    want = {
        r for group in by_group(rows, lambda r: (-r[1], -r[2])).values() for r in group[:5]
    }
    assert {tuple(r) for r in got.collect()} == want
    assert plan_text(got).count("WindowGroupLimit") >= 2


def test_newest_per_key(df, rows):
    got = newest_per_key(df, ["g"], ["t", "id"])
    want = {group[-1] for group in by_group(rows, lambda r: (r[1], r[2])).values()}
    assert {tuple(r) for r in got.collect()} == want


@pytest.mark.parametrize("copies", [0, 1, 500])
@pytest.mark.parametrize("n", [1, 20, 150, 1000, 10_000])
def test_merge_feed(spark, copies, n):
    """With 500 copies near the front the newest rows alone do not suffice."""
    rows = [(i, 1000 - i // 2, f"v{i}") for i in range(200)]
    hot = [rows[3]] * copies
    seen = spark.createDataFrame(rows[50:] + hot, "id bigint, t int, v string")
    page = spark.createDataFrame(rows[:100] + hot, "id bigint, t int, v string")
    want = set(sorted(rows, key=lambda r: (-r[1], -r[0]))[:n])
    for key in ("id", None):
        got = [tuple(r) for r in merge_feed(seen, page, key, "t", n).collect()]
        assert set(got) == want and len(got) == len(want)


def test_merge_feed_keeps_the_newest_version(spark):
    old = spark.createDataFrame([(i, i, "old") for i in range(100)], "id bigint, t int, v string")
    new = spark.createDataFrame([(i, 1000, "new") for i in range(3)], "id bigint, t int, v string")
    got = {tuple(r) for r in merge_feed(old, new, "id", "t", 5).collect()}
    assert got == {(2, 1000, "new"), (1, 1000, "new"), (0, 1000, "new"), (99, 99, "old"), (98, 98, "old")}


def test_merge_feed_with_a_null_key(spark):
    seen = spark.createDataFrame([(i, i, "v") for i in range(1, 8001)], "id bigint, t int, v string")
    page = spark.createDataFrame([(None, 9000, "v"), (None, 8999, "old"), (8000, 8000, "v")], seen.schema)
    for n in (1, 10, 5000, 6000, 8001, 9000):
        got = [tuple(r) for r in merge_feed(seen, page, "id", "t", n).collect()]
        assert len(got) == len(set(got)) == min(n, 8001) and got[0] == (None, 9000, "v")


def test_equal_times_have_one_answer(spark):
    rows = [("k", 5, i % 4, f"v{i}") for i in range(8)]
    rng = random.Random(1)
    answers = set()
    for _ in range(6):
        rng.shuffle(rows)
        df = spark.createDataFrame(rows, "k string, t int, a int, b string").repartition(4)
        answers |= {tuple(r) for r in newest_per_key(df, ["k"], ["t"]).collect()}
        answers |= {tuple(r) for r in merge_feed(df, df, "k", "t", 3).collect()}
    assert answers == {("k", 5, 3, "v7")}


def test_broadcast_follows_measured_size(spark, df):
    small = measured(df.groupBy("g").agg(F.count("*").alias("n")))
    joined = df.join(small, "g")
    joined.collect()
    assert "BroadcastHashJoin" in plan_text(joined)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10")
    try:
        joined = df.join(small, "g")
        assert joined.count() == N
        assert "Broadcast" not in plan_text(joined)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
