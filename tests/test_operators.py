"""Properties of curves, joins, predictions, splits, search, sources and the stream."""

import datetime
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tideline.config import GRAY, HILBERT, ZORDER, KnnConfig, parse, shift_vectors
from tideline.functions import calendar, curves, scaling
from tideline.operators import knn, lookups, metrics, predict, ranges, splits
from tideline.plans import forecast, search
from tideline.sources import tables
from tideline.streaming.score import score_stream

BITS = 8


@given(st.lists(st.lists(st.integers(0, 255), min_size=3, max_size=3), min_size=1, max_size=20))
@settings(max_examples=60, deadline=None)
def test_hilbert_round_trip(points):
    for p, key in zip(points, curves.hilbert_keys(np.array(points), BITS), strict=True):
        assert curves.decode(key, HILBERT, 3, BITS) == p and len(key) == 3 * BITS


def test_hilbert_is_continuous():
    grid = np.array([[x, y] for x in range(16) for y in range(16)])
    order = sorted(zip(curves.hilbert_keys(grid, 4), grid.tolist(), strict=True))
    assert all(abs(a[0] - b[0]) + abs(a[1] - b[1]) == 1 for (_, a), (_, b) in zip(order, order[1:]))


def test_keys_round_trip_and_order(spark):
    rng = random.Random(1)
    points = [[rng.randrange(256) for _ in range(3)] for _ in range(60)] + [[0, 0, 0], [255, 255, 255], [3, 5, 0]]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(points)], "id int, q array<bigint>")
    for curve in (ZORDER, GRAY, HILBERT):
        keys = {r.id: r.k for r in df.select("id", curves.curve_key(F.col("q"), curve, BITS).alias("k")).collect()}
        assert all(curves.decode(keys[i], curve, 3, BITS) == p for i, p in enumerate(points))
        if curve != HILBERT:
            z = {i: sum(((p[d] >> b) & 1) << (3 * b + 2 - d) for d in range(3) for b in range(BITS)) for i, p in enumerate(points)}
            assert all(int(keys[i], 2) == (z[i] if curve == ZORDER else z[i] ^ (z[i] >> 1)) for i in z)


def rows(spark, n, seed, d=3, target=True):
    rng = random.Random(seed)
    return spark.createDataFrame([(i, [rng.randrange(50) for _ in range(d)], float(rng.randrange(1, 3))) for i in range(n)], "id bigint, q array<bigint>, target double")


def brute(r, s, k):
    out = set()
    for a in r.collect():
        near = sorted((sum((x - y) ** 2 for x, y in zip(a.q, b.q, strict=True)), b.id) for b in s.collect())[:k]
        out |= {(a.id, i, d) for d, i in near}
    return out


@pytest.mark.parametrize("block", [4096, 17])
def test_exact_join(spark, block):
    r, s = rows(spark, 40, 1), rows(spark, 70, 2)
    got = {(x.r_id, x.s_id, x.d2) for x in knn.knn_exact(r, s, 5, block=block).collect()}
    assert got == brute(r, s, 5)


def test_exact_join_large_values_and_empty(spark):
    schema = "id bigint, q array<bigint>, target double"
    big = spark.createDataFrame([(1, [2**40, 0], 1.0), (2, [2**40 + 1, 5], 2.0), (3, None, 1.0), (4, [None, 1], 1.0)], schema)
    some = spark.createDataFrame([(1, [2**40, 7], 1.0), (5, [2**40 + 2**30, 7], 1.0)], schema)
    assert {(x.r_id, x.s_id, x.d2) for x in knn.knn_exact(big, some, 2).collect()} == {(1, 1, 49), (1, 5, 2**60 + 49), (2, 1, 5), (2, 5, (2**30 - 1) ** 2 + 4)}
    with pytest.raises(Exception, match="too far apart"):
        knn.knn_exact(big, some.withColumn("q", F.array(F.lit(0).cast("bigint"), F.lit(0).cast("bigint"))), 1).collect()
    assert knn.knn_exact(big, big.where("id > 9"), 3).count() == 0


def test_exact_join_by_folds_and_candidates(spark):
    """Rows of one fold do not meet, a null fold meets all; candidates keep apart."""
    base = rows(spark, 60, 3).withColumn("fold", F.when(F.col("id") < 50, (F.col("id") % 5).cast("int")))
    points = {r.id: (r.fold, r.q) for r in base.collect()}
    got = {(x.r_id, x.s_id) for x in knn.knn_exact(base.where("fold is not null"), base, 4, block=16, differ="fold").collect()}
    want = set()
    for i, (fold, q) in points.items():
        near = sorted((sum((a - b) ** 2 for a, b in zip(q, p, strict=True)), j) for j, (other, p) in points.items() if other is None or other != fold)
        want |= {(i, j) for _, j in near[:4]} if fold is not None else set()
    assert got == want
    tried = spark.createDataFrame([(0, 1), (1, -3)], "candidate bigint, w int")
    many = lambda df: df.crossJoin(tried).withColumn("q", F.transform("q", lambda x: x * F.col("w"))).withColumn("candidate", F.col("candidate"))
    both = knn.knn_exact(many(base), many(rows(spark, 40, 4)), 3, by="candidate").collect()
    alone = brute(base, rows(spark, 40, 4), 3)
    assert {(x.r_id, x.s_id, x.d2) for x in both if x.candidate == 0} == alone and {(x.r_id, x.s_id, x.d2 // 9) for x in both if x.candidate == 1} == alone


def test_curve_keys_refuse_what_does_not_fit(spark):
    df = spark.createDataFrame([([300, 1],)], "q array<bigint>")
    for curve in (ZORDER, GRAY, HILBERT):
        with pytest.raises(Exception, match="not in 0..2"):
            df.select(curves.curve_key(F.col("q"), curve, BITS)).collect()
        with pytest.raises(Exception, match="not in 0..2"):
            df.select(curves.curve_key(F.array(F.lit(-1).cast("bigint"), F.lit(2).cast("bigint")), curve, BITS)).collect()


@pytest.mark.parametrize("curve", [ZORDER, GRAY, HILBERT])
def test_curve_join_is_exact_when_k_covers_all(spark, curve):
    r, s = rows(spark, 12, 1), rows(spark, 20, 2)
    vectors = shift_vectors(2, 3, 5, most=100)
    offset, bits = knn.coordinate_span(r, s, vectors)
    got = {(x.r_id, x.s_id, x.d2) for x in knn.knn_curve(r, s, 20, vectors, curve, bits, offset, buckets=4).collect()}
    assert got == brute(r, s, 20)


def test_curve_join_does_not_depend_on_partitions_or_order(spark):
    r, s = rows(spark, 30, 3), rows(spark, 90, 4)
    vectors = shift_vectors(3, 3, 5, most=100)
    join = lambda a, b, buckets: {(x.r_id, x.s_id, x.d2, x.rank) for x in knn.knn_curve(a, b, 4, vectors, ZORDER, 9, 0, buckets).collect()}
    assert join(r, s, 1) == join(r.repartition(7), s.orderBy(F.desc("id")), 6)
    assert {x[:3] for x in join(r, s, 3)} <= {(a, b, d) for a, b, d in brute(r, s, 90)}


def test_predictions(spark):
    near = spark.createDataFrame([(1, 1, 4, 1.0, 1), (1, 2, 9, 2.0, 2), (1, 3, 16, 2.0, 3), (2, 1, 1, 1.0, 1), (3, 1, 4, 2.0, 1), (3, 2, 4, 1.0, 2), (3, 4, 4, 1.0, 3)], "r_id bigint, s_id bigint, d2 bigint, target double, rank int")
    got = {r.r_id: r for r in predict.classify(near, 3, 3).collect()}
    assert (got[1].pred, got[1].p_1, got[1].p_2, got[1].p_3) == (1, pytest.approx(2 / 3), pytest.approx(1 / 3), 0.0)
    assert (got[2].status, got[2].pred, got[2].p_1) == ("ERROR", None, None) and got[3].pred == 1
    assert {r.r_id: r.pred for r in predict.regress(near).collect()} == {1: pytest.approx(5 / 3), 2: 1.0, 3: pytest.approx(4 / 3)}
    truth = spark.createDataFrame([(1, 2.0), (2, 1.0), (3, 1.0)], "id bigint, target double")
    lines = sorted(r.value for r in predict.class_lines(predict.classify(near, 3, 2), truth, 2).collect())
    assert lines[1] == "2:1.0 ERROR!" and lines[2].startswith("3:1.0 | Result 1.0 | Class 1 probability 0.6666") and lines[2].endswith(" | ")
    assert sorted(r.value for r in predict.value_lines(predict.regress(near), truth).collect())[1] == "2:1.0 | Result: 1.0"
    assert metrics.accuracy(predict.classify(near, 3, 2), truth).first().accuracy == pytest.approx(100 / 3)


def test_measures_of_nothing(spark):
    none = spark.createDataFrame([], "r_id bigint, pred double")
    truth = spark.createDataFrame([(1, 1.0), (2, None)], "id bigint, target double")
    assert metrics.f_measure(none, truth).first().f_measure is None and metrics.accuracy(none, truth).first().accuracy == 0
    assert metrics.rmse(none, truth).first().rmse is None and metrics.r_squared(none, truth).first().r2_standard is None


def test_calendar(spark):
    start = datetime.datetime(2016, 2, 1)
    hours = spark.createDataFrame([(start + datetime.timedelta(hours=h),) for h in range(24 * 7)] + [(datetime.datetime(2016, m, 3),) for m in range(1, 13)], "ts timestamp")
    for r in hours.select("ts", *calendar.calendar_columns(F.col("ts"))).collect():
        h, free = r.hour, r.ts.isoweekday() >= 6
        want = (1 if 1 <= h <= 5 else 2 if h in (0, 6, 7, 22, 23) else 4 if 9 <= h <= 12 else 3) if free else (5 if 1 <= h <= 4 else 6 if h in (0, 5, 6, 22, 23) else 7)
        assert (r.timezone, r.day_of_week, r.weekend, r.season, r.day_of_month) == (want, r.ts.isoweekday(), 2 if free else 1, r.ts.month % 12 // 3 + 1, r.ts.day)


def test_feature_rows(spark):
    lines = spark.createDataFrame([("a,1,x,-9999,5.5,2",), ("b,1.5,2,3,-1,-1",), ("",), ("c,,1e3,NaN,0,1",)], "value string")
    got = {r.id: r for r in scaling.feature_rows(lines, 3, "classify").collect()}
    assert got["a"].features == [1.0, 0.0, 0.0] and got["a"].target == 2 and got["b"].target is None and got["c"].features == [0.0, 1000.0, 0.0]
    q = scaling.feature_rows(lines, 3, "regress").select("id", "target", scaling.quantised(F.col("features"), (1, 1, 2)).alias("q"))
    assert {r.id: (r.target, r.q) for r in q.collect()}["b"] == (None, [15, 20, 60])


def test_splits(spark):
    df = spark.range(103).select((F.col("id") * 7 % 103).alias("id"))
    assert {r.id: r.position for r in splits.numbered(df, ["id"], 5).collect()} == {i: i for i in range(103)}
    held = splits.fold_column(df, ["id"], 10)
    r, s = splits.fold_sets(held, 10)
    assert r.count() == 100 and s.count() == 930 and held.where("fold is null").count() == 3
    side = {x.id: x.side for x in splits.positional_split(df, ["id"]).collect()}
    assert [side[i] for i in (0, 91, 92, 102)] == ["S", "S", "R", "R"]
    assert splits.positional_split(df.where("id < 0"), ["id"]).count() == 0


def test_ranges(spark):
    df = spark.range(100).select(F.lit("g").alias("g"), "id")
    bounds = ranges.range_bounds(df, ["g"], "id", 4).first().bounds
    assert bounds == [25, 50, 75]
    assert {r.bucket for r in ranges.assigned(df.where("id in (24, 25)"), bounds, "id").collect()} == {0, 1}
    assert ranges.assigned(df.where("id = 0"), bounds, "id", halo=1).count() == 2


def test_search():
    config = search.SearchConfig(generations=30, seed=3)
    best = search.search(lambda gs: [-sum((g[j] - 5) ** 2 for j in range(4)) for g in gs], [10] * 4, config)
    assert best[0][0] >= -4 and best == search.search(lambda gs: [-sum((g[j] - 5) ** 2 for j in range(4)) for g in gs], [10] * 4, config)
    rng = random.Random(1)
    for _ in range(200):
        assert all(0 <= x <= 10 for x in search.mutate((0, 10, 5), (10, 10, 10), 2, rng))
    a, b = (1, 1, 1, 1), (2, 2, 2, 2)
    assert set(search.crossover(a, b, rng)) == {1, 2}


def test_config():
    assert parse([]).scale[0] == 10 and parse(["--dimension", "3", "--scale", "1,2,3", "--curve", "gray"]).vectors[0] == (0, 0, 0)
    with pytest.raises(ValueError):
        KnnConfig(dimension=3)


def test_lookups(spark):
    df = spark.createDataFrame([(1, "1"), (2, "9")], "id int, hour string")
    codes = spark.createDataFrame([("1", 4.0)], "key string, code double")
    assert lookups.with_codes(df.where("id = 1"), codes, "hour", "c").first().c == 4.0
    with pytest.raises(Exception, match="no c for 9"):
        lookups.with_codes(df, codes, "hour", "c").collect()
    cats = spark.createDataFrame([("1", ["a", "b"]), ("0", ["b"])], "key string, households array<string>")
    assert {r.household: r.customer_category for r in lookups.membership(cats).collect()} == {"a": 2, "b": 1}


def test_sources(spark, tmp_path):
    (tmp_path / "r.txt").write_text("h1;05/02/2016 13:00;0;1.5\nh2;31/12/2015 00:30;2;x\n")
    got = {r.id: r for r in tables.read_readings(spark, str(tmp_path / "r.txt")).collect()}
    assert got["h1_05/02/2016-13"]["class"] == 1 and got["h1_05/02/2016-13"].value == 1.5 and got["h2_31/12/2015-00"]["class"] == 2 and got["h2_31/12/2015-00"].value is None
    (tmp_path / "c.txt").write_text('{"01": 3, "02": 4.5}\nignored')
    (tmp_path / "l.txt").write_text('{"0": ["h1", "h2"]}')
    (tmp_path / "n.txt").write_text('{"01": {"h1": 2}, "02": {"h1": 3, "h2": 1}}')
    assert {r.key: r.code for r in tables.read_codes(spark, str(tmp_path / "c.txt")).collect()} == {"01": 3.0, "02": 4.5}
    assert tables.read_code_lists(spark, str(tmp_path / "l.txt")).first().households == ["h1", "h2"]
    assert tables.read_nested_codes(spark, str(tmp_path / "n.txt")).count() == 3
    vectors = shift_vectors(3, 4, 1)
    tables.write_vectors(spark, vectors, str(tmp_path / "v"))
    assert tables.read_vectors(spark, str(tmp_path / "v")) == vectors
    series = spark.createDataFrame([("h", datetime.datetime(2016, 6, 1, 5), 0.0)], "household string, ts timestamp, value double")
    assert tables.series_lines(series).first().value == "h;01/06/2016 05:00:00;0.0"


def test_sample_depends_on_the_seed_only(spark):
    df = spark.range(2000).select((F.col("id") % 2).cast("int").alias("src"), "id")
    one = {r.id for r in knn.sampled(df, {0: 0.5, 1: 0.0}, 3).collect()}
    assert one == {r.id for r in knn.sampled(df.repartition(5), {0: 0.5, 1: 0.0}, 3).collect()} and 400 < len(one) < 600 and all(i % 2 == 0 for i in one)
    assert knn.sample_rate(0, 0.1) == 1.0 and knn.sample_rate(10**6, 0.01) == pytest.approx(0.01)


def test_stream(spark, tmp_path):
    schema = "id bigint, features array<double>"
    training = spark.createDataFrame([(i, [float(i), 0.0], float(i % 2 + 1)) for i in range(20)], schema + ", target double")
    spark.createDataFrame([(100, [3.1, 0.0]), (101, [8.2, 0.0])], schema).write.parquet(str(tmp_path / "in"))
    config = KnnConfig(k=1, dimension=2, scale=(10, 10), scale_domain=(10, 10), mode="classify")
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    score_stream(stream, training, config, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
    assert {r.r_id: r.pred for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {100: 2, 101: 1}
