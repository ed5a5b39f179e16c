"""Published constants of the estimators, and behaviour at their edges."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetrace.functions.special import digamma, log_unit_ball
from kinetrace.operators import information as info
from kinetrace.operators import series as ts
from kinetrace.sources.tables import from_array


def frame(spark, a, columns="abcdefghij"):
    cols = list(columns[: a.shape[1]])
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(a)], ", ".join(["id long", *(f"{c} double" for c in cols)])), cols


def test_special():
    assert digamma(1) == pytest.approx(-0.5772156649)
    assert digamma(1500) == pytest.approx(math.log(1500) - 1 / 3000 - 1 / (12 * 1500**2), abs=1e-12)
    assert math.exp(log_unit_ball(2)) == pytest.approx(math.pi)


def test_sample_entropy():
    x = np.random.default_rng(12345).random(100)
    assert info.sample_entropy_of(x, 0.5 * x.std()) == pytest.approx(1.3062516534463542, abs=1e-12)
    with pytest.raises(ValueError):
        info.sample_entropy_of(x[:3], 1.0)
    with pytest.raises(RuntimeError):
        info.sample_entropy_of(np.arange(20.0) ** 2, 1e-9)


def test_sample_entropy_counts_all_near_pairs():
    """4.2 + 8 rounds to 12.2, yet 12.2 - 4.2 is under 8: such pairs count, as in the SQL."""
    assert info.sample_entropy_of(np.array([4.2, 36.0, 23.5, 12.2, 33.36, 30.56, 12.0]), 8.0) == pytest.approx(math.log(2))
    x = np.random.default_rng(3).integers(0, 3000, 500) / 100
    pairs = [sum(int((np.abs(w[k + 1 :] - w[k]).max(1) < 8).sum()) for k in range(len(w) - 1)) for w in (np.lib.stride_tricks.sliding_window_view(x, n) for n in (3, 4))]
    assert info.sample_entropy_of(x, 8.0) == pytest.approx(-math.log(pairs[1] / pairs[0]), abs=1e-12)


def test_correlations(spark):
    np.random.seed(1234)
    series = from_array(spark, np.random.rand(100, 100))
    own = {r["lag"]: r["value"] for r in ts.self_time_correlation(series, 3).collect()}
    assert own[0] == pytest.approx(1) and own[1] == pytest.approx(0.005519088806189553, abs=1e-12)
    cross = ts.cross_time_correlation(series, 2).orderBy("lag").first()
    assert cross["value"] == pytest.approx(0.0002474572311281272, abs=1e-12)


def test_entropies(spark):
    a = np.random.default_rng(12345).random((100, 2))
    df, cols = frame(spark, a)
    assert info.kozachenko_leonenko(df, cols) == pytest.approx(0.0755109447796211, abs=1e-8)
    assert info.shannon(df, cols).first()["h"] == pytest.approx(6.643856189774724)
    assert info.negentropy(df, cols) == pytest.approx(0.40485364974320515, abs=1e-6)
    assert info.kozachenko_leonenko(df.limit(2), cols) == 0.0


def test_seeded_constants(spark):
    np.random.seed(1234)
    flat, _ = frame(spark, np.random.rand(100, 100).reshape(-1, 1))
    lo, hi = flat.agg(F.min("a"), F.max("a")).first()
    assert info.histogram_entropy(flat, {"a": (lo, hi)}, 40).first()["h"] == pytest.approx(0.9993954419344714, abs=1e-12)
    np.random.seed(1234)
    two, cols = frame(spark, np.random.rand(1000, 2))
    assert info.histogram_entropy(two, {"a": (0, 1), "b": (0, 1)}, 40).first()["h"] == pytest.approx(0.8837924363474094, abs=1e-12)
    np.random.seed(1234)
    x, _ = frame(spark, np.random.rand(10000).reshape(-1, 1))
    assert info.spacing_entropy(x, "a", 1, "bit") == pytest.approx(0.9891067080934253, abs=1e-10)
    np.random.seed(1234)
    plane, _ = frame(spark, np.random.rand(10000, 2))
    assert info.kozachenko_leonenko(plane, ["a", "b"], 1, 2.0, "euclid") == pytest.approx(0.013521446183128614, abs=1e-10)
    np.random.seed(1234)
    a, labels = np.random.rand(100, 100), np.random.randint(-1, 2, size=(100, 100))
    both, _ = frame(spark, np.column_stack([a.ravel(), labels.ravel()]))
    assert info.entropy_gain(both, ["a"], "b", 40).first()["relative"] == pytest.approx(0.0010065005804883983, abs=1e-12)
    np.random.seed(1234)
    a, labels = np.random.rand(1000, 2), np.random.randint(-1, 2, size=1000)
    both, _ = frame(spark, np.column_stack([a, labels]))
    assert info.entropy_gain(both, ["a", "b"], "c", 40).first()["relative"] == pytest.approx(0.13171418273750357, abs=1e-12)


def test_gain_takes_any_names(spark):
    df = spark.createDataFrame([(1, 1, 2), (1, 2, 2), (2, 2, 1)], "c int, label int, `a b` int")
    for label, columns in (("label", ["c"]), ("c", ["label", "a b"]), ("a b", ["c"])):
        assert info.info_gain(df, columns, label).first()["h0"] >= 0 and info.entropy_gain(df, columns, label, 2).count() == 1


@pytest.mark.parametrize("norm", ["euclid", "chebyshev"])
def test_nearest_neighbours_with_copies_and_outliers(spark, norm):
    rng = np.random.default_rng(7)
    a = np.concatenate([rng.normal(size=(150, 2)), np.repeat(rng.normal(size=(3, 2)), 9, 0), [[1e6, -1e6], [5e3, 0]]])
    df, cols = frame(spark, a)
    gap = np.abs(a[:, None] - a[None])
    d = gap.max(2) if norm == "chebyshev" else np.sqrt((gap**2).sum(2))
    np.fill_diagonal(d, np.inf)
    for k in (1, 4):
        want = np.sort(d, 1)[:, k - 1]
        got = {r["id"]: r["d"] for r in info.knn_distance(df, cols, k, norm).collect()}
        assert len(got) == len(a) and all(got[i] == pytest.approx(x, abs=1e-9) for i, x in enumerate(want))


def test_two_nearest_neighbours_in_blocks(spark):
    rng = np.random.default_rng(0)
    a = rng.normal(size=(3, 40, 5))
    a[0, 1] = a[0, 0]
    a[2, 2:] = a[2, 0]
    df = spark.createDataFrame([(p, f, a[f, p].tolist()) for f in range(3) for p in range(40)] + [(0, 3, [1.0] * 5), (1, 3, [2.0] * 5)], "particle_id long, frame int, vec array<double>").repartition(5)
    want = {3: (0, 0.0)}
    for f in range(3):
        d = np.sqrt(((a[f][:, None] - a[f][None]) ** 2).sum(2))
        np.fill_diagonal(d, np.inf)
        two = np.sort(d, 1)[:, :2]
        two = two[two[:, 0] > 0]
        want[f] = (len(two), np.log(two[:, 1] / two[:, 0]).sum())
    for block in (4096, 7):
        got = {r["frame"]: (r["n"], r["s"]) for r in ts.two_nn_sums(df, block=block).collect()}
        assert {f: n for f, (n, _) in got.items()} == {f: n for f, (n, _) in want.items()} and all(got[f][1] == pytest.approx(want[f][1]) for f in want)


def test_gaussian_sample(spark):
    one = [r["x"] for r in info.gaussian_sample(spark, 50, 3).orderBy("id").collect()]
    assert one == np.random.default_rng(3).normal(size=50).tolist()
    parts = info.gaussian_sample(spark, 50, 3, block=20).orderBy("id").collect()
    assert [r["id"] for r in parts] == list(range(50)) and parts[0]["x"] == one[0] and len({r["x"] for r in parts}) == 50


def test_correlations_of_unequal_series(spark):
    """Lengths differ, frames are missing: every pair of frames a lag apart counts, and no other."""
    rng = np.random.default_rng(1)
    rows = [(p, f, float(rng.normal())) for p in range(7) for f in range(3 + 2 * p) if rng.random() > 0.2 or f == 0]
    df = spark.createDataFrame(rows, "particle_id long, frame int, value double")
    means = {p: np.mean([v for q, _, v in rows if q == p]) for p in range(7)}
    d = {(p, f): v - means[p] for p, f, v in rows}
    own = {r["lag"]: (r["value"], r["error"]) for r in ts.self_time_correlation(df).collect()}
    cross = {r["lag"]: (r["value"], r["error"]) for r in ts.cross_time_correlation(df).collect()}
    assert {r["lag"]: r["value"] for r in ts.cross_time_correlation(df, errors=False).collect()} == pytest.approx({k: v for k, (v, _) in cross.items()}, nan_ok=True)
    zero = None
    for lag in range(max(f for _, f, _ in rows) + 1):
        each = [np.mean(x) for p in range(7) if (x := [v * d[p, f + lag] for (q, f), v in d.items() if q == p and (p, f + lag) in d])]
        zero = np.mean(each) if zero is None else zero
        assert (lag in own) == bool(each)
        if each:
            assert own[lag] == pytest.approx((np.mean(each) / zero, np.std(each) / math.sqrt(len(each)) / zero), abs=1e-9)
        s = [(sum(x), len(x)) for p in range(7) for q in range(7) if p != q for x in [[v * d[q, f + lag] for (r, f), v in d.items() if r == p and (q, f + lag) in d]]]
        n = sum(k for _, k in s)
        if n:
            value = sum(x for x, _ in s) / n
            assert cross[lag] == pytest.approx((value, math.sqrt(sum((x - value * k) ** 2 for x, k in s)) / n), abs=1e-9)
        else:
            assert math.isnan(cross[lag][0])


def test_missing_frames_pair_no_others(spark):
    from kinetrace.operators import vectors as vs

    df = spark.createDataFrame([(0, f, [float(f), 1.0]) for f in (0, 1, 3, 4, 7)], "particle_id long, frame int, vec array<double>")
    assert sorted(r["frame"] for r in vs.timesoap(df).collect()) == [0, 3] and sorted(r["frame"] for r in vs.timesoap(df, 3).collect()) == [0, 1, 4]
    assert ts.lagged_covariances(df, 1)[2] == 2


def test_spacing_entropy_matches_one_task(spark):
    x = np.round(np.random.default_rng(3).normal(size=500), 2)
    for k in (1, 3):
        s = np.sort(x)
        want = digamma(500) - digamma(k) + math.log(2) + np.log(np.maximum(s[k:] - s[:-k], 1e-10)).mean()
        df = spark.createDataFrame([(float(v),) for v in x], "x double").repartition(7)
        assert info.spacing_entropy(df, "x", k) == pytest.approx(want, abs=1e-9)


def test_extrema():
    x = np.linspace(-5, 5, 400)
    y = (x + 3) * (x - 2) ** 2 * (x + 1) ** 3
    found = ts.extrema_of(x, y, "min", 0.1)
    assert ((found[:, 0] + 3) * (found[:, 0] - 2) ** 2 * (found[:, 0] + 1) ** 3) == pytest.approx(found[:, 1])
    assert found[:, 0] == pytest.approx([-2.5, 2.0], abs=0.6)
    assert len(ts.extrema_of(x, np.zeros(400), "max")) == 0
    assert ts.extrema_of(np.arange(5), np.array([0, 1, 1, 1, 0]), "max")[0, 0] == 2
    with pytest.raises(ValueError):
        ts.extrema_of(x, y, "middle")


def test_tica_finds_the_slow_mode(spark):
    rng = np.random.default_rng(0)
    slow = np.cumsum(rng.normal(size=(4, 200)), 1) * 0.3
    data = np.stack([rng.normal(size=(4, 200)), slow, rng.normal(size=(4, 200))], 2)
    times, coefficients, out = ts.tica(from_array(spark, data), 2, 2)
    assert times[0] > times[1] and np.abs(coefficients[0]).argmax() == 1
    assert out.count() == 800


def test_gain_is_nan_without_entropy(spark):
    df = spark.createDataFrame([(1, 1), (1, 2)], "s int, l int")
    assert math.isnan(info.info_gain(df, ["s"], "l").first()["relative"])


def test_out_of_range_is_dropped(spark):
    df = spark.createDataFrame([(-1.0,), (0.0,), (10.0,), (11.0,)], "x double")
    assert info.histogram_entropy(df, {"x": (0, 10)}, 10, "bit").first()["n"] == 2
    assert info.bin_of(F.lit(10.0), 0, 10, 10) is not None


def test_nearest_neighbour_gain(spark):
    rng = np.random.default_rng(0)
    a = np.concatenate([rng.normal(0, 1, 300), rng.normal(20, 1, 300)])
    df = spark.createDataFrame([(i, float(x), i // 300) for i, x in enumerate(a)], "id long, x double, l int")
    r = info.info_gain_kl(df, ["x"], "l").first()
    assert r["gain"] == pytest.approx(1.0, abs=0.1) and r["relative"] == pytest.approx(r["gain"] / r["h0"])
