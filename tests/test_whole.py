"""Queries do the whole job: no row is left out to make them cheap."""

import os

import numpy as np
import pytest

from kinetrace.operators import detections, onion, soap, tracking
from kinetrace.plans import views
from kinetrace.plans.catalogue import QUERIES

DIR = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(LARGER), reason="needs the test tables")


def brute_suppress(pdf, iou, agnostic=False):
    out = []
    for path, image in pdf.groupby("image_path"):
        kept = []
        for r in image.sort_values(["conf", "det_id"], ascending=[False, True]).itertuples():
            for k in kept:
                w, h = min(r.x2, k.x2) - max(r.x1, k.x1), min(r.y2, k.y2) - max(r.y1, k.y1)
                both = max(w, 0) * max(h, 0)
                union = (r.x2 - r.x1) * (r.y2 - r.y1) + (k.x2 - k.x1) * (k.y2 - k.y1) - both
                if (agnostic or r.cls == k.cls) and both > iou * union:
                    break
            else:
                kept.append(r)
        out += [(path, r.det_id, r.cls) for r in kept]
    return sorted(out)


def test_suppression_sees_every_confident_box(spark):
    boxes = views.detections(spark, LARGER).where("conf >= 0.25").toPandas()
    assert boxes.groupby("image_path").size().min() > 150
    got = QUERIES["det_suppress"](spark, LARGER).collect()
    assert sorted(map(tuple, got)) == brute_suppress(boxes, 0.5)
    rng = np.random.default_rng(0)
    x, y = rng.uniform(0, 60, (2, 700))
    rows = [("a", k, int(rng.integers(0, 3)), float(rng.random()), float(x[k]), float(y[k]), float(x[k] + rng.uniform(1, 20)), float(y[k] + rng.uniform(1, 20))) for k in range(700)]
    df = spark.createDataFrame(rows, detections.DETECTIONS)
    for agnostic in (False, True):
        got = detections.suppress(df, 0.3, agnostic).select("image_path", "det_id", "cls").collect()
        assert sorted(map(tuple, got)) == brute_suppress(df.toPandas(), 0.3, agnostic)


def test_spectra_equal_the_double_sum():
    """c c^T over harmonics against Legendre polynomials of all pairs of neighbours."""
    rng = np.random.default_rng(3)
    for n, kinds in ((1, 1), (7, 1), (12, 2)):
        delta = rng.normal(size=(n, 3)) * 2
        delta[0] = 0
        kind = np.arange(n) % kinds
        got = soap.spectrum(delta, kind, kinds, 3.0, 4, 3)
        alpha, beta = soap.radial_basis(3.0, 4, 3)
        r = np.linalg.norm(delta, axis=1)
        unit = delta / np.where(r > 0, r, 1)[:, None]
        want = []
        for i in range(kinds):
            for j in range(i, kinds):
                for l in range(4):
                    c = np.zeros(l + 1)
                    c[l] = 1
                    p = np.polynomial.legendre.legval(np.clip(unit @ unit.T, -1, 1), c)
                    a = 0.5 / soap.SIGMA**2
                    f = np.array([[sum(beta[l][m, k] * np.pi**1.5 * (a * x) ** l * (a + alpha[l][k]) ** -(l + 1.5) * np.exp(-a * alpha[l][k] * x * x / (a + alpha[l][k])) for k in range(4)) for m in range(4)] for x in r])
                    full = np.pi * np.sqrt(8 / (2 * l + 1)) * (2 * l + 1) / (4 * np.pi) * np.einsum("am,ab,bn->mn", f * (kind == i)[:, None], p, f * (kind == j)[:, None])
                    want += [full[m, k] for m in range(4) for k in range(m if i == j else 0, 4)]
        assert got == pytest.approx(want, rel=1e-9, abs=1e-9)


def brute_runs(values, lo, hi, least):
    """Indices in runs of at least `least` consecutive values inside."""
    out, run = [], []
    for k, x in enumerate([*values, None]):
        if x is not None and lo <= x <= hi:
            run.append(k)
        else:
            out += run if len(run) >= least else []
            run = []
    return set(out)


@pytest.mark.parametrize(("smooth", "dt"), [(True, 4), (False, 3)])
def test_onion_labels_follow_from_the_states(spark, smooth, dt):
    rows = views.series(spark, DIR)
    states, labels = onion.onion(rows, dt, smooth=smooth)
    got = {(r[0], r[1]): r[2] for r in labels.collect()}
    bounds = [(max(s.mean - 2 * s.sigma, s.th_inf[0]), min(s.mean + 2 * s.sigma, s.th_sup[0])) for s in states]
    want = {}
    for p, g in rows.toPandas().sort_values("frame").groupby("particle_id"):
        x = g["value"].tolist()
        if smooth:
            inside = [brute_runs(x, lo, hi, dt) for lo, hi in bounds]
            want |= {(p, k): next((j for j, s in enumerate(inside) if k in s), -1) for k in range(len(x))}
        else:
            want |= {(p, w): next((j for j, (lo, hi) in enumerate(bounds) if all(lo <= v <= hi for v in x[w * dt : w * dt + dt])), -1) for w in range(len(x) // dt)}
    assert got == want and len(states) >= 1 and sum(v >= 0 for v in got.values()) > 0
    name = "onion_full" if smooth else "onion_windows_full"
    assert {(r[0], r[1]): r[2] for r in QUERIES[name](spark, DIR).collect()} == got


def test_onion_scan_and_vectors_cover_every_frame(spark):
    v = views.vectors(spark, DIR).select("particle_id", "frame").toPandas()
    got = QUERIES["onion_vectors"](spark, DIR).toPandas()
    assert sorted(zip(got["particle_id"], got["frame"], strict=True)) == sorted(zip(v["particle_id"], v["frame"], strict=True)) and got["label"].min() >= -1
    scan = {r["delta_t"]: (r["n_clusters"], r["unclassified"]) for r in QUERIES["onion_scan"](spark, DIR).collect()}
    rows = views.series(spark, DIR)
    for dt, (n, share) in scan.items():
        states, labels = onion.onion(rows, dt, sigmas=3.0, smooth=True)
        all_labels = [r["label"] for r in labels.collect()]
        assert n == len(states) and share == pytest.approx(sum(x == -1 for x in all_labels) / len(all_labels), abs=1e-6)
    assert sorted(scan) == onion.delays(0, 2, 8, 3)


def test_slow_modes_equal_the_eigenproblem(spark):
    rows = views.vectors(spark, DIR).toPandas().sort_values(["particle_id", "frame"])
    a = np.stack([np.stack(g["vec"]) for _, g in rows.groupby("particle_id")])
    x, y = a[:, :-1].reshape(-1, 64), a[:, 1:].reshape(-1, 64)
    both = np.concatenate([x, y])
    mean = both.mean(0)
    c0 = (both - mean).T @ (both - mean) / len(both)
    ct = ((x - mean).T @ (y - mean) + (y - mean).T @ (x - mean)) / len(both)
    value, mode = np.linalg.eig(np.linalg.solve(c0, ct))
    order = np.argsort(-np.abs(value))[:3]
    got = QUERIES["tica_project"](spark, DIR).toPandas().pivot(index=["particle_id", "frame"], columns="k", values="value").to_numpy()
    flat = a.reshape(-1, 64) - a.reshape(-1, 64).mean(0)
    for k, j in enumerate(order):
        w = np.real(mode[:, j])
        w = w / np.sqrt(w @ c0 @ w) * np.real(value[j])
        w = w * np.sign(w[np.abs(w).argmax()])
        p = flat @ w
        assert min(np.abs(p - got[:, k]).max(), np.abs(p + got[:, k]).max()) < 1e-4


def test_tracks_have_the_least_steps(spark):
    """Five walkers whose steps are far shorter than their gaps: every frame is matched by the best of all permutations."""
    import itertools

    rng = np.random.default_rng(9)
    x = np.cumsum(rng.normal(0, 0.1, (30, 5, 3)), 0) + np.arange(5)[None, :, None] * 1.2
    order = np.stack([rng.permutation(5) for _ in range(30)])
    rows = [(f, *map(float, x[f, p])) for f in range(30) for p in order[f]]
    out = tracking.track(spark.createDataFrame(rows, "frame int, x double, y double, z double"), 1.0, 1).toPandas()
    for f in range(29):
        a, b = (out[out["frame"] == k].sort_values("particle_id") for k in (f, f + 1))
        p, q = (t[["x", "y", "z"]].to_numpy() for t in (a, b))
        assert a["particle_id"].tolist() == b["particle_id"].tolist() == [0, 1, 2, 3, 4]
        best = min(itertools.permutations(range(5)), key=lambda s: sum(((p[i] - q[j]) ** 2).sum() for i, j in enumerate(s)))
        assert best == (0, 1, 2, 3, 4)
    linked = QUERIES["track_link"](spark, DIR).toPandas()
    assert len(linked) == views.positions(spark, DIR).count() and not linked.duplicated(["frame", "particle_id"]).any()


def test_every_environment_has_its_spectrum(spark):
    got = QUERIES["soap_kernel"](spark, DIR).cache()
    found = got.groupBy("particle_id", "frame").count().toPandas()
    every = views.positions(spark, DIR).select("particle_id", "frame").toPandas()
    assert sorted(zip(found["particle_id"], found["frame"], strict=True)) == sorted(zip(every["particle_id"], every["frame"], strict=True))
    assert found["count"].nunique() == 1
    few = soap.soap(views.positions(spark, DIR), 2.0, 4, 3, box=views.BOX, centers="id 8", selection="all")
    want = {(r["frame"], k): x for r in few.collect() for k, x in enumerate(r["vec"])}
    have = {(r["frame"], r["k"]): r["value"] for r in got.where("particle_id = 7").collect()}
    assert want.keys() == have.keys() and all(abs(want[k] - have[k]) < 1e-5 for k in want)
