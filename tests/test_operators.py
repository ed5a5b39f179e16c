"""Operators against brute force, on small made-up data."""

import itertools
import json

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinetrace.functions.arrays import normalized, soap_distance
from kinetrace.functions.select import selection
from kinetrace.operators import descriptors, detections, labels, onion, soap, tracking, vectors
from kinetrace.operators.neighbors import neighbor_edges
from kinetrace.provenance import Log
from kinetrace.sources import gro, tables, xyz
from kinetrace.sources.tables import from_array
from kinetrace.trajectory import Insight, OnionSmoothInsight, Trajectory, track_xyz


def cloud(spark, n=60, frames=3, seed=0, lo=-1.0, hi=11.0):
    a = np.random.default_rng(seed).uniform(lo, hi, (frames, n, 3))
    rows = [(f, p, "A" if p % 2 else "B", "A" if p % 2 else "B", *map(float, a[f, p])) for f in range(frames) for p in range(n)]
    return a, spark.createDataFrame(rows, "frame int, particle_id long, name string, type string, x double, y double, z double")


def brute(a, r, box=None):
    out = set()
    for f, x in enumerate(a):
        d = x[:, None] - x[None]
        if box:
            d -= box * np.rint(d / box)
        near = (d**2).sum(2) < (r - 1e-6) ** 2
        out |= {(f, i, j) for i, j in zip(*np.nonzero(near), strict=True) if i != j}
    return out


def pairs(df):
    return {(r["frame"], r["center_id"], r["neigh_id"]) for r in df.collect()}


@pytest.mark.parametrize("r", [1.3, 2.0, 4.0, 6.0])
def test_neighbors(spark, r):
    a, df = cloud(spark)
    rows = neighbor_edges(df, r, box=(10, 10, 10))
    assert pairs(rows) == brute(a, r, 10.0) and rows.count() == len(pairs(rows))
    assert pairs(neighbor_edges(df, r, respect_pbc=False)) == brute(a, r)


def test_neighbors_of_a_flat_frame(spark):
    a, df = cloud(spark, 20, 1, lo=0.0, hi=10.0)
    a[:, :, 2] = 0
    rows = neighbor_edges(df.withColumn("z", F.lit(0.0)), 2.0, box=(10, 10, 0))
    d = a[0][:, None] - a[0][None]
    d[..., :2] -= 10 * np.rint(d[..., :2] / 10)
    want = {(0, i, j) for i, j in zip(*np.nonzero((d**2).sum(2) < 4), strict=True) if i != j}
    assert pairs(rows) == want


def test_centers_are_excluded_by_global_id(spark):
    a, df = cloud(spark)
    want = {(f, i, j) for f, i, j in brute(a, 3.0, 10.0) if i % 2 and j % 2 == 0}
    assert pairs(neighbor_edges(df, 3.0, (10, 10, 10), centers="type A", selection="type B")) == want


def test_lens_and_coordination(spark):
    a, df = cloud(spark)
    near = brute(a, 3.0, 10.0)
    sets = {(f, p): {j for g, i, j in near if (g, i) == (f, p)} for f in range(3) for p in range(60)}
    got = {(r["frame"], r["particle_id"]): r["value"] for r in descriptors.lens(df, 3.0, box=(10, 10, 10)).collect()}
    assert len(got) == 120
    for (f, p), v in got.items():
        x, y = sets[f, p], sets[f + 1, p]
        assert v == pytest.approx((len(x) + len(y) - 2 * len(x & y)) / (len(x) + len(y)) if x or y else 0.0)
    counts = {(r["frame"], r["particle_id"]): r["value"] for r in descriptors.coordination_number(df, 3.0, box=(10, 10, 10)).collect()}
    assert counts == {k: float(len(v)) for k, v in sets.items()}
    with pytest.raises(ValueError):
        descriptors.lens(df, 3.0, 0)


def test_alignment_references_differ(spark):
    _, df = cloud(spark)
    e = neighbor_edges(df, 4.0, (10, 10, 10))
    first, prev = ({(r["frame"], r["particle_id"]): r["value"] for r in descriptors.velocity_alignment(df, e, k).collect()} for k in ("first", "previous"))
    assert {k for k in first if k[0] == 0 and abs(first[k] - prev[k]) > 1e-9} == set() and first != prev
    own = df.withColumns({"vx": F.lit(1.0), "vy": F.lit(0.0), "vz": F.lit(0.0)})
    assert {round(r["value"], 9) for r in descriptors.velocity_alignment(own, e).collect()} <= {0.0, 1.0}
    with pytest.raises(ValueError):
        descriptors.displacements(df, "last")


def test_selection_language(spark):
    df = spark.createDataFrame([(k, f"C{k}", "O" if k % 2 else "H") for k in range(6)], "particle_id long, name string, type string")
    ids = lambda s: sorted(r[0] for r in df.where(selection(s)).select("particle_id").collect())
    assert ids("all") == list(range(6)) and ids("id 1") == [0] and ids("type O") == [1, 3, 5]
    assert ids("name C3 or name C5") == [3, 5] and ids("not name C5") == [0, 1, 2, 3, 4]
    assert ids("(type O or id 1) and not name C3") == [0, 1, 5] and ids("particle_id > 3") == [4, 5]
    for bad in ("name", "(all", "all all", "not"):
        with pytest.raises(ValueError):
            selection(bad)


def test_vectors(spark, tmp_path):
    df = spark.createDataFrame([([0.0, 0.0], [3.0, 4.0])], "a array<double>, b array<double>")
    r = df.select(normalized(F.col("a")).alias("a"), normalized(F.col("b")).alias("b"), soap_distance(F.col("a"), F.col("b")).alias("d")).first()
    assert r["a"] == [0.0, 0.0] and r["b"] == pytest.approx([0.6, 0.8]) and r["d"] == pytest.approx(2**0.5)
    assert len(spark.range(1).select(vectors.fill_spectrum(F.transform(F.sequence(F.lit(1), F.lit(324)), lambda x: x.cast("double")), 8, 8).alias("v")).first()["v"]) == 576
    v = from_array(spark, np.random.default_rng(0).random((3, 4, 2)))
    for delay in (0, 4):
        with pytest.raises(ValueError):
            vectors.timesoap(v, delay, check=True)
    a = vectors.create_references(v, {"a": (0, 1)}, 8, 8)
    vectors.save_references(a, str(tmp_path / "refs"))
    assert vectors.load_references(spark, str(tmp_path / "refs")).count() == 1
    with pytest.raises(ValueError):
        vectors.merge_references(a, a.withColumn("l_max", F.lit(6)))


def test_soap_is_invariant_and_orthonormal(spark):
    alpha, beta = soap.radial_basis(4.0, 3, 2)
    for l in range(3):
        from math import gamma

        s = 0.5 * gamma(l + 1.5) * (alpha[l][:, None] + alpha[l][None]) ** -(l + 1.5)
        assert beta[l] @ s @ beta[l].T == pytest.approx(np.eye(3), abs=1e-8)
    x = np.vstack([[0, 0, 0], np.random.default_rng(1).normal(size=(6, 3))])
    q, _ = np.linalg.qr(np.random.default_rng(2).normal(size=(3, 3)))
    kind = np.array([0, 0, 1, 0, 1, 1, 0])
    p = soap.spectrum(x, kind, 2, 4.0, 3, 2)
    assert p == pytest.approx(soap.spectrum(x @ q, kind, 2, 4.0, 3, 2), rel=1e-9) and len(p) == 3 * (6 + 9 + 6)
    _, df = cloud(spark, 10, 1)
    out = soap.soap(df, 3.0, 3, 2, centers="type A").collect()
    assert len(out) == 5 and all(len(r["vec"]) == 63 for r in out)


def test_label_cleaning(spark):
    a = np.array([[[0, 1]] * 3 + [[1, 1]] * 6 + [[2, 1]]] * 2)
    rows = [(p, f, k, int(a[p, f, k])) for p in range(2) for f in range(10) for k in range(2)]
    df = spark.createDataFrame(rows, "particle_id long, frame int, delta_t int, label int")
    clean = lambda *x: sorted({(r["delta_t"], r["label"]) for r in labels.clean_population(df, *x).collect()})
    assert clean(0.1, 9) == [(0, 0), (0, 1), (0, 9), (1, 1)]
    assert clean(0.3, 9, 0) == [(0, 0), (0, 1), (0, 9), (1, 1)]
    assert clean(0.3, 9, [0, 2]) == [(0, 0), (0, 1), (0, 2), (1, 1)]
    assert labels.unknown_labels(df, [0, 7]) == [7]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 4)), min_size=1, max_size=5), st.lists(st.tuples(st.integers(0, 4), st.integers(0, 4)), min_size=1, max_size=5))
def test_assignment_is_least(a, b):
    a, b = np.array(a, float), np.array(b, float)
    cost, limit = ((a[:, None] - b[None]) ** 2).sum(2), 6.0
    found = tracking.assign(np.where(cost <= limit, cost, 1e18), limit)
    total = sum(cost[i, j] if j >= 0 else limit for i, j in enumerate(found))
    best = min(sum(cost[i, j] if j is not None and cost[i, j] <= limit else limit for i, j in enumerate(p)) for p in itertools.permutations([*range(len(b)), *[None] * len(a)], len(a)))
    assert total == pytest.approx(best) and len([j for j in found if j >= 0]) == len({j for j in found if j >= 0})


def test_tracking(spark, tmp_path):
    rng = np.random.default_rng(0)
    paths = np.cumsum(rng.normal(0, 0.2, (30, 5, 3)), 0) + np.arange(5)[None, :, None] * 4
    rows = [(f, *map(float, paths[f, p])) for f in range(30) for p in rng.permutation(5)]
    got = tracking.track(spark.createDataFrame(rows, "frame int, x double, y double, z double"), 2.0).collect()
    name = {tuple(paths[f, p]): p for f in range(30) for p in range(5)}
    where = {}
    for r in got:
        where.setdefault(r["particle_id"], set()).add(name[r["x"], r["y"], r["z"]])
    assert len(where) == 5 and all(len(v) == 1 for v in where.values())
    with pytest.raises(ValueError):
        tracking.track(spark.createDataFrame(rows, "frame int, x double, y double, z double"), 2.0, adaptive_stop=None)
    source, target = tmp_path / "in.xyz", tmp_path / "out.xyz"
    source.write_text("".join("5\nframe\n" + "".join(f"X {x:.6f} {y:.6f} {z:.6f}\n" for x, y, z in paths[f]) for f in range(30)))
    assert track_xyz(spark, str(source), str(target), 2.0).n_frames() == 30
    assert target.read_text().splitlines()[2].split()[0] == "X"
    with pytest.raises(FileNotFoundError):
        track_xyz(spark, str(tmp_path / "none.xyz"), str(target), 2.0)


def test_memory_bridges_a_gap():
    frame, x = np.array([0, 2, 5]), np.zeros((3, 3))
    assert tracking.link_frames(frame, x, 1.0, memory=1).tolist() == [0, 0, 1]


def test_onion(spark):
    rng = np.random.default_rng(12345)
    a = np.where(np.arange(200) < 100, 0.0, 6.0)[None] + rng.normal(0, 0.3, (6, 200))
    series = from_array(spark, a)
    for smooth in (False, True):
        states, found = onion.onion(series, 5, sigmas=3.0, smooth=smooth)
        assert len(states) == 2 and states[0].mean == pytest.approx(0, abs=0.2) and states[1].mean == pytest.approx(6, abs=0.2)
        assert found.where("label = -1").count() < 0.3 * found.count()
    runs = found.where("label >= 0").groupBy("particle_id", "label").count().agg(F.min("count")).first()[0]
    assert runs >= 5
    both = from_array(spark, np.stack([a, -a], 2))
    assert len(onion.onion(both, 5, sigmas=3.0)[0]) == 2
    scan, out = onion.onion_scan(series, 2, 20, 3)
    assert out.select("delta_t").distinct().count() == len(scan) == 3
    assert onion.delays(100, 1, None, 4) == [1, 4, 21, 100] or len(onion.delays(100, 1, None, 4)) == 4


def test_xyz(spark, tmp_path):
    f = tmp_path / "a.xyz"
    f.write_text("junk\n2\nc\nA 1 2 3\nB 4 5\n1\nc\nA 7 8 9 10\n")
    rows = xyz.read_xyz(spark, str(f)).select("frame", "row", "name", "x", "y", "z").collect()
    assert [tuple(r) for r in rows] == [(0, 0, "A", 1, 2, 3), (1, 0, "A", 7, 8, 9)]
    assert xyz.columns_of("1\nc\n1 2 3\n") == ["x", "y", "z"]
    with pytest.raises(ValueError):
        xyz.columns_of("1\nc\n1 2\n")
    with pytest.raises(ValueError):
        xyz.array_blocks(spark, np.zeros((2, 3)))
    _, df = cloud(spark, 3, 2)
    trj = Trajectory(df)
    labelled = df.select("particle_id", "frame", F.lit(1).alias("label"))
    trj.dump_colored_trj(labelled, str(tmp_path / "c.xyz"))
    lines = (tmp_path / "c.xyz").read_text().splitlines()
    assert lines[0] == "3" and lines[1].startswith("Lattice=0.0 0.0") and lines[2].split()[-1] == "3"
    with pytest.raises(ValueError):
        trj.dump_colored_trj(labelled.limit(2), str(tmp_path / "c.xyz"))
    trj.dump_xyz_with_insight([Insight(df.select("particle_id", "frame", F.col("x").alias("value")))], str(tmp_path / "i.xyz"))
    assert 'Lattice="0 0 0 0 0 0" Frame=0' in (tmp_path / "i.xyz").read_text()


def test_gro(spark, tmp_path):
    f = tmp_path / "a.gro"
    f.write_text("t= 1.5\n2\n    1WAT     O1    1   0.100   0.200   0.300  0.1000  0.2000  0.3000\n    1WAT     H2    2   1.100   1.200   1.300  0.0000  0.0000  0.0000\n   3.0   3.0   3.0\n")
    trj = Trajectory.from_gro(spark, str(f))
    r = trj.positions.orderBy("particle_id").first()
    assert (r["name"], r["type"], r["x"], r["vz"]) == ("O1", "O", pytest.approx(1.0), pytest.approx(3.0))
    assert trj.box.first()["lx"] == pytest.approx(30.0) and trj.n_atoms() == 2


def test_stored_trajectory_reads_only_its_chunks(spark, tmp_path):
    _, df = cloud(spark, 4, 20)
    path = str(tmp_path / "t")
    tables.write_trajectory(df, path, chunk=5, usetype="float32")
    got = tables.read_trajectory(spark, path, 6, 12, 2)
    assert sorted({r["frame"] for r in got.collect()}) == [0, 1, 2] and got.schema["x"].dataType.simpleString() == "float"
    assert "PartitionFilters: [isnotnull(frame_chunk" in got._jdf.queryExecution().executedPlan().toString()


def test_slices_replace_each_other(spark):
    _, df = cloud(spark, 2, 10)
    trj = Trajectory(df).with_slice(2, 8)
    assert trj.n_frames() == 6 and trj.with_slice(0, 10, 3).n_frames() == 4


def test_sidecars(spark, tmp_path):
    data = from_array(spark, np.arange(6.0).reshape(2, 3))
    Insight(data, {"name": "x"}).dump_to_json(str(tmp_path / "a.json"))
    back = Insight.load_from_json(spark, str(tmp_path / "a.json"))
    assert back.meta == {"name": "x"} and tables.to_array(back.dataset).tolist() == [[0, 1, 2], [3, 4, 5]]
    (tmp_path / "empty.json").write_text("{}")
    for kind in (Insight, OnionSmoothInsight):
        with pytest.raises(ValueError):
            kind.load_from_json(spark, str(tmp_path / "empty.json"))
    np.save(tmp_path / "d.npy", np.zeros((2, 3, 4)))
    (tmp_path / "b.json").write_text(json.dumps({"dataset_file": "d.npy", "meta": {}}))
    assert Insight.load_from_json(spark, str(tmp_path / "b.json")).dataset.columns == ["particle_id", "frame", "vec"]
    made = OnionSmoothInsight(data.select("particle_id", "frame", F.lit(0).alias("label")), {"delta_t": 2}, [{"mean": 1.0}])
    made.dump_to_json(str(tmp_path / "o.json"))
    assert OnionSmoothInsight.load_from_json(spark, str(tmp_path / "o.json")).state_list == [{"mean": 1.0}]
    kept = tables.load_or_compute(spark, str(tmp_path / "s.json"), lambda: data, r=1)
    assert kept.count() == 6 and tables.load_or_compute(spark, str(tmp_path / "s.json"), lambda: 1 / 0, r=1).count() == 6
    with pytest.raises(ValueError):
        tables.load_or_compute(spark, str(tmp_path / "s.json"), lambda: data, r=2)


def test_log(spark, tmp_path):
    log = Log()
    log.log("a")
    log.warning("b")
    data = from_array(spark, np.zeros((1, 2)))
    meta = {"name": "lens", "r": 4, "delay": 1, "c": "all", "s": "all"}
    assert log.record(data, meta) and not log.record(data, dict(meta)) and log.record(data, meta | {"s": "all "})
    assert log.extract(spark, str(tmp_path / "z.zip")) == ["lens_4_1_all_all", "lens_4_1_all_all_1"]
    log.save_history(str(tmp_path / "h"))
    assert "WARNING: b" in (tmp_path / "h").read_text() and log.table(spark).count() == 2


def test_detections(spark, tmp_path):
    rows = [("a", 0, 0, 0.9, 0.0, 0.0, 10.0, 10.0), ("a", 1, 0, 0.8, 1.0, 1.0, 10.0, 10.0), ("a", 2, 1, 0.7, 1.0, 1.0, 10.0, 10.0), ("b", 0, 0, 0.1, 0.0, 0.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, detections.DETECTIONS)
    ids = lambda d: sorted((r["image_path"], r["det_id"]) for r in d.collect())
    assert ids(detections.suppress(df, 0.7)) == [("a", 0), ("a", 2), ("b", 0)]
    assert ids(detections.suppress(df, 0.7, agnostic=True)) == [("a", 0), ("b", 0)]
    assert ids(detections.filter_detections(df, max_det=1)) == [("a", 0)]
    assert ids(detections.without_overlap(df, df.where("det_id = 0 and image_path = 'a'"))) == [("b", 0)]
    assert xyz.centre_blocks(detections.centres(df)).orderBy("frame").first()["value"].splitlines()[:2] == ["3", "class x y z"]
    detections.write_dataset(df, str(tmp_path / "set"), 100.0, 100.0, {0: "x"}, 0.5)
    assert spark.read.parquet(str(tmp_path / "set/labels")).where("part = 'train'").count() == 1
    images = spark.createDataFrame([("a", bytearray(b"xy"))], "path string, content binary")
    assert detections.predict(images, lambda data: [(len(data), 0.9, 0.0, 0.0, 1.0, 1.0)]).first()["cls"] == 2
    with pytest.raises(ValueError):
        detections.check_hyperparameters({"nonsense": 1})
    assert detections.check_hyperparameters({"bgr": 0.5, "cutmix": 0.1})["lr0"] == 0.01


def test_vision(spark, tmp_path):
    def trainer(dataset, given, epochs, batch, patience, size):
        return (lambda data: [(1, 0.9, 0.0, 0.0, 2.0, 2.0)]), -abs(given["lr0"] - 0.02)

    images = spark.createDataFrame([(f"x/{k}.png", bytearray([k] * 4)) for k in range(10)], "path string, content binary")
    eye = detections.Vision(images, lambda data: [(0, 0.8, 0.0, 0.0, 10.0, 10.0)] if data[0] % 2 else [], trainer)
    for early in (lambda: eye.create_dataset("p", 1, 1, {}), eye.train, eye.tune_hyperparams, lambda: eye.export_prediction_to_xyz("p")):
        with pytest.raises(ValueError):
            early()
    seen = eye.predict()
    assert seen.found.count() == 5
    path = f"file://{tmp_path}/set"
    ready = seen.create_dataset(path, 100.0, 100.0, {0: "ball"})
    detections.export_dataset(spark, path, str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out/images/train").iterdir()) == [f"{k}.png" for k in range(8)] and (tmp_path / "out/images/val/9.png").read_bytes() == bytes([9] * 4)
    assert (tmp_path / "out/labels/train/1.txt").read_text() == "0 0.050000 0.050000 0.100000 0.100000\n" and (tmp_path / "out/labels/train/0.txt").read_text() == ""
    assert (tmp_path / "out/dataset.yaml").read_text().splitlines()[1:] == ["train: images/train", "val: images/val", "nc: 1", "names:", "- ball"]
    with pytest.raises(ValueError):
        ready.train({"nonsense": 1})
    assert ready.train({"lr0": 0.02}).predict().found.select("cls").distinct().first()[0] == 1
    best = ready.tune_hyperparams(40)
    assert abs(best["lr0"] - 0.02) < 0.005 and set(best) == set(detections.HYPERPARAMETERS)
    with pytest.raises(FileNotFoundError):
        eye.set_training_dataset(f"file://{tmp_path}/none")
    seen.export_prediction_to_xyz(str(tmp_path / "d.xyz"))
    assert (tmp_path / "d.xyz").read_text().splitlines()[:3] == ["1", "class x y z", "0 5.000000 5.000000 0.0"]


def test_dumps_carry_the_box(spark, tmp_path):
    from kinetrace.trajectory import Insight, Trajectory

    rows = [(f, p, "C", "C", 1.0 * p, 2.0, 3.0) for f in range(2) for p in range(2)]
    df = spark.createDataFrame(rows, "frame int, particle_id long, name string, type string, x double, y double, z double")
    values = Insight(spark.createDataFrame([(p, f, f + 0.5) for f in range(2) for p in range(2)], "particle_id long, frame int, value double"))
    labels = spark.createDataFrame([(p, f, p - 1) for f in range(2) for p in range(2)], "particle_id long, frame int, label int")
    table = spark.createDataFrame([(0, 10.0, 11.0, 12.0), (1, 20.0, 21.0, 22.0)], "frame int, lx double, ly double, lz double")
    six = "10.00000 11.00000 12.00000 90.00000 90.00000 90.00000"
    for box in ((10.0, 11.0, 12.0), (10.0, 11.0, 12.0, 90.0, 90.0, 90.0), table):
        trj = Trajectory(df, box)
        trj.dump_colored_trj(labels, str(tmp_path / "c"))
        trj.dump_xyz_with_insight([values, values], str(tmp_path / "i"))
        colored, plain = ((tmp_path / x).read_text().splitlines() for x in "ci")
        assert colored[:3] == ["2", f"Lattice={six} Properties=species:S:1:pos:R:3:type:I:1", "C 0.00000 2.00000 3.00000 1"]
        assert plain[:3] == ["2", f'Lattice="{six}" Frame=0', "C 0.00000 2.00000 3.00000 0.50000 0.50000"] and plain[5].endswith("Frame=1")
        assert (box is not table) or plain[5].startswith('Lattice="20.00000 21.00000')
    trj = Trajectory(df)
    trj.dump_xyz_with_insight([values], str(tmp_path / "i"))
    assert (tmp_path / "i").read_text().splitlines()[1] == 'Lattice="0 0 0 0 0 0" Frame=0'
    short = Insight(values.dataset.where("frame = 0"))
    for bad in ([short], [values, short]):
        with pytest.raises(ValueError):
            trj.dump_xyz_with_insight(bad, str(tmp_path / "x"))
    with pytest.raises(ValueError):
        trj.dump_colored_trj(labels.where("frame = 0"), str(tmp_path / "x"))


def test_xyz_is_read_in_splits(spark, tmp_path):
    """Lines find their frame whatever the split; irregular files are parsed whole, with the same rows."""
    from urllib.parse import unquote

    rng = np.random.default_rng(0)
    frames = [[f"C{p} {rng.normal():.3f} {rng.normal():.3f}\t{rng.normal():.3f}  {p}" for p in range(7)] for _ in range(40)]
    text = lambda fs: "".join(f"{len(f)}\na comment\n" + "\n".join(f) + "\n" for f in fs)
    files = {"a": text(frames), "b": text(frames) + "\n \n", "c": text(frames).replace("\n", "\r\n"), "ragged": text([f[: 2 + k % 3] for k, f in enumerate(frames)]), "junk": "note\n" + text(frames[:3]), "gap": text(frames[:2]) + "\n" + text(frames[2:4]), "short": text(frames[:2]).replace(" 3\n", "\n"), "empty": "", "a b": text(frames[:2]), "c d%": "x\n" + text(frames[:2])}
    for name, t in files.items():
        (tmp_path / f"{name}.xyz").write_bytes(t.encode())
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        names = ["name", "x", "y", "z", "ID"]
        got = {}
        for r in xyz.read_xyz(spark, str(tmp_path), names).collect():
            got.setdefault(unquote(r["path"].rsplit("/", 1)[1][:-4]), []).append(tuple(r)[1:])
        for name, t in files.items():
            assert sorted(got.get(name, [])) == sorted(xyz.parse(t, names)), name
        assert len(got["a"]) == 280 and len(got["ragged"]) > 90 and len(got["short"]) == 12
        auto = xyz.read_xyz(spark, str(tmp_path / "a.xyz"), "auto")
        assert auto.columns == ["path", "frame", "row", "name", "x", "y", "z"] and auto.count() == 280
        assert xyz.read_xyz(spark, str(tmp_path / "junk.xyz"), "auto").count() == 21
    finally:
        for k, x in old.items():
            spark.conf.set(k, x)


class Packer:
    """Writes what the reader reads: bits, the highest first."""

    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> k & 1 for k in range(n - 1, -1, -1)]

    def triple(self, abc, n, sizes):
        value = (abc[0] * sizes[1] + abc[1]) * sizes[2] + abc[2]
        while n > 0:
            self.put(value & 255 if n >= 8 else value & ((1 << n) - 1), min(8, n))
            value, n = value >> 8, n - 8

    def bytes(self):
        return np.packbits(np.array(self.bits, np.uint8)).tobytes()


def packed_xtc(numbers, rung, step=1):
    """A frame's packed part: runs of small distances wherever they fit, the rung going up and down."""
    from kinetrace.sources.xtc import LADDER, LOWEST

    low, high = numbers.min(0), numbers.max(0)
    sizes = (high - low + 1).tolist()
    wide, width = max(sizes) > 0xFFFFFF, (sizes[0] * sizes[1] * sizes[2]).bit_length()
    out, at, last, first, turn = Packer(), 0, 0, rung, 0
    while at < len(numbers):
        half = LADDER[rung] // 2
        fits = lambda d: ((d + half >= 0) & (d + half < LADDER[rung])).all()  # noqa: B023, E731
        run, full = [], numbers[at]
        if at + 1 < len(numbers) and fits(numbers[at] - numbers[at + 1]):
            full, run, k = numbers[at + 1], [numbers[at] - numbers[at + 1]], at + 2
            before = numbers[at]
            while len(run) < 8 and k < len(numbers) and fits(numbers[k] - before):
                run.append(numbers[k] - before)
                before, k = numbers[k], k + 1
        if wide:
            for value, size in zip((full - low).tolist(), sizes):
                out.put(value, size.bit_length())
        else:
            out.triple((full - low).tolist(), width, sizes)
        turn += 1
        move = (0, 1, 0, -1)[turn % 4] if LOWEST < rung < len(LADDER) - 2 else 0
        if len(run) != last or move:
            out.put(1, 1)
            out.put(3 * len(run) + move + 1, 5)
            last = len(run)
        else:
            out.put(0, 1)
        for d in run:
            out.triple((d + half).tolist(), rung, [LADDER[rung]] * 3)
        at += max(1, len(run) + 1)
        rung += move
    return low.tolist(), high.tolist(), first, out.bytes()


def xtc_bytes(coords, box, precision=1000.0, rung=20, magic=1995):
    import struct

    data = b""
    for f, a in enumerate(coords):
        n = len(a)
        data += struct.pack(">iiif9f", magic, n, f * 10, f * 0.5, *np.asarray(box, float).ravel()) + struct.pack(">i", n)
        if n <= 9:
            data += struct.pack(f">{3 * n}f", *a.ravel())
        else:
            low, high, first, packed = packed_xtc(np.rint(a * precision).astype(np.int64), rung)
            data += struct.pack(">f7i", precision, *low, *high, first) + struct.pack(">i" if magic == 1995 else ">q", len(packed)) + packed + bytes(-len(packed) % 4)
    return data


def test_xtc(spark, tmp_path):
    from kinetrace.sources import xtc
    from kinetrace.trajectory import Trajectory

    rng = np.random.default_rng(0)
    box = np.diag([3.0, 4.0, 5.0])
    water = np.repeat(rng.uniform(0, 3, (40, 3)), 3, 0) + rng.normal(0, 0.05, (120, 3))  # neighbours stand close together
    for coords, options in (([rng.uniform(0, 3, (7, 3)) for _ in range(4)], {}), ([water + 0.1 * k for k in range(3)], {}), ([water], {"rung": 30}), ([water * 9000], {"precision": 1000.0, "rung": 40}), ([water - 7], {"magic": 2023, "rung": 12})):
        got = list(xtc.parse(xtc_bytes(coords, box, **options)))
        assert [g[0] for g in got] == list(range(len(coords))) and [g[1] for g in got] == [10 * k for k in range(len(coords))]
        for g, a in zip(got, coords, strict=True):
            assert np.abs(g[4] - a).max() <= (1e-3 if len(a) > 9 else 1e-6 * 3) and (g[3] == box).all()
    data = xtc_bytes([water], box)
    for bad in (data[:-8], data[:30], b"nonsense" * 20):
        with pytest.raises(ValueError):
            list(xtc.parse(bad))
    assert xtc.box_of(np.array([[1.0, 0, 0], [0.5, 3**0.5 / 2, 0], [0, 0, 2]])) == pytest.approx((10, 10, 20, 90, 90, 60))
    (tmp_path / "t.xtc").write_bytes(xtc_bytes([water + 0.1 * k for k in range(3)], box))
    atom = lambda k: f"{k // 3 + 1:5d}{'SOL':<5}{('OW', 'HW1', 'HW2')[k % 3]:>5}{k + 1:5d}" + "".join(f"{x:8.3f}" for x in water[k])
    (tmp_path / "t.gro").write_text("\n".join(["a title", " 120", *map(atom, range(120)), "   3.00000   4.00000   5.00000"]) + "\n")
    trj = Trajectory.from_xtc(spark, str(tmp_path / "t.xtc"), str(tmp_path / "t.gro"))
    rows = trj.positions.toPandas().sort_values(["frame", "particle_id"])
    assert len(rows) == 360 and rows["name"].tolist()[:3] == ["OW", "HW1", "HW2"]
    assert np.abs(rows[["x", "y", "z"]].to_numpy().reshape(3, 120, 3)[1] - (water + 0.1) * 10).max() < 0.01
    assert trj.get_coord_number(3.0)[1].dataset.count() == 360 and trj.box.count() == 3
    (tmp_path / "s.gro").write_text("\n".join(["a title", "  2", atom(0), atom(1), "   3.0   4.0   5.0"]) + "\n")
    with pytest.raises(ValueError):
        Trajectory.from_xtc(spark, str(tmp_path / "t.xtc"), str(tmp_path / "s.gro"))


def test_labelling(spark, tmp_path):
    import json
    import threading
    import urllib.error
    import urllib.request

    from kinetrace.sources import labelling

    where = []
    ready = threading.Event()
    server = threading.Thread(target=labelling.label_tool, args=(0, lambda at: (where.append(at), ready.set())), daemon=True)
    server.start()
    assert ready.wait(10)
    assert b"<canvas" in urllib.request.urlopen(where[0]).read()
    for bad in (urllib.request.Request(where[0] + "else"), urllib.request.Request(where[0] + "else", method="POST")):
        with pytest.raises(urllib.error.HTTPError):
            urllib.request.urlopen(bad)
    urllib.request.urlopen(urllib.request.Request(where[0] + "stop", method="POST"))
    server.join(10)
    assert not server.is_alive()
    box = {"cls": 1, "x1": 10.0, "y1": 20.0, "x2": 30.0, "y2": 60.0}
    rows = [{"image_path": "a.png", "width": 100, "height": 200, "names": ["x", "y"], "boxes": [box]}, {"image_path": "b.png", "width": 100, "height": 200, "names": ["x", "y"], "boxes": []}]
    (tmp_path / "labels.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows))
    found = labelling.read_labels(spark, str(tmp_path / "labels.jsonl"))
    assert [f.split()[0] for f in detections.DETECTIONS.split(", ")] == found.columns and tuple(found.first()) == ("a.png", 0, 1, 1.0, 10.0, 20.0, 30.0, 60.0)
    assert detections.yolo_lines(found, 100.0, 200.0).first()["lines"] == "1 0.200000 0.200000 0.200000 0.200000"
    assert labelling.label_names(spark, str(tmp_path / "labels.jsonl")) == {0: "x", 1: "y"}


def test_large_groups_may_be_linked(spark):
    from kinetrace.operators import tracking

    rng = np.random.default_rng(0)
    old = rng.uniform(0, 1, (45, 3))
    order = rng.permutation(45)
    new = old[order] + 1e-3
    with pytest.raises(ValueError):
        tracking.link_step(old, new, 2.0, None, None)
    linked = tracking.link_step(old, new, 2.0, None, None, largest=None)
    assert [linked[j] for j in range(45)] == order.tolist()


def test_harmonics_add_up():
    from kinetrace.operators import soap

    u = np.random.default_rng(0).normal(size=(9, 3))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    for l, y in enumerate(soap.harmonics(u, 8)):
        c = np.zeros(l + 1)
        c[l] = (2 * l + 1) / (4 * np.pi)
        assert y.T @ y == pytest.approx(np.polynomial.legendre.legval(u @ u.T, c), abs=1e-12)


def test_onion_of_vectors_follows_the_covariance(spark):
    """Two tilted, touching clouds that boxes along the axes can't part."""
    from kinetrace.operators import onion

    rng = np.random.default_rng(1)
    tilt = np.array([[1.0, 0.95], [0.95, 1.0]])
    a = np.stack([rng.multivariate_normal(((0, 0), (2, -2))[p % 2], tilt, 60) for p in range(30)])
    states, labels = onion.onion(from_array(spark, a), 1, 20, 3.0, smooth=True)
    got = labels.where("label >= 0").toPandas()
    assert len(got) > 0.95 * 1800 and np.sign(states[0].sigma[0][1]) == 1 and states[0].sigma[0][1] / states[0].sigma[0][0] > 0.7
    pure = got.groupby("label")["particle_id"].agg(lambda x: max((x % 2).mean(), 1 - (x % 2).mean()))
    assert (pure > 0.98).all() and sum(s.perc for s in states) > 0.95
    assert len(onion.onion(from_array(spark, a), 1, 20, 3.0, smooth=True, max_states=1)[0]) == 1
