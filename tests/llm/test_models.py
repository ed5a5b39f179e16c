"""Trained operators: gradients, held-out accuracy, and odd inputs."""

import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from kinetrace.llm import langid, nbsvm, toxicity
from kinetrace.llm.queries import ORACLE_SQL, QUERIES

DIR = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the test tables")


def fold(i, m):
    return zlib.crc32(str(i).encode()) % m


def test_subwords_never_cross_words():
    words = ["abc", "d", "été"]
    bucket, owner = toxicity.subwords(words)
    for k, w in enumerate(words):
        assert sorted(bucket[owner == k]) == sorted(toxicity.subwords([w])[0])
    start, doc = toxicity.segments(np.array([0, 32, 33]))
    assert start.tolist() == [0, 0, 32, 64] and doc.tolist() == [0, 1, 2, 2]


def test_toxicity_sees_misspellings(spark):
    rng = np.random.default_rng(0)
    clean = lambda k: " ".join("".join(rng.choice(list("lmnoprst"), 5)) for _ in range(k))
    texts = [clean(60) for _ in range(300)]
    y = np.arange(300) % 5 == 0
    texts = [f"{t} horrible {clean(5)}" if bad else t for t, bad in zip(texts, y, strict=True)]
    m = toxicity.fit(texts, y.astype(int))
    s = m.score([f"{clean(500)} horrible {clean(500)}", f"{clean(30)} horribble {clean(30)}", clean(900), "", "!!!"])
    assert s[0] > 0.5 and s[1] > s[2] and s[2] < 0.5 and s[3] == s[4] < 0.5
    for labels in (np.zeros(3, int), np.ones(3, int), np.zeros(0, int)):
        assert ((toxicity.fit(["a"] * len(labels), labels).score(["x"]) >= 0.5) == (len(labels) > 0 and labels[0] == 1)).all()


def test_toxicity_reads_every_passage():
    rng = np.random.default_rng(1)
    lengths = np.array([0, 5, 32, 33, 90, 300])
    starts, doc = toxicity.segments(lengths, 1)
    assert starts.tolist() == [s + k for s, n in zip(np.cumsum(lengths) - lengths, lengths, strict=True) for k in range(max(n - 31, 1))]
    ends = np.minimum(starts + 32, np.cumsum(lengths)[doc])
    hot = np.flatnonzero(rng.random(lengths.sum()) < 0.1)
    some, of = toxicity.changing(hot, lengths)
    sets = lambda s, d: {(int(k), *hot[(hot >= a) & (hot < min(a + 32, lengths[: k + 1].sum()))].tolist()) for a, k in zip(s, d, strict=True)}
    assert sets(some, of) == sets(starts, doc) and len(some) < len(starts)
    value = rng.normal(size=lengths.sum())
    assert np.allclose(toxicity.sums(value, starts, ends), [value[a:b].sum() for a, b in zip(starts, ends, strict=True)])

    clean = lambda k: " ".join("".join(rng.choice(list("lmnoprst"), 5)) for _ in range(k))
    pair = lambda at: f"{clean(at)} horrible {clean(3)} dreadful {clean(70 - at)}"
    lone = lambda at, w: f"{clean(at)} {w} {clean(70 - at)}"
    y = np.arange(600) % 6 == 0  # toxic: two insults close together; some clean ones hold one
    texts = [pair(int(rng.integers(0, 60))) if bad else lone(int(rng.integers(0, 60)), ("horrible", "dreadful")[k % 2]) if k % 12 < 3 else clean(72) for k, bad in enumerate(y)]
    m = toxicity.fit(texts, y.astype(int))
    held = [pair(at) for at in range(60)] + [lone(at, w) for at in range(60) for w in ("horrible", "dreadful")]
    assert ((m.score(held) >= 0.5) == (np.arange(180) < 60)).all()
    assert len(m.score([])) == 0


def test_toxicity_gradients():
    rng = np.random.default_rng(0)
    params = (rng.normal(0, 0.5, (9, 3)), rng.normal(0, 0.5, (3, 2)), rng.normal(0, 0.5, 2))
    gram, part, passage = rng.integers(0, 9, 60), rng.random(60), rng.integers(0, 7, 60)
    labels, weight = rng.integers(0, 2, 7), rng.random(7)
    _, *found = toxicity.gradients(params, gram, part, passage, labels, weight)
    for k, g in enumerate(found):
        for at in np.ndindex(g.shape):
            loss = []
            for step in (1e-5, -1e-5):
                moved = [p.copy() for p in params]
                moved[k][at] += step
                loss.append(toxicity.gradients(tuple(moved), gram, part, passage, labels, weight)[0])
            assert (loss[0] - loss[1]) / 2e-5 == pytest.approx(g[at], rel=1e-4, abs=1e-7)


def test_dual_descent_meets_its_conditions():
    rng = np.random.default_rng(0)
    rows = [np.unique(rng.integers(0, 40, 12)) for _ in range(60)]
    good = np.array([(r < 20).mean() > 0.5 for r in rows])
    w, b = nbsvm.dual_descent(rows, good, np.ones(1 << nbsvm.BITS), cost=1.0, sweeps=400)
    margin = np.array([w[r].sum() + b for r in rows]) * np.where(good, 1, -1)
    assert (margin > 0).mean() > 0.95 and margin.min() < 1.01
    for labels in (np.zeros(3, int), np.ones(3, int), np.zeros(0, int)):
        assert ((nbsvm.fit([b"a"] * len(labels), labels).score([b"x", b""]) >= 0.3) == (not len(labels) or labels[0] == 1)).all()


def test_recurrent_gradients():
    rng = np.random.default_rng(0)
    p = {k: a.astype(np.float64) for k, a in langid.start(3).items()}
    x, size, y, w = rng.integers(0, 256, (langid.WIDTH, 5)).astype(np.uint8), np.array([48, 20, 48, 1, 30]), np.array([0, 1, 2, 1, 0]), np.ones(5)
    _, g = langid.gradients(p, x, size, y, w)
    for k in p:
        i = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        loss = []
        for e in (1e-3, -1e-3):
            q = {**p, k: p[k].copy()}
            q[k][i] += e
            loss.append(langid.gradients(q, x, size, y, w)[0])
        assert (loss[0] - loss[1]) / 2e-3 == pytest.approx(g[k][i], rel=1e-3, abs=1e-6)


def test_windows():
    x, size, owner = langid.windows([b"", b"a" * 48, b"b" * 49])
    assert size.tolist() == [48, 48, 1] and owner.tolist() == [1, 2, 2] and x.shape == (48, 3)


def test_odd_texts(spark, docs, empty):
    names, p = langid.fit([b"the cat and the hat " * 5, b"der hund und die katze " * 5], ["en", "de"], steps=30)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !?"), (4, "the the and"), (4, "the the and"), (None, "und die"), (2, "² ½ ①"), (3, "12 _ ٣")], "doc_id long, text string")
    got = langid.language_scores(odd, names, p).collect()
    assert sorted(r["lang_pred"] for r in got if r["doc_id"] in (1, 2, 3)) == ["und"] * 5 and len(got) == 8
    assert all(0 <= r["score"] <= 1 for r in got) and all(r["lang_pred"] in names for r in got if r["doc_id"] == 4)
    assert all(r["lang_pred"] == "und" for r in langid.language_scores(odd, [], {}).collect())
    tox, good = toxicity.fit([], np.zeros(0, int)), nbsvm.fit([], np.zeros(0, int))
    for out in (toxicity.toxicity_scores(odd, tox), nbsvm.quality_scores(odd, good)):
        assert out.count() == 8 and all(0 <= r["score"] <= 1 for r in out.collect())
    assert toxicity.toxicity_scores(empty, tox).count() == nbsvm.quality_scores(empty, good).count() == langid.language_scores(empty, names, p).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    kept = toxicity.reject_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == docs.count()


@needs_tables
@pytest.mark.parametrize(("name", "label", "rare"), [("op8_toxicity", "toxic", 1), ("op9_quality_classifier", "quality", 0)])
def test_held_out_labels(spark, name, label, rare):
    """Of the rarer class nine in ten are found, of the other at most one in fifty is taken for it."""
    d = DIR.replace("sf0.01", "sf0.1")
    got = QUERIES[name](spark, d).toPandas()
    truth = spark.read.parquet(f"{d}/labels.parquet").toPandas()
    assert len(got) == spark.read.parquet(f"{d}/documents.parquet").count()
    assert (got["held_out"] == [fold(i, 5) == 0 for i in got["doc_id"]]).all()
    both = got.merge(truth, on="doc_id")
    both = both[both["held_out"]]
    right = both["predicted"] == both[label]
    assert right[both[label] == rare].mean() >= 0.9 and (~right[both[label] != rare]).mean() <= 0.02


@needs_tables
def test_held_out_languages(spark):
    got = QUERIES["op10_language_id"](spark, DIR).toPandas().merge(spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "lang").toPandas(), on="doc_id")
    assert (got["held_out"] == [fold(i, 4) == 2 for i in got["doc_id"]]).all()
    held = got[got["held_out"]]
    assert (held["lang_pred"] == held["lang"]).mean() > 0.97


@needs_tables
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    d = "/root/testdata/sf0.001"
    c.sql(f"create view documents as select * from '{d}/documents.parquet'")
    got, want = QUERIES[name](spark, d).toPandas(), c.sql(ORACLE_SQL[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    rows = lambda x: sorted(map(repr, x[cols].astype(object).itertuples(index=False, name=None)))
    assert rows(got) == rows(want)


@needs_tables
def test_pipeline_equals_brute_force(spark):
    """Each stage on what its predecessor left, against plain Python."""
    import corpus_pipeline as p
    import hashlib

    from kinetrace.llm import mixing, packing
    from kinetrace.llm.encode import encoder, vocabulary

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    names = [n for n, _ in p.STAGES]
    assert names == ["toxicity", "near_copies", "repeats", "mixture", "packing"]
    stages = dict(p.STAGES)
    rows = lambda df: {r["doc_id"]: r for r in df.collect()}
    before = rows(docs)

    model = toxicity.trained(docs, spark.read.parquet(f"{d}/labels.parquet"))
    ids = list(before)
    scores = dict(zip(ids, naive_toxicity(model, [before[i]["text"] or "" for i in ids]), strict=True))
    docs = p.materialize(stages["toxicity"](spark, docs, d))
    after = rows(docs)
    assert after == {i: r for i, r in before.items() if scores[i] < 0.5} and 0 < len(before) - len(after) < 0.3 * len(before)

    before, low = after, str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    word = re.compile(r"[^\x20\x09-\x0D]+")
    sets = {}
    for i, r in before.items():
        w = word.findall((r["text"] or "").translate(low))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    docs = p.materialize(stages["near_copies"](spark, docs, d))
    after = rows(docs)
    assert after == {i: r for i, r in before.items() if find(i) == i} and len(after) < len(before)

    before, seen, want = after, set(), {}
    for i in sorted(before):
        text = before[i]["text"] or ""
        w = word.findall(text)
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            if tuple(w[k : k + 20]) in seen:
                gone[k : k + 20] = [True] * 20
            seen.add(tuple(w[k : k + 20]))
        if not any(gone):
            want[i] = before[i]["text"]
        elif not all(gone):
            want[i] = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
    docs = p.materialize(stages["repeats"](spark, docs, d))
    after = rows(docs)
    assert {i: r["text"] for i, r in after.items()} == want and all(r["n_chars"] == len(r["text"]) for i, r in after.items() if r["text"] != before[i]["text"])

    before = after
    chance = {r["doc_id"]: r["probability"] for r in mixing.calibrated(docs).collect()}
    docs = p.materialize(stages["mixture"](spark, docs, d))
    after = rows(docs)
    draw = lambda i: int(hashlib.md5(str(i).encode()).hexdigest()[:8], 16) / 2**32
    assert after == {i: r for i, r in before.items() if draw(i) < chance[i]} and len(after) > 0.6 * len(before)

    got = stages["packing"](spark, docs, d).collect()
    bpe = encoder(vocabulary("byte_bpe_50k.json"), False).tokenizer
    want = []
    for i, r in after.items():
        ids, at = [*bpe.encode(r["text"] or "", add_special_tokens=False).ids, 0], 0
        for k, n in enumerate(packing.cut_lengths(len(ids))):
            want.append((i, k, at, n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes())))
            at += n
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)
    at, now = 0, None
    for s, o, n in sorted((r["sequence_id"], r["offset"], r["length"]) for r in got):
        at, now = (0 if s != now else at), s
        assert o == at and o + n <= 2048
        at += n
    assert len({r["sequence_id"] for r in got}) <= 1.02 * sum(n for *_, n, _ in want) / 2048 + 1
    columns = [x.name for x in spark.read.parquet(f"{d}/documents.parquet").schema]
    assert docs.columns == columns
    run = p.run(spark, d).collect()
    assert sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in run) == sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in got)


def naive_toxicity(model, texts):
    """Score by plain loops: n-grams of each word, every run of words, the most toxic one."""
    out = []
    for text in texts:
        value = []
        for w in toxicity.words_of(text):
            marked, grams = f"<{w}>", []
            for n in toxicity.SIZES:
                for k in range(len(marked) - n + 1):
                    h = 0
                    for c in marked[k : k + n]:
                        h = (h * 0x100000001B3 + ord(c)) % (1 << 64)
                    grams.append(int(toxicity.mix64(np.array([h + n], np.uint64))[0]) % toxicity.BUCKETS)
            value.append(sum(model.bucket_score[g] for g in grams) / max(1, len(grams)))
        runs = [sum(value[k : k + toxicity.SEGMENT]) for k in range(max(1, len(value) - toxicity.SEGMENT + 1))]
        out.append(1 / (1 + np.exp(-np.clip(model.bias + max(runs) / toxicity.SEGMENT, -30, 30))))
    return out


def test_scores_equal_plain_loops():
    rng = np.random.default_rng(0)
    model = toxicity.Toxicity(rng.normal(size=toxicity.BUCKETS), -0.3)
    texts = ["", "one", "!!", "été B2 x", " ".join("".join(rng.choice(list("abcdé"), 4)) for _ in range(90)), "aa " * 200]
    assert model.score(texts) == pytest.approx(naive_toxicity(model, texts), rel=1e-9)

    weight = rng.normal(size=1 << nbsvm.BITS)
    quality = nbsvm.Quality(weight, 0.2, 1.5, -0.1)
    size = 1 << nbsvm.BITS
    for text in (b"", b"a", b"The cat sat. the CAT sat.\nThe cat\nthe cat\nThe cat", "été d'été".encode() * 30):
        found = set()
        low = bytes(c + 32 if 65 <= c <= 90 else c for c in text)
        for k in range(len(low) - 2):
            found.add(((low[k] << 16 | low[k + 1] << 8 | low[k + 2]) * 0x9E3779B1 >> 7) % size)
        hashes, *_ = nbsvm.word_hashes(text, lower=True)
        assert len(hashes) == len(text.split())
        found |= {int(h) % size for h in hashes} | {int(h) % size for h in nbsvm.gram_hashes(hashes, 2)}
        lines = [x for x in text.split(b"\n") if x.strip()]
        fives = [tuple(hashes[k : k + 5].tolist()) for k in range(len(hashes) - 4)]
        share = lambda part, whole: 0 if not part else 10 - min(9, int(np.log2(whole / part)))
        for k, r in enumerate((share(len(lines) - len(set(lines)), len(lines)), share(int((hashes[1:] == hashes[:-1]).sum()), len(hashes)), share(len(fives) - len(set(fives)), len(fives)), min(len(hashes), 40) // 4)):
            found.add((0x51ED270B * (16 * k + r + 1) >> 3) % size)
        margin = sum(weight[f] for f in found) + 0.2
        assert quality.score([text])[0] == pytest.approx(1 / (1 + np.exp(-np.clip(1.5 * margin - 0.1, -30, 30))), rel=1e-9)


def test_recurrent_prediction_equals_plain_loops():
    p = langid.start(3, 1)
    k = langid.HIDDEN
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    texts = [b"the cat and the hat", b"x" * 70, "été".encode()]

    def states(data, d):
        h, out = np.zeros(k), {}
        for t in range(langid.WIDTH) if d == "f" else range(langid.WIDTH - 1, -1, -1):
            x, u = p[f"x{d}"][:, data[t]], p[f"u{d}"] @ h
            r, z = sigmoid(x[:k] + u[:k]), sigmoid(x[k : 2 * k] + u[k : 2 * k])
            m = np.tanh(x[2 * k :] + r * (u[2 * k :] + p[f"n{d}"][:, 0]))
            h = m + z * (h - m)
            out[t] = h
        return out

    got = langid.predict(["a", "b", "c"], p, texts)
    for text, row in zip(texts, got, strict=True):
        total = np.zeros(3)
        for at in range(0, len(text), langid.WIDTH):
            part = text[at : at + langid.WIDTH]
            data = part + bytes(langid.WIDTH - len(part))
            f, b = states(data, "f"), states(data, "b")
            for t in range(len(part)):
                z = p["v"] @ np.concatenate([f[t], b[t]]) + p["c"][:, 0]
                total += np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert row == pytest.approx(total / len(text), abs=1e-4)


def test_rejected_documents(spark):
    """The stage drops what the model calls toxic and nothing else, row by row: repeated ids, nulls, empty and long texts."""
    rng = np.random.default_rng(2)
    clean = lambda k: " ".join("".join(rng.choice(list("lmnoprst"), 5)) for _ in range(k))
    bad = lambda k: f"{clean(k)} horrible {clean(3)} dreadful {clean(k)}"
    rows = [(i, bad(20) if i % 5 == 0 else clean(43)) for i in range(400)]
    rows += [(1000, bad(9)), (1000, clean(20)), (1001, bad(4000)), (1002, clean(8000)), (1003, None), (1004, ""), (None, clean(9)), (None, bad(9)), (1005, bad(3)), (1005, bad(3))]
    docs = spark.createDataFrame([(i, t, len(t or ""), 1.0) for i, t in rows], "doc_id long, text string, n_chars long, score double")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(400)] + [(500, None), (None, 1)], "doc_id long, toxic int")
    kept = toxicity.reject_toxic(docs, labels)
    toxic = lambda t: "horrible" in (t or "") and "dreadful" in t
    assert kept.schema == docs.schema and sorted(map(repr, kept.collect())) == sorted(repr(r) for r in docs.collect() if not toxic(r["text"]))


def test_sample_is_bounded(spark):
    from kinetrace.llm.learn import labelled_sample

    docs = spark.createDataFrame([(i, f"t{i}") for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2 if i % 7 else None) for i in range(200)], "doc_id long, toxic int")
    s = labelled_sample(docs, labels, "toxic", 5, 0, 20)
    assert len(s) == 20 and not any(fold(i, 5) == 0 or i % 7 == 0 for i in s["doc_id"])
    assert pa.array(s["text"]).null_count == 0
    twice = docs.unionByName(spark.createDataFrame([(i, f"a{k}") for i in s["doc_id"] for k in range(3)], "doc_id long, text string"))
    again = labelled_sample(twice, labels, "toxic", 5, 0, 20)  # the least text of an id
    assert sorted(again["doc_id"]) == sorted(s["doc_id"]) and (again["text"] == "a0").all()
    assert len(labelled_sample(docs, labels, "toxic", 5, 0, 20, limit=30)) < 11
