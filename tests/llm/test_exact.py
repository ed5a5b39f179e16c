"""Operators with an exact contract, against plain Python."""

import hashlib
import itertools
import re
import zlib
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kinetrace.llm import common, fm, jaccard, media, mixing, packing, quality, store, substring
from kinetrace.llm.components import components
from kinetrace.llm.encode import CachedEncoder, encoder, vocabulary

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLIP, BYTE = vocabulary("word_bpe_49k.json"), vocabulary("byte_bpe_50k.json")


def words(t):
    return WORD.findall(t or "")


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize(("path", "drops"), [(CLIP, True), (BYTE, False)])
def test_encoder_equals_the_library(path, drops):
    rng = np.random.default_rng(0)
    parts = ["a", "B", "é", "É", " ", "  ", "\n", "\t", "'s", "'LL", "1", "23", "!", "|", "\xa0", "\x1c", "́", "Σ", "<|endoftext|>", "\r\n", "。", "\U0001f600", "×", "—", "word"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 25))) for _ in range(3000)] + [""]
    e = CachedEncoder(path, drops, max_units=50)
    got = e.encode([t.encode() for t in texts])
    assert all(list(g) == w.ids for g, w in zip(got, e.tokenizer.encode_batch(texts, add_special_tokens=False), strict=True))


@pytest.mark.parametrize(("path", "drops"), [(CLIP, True), (BYTE, False)])
def test_encoder_tokenizes_a_piece_once_while_it_is_met(path, drops):
    """A cache that is full goes on from the last one, so pieces of every text aren't tokenized again."""
    e, calls = CachedEncoder(path, drops, max_units=50), []
    library = e.tokenizer
    e.tokenizer = SimpleNamespace(encode=library.encode, model=SimpleNamespace(tokenize=lambda text: (calls.append(text), library.model.tokenize(text))[1]))
    texts = [" ".join(["common words, again", *(f"{chr(97 + k % 26)}{chr(97 + k // 26)}{'xyz'[j]}" for j in range(3))]) for k in range(400)]
    for k in range(0, 400, 10):
        got = e.encode([t.encode() for t in texts[k : k + 10]])
        assert [g.tolist() for g in got] == [e.tokenizer.encode(t, add_special_tokens=False).ids for t in texts[k : k + 10]]
        assert len(e.cache) <= 2 * 50
    assert len(calls) == len(set(calls)) > 1000


def test_encoder_by_words():
    """Words between white space of every kind, with signs, digits and capitals at their borders, give the library's ids."""
    rng = np.random.default_rng(3)
    parts = [chr(k) for k in [*range(128), *range(0xC0, 0x100)]] + ["the", "Don't", "we'LL", "É", "...", "<|", "12a"] * 9 + [" "] * 40
    texts = ["".join(rng.choice(parts, rng.integers(0, 60))) for _ in range(2000)] + ["", " ", "\n\t ", " a ", "x" * 5000]
    e = CachedEncoder(CLIP, True, max_units=200)
    got = [g for k in range(0, len(texts), 97) for g in e.encode([t.encode() for t in texts[k : k + 97]])]
    assert all(g.dtype == "<u2" and g.tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids for g, t in zip(got, texts, strict=True))


def area_mean(image, height, width):
    """Mean over each cell of a grid, pixel by pixel, with exact fractions."""
    from fractions import Fraction as Q

    h, w = image.shape
    part = lambda n, m, i, k: max(Q(0), min(Q(k + 1), Q((i + 1) * n, m)) - max(Q(k), Q(i * n, m)))  # noqa: E731 - of pixel k in cell i
    rows = [[part(h, height, i, k) for k in range(h)] for i in range(height)]
    cols = [[part(w, width, i, k) for k in range(w)] for i in range(width)]
    size = Q(h, height) * Q(w, width)
    return [[sum(r * c * int(image[y, x]) for y, r in enumerate(ry) if r for x, c in enumerate(cx) if c) / size for cx in cols] for ry in rows]


def test_media(spark, docs, rows, empty):
    got = media.stored(docs).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    for i, t, *_ in rows:
        raw, r = (t or "").encode(), by[i]
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        data = (media.encode_bmp if zlib.crc32(payload) & 1 else media.encode_pgm)(payload)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(data), hashlib.sha256(data).hexdigest())
        if len(payload) > 6400:
            continue
        image = np.frombuffer(payload, np.uint8).reshape(-1, 64)
        dark = area_mean(image, 8, 9)
        bits = "".join("1" if a < b else "0" for row in dark for a, b in itertools.pairwise(row))
        assert r["feature"] == f"{int(bits, 2):016x}"
        tile = np.array([[float(x) for x in row] for row in area_mean(image, 16, 16)])
        assert abs(r["tile_mean"] - np.rint(tile).mean()) < 0.1
        file = np.lib.format.MAGIC_PREFIX + media.npy_tile(image)[6:]
        assert hashlib.sha256(file).hexdigest() == r["tile_sha256"] and np.abs(np.load(__import__("io").BytesIO(file)) - tile).max() <= 0.5 + 1e-6
    assert media.stored(empty).count() == 0
    again = media.stored(spark.createDataFrame([(1, "x" * 70), (1, "x" * 70), (None, "x" * 70), (2, None), (3, "")], "doc_id long, text string")).drop("doc_id").distinct().collect()
    assert len(again) == 2


def test_media_formats(spark):
    a = np.random.default_rng(0).integers(0, 256, (5, 8)).astype(np.uint8)
    assert (media.decode(media.encode_pgm(a.tobytes(), 8)) == a).all() and (media.decode(media.encode_bmp(a.tobytes(), 8)) == a).all()
    assert media.decode(b"P2 # c\n2 2\n9\n1 2\n3 4").tolist() == [[1, 2], [3, 4]]
    assert media.decode(b"P1\n3 1\n1 0 1").tolist() == [[0, 1, 0]] and media.decode(b"P4\n3 1\n\xa0").tolist() == [[0, 1, 0]]
    assert media.decode(b"P6\n1 1\n255\nabc").shape == (1, 1, 3) and media.decode(b"P3\n1 1\n255\n1 2 3").shape == (1, 1, 3)
    assert media.decode(b"P5\n1 1\n65535\n\x01\x02").tolist() == [[258]]
    assert media.area_resize(a.astype(float), 5, 8) == pytest.approx(a)
    x = media.area_resize(a.astype(float), 3, 3)
    assert x.mean() == pytest.approx(a.mean()) and media.area_resize(a.astype(float), 1, 1)[0, 0] == pytest.approx(a.mean())
    df = spark.createDataFrame([(1, bytearray(b"nonsense")), (2, None), (3, bytearray(media.encode_pgm(a.tobytes(), 8)))], "doc_id long, media binary")
    r = {x["doc_id"]: x for x in media.media_features(df).collect()}
    assert r[1]["error"] and r[2]["error"] and r[3]["payload"] == a.tobytes() and r[3]["tile"][:6] == b"\x93NUMPY"


clip = lambda texts: encoder(CLIP, True).encode(texts)  # noqa: E731 - workers don't have this module


def test_store(spark, docs, rows, empty, tmp_path):
    path = f"file://{tmp_path}/store"
    store.write_store(docs, clip, 2, path)
    made = store.open_store(spark, path)
    got = {r["doc_id"]: r for r in store.read_digests(made).collect()}
    back = {r["doc_id"]: np.frombuffer(r["ids"], "<u2").tolist() for r in store.read_documents(made).collect()}
    at = 0
    for i, t, *_ in sorted(rows):
        ids = [*encoder(CLIP, True).tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (at, len(ids), crc(ids)) and back[i] == ids
        at += len(ids)
    assert sorted(x.name for x in (tmp_path / "store").iterdir() if x.is_dir()) == ["kind=chunks", "manifest", "recipes"]
    assert made.chunks.count() == made.chunks.select("key").distinct().count()
    assert made.manifest.where("part = -1").first()["n_tokens"] == at
    assert store.read_digests(store.write_store(empty, clip, 2)).count() == 0
    assert store.read_documents(store.write_store(empty, clip, 2)).count() == 0


def test_store_of_repeated_rows(spark, rows):
    """Equal and different texts under one id, null ids, empty streams."""
    made = [(5, "b c"), (5, "a"), (5, "a"), (None, "z"), (None, None), (None, ""), (1, ""), (1, None), *[(3, t) for _, t, *_ in rows[:12]], *[(4, "same words " * 300)] * 9]
    docs = spark.createDataFrame(made, "doc_id long, text string").repartition(4)
    for end in (2, None):
        kept = store.write_store(docs, clip, end)
        ids = {t: [*encoder(CLIP, True).tokenizer.encode(t or "", add_special_tokens=False).ids, *[end] * (end is not None)] for _, t in made}
        got = store.read_digests(kept).collect()
        assert sorted((repr(r["doc_id"]), r["n_tokens"], r["ids_crc32"]) for r in got) == sorted((repr(i), len(ids[t]), crc(ids[t])) for i, t in made)
        by = sorted(got, key=lambda r: (r["start"], r["n_tokens"]))
        assert [r["start"] for r in by] == [0, *itertools.accumulate(r["n_tokens"] for r in by)][:-1]
        assert [r["doc_id"] is not None for r in by if r["n_tokens"]] == sorted(r["doc_id"] is not None for r in by if r["n_tokens"])
        assert sorted((repr(r["doc_id"]), r["start"], bytes(r["ids"])) for r in store.read_documents(kept).collect()) == sorted((repr(i), s, np.array(x, "<u2").tobytes()) for i, s, x in [(r["doc_id"], r["start"], next(ids[t] for j, t in made if j == r["doc_id"] and len(ids[t]) == r["n_tokens"] and crc(ids[t]) == r["ids_crc32"])) for r in got])


def test_store_is_verified(spark, docs, tmp_path):
    from pyspark.sql import functions as F

    path = f"file://{tmp_path}/store"
    made = store.write_store(docs, clip, 2, path)
    assert made.manifest.inputFiles() and made.manifest.where("part >= 0").count() == made.recipes.select("part").distinct().count()
    first = made.recipes.orderBy("part", "row").first()
    long = made.recipes.where("length(keys) > 64").orderBy("part", "row").first()
    here = (F.col("part") == long["part"]) & (F.col("row") == long["row"])
    swapped = F.concat(F.expr("substring(keys, 33, 32)"), F.expr("substring(keys, 1, 32)"), F.expr("substring(keys, 65)"))
    for bad in (
        made.recipes.where(f"part <> {first['part']} or row <> 0"),  # a dropped recipe
        made.recipes.where(F.col("part") != first["part"]),  # a missing part
        made.recipes.union(made.recipes.limit(1)),  # an extra one
        made.recipes.withColumn("keys", F.when(here, swapped).otherwise(F.col("keys"))),  # swapped chunks
        made.recipes.withColumn("doc_id", F.col("doc_id") + 1),
        made.recipes.withColumn("n_tokens", F.when(here, F.col("n_tokens") + 1).otherwise(F.col("n_tokens"))),
        made.recipes.withColumn("rest", F.when(here, F.reverse("rest")).otherwise(F.col("rest"))),
    ):
        for read in (store.read_digests, store.read_documents):
            with pytest.raises(ValueError, match="manifest"):
                read(store.Store(made.chunks, bad, made.manifest))
    key = made.chunks.first()["key"]
    for bad in (made.chunks.where(F.col("key") != key), made.chunks.union(made.chunks.limit(1)), made.chunks.withColumn("key", F.when(F.col("key") == key, F.lit(b"x")).otherwise(F.col("key")))):  # missing, extra, renamed
        with pytest.raises(ValueError, match="manifest"):
            store.read_digests(store.Store(bad, made.recipes, made.manifest))
    changed = made.chunks.withColumn("ids", F.reverse(F.hex("ids")).cast("binary"))
    for read in (store.read_digests, store.read_documents):
        with pytest.raises(Exception, match="match its key"):
            read(store.Store(changed, made.recipes, made.manifest)).collect()
    anew = lambda c, r: store.Store(c, r, spark.createDataFrame(store.manifest(store.Store(c, r, None)), store.MANIFEST))
    longer = made.recipes.withColumn("n_tokens", F.when(here, F.col("n_tokens") + 1).otherwise(F.col("n_tokens")))
    for read in (store.read_digests, store.read_documents):  # a manifest made anew hides neither wrong lengths nor missing chunks
        with pytest.raises(Exception, match="add up"):
            read(anew(made.chunks, longer)).collect()
        with pytest.raises(Exception, match="missing"):
            read(anew(made.chunks.where(F.col("key") != key), made.recipes)).collect()
    next((tmp_path / "store" / "recipes").glob("*.parquet")).unlink()  # a lost file
    with pytest.raises(ValueError, match="manifest"):
        store.read_digests(store.open_store(spark, path))


def test_chunk_marks_equal_the_plain_sum():
    for n in (0, 1, 2, 15, 16, 17, 100, store.BLOCK, store.BLOCK + 1, 3 * store.BLOCK - 5):
        ids = np.random.default_rng(n).integers(0, 50000, n).astype("<u2")
        g = store.mix64(ids.astype(np.uint64) + np.uint64(1))
        h = sum((np.concatenate([np.zeros(min(k, n), np.uint64), g[: max(n - k, 0)]]) << np.uint64(k) for k in range(16)), np.zeros(n, np.uint64))
        for mean in (3, 256):
            assert (store.chunk_marks(ids, mean) == np.flatnonzero(store.mix64(h) % np.uint64(mean) == 0) + 1).all()


def test_gathered():
    parts = [pa.RecordBatch.from_arrays([pa.array(range(k, k + n))], ["a"]) for k, n in ((0, 3), (3, 0), (3, 5), (8, 1), (9, 40), (49, 2))]
    for size in (1, 60, 1 << 20):
        got = list(common.gathered(iter(parts), size))
        assert [x for b in got for x in b.column(0).to_pylist()] == list(range(51)) and all(b.nbytes >= size for b in got[:-1]) and all(b.num_rows for b in got)
    assert list(common.gathered(iter(parts[1:2]), 1)) == []


def test_chunks_and_merkle():
    ids = np.random.default_rng(0).integers(0, 50000, 5000).astype("<u2")
    ends = store.cut_points(store.chunk_marks(ids), 0, 5000)
    sizes = np.diff([0, *ends])
    assert ends[-1] == 5000 and sizes.max() <= store.MOST and (sizes[:-1] >= store.LEAST).all()
    moved = np.concatenate([ids[:7], ids])
    cut = lambda x: {x[a:b].tobytes() for a, b in itertools.pairwise([0, *store.cut_points(store.chunk_marks(x), 0, len(x))])}
    assert len(cut(ids) & cut(moved)) > 0.7 * len(cut(ids))
    a, b = b"some bytes", b"and more of them" * 9
    assert int(store.crc_shift(np.array([zlib.crc32(a)], np.uint32), np.array([len(b)]))[0]) ^ zlib.crc32(b) == zlib.crc32(a + b)
    leaves = [bytes([k]) * 32 for k in range(5)]
    assert store.merkle(leaves) != store.merkle(leaves[::-1]) and store.merkle(leaves[:1]) == leaves[0]


def test_packing(spark, docs, rows, empty):
    got = packing.pack(docs).collect()
    by, seq = {}, {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
        seq.setdefault(r["sequence_id"], []).append(r)
    for i, t, *_ in rows:
        ids, at = [*encoder(BYTE, False).tokenizer.encode(t or "", add_special_tokens=False).ids, 0], 0
        for r in sorted(by[i], key=lambda r: r["piece"]):
            assert r["start"] == at and r["ids_crc32"] == crc(ids[at : at + r["length"]])
            at += r["length"]
        assert at == len(ids) and len(by[i]) == -(-len(ids) // 2048)
    for group in seq.values():
        at = 0
        for r in sorted(group, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    packed = packing.sequences(docs, lambda t: encoder(BYTE, False).encode(t), 0, spark.createDataFrame(got)).collect()
    assert {r["sequence_id"]: len(r["ids"]) // 4 for r in packed} == {k: sum(r["length"] for r in g) for k, g in seq.items()}
    assert packing.pack(empty).count() == 0


def test_own_tables_have_no_checksum_files(spark, docs):
    """A checksum file beside each file, and a process for the mode of both, is what Hadoop's default makes."""
    from pathlib import Path

    made = common.materialize(docs.repartition(3))
    names = [p.name for p in Path(made.written_to.removeprefix("file://")).rglob("*")]
    assert sum(n.startswith("part-") for n in names) == 3 and not [n for n in names if n.endswith(".crc")]
    assert made.count() == docs.count()


@pytest.mark.parametrize("query", [packing.pack, substring.remove_repeats])
def test_small_results_are_written(spark, docs, query):
    """Whoever reads the result runs none of the stages that made it."""
    got = query(docs)
    assert got.inputFiles() and "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_each_core_frees_its_executor(spark):
    spark.sparkContext.setJobGroup("freed", "")
    common.free_executors(spark)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    told = spark.sparkContext.statusTracker()
    stages = [told.getStageInfo(s) for j in told.getJobIdsForGroup("freed") for s in told.getJobInfo(j).stageIds]
    assert [(s.numTasks, s.numFailedTasks) for s in stages] == [(spark.sparkContext.defaultParallelism, 0)]


def test_packing_of_repeated_rows(spark):
    made = [(1, "a b")] * 7 + [(1, "c d e")] * 3 + [(None, "x")] * 5 + [(None, None), (2, ""), (2, ""), (3, "word " * 5000), (3, "word " * 5000)]
    got = packing.pack(spark.createDataFrame(made, "doc_id long, text string").repartition(3)).collect()
    ids = {t: [*encoder(BYTE, False).tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for _, t in made}
    want = []
    for i, t in made:
        at = 0
        for k, n in enumerate(packing.cut_lengths(len(ids[t]))):
            want.append((repr(i), k, at, n, crc(ids[t][at : at + n])))
            at += n
    assert sorted((repr(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)
    seats = sorted((r["sequence_id"], r["offset"], r["length"]) for r in got)
    at, now = 0, None
    for s, o, n in seats:
        at, now = (0 if s != now else at), s
        assert o == at and o + n <= 2048
        at += n


def test_patterns():
    assert len(packing.full_patterns(12)) == sum(1 for a in range(1, 13) for b in range(a + 1) for c in range(b + 1) if a + b + c == 12)
    rng = np.random.default_rng(0)
    least = lambda h: -(-int((h * np.arange(len(h))).sum()) // (len(h) - 1))
    for n, mean in ((0, 50), (1, 50), (30, 50), (3000, 50), (3000, 400), (20000, 900), (20000, 15)):
        h = np.bincount(np.minimum(rng.geometric(1 / mean, n), 2048), minlength=2049)
        packed, used = packing.plan(h), np.zeros(2049, int)
        for lengths, many in packed:
            assert sum(lengths) <= 2048 and many > 0
            np.add.at(used, list(lengths), many)
        assert (used == h).all()
        assert sum(m for _, m in packed) <= 1.02 * least(h) + 1
    for n in (1, 9, 17, 128, 129, 700, 1024, 2048):  # as few as there can be
        h = np.zeros(2049, np.int64)
        h[n] = 10_000
        assert sum(m for _, m in packing.plan(h)) == -(-10_000 // (2048 // n))
    parts = packing.full_patterns(6)
    j, x = packing.nnls(parts, np.array([0, 2.0, 1.0, 0, 1.0, 1.0, 3.0]))
    fit = np.zeros(7)
    for k, v in zip(j, x, strict=True):
        np.add.at(fit, parts[k], v)
    assert (x > 0).all() and fit[1:] == pytest.approx([2, 1, 0, 1, 1, 3], abs=1e-6)


def removed(rows):
    seen, out = set(), {}
    for i, t, *_ in sorted(rows):
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            key = tuple(w[k : k + 20])
            if key in seen:
                gone[k : k + 20] = [True] * 20
            seen.add(key)
        out[i] = (len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest())
    return out


def test_substring_dedup(spark, docs, rows, empty):
    want = removed(rows)
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.remove_repeats(docs).collect()} == want
    assert sum(x[1] > 0 for x in want.values()) > 5
    kept = substring.strip_repeats(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, (n, g, _) in want.items() if not n or g < n}
    assert all(hashlib.sha256(" ".join(words(r["text"])).encode()).hexdigest() == want[r["doc_id"]][2] for r in kept.collect())
    assert substring.remove_repeats(empty).count() == 0 and substring.strip_repeats(empty).count() == 0


@pytest.mark.parametrize("hot", [4096, 2])
def test_substring_dedup_with_repeated_rows(spark, rows, hot):
    import random

    from pyspark.sql import functions as F

    rng = random.Random(3)
    prose = lambda k: " ".join(rng.choice("abcdefgh") * rng.randint(1, 9) + str(rng.randint(0, 9)) for _ in range(k))
    line = "one line of six common words and more of it"
    twice, short, passage = prose(60), prose(7), prose(35)
    made = [(i, t) for i, t, *_ in rows] + [(i, t) for i, t, *_ in rows[:9]]  # equal rows
    made += [(1, twice), (1, twice), (1, twice + " "), (2, twice), (2, prose(40)), (2, short), (2, short), (7, f"{prose(5)} {passage}"), (7, f"{passage} {prose(5)}")]  # equal and different texts under one id
    made += [(None, twice), (None, twice), (None, None), (8, None), (8, None), (9, ""), (9, "")]
    made += [(2000 + k, f"{prose(30)} {line} {prose(30)}") for k in range(40)] + [(3000 + k, f"{passage} {line} {prose(9)}") for k in range(8)]  # a minimizer in many texts
    docs = spark.createDataFrame([(i, t, len(t or ""), "x", k) for k, (i, t) in enumerate(made)], "doc_id long, text string, n_chars long, spans string, th int").repartition(5)
    with_hash = [(r[0], r[1], r[2]) for r in docs.select("doc_id", F.xxhash64("text"), "text").collect()]
    known = sorted(((i, h), t or "") for i, h, t in with_hash if i is not None)
    want, seen = [], set()
    for (i, _), t in known:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            key = tuple(w[k : k + 20])
            if key in seen:
                gone[k : k + 20] = [True] * 20
            seen.add(key)
        want.append((i, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest()))
    want += [(None, len(words(t)), 0, hashlib.sha256(" ".join(words(t)).encode()).hexdigest()) for i, _, t in with_hash if i is None]
    got = [tuple(r) for r in substring.remove_repeats(docs, hot).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and sum(0 < g < n for _, n, g, _ in want) > 10
    kept = substring.strip_repeats(docs, hot)
    assert kept.schema == docs.schema
    assert sorted((repr(r["doc_id"]), hashlib.sha256(" ".join(words(r["text"])).encode()).hexdigest()) for r in kept.collect()) == sorted((repr(i), s) for i, n, g, s in want if not n or g < n)


def test_fm_index():
    rng = np.random.default_rng(0)
    for n, s in ((50, 3), (400, 4), (2000, 30)):
        t = rng.integers(1, s + 1, n)
        t[::37] = 0
        q = rng.integers(1, s + 2, 60)
        q[:20] = t[5:25]
        got, flat = fm.FMIndex(t).matching_statistics(q, 12), " " + " ".join(map(str, t)) + " "
        for e in range(60):
            k = 0
            while k < 12 and k <= e and 0 not in q[e - k : e + 1] and f" {' '.join(map(str, q[e - k : e + 1]))} " in flat:
                k += 1
            assert got[e] == k
    assert fm.FMIndex(np.array([5, 6, 7, 8])).report(np.array([1, 6, 7, 8, 6, 7]), 2) == [(1, 6)]
    parts = [rng.integers(1, 4, rng.integers(1, 30)) for _ in range(60)]
    length = np.array([len(p) for p in parts])
    text = np.concatenate([x for p in parts for x in (p, [0])])
    seen, want = set(), set()
    for k, p in enumerate(parts):
        for at in range(len(p) - 4):
            if tuple(p[at : at + 5]) in seen:
                want.add((k, at))
            seen.add(tuple(p[at : at + 5]))
    which, place = fm.FMIndex(text, 5).earlier(text, np.cumsum(length + 1) - 1, length)
    assert list(zip(which, place, strict=True)) == sorted(want)


def shingle_sets(rows):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = {}
    for i, t, *_ in rows:
        w = words((t or "").translate(low))
        out[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    return out


def near_components(sets):
    """doc_id: least doc_id reachable. sets: (doc_id, set) in any number."""
    root = {i: i for i, _ in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for (a, x), (b, y) in itertools.combinations(sets, 2):
        if a != b and x and y and 100 * len(x & y) >= 75 * len(x | y):
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    return {i: find(i) for i in root}


def test_jaccard(spark, docs, rows, empty):
    sets = shingle_sets(rows)
    comps = near_components(list(sets.items()))
    want = {i: (len(s), comps[i]) for i, s in sets.items()}
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_groups(docs).collect()} == want
    assert len({c for _, c in want.values()}) < len(want)
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {c for _, c in want.values()}
    assert jaccard.near_groups(empty).count() == 0


@pytest.mark.parametrize("small", [False, True])
def test_jaccard_with_repeated_rows(spark, rows, small, monkeypatch):
    if small:  # lists in blocks, hubs in parts, shards and hot shingles from the start
        for name, value in (("BLOCK", 3), ("HUB", 2), ("PER_SHARD", 10), ("HOT_CLASS", 4)):
            monkeypatch.setattr(jaccard, name, value)
    import random

    rng = random.Random(5)
    prose = lambda k: " ".join(rng.choice("abcdefgh") * rng.randint(1, 9) + str(rng.randint(0, 9)) for _ in range(k))
    one, two, three, line = prose(60), prose(60), prose(80), prose(9)
    near = lambda t: " ".join("changed" if k == 20 else w for k, w in enumerate(t.split()))
    made = [(i, t) for i, t, *_ in rows] + [(i, t) for i, t, *_ in rows[:7]]
    made += [(901, one), (902, near(one)), (902, two), (903, near(two)), (903, ""), (904, two), (905, three), (905, three), (906, near(three)), (906, near(three))]
    made += [(None, one), (None, one), (None, None), (907, None), (908, "")]
    made += [(1000 + k, f"{line} {prose(12)}") for k in range(25)] + [(1100 + k, f"{line} few more {k % 3}") for k in range(9)]  # one shingle in many prefixes
    docs = spark.createDataFrame(made, "doc_id long, text string").repartition(4)
    sets = [(i, shingle_sets([(0, t)])[0]) for i, t in made]
    comps = near_components([x for x in sets if x[0] is not None])
    want = [(repr(i), len(s), comps.get(i)) for i, s in sets]
    assert comps[903] == comps[902] == comps[901] == 901 and comps[904] == 901
    assert sorted((repr(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in jaccard.near_groups(docs).collect()) == sorted(want, key=lambda r: (r[0], r[1]))
    kept = jaccard.keep_one(docs)
    assert sorted(map(repr, kept.collect())) == sorted(map(repr, (r for r in docs.collect() if r["doc_id"] is None or comps[r["doc_id"]] == r["doc_id"])))


def test_meetings():
    rng = np.random.default_rng(0)
    for n in (2, 30, 200):
        ns = np.sort(rng.integers(1, 60, n))
        comp, ids, rest, side = rng.integers(0, 9, n), rng.permutation(n), rng.integers(1, 60, n), rng.integers(0, 2, n)
        for sides in (side, np.full(n, -1)):
            for old in (0, n // 2):
                got = np.concatenate(list(jaccard.meetings(comp, sides, ids, ns, rest, old, 64)))
                want = {tuple(sorted((ids[x], ids[y]))) for y in range(old, n) for x in range(y) if comp[x] != comp[y] and (sides[x] < 0 or sides[x] != sides[y]) and 100 * ns[x] >= 75 * ns[y] and 175 * min(rest[x], rest[y]) >= 75 * (ns[x] + ns[y])}
                assert len(got) == len(set(map(tuple, got))) and want <= set(map(tuple, got))
                assert all(175 * min(rest[ids == p][0], rest[ids == q][0]) >= 75 * (ns[ids == p][0] + ns[ids == q][0]) for p, q in got)


def test_orders_and_signatures():
    rng = np.random.default_rng(0)
    classes = rng.integers(0, 3, 1 << jaccard.CELL_BITS).astype(np.uint8)
    apart = 0
    for _ in range(200):
        n = int(rng.integers(1, 1500 if _ % 10 == 0 else 120))
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) > 0.1], rng.integers(0, 1 << 63, int(n * 0.1), dtype=np.uint64)]))
        assert jaccard.signature_distance(jaccard.signature(a), jaccard.signature(b)) <= len(np.setxor1d(a, b))
        size = lambda x: (x % np.uint64(40)).astype(np.int64)
        marks = lambda x, k: jaccard.prefix_marks(x, size(x), k)
        if len(b) and jaccard.linked(a, b):
            assert len(np.intersect1d(jaccard.prefix(a, classes), jaccard.prefix(b, classes)))
            assert all(jaccard.share(marks(a, k), len(a), marks(b, k), len(b)) for k in (1, 2))
        c = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        apart += not all(jaccard.share(marks(a, k), len(a), marks(c, k), len(c)) for k in (1, 2))
    assert apart > 100
    words = b"Some words and SOME words and some more words"
    found, size = jaccard.measured(words)
    assert len(found) == 5 and sorted(size.tolist()) == sorted(len(b"".join(g)) for g in {tuple(words.lower().split()[k : k + 5]) for k in range(5)})


def test_components(spark):
    rng = np.random.default_rng(1)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 200, (150, 2))] + [(k, k + 1) for k in range(300, 420)] + [(500, 500 + k) for k in range(1, 50)]
    root = {}

    def find(a):
        root.setdefault(a, a)
        while root[a] != a:
            a = root[a]
        return a

    for a, b in links:
        if a != b:
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {a: find(a) for a in root}


def test_quality_statistics(spark, docs, rows, empty):
    got = {r["doc_id"]: r for r in quality.quality_rules(docs).collect()}
    for i, t, *_ in rows:
        w, t = words(t), t or ""
        lines = [x for x in t.split("\n") if WORD.search(x)]
        grams = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        cover = {p for k, g in enumerate(grams) if grams.count(g) > 1 for p in range(k, k + 5)} if len(w) < 5000 else set()
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover))
        assert r["base_failed"] == (len(w) < 10 or 100 * len(cover) > 20 * len(w)) and not (r["base_failed"] and r["kept"])
    assert quality.quality_rules(empty).count() == 0


def test_outliers_are_rejected(spark):
    rng = np.random.default_rng(0)
    text = lambda k: " ".join("".join(rng.choice(list("abcdefgh"), rng.integers(3, 8))) for _ in range(k))
    rows = [(i, text(80), "en", "a") for i in range(300)] + [(1000 + i, text(80).replace(" ", "### "), "en", "a") for i in range(30)]
    r = {x["doc_id"]: x["kept"] for x in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert sum(r[i] for i in range(300)) >= 299 and not any(r[i] for i in range(1000, 1030))
    # a tight cluster of a fifth of the group draws all moments towards itself; one start isn't misled
    far = [(2000 + i, text(80).replace(" ", "## ", 40 + i % 3), "de", "a") for i in range(70)] + [(3000 + i, text(80), "de", "a") for i in range(280)]
    r = {x["doc_id"]: x for x in quality.quality_rules(spark.createDataFrame(far, "doc_id long, text string, lang string, source string")).collect()}
    assert sum(r[3000 + i]["kept"] for i in range(280)) >= 278 and not any(r[2000 + i]["kept"] for i in range(70))
    assert min(r[2000 + i]["mahalanobis2"] for i in range(70)) > quality.CUTOFF
    odd = [(1, None, None, None), (1, None, None, None), (None, "a b c", None, "a"), (2, "", "en", None), (3, "word " * 100_000, "en", "a"), (4, " \n", "en", "a")]
    r = quality.quality_rules(spark.createDataFrame(odd, "doc_id long, text string, lang string, source string")).collect()
    assert len(r) == 6 and all(x["base_failed"] and not x["kept"] for x in r) and max(x["n_words"] for x in r) == max(x["n_repeat_words"] for x in r) == 100_000
    plan = quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_mixing(spark, docs, rows, empty):
    got = mixing.calibrated(docs).collect()
    assert len(got) == len(rows) and all(0 < r["probability"] <= 1 for r in got)
    assert {r["doc_id"]: r["tokens"] for r in got} == {i: len(words(t)) + 1 for i, t, *_ in rows}
    kept = mixing.mix(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in got if r["kept"]}
    assert mixing.calibrated(empty).count() == 0


def test_sketch_reaches_the_driver_compressed(spark, monkeypatch):
    texts = [" ".join(f"w{k * j % 997}" for j in range(1, 120)) for k in range(1, 40)]
    parts = jaccard.set_digests(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).where("sketch").select("block", "counts")
    made, real = [], jaccard.in_arrow
    monkeypatch.setattr(jaccard, "in_arrow", lambda *a: made.append(real(*a)) or made[-1])
    classes = jaccard.classes_of(parts)
    assert made[-1].agg(F.sum(F.octet_length("counts"))).first()[0] < 1 << 20
    counts = np.bincount(np.concatenate([jaccard.cells(jaccard.shingles(t.encode())) for t in texts]), minlength=len(classes))
    assert (classes == counts).all() and counts.max() < 128


def brute_targets(tokens, power, budget):
    """By value: budget of all tokens by share ** power, values that fall short give all."""
    names, t = list(tokens), np.array(list(tokens.values()), float)
    p, full = t**power, np.zeros(len(t), bool)
    while True:
        want = np.where(full, t, p * ((budget * t.sum() - t[full].sum()) / p[~full].sum() if (~full).any() else 0))
        if not (over := (want > t) & ~full).any():
            return dict(zip(names, want, strict=True))
        full |= over


def brute_rake(cells, wants, rounds, budget):
    """cells: {(source, lang, topic): tokens}."""
    t = np.array(list(cells.values()), float)
    w = t * budget
    for _ in range(rounds):
        for k, m in enumerate(mixing.MARGINS):
            for value, want in wants[m].items():
                mine = np.array([c[k] == value for c in cells])
                has, full = w[mine].sum(), mine & (w >= t)
                if want <= has:
                    w[mine] *= want / has
                elif (mine & ~full).any():
                    w[mine & ~full] *= (want - w[full].sum()) / (has - w[full].sum())
                w = np.minimum(w, t)
    return dict(zip(cells, w / t, strict=True))


def test_mixing_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    vocabulary = [[f"w{k}x{j}" for j in range(40)] for k in range(4)]
    rows = [(i, " ".join(rng.choice(vocabulary[int(rng.choice(4, p=[0.6, 0.2, 0.15, 0.05]))], 60)), str(rng.choice(["en", "de", "fr"], p=[0.7, 0.25, 0.05])), str(rng.choice(["a", "b", "c", "d"], p=[0.7, 0.2, 0.08, 0.02]))) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = mixing.calibrated(docs).collect()
    cells = {}
    for r in got:
        key = (r["source"], r["lang"], r["topic"])
        cells[key] = cells.get(key, 0) + r["tokens"]
    wants = {}
    for k, m in enumerate(mixing.MARGINS):
        sums = {}
        for c, t in cells.items():
            sums[c[k]] = sums.get(c[k], 0) + t
        wants[m] = brute_targets(sums, mixing.POWERS[m], mixing.BUDGET)
    chance = brute_rake(cells, wants, mixing.ROUNDS, mixing.BUDGET)
    for r in got:
        p = chance[r["source"], r["lang"], r["topic"]]
        assert r["probability"] == pytest.approx(p, abs=1e-9)
        assert r["kept"] == (int(hashlib.md5(str(r["doc_id"]).encode()).hexdigest()[:8], 16) / 2**32 < r["probability"])
    assert any(r["probability"] == 1 for r in got)
    for r in mixing.reached(spark.createDataFrame(got)).collect():
        assert r["expected"] == pytest.approx(r["target"], rel=0.01) and r["target"] == pytest.approx(wants[r["margin"]][r["value"]])


def test_topics_are_learned(spark):
    """Texts of two languages on three subjects: clusters follow the subject, not the language."""
    rng = np.random.default_rng(4)
    common = {"en": [f"the{k}" for k in range(20)], "de": [f"der{k}" for k in range(20)]}
    subject = [[f"s{k}word{j}" for j in range(15)] for k in range(3)]
    rows, of = [], {}
    for i in range(300):
        lang, of[i] = ("en", "de")[i % 2], int(rng.integers(0, 3))
        rows.append((i, " ".join([*rng.choice(common[lang], 40), *rng.choice(subject[of[i]], 40)]), lang, "a"))
    rows += [(900, None, "en", "a"), (901, " ", None, None)]
    got = {r["doc_id"]: r["topic"] for r in mixing.cells_of(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert got[900] == got[901] == "none"
    pure = sum(max(sum(got[i] == t and of[i] == s for i in of) for s in range(3)) for t in set(got.values()))
    assert pure > 0.95 * len(of) and len({got[i] for i in of}) >= 3


@pytest.mark.skipif(not __import__("os").path.isdir("/root/testdata/sf0.01"), reason="needs the test tables")
def test_mixing_reaches_its_marginals(spark):
    rows = mixing.materialize(mixing.calibrated(mixing.documents(spark, "/root/testdata/sf0.01")))
    found = mixing.reached(rows).collect()
    assert all(r["expected"] == pytest.approx(r["target"], rel=0.01) for r in found) and len(found) > 25
    assert sum(r["expected"] for r in found if r["margin"] == "lang") == pytest.approx(mixing.BUDGET * rows.agg({"tokens": "sum"}).first()[0], rel=0.01)


def test_raking_reaches_its_targets(spark):
    cells = spark.createDataFrame([("a", "x", 100), ("a", "y", 50), ("b", "x", 10), ("b", "y", 40)], "source string, lang string, tokens long")
    want = {"source": spark.createDataFrame([("a", 100.0), ("b", 100.0)], "source string, want_source double"), "lang": spark.createDataFrame([("x", 120.0), ("y", 80.0)], "lang string, want_lang double")}
    r = mixing.rake(cells, want, 30, bounded=False).collect()
    assert sum(x["w"] for x in r if x["source"] == "a") == pytest.approx(100, abs=1e-6) and sum(x["w"] for x in r if x["lang"] == "x") == pytest.approx(120, abs=1e-6)
    odds = {(x["source"], x["lang"]): x["w"] for x in r}
    assert odds["a", "x"] * odds["b", "y"] / odds["a", "y"] / odds["b", "x"] == pytest.approx(100 * 40 / 50 / 10)
