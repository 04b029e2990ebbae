"""Fingerprints, language, archives, nearest neighbours and the pipeline."""

from __future__ import annotations

import base64
import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from signalmill.llm import langid, posting_lists, simhash, warc
from signalmill.llm.components import connected_components
from tests.llm import cases


def brute_fingerprint(text: str, size: int = 4) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps: dict) -> dict:
    roots = {k: k for k in fps}

    def root(k):
        while roots[k] != k:
            k = roots[k]
        return k

    keys = sorted(fps)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= 4:
                x, y = sorted((root(a), root(b)))
                roots[y] = x
    return {k: root(k) for k in fps}


def test_op6(spark, sf, tmp_path):
    for folder in (sf, cases.as_table(spark, cases.frame(spark).where("doc_id is not null and length(text) < 100000 or text is null"), tmp_path / "odd")):
        docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").where("doc_id is not null").collect()}
        fps = {k: brute_fingerprint(t) for k, t in docs.items()}
        roots = brute_components(fps)
        got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op6_simhash(spark, folder).collect() if r.doc_id is not None}
        assert got == {k: (f"{fps[k]:016x}", roots[k]) for k in docs}


def test_hot_buckets_are_tiled_without_losing_links(spark):
    draw = random.Random(1)
    base = draw.getrandbits(64)
    made = {base}
    while len(made) < 300:  # a chain of close ones that share many segments
        made.add(random.Random(len(made)).choice(sorted(made)) ^ (1 << draw.randrange(64)) ^ (1 << draw.randrange(20)))
    made |= {draw.getrandbits(64) for _ in range(50)}
    signed = [x - (1 << 64) if x >> 63 else x for x in sorted(made)]
    nodes = spark.createDataFrame([(x,) for x in signed], "fp long")
    got = {r.node: r.root for r in connected_components(simhash.links(nodes, hot=16)).collect()}
    want = brute_components({x: x & (1 << 64) - 1 for x in signed})
    assert {k: v for k, v in want.items() if list(want.values()).count(v) > 1} == got


def test_one_of_each_group_stays(spark):
    after = simhash.without_near_duplicates(cases.frame(spark))
    assert after.columns == cases.frame(spark).columns
    left = Counter(r.doc_id for r in after.select("doc_id").collect())
    assert left[6] == 1 and left[7] == 0 and left[0] == 1 and left[1] == 0
    assert simhash.without_near_duplicates(cases.empty(spark)).count() == 0


def test_components_of_chains_and_cycles(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 102), (102, 101), (101, 100), (7, 7), (200, 201), (200, 201)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100, 200: 200, 201: 200}


def test_op3(spark, tmp_path):
    folder = "/root/testdata/sf0.01"
    got = langid.op3_langid(spark, folder).toPandas()
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang", "text").toPandas()
    both = got.merge(docs, on="doc_id")
    assert len(both) == len(docs) and both["held_out"].mean() > 0.1
    held = both[both["held_out"] & both["lang"].notna() & (both["lang_pred"] != "und")]
    assert (held["lang_pred"] == held["lang"]).mean() > 0.95
    assert both["score"].between(0, 1).all()
    odd = cases.as_table(spark, cases.frame(spark), tmp_path / "odd")
    shown = defaultdict(set)
    for r in langid.op3_langid(spark, odd).collect():
        shown[r.doc_id].add(r.lang_pred)
    assert shown[0] == shown[1] == shown[2] == shown[19] == {"und"} and shown[10] <= {"en", "fr"}
    none = cases.as_table(spark, cases.empty(spark), tmp_path / "none")
    assert langid.op3_langid(spark, none).count() == 0


def test_a_text_is_the_mean_over_its_characters(spark):
    """Windows and batches against the network run over each text by itself."""
    from signalmill.llm.gru import ByteNetwork

    draw, random_text = np.random.default_rng(1), random.Random(6)
    net = ByteNetwork(["a", "b", "c"], 8)
    for part in (net.ahead.p, net.behind.p, net.p):
        for name in part:
            part[name] = draw.normal(0, 0.5, part[name].shape).astype(np.float32)
    texts = ["", "12 34", "a", "été", "word " * 7, "x" * 224, "y" * 225, "ñandú 日本語 " * 90, "".join(random_text.choice("abc é") for _ in range(5000)), None or "Z"]
    for text, got in zip(texts, langid.probabilities(net, texts), strict=True):
        if not any(map(str.isalpha, text)):
            assert got is None
            continue
        data = text.encode()
        count, body = langid.cuts(len(data))
        padded = bytes(langid.MARGIN) + data + bytes(count * body - len(data) + langid.MARGIN)
        sums = np.zeros(3)
        for k in range(count):
            window = np.frombuffer(padded[k * body : k * body + body + 2 * langid.MARGIN], np.uint8)[None]
            ahead, behind = net.ahead.run(window)[0][:, 0], net.behind.run(window[:, ::-1])[0][::-1, 0]
            scores = np.concatenate([ahead, behind], 1) @ net.p["v"] + net.p["c"]
            p = np.exp(scores) / np.exp(scores).sum(1, keepdims=True)
            for i in range(body):
                at = k * body + i
                if at < len(data) and data[at] & 0xC0 != 0x80:
                    sums += p[langid.MARGIN + i]
        assert np.allclose(got, sums / len(text), atol=1e-4) and abs(got.sum() - 1) < 1e-3


def test_op3_without_labels_and_with_ties(spark, tmp_path):
    bare = cases.frame(spark).withColumn("lang", F.lit(None).cast("string"))
    folder = cases.as_table(spark, bare, tmp_path / "bare")
    got = langid.op3_langid(spark, folder).collect()
    assert len(got) == bare.count() and {(r.lang_pred, r.score) for r in got} == {("und", 0.0)}
    same = spark.createDataFrame([(i, "the very same words", label) for i in range(40) for label in ("b", "a")], "doc_id long, text string, lang string")
    shown = {r.lang_pred for r in langid.predict(same, langid.fitted(same)).collect()}
    assert len(shown) == 1 and shown <= {"a", "b"}
    assert langid.training_sample(same, documents=5, rows=6).groupby("label").size().max() <= 3


def test_network_learns_through_time():
    from signalmill.llm.gru import ByteNetwork, Direction

    draw = np.random.default_rng(0)
    unit = Direction(3, draw)
    unit.p = {k: v.astype(np.float64) for k, v in unit.p.items()}
    data, up = draw.integers(0, 256, (2, 5)).astype(np.uint8), draw.normal(size=(5, 2, 3))
    _, saved = unit.run(data, True)
    grads = unit.back(data, saved, up)
    for name, place in (("u", (1, 4)), ("b", (7,)), ("table", (int(data[0, 2]), 2))):
        value, h = unit.p[name], 1e-2
        kept = value[place]
        value[place] = kept + h
        high = (unit.run(data)[0] * up).sum()
        value[place] = kept - h
        low = (unit.run(data)[0] * up).sum()
        value[place] = kept
        assert abs((high - low) / (2 * h) - grads[name][place]) < 1e-2
    made = [bytes(draw.choice([97, 98, 99], 6)) for _ in range(300)]
    net = ByteNetwork(["even", "odd"], 6).fit(made, np.array([s[0] % 2 for s in made]), epochs=80)
    assert np.mean([net.positions(np.frombuffer(s, np.uint8)[None]).sum(0)[0].argmax() == s[0] % 2 for s in made]) > 0.8


def pages(spark):
    made = [(5, "http://a/1", "<p>same</p>"), (3, "http://a/2", "<p>same</p>"), (9, None, None), (2, "u", ""), (7, "u v\r\n", "é" * 100_000), (3, "http://a/2", "<p>same</p>"), (None, "n", "<p>same</p>"), (11, "x", "only")]
    return spark.createDataFrame([(*r, "z") for r in made], "page_id long, url string, html string, digest string")


def test_op7(spark, sf, tmp_path):
    def brute(rows):
        least = {}
        for k, html in rows:
            if k is not None:
                least[html] = min(k, least.get(html, k))
        out, seen = Counter(), set()
        for k, html in rows:
            data = (html or "").encode()
            first = least.get(html)
            is_first = k == first and (k, html) not in seen
            seen.add((k, html))
            out[k, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if is_first or first is None else "revisit", None if is_first else first] += 1
        return out

    odd, none = tmp_path / "odd", tmp_path / "none"
    pages(spark).write.parquet(f"{odd}/pages.parquet")
    pages(spark).limit(0).write.parquet(f"{none}/pages.parquet")
    for folder in (sf, odd, none):
        rows = [(r.page_id, r.html or "") for r in spark.read.parquet(f"{folder}/pages.parquet").collect()]
        got = warc.op7_warc(spark, str(folder)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
        assert Counter(map(tuple, got)) == brute(rows)


def test_archive_has_one_frame_for_each_record(tmp_path):
    import io

    made = [warc.record(i, f"http://x/{i}", b"<p>%d</p>" % i * 20, "D", None, False) for i in range(30)]
    out = io.BytesIO()
    assert warc.write_archive(out, iter(made)) == 30
    data = out.getvalue()
    assert int.from_bytes(data[:4], "little") == warc.DICTIONARY_FRAME and data.count(b"\x28\xb5\x2f\xfd") >= 30
    assert list(warc.read_archive(io.BytesIO(data), piece=7)) == made


def test_every_file_is_read_by_a_task_of_its_own(spark, sf, tmp_path):
    import public_tokenizers

    from signalmill.llm import token_planes

    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
    manifest = warc.write_warc(spark.read.parquet(f"{sf}/pages.parquet"), f"file://{tmp_path}/warc", partitions=7)
    assert manifest.count() == 7
    tasks = warc.read_warc(manifest).select(F.spark_partition_id().alias("task"), "page_id").groupBy("task").count().count()
    assert tasks == 7
    ids = token_planes.write_ids(spark.read.parquet(f"{sf}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), f"file://{tmp_path}/ids", partitions=5)
    assert token_planes.read_ids(ids).select(F.spark_partition_id().alias("task")).distinct().count() == 5


def test_small_payloads_are_never_revisits(spark, tmp_path):
    made = warc.read_warc(warc.write_warc(pages(spark), f"file://{tmp_path}/warc", least_bytes=8)).collect()
    assert {r.page_id: r.record_type for r in made if r.page_id in (2, 9)} == {2: "response", 9: "response"}
    assert {r.page_id: r.refers_to for r in made if r.payload_bytes == 11 and r.page_id == 5} == {5: 3}


def test_pages_are_read_three_times_and_the_manifest_is_not_a_file_for_each_archive(spark, sf, tmp_path):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    manifest = warc.write_warc(pages.mapInArrow(counted, pages.schema), f"file://{tmp_path}/warc", partitions=7)
    assert manifest.count() == 7 and manifest.rdd.getNumPartitions() == 1
    assert reads.value == 3 * pages.count()  # for digests, for the ranges of keys, for the archives


def brute_nearest(rows, k):
    usable = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float) != 0)]
    size = Counter(len(v) for _, v in usable).most_common(1)[0][0]
    usable = [(i, v) for i, v in usable if len(v) == size]
    out = {}
    for q, x in usable:
        if q % 20 == 0:
            out[q] = sorted((-float((x * v).sum()), i) for i, v in {(i, tuple(v)): (i, v) for i, v in usable}.values() if i != q)[:k]
    return out


def test_op9_finds_the_nearest(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    want = brute_nearest(rows, 20)
    got = defaultdict(list)
    for r in posting_lists.op9_posting_lists(spark, sf).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    hits = sum(len({i for _, i in want[q]} & {i for i, _ in got[q]}) for q in want)
    assert got.keys() == want.keys() and hits / (20 * len(want)) >= 0.9 and all(len(v) == 20 for v in got.values())


def test_op9_on_many_lists_and_awkward_vectors(spark, monkeypatch):
    draw = np.random.default_rng(2)
    centers = draw.normal(size=(30, 16))
    vectors = (centers[draw.integers(0, 30, 3000)] + 0.3 * draw.normal(size=(3000, 16))) * draw.uniform(0.5, 3, (3000, 1))
    made = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    made += [(i, made[40][1]) for i in range(4000, 4100)] + [(40, made[40][1])]
    made += [(5000, None), (5020, [0.0] * 16), (5040, [float("nan")] * 16), (5060, [1.0, None] * 8), (5080, [1.0]), (None, [1.0] * 16), (5100, [float("inf")] * 16)]
    df = spark.createDataFrame([(*r, 1) for r in made], "vec_id long, embedding array<double>, list int")
    monkeypatch.setattr(posting_lists, "LIST", 64)
    want = brute_nearest(made, 20)
    got = defaultdict(list)
    for r in posting_lists.nearest(df, F.col("vec_id") % 20 == 0, tile_rows=50, tile_queries=16).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert got.keys() == want.keys()
    hits = sum(len({i for _, i in want[q]} & {i for i, _ in got[q]}) for q in want)
    assert hits / sum(map(len, want.values())) >= 0.9
    assert [i for i, _ in got[40]] == [i for _, i in want[40]]  # ties by key
    assert posting_lists.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    few = posting_lists.nearest(df.where("vec_id in (20, 21, 22)"), F.col("vec_id") == 20)
    assert sorted(r.vec_id for r in few.collect()) == [21, 22]


def test_op9_counts_distinct_keys_of_a_vector(spark):
    shared, other = [1.0, 2.0, 0.5], [0.5, 0.1, 0.2]
    made = [(i, shared) for i in range(30)] * 2 + [(0, shared)] * 30 + [(i, other) for i in range(40, 70)]
    df = spark.createDataFrame(made, "vec_id long, embedding array<double>").repartition(3)
    want = brute_nearest(made, 20)
    got = defaultdict(list)
    for r in posting_lists.nearest(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    assert got == {q: [i for _, i in found] for q, found in want.items()}


def shingles(text: str, size: int = 5) -> frozenset:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return frozenset(" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))) if words else frozenset()


def check_similar(texts: dict, kept: set) -> None:
    """No two similar texts stay, and what went resembles a text of its group.
    Fingerprints leave a margin on both sides of 0.8."""
    sets = {k: shingles(t or "") for k, t in texts.items()}
    alike = lambda a, b: len(sets[a] & sets[b]) / max(1, len(sets[a] | sets[b])) if sets[a] or sets[b] else 1.0
    holders = defaultdict(set)
    for k, own in sets.items():
        for x in own or {""}:
            holders[x].add(k)
    near = {k: {o: alike(k, o) for x in own or {""} for o in holders[x] if o != k} for k, own in sets.items()}
    assert not [(a, b) for a in kept for b, s in near[a].items() if b in kept and s >= 0.85]
    for gone in texts.keys() - kept:
        assert any(s >= 0.6 for s in near[gone].values()), gone
        group, front = {gone}, [gone]
        while front:
            more = {o for k in front for o, s in near[k].items() if s >= 0.6} - group
            group |= more
            front = list(more)
        assert min(group) <= gone and group & kept


def test_similar_documents_are_found_at_every_size_of_text(spark, monkeypatch):
    from signalmill.llm import similar

    draw = random.Random(8)
    words = [f"w{i}" for i in range(3000)]
    made, pairs = [], defaultdict(list)
    for n in range(400):
        size = draw.choice([60, 150, 400, 1500])
        text = [draw.choice(words) for _ in range(size)]
        copy = list(text)
        for _ in range(draw.randint(1, size // draw.choice([15, 45, 60]))):
            copy[draw.randrange(size)] = draw.choice(words)
        a, b = shingles(" ".join(text)), shingles(" ".join(copy))
        s = len(a & b) / len(a | b)
        made += [(2 * n, " ".join(text)), (2 * n + 1, " ".join(copy).upper())]
        pairs["far" if s < 0.55 else "gray" if s < 0.8 else "near" if s < 0.85 else "close"].append(2 * n)
    base = [draw.choice(words) for _ in range(200)]
    for n in range(800, 1100):  # a large group, in tiles
        copy = list(base)
        copy[draw.randrange(200)] = f"x{n}"
        made.append((n, " ".join(copy)))
    df = spark.createDataFrame(made, "doc_id long, text string")
    got = {r.doc_id: r.component for r in similar.similar_documents(df, block=64).collect()}
    found = {kind: sum(got[k + 1] == k for k in of) / len(of) for kind, of in pairs.items()}
    assert found["close"] >= 0.98 and found["near"] >= 0.85 and found["far"] <= 0.05, found
    assert {got[n] for n in range(800, 1100)} == {800}
    odd = similar.without_similar(cases.frame(spark))
    left = Counter(r.doc_id for r in odd.select("doc_id").collect())
    assert odd.columns == cases.frame(spark).columns and left[6] == 1 and left[7] == left[9] == 0 and left[0] == 1 and left[1] == left[2] == left[3] == 0
    assert similar.without_similar(cases.empty(spark)).count() == 0


def test_segments_cover_the_radius():
    for count in (1, 500, 10**6, 10**10):
        shape = simhash.plan(count)
        assert sum(r + 1 for *_, r in shape) == simhash.RADIUS + 1 and sum(b for _, b, _ in shape) == 64
    # a look-up meets a bounded number of unlike fingerprints, whatever the corpus
    assert all(10**9 / 2**bits < 10 for _, bits, _ in simhash.plan(10**9))


def test_op6_takes_null_keys_and_long_texts(spark):
    long = " ".join(f"w{i % 997}" for i in range(60_000))
    made = [(1, long), (None, long), (2, long + " end"), (3, "other words here now"), (None, "other words here now"), (None, "alone among all texts"), (4, None), (None, ""), (5, "  ")]
    df = spark.createDataFrame(made, "doc_id long, text string")
    got = Counter((r.doc_id, r.component) for r in simhash.near_duplicates(df).collect())
    assert got == Counter([(1, 1), (None, 1), (2, 1), (3, 3), (None, 3), (None, None), (4, 4), (None, 4), (5, 4)])


def test_pipeline_takes_awkward_rows(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = cases.frame(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, "")
        assert after.columns == docs.columns, name
        rows = after.select("doc_id", "text").collect()
        if name == "language":  # texts without a letter go
            assert not [r for r in rows if not any(map(str.isalpha, r.text or ""))]
        docs = spark.createDataFrame(after.collect(), docs.schema)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, "")
    assert last.count() == docs.count() > 0


def test_pipeline(spark, sf):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf)
        assert after.columns == docs.columns, name
        kept = {r.doc_id for r in after.select("doc_id").collect()}
        before = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
        assert kept <= before.keys()
        if name == "near_duplicates":
            check_similar(before, kept)
        if name == "secrets":
            assert kept == before.keys()
        docs = spark.createDataFrame(after.collect(), docs.schema)
    assert corpus_pipeline.run(spark, sf).count() == docs.count()
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, cases.empty(spark), sf).count() == 0


def test_op9_compares_vectors_of_each_length(spark):
    draw = np.random.default_rng(4)
    made = [(i, [float(x) for x in draw.normal(size=size)]) for i, size in enumerate([6] * 200 + [3] * 120 + [2] * 45)]
    df = spark.createDataFrame(made, "vec_id long, embedding array<double>")
    want = {}
    for size in (6, 3, 2):
        want |= brute_nearest([r for r in made if len(r[1]) == size], 20)
    monkey = dict(tile_rows=40, tile_queries=3)
    got = defaultdict(list)
    for r in posting_lists.nearest(df, F.col("vec_id") % 20 == 0, **monkey).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    hits = sum(len({i for _, i in want[q]} & set(got[q])) for q in want)
    assert got.keys() == want.keys() and hits / sum(map(len, want.values())) >= 0.9
    vectors = posting_lists.distinct_vectors(df, "vec_id", "embedding", 20)
    indexes, _ = posting_lists.fit_each(vectors)
    assert all(len(i.centroids) > 1 for i in indexes.values())  # no length is searched by one list
    saved = posting_lists.MOST_INDEXES
    posting_lists.MOST_INDEXES = 1
    try:  # the other lengths are compared exactly
        found = defaultdict(list)
        for r in posting_lists.nearest(df, F.col("vec_id") % 20 == 0, **monkey).orderBy("query_id", "rank").collect():
            found[r.query_id].append(r.vec_id)
    finally:
        posting_lists.MOST_INDEXES = saved
    assert all(found[q] == [i for _, i in want[q]] for q in want if q >= 200)
