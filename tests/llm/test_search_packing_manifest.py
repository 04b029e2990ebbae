"""Lexical search, packing and the Merkle manifest against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from signalmill.llm import lexical, merkle, packing
from tests.llm import cases

WORDS = public_tokenizers.path("word_bpe_49k.json")


# Merkle manifest


def h(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def brute_leaf(*values) -> str:
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def brute_tree(leaves: list[str]) -> tuple[str, list[list[tuple[str, str]]]]:
    """(root, each leaf's siblings left and right, level by level)"""
    beside, nodes, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(nodes) > 1:
        for i, k in enumerate(at):
            first = k // 3 * 3
            beside[i].append(("".join(nodes[first:k]), "".join(nodes[k + 1 : first + 3])))
            at[i] = k // 3
        nodes = [h("".join(nodes[k : k + 3])) for k in range(0, len(nodes), 3)]
    return nodes[0], beside


def brute_manifest(docs) -> Counter:
    groups = defaultdict(list)
    for d in docs:
        groups[d.source].append((d.doc_id is not None, d.doc_id or 0, brute_leaf(d.doc_id, d.source, d.lang, d.n_chars, d.text), d))
    trees = {}
    for source, leaves in groups.items():
        leaves.sort(key=lambda x: x[:3])
        trees[source] = leaves, *brute_tree([x[2] for x in leaves])
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    root, above = brute_tree([trees[s][1] for s in names]) if names else ("", [])
    found = Counter()
    for name, up in zip(names, above, strict=True):
        leaves, subroot, beside = trees[name]
        for (_, _, leaf, d), path in zip(leaves, beside, strict=True):
            node = leaf
            if d.doc_id is not None and zlib.crc32(str(d.doc_id).encode()) % 2 == 0:
                node = brute_leaf(d.doc_id, d.source, d.lang, d.n_chars, d.text and d.text.replace("\n", ""))
            for left, right in path + up:
                node = h(left + node + right)
            found[d.doc_id, leaf, subroot, root, h("".join(a + b for a, b in path + up)), node, node == root] += 1
    return found


COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def test_op13_takes_awkward_rows(spark, tmp_path):
    folder = cases.as_table(spark, cases.frame(spark), tmp_path / "odd")
    got = Counter(tuple(r[c] for c in COLUMNS) for r in merkle.op13_merkle(spark, folder).collect())
    assert got == brute_manifest(spark.read.parquet(f"{folder}/documents.parquet").collect())
    none = cases.as_table(spark, cases.empty(spark), tmp_path / "none")
    assert merkle.op13_merkle(spark, none).collect() == []


@pytest.mark.parametrize(("partitions", "step"), [(1, 1), (7, 2), (40, 1), (13, 3)])
def test_trees_over_ragged_partitions(spark, partitions, step):
    """Groups of 1 to 600 leaves, one of them over many partitions, whatever the partitioning."""
    made = [(g, k, h(f"{g} {k}"), "x") for g, n in (("a", 600), (None, 28), ("b", 1), ("", 2), ("c", 81), ("é", 82), ("d", 9)) for k in range(n)]
    df = spark.createDataFrame(made, "source string, doc_id long, leaf string, part string").repartition(5)
    got = merkle.manifest(df, "source", ["doc_id"], partitions, step).collect()
    trees = {g: brute_tree([m[2] for m in made if m[0] == g]) for g in {m[0] for m in made}}
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    root, above = brute_tree([trees[s][0] for s in names])
    want = {(g, k): trees[g][1][k] + above[names.index(g)] for g, k, _, _ in made}
    assert len(got) == len(made) and {r.root for r in got} == {root} and {r.part for r in got} == {"x"}
    for r in got:
        assert [tuple(run) for run in r.proof] == want[r.source, r.doc_id] and r.subroot == trees[r.source][0]


def test_a_proof_fails_for_any_change(spark):
    made = [("s", k, h(str(k))) for k in range(50)]
    df = merkle.manifest(spark.createDataFrame(made, "source string, doc_id long, leaf string"), "source", ["doc_id"], 4)
    told = df.select((merkle.folded(F.col("leaf"), F.col("proof")) == F.col("root")).alias("right"), (merkle.folded(F.lit(h("other")), F.col("proof")) == F.col("root")).alias("wrong")).distinct().collect()
    assert [tuple(r) for r in told] == [(True, False)]


def test_equal_rows_are_spread_and_each_is_a_leaf(spark):
    df = spark.createDataFrame([("s", 1, h("same"))] * 300 + [("s", 2, h("b"))], "source string, doc_id long, leaf string").repartition(6)
    got = merkle.manifest(df, "source", ["doc_id"], 6).collect()
    assert len(got) == 301 and {r.root for r in got} == {brute_tree([h("same")] * 300 + [h("b")])[0]}


# Packing


def brute_pieces(docs, size: int = 2048) -> Counter:
    tokenizer, found = Tokenizer.from_file(WORDS), Counter()
    for d in docs:
        ids = np.array([*tokenizer.encode(d.text or "", add_special_tokens=False).ids, 0], "<u4")
        for piece, start in enumerate(range(0, len(ids), size)):
            part = ids[start : start + size]
            found[d.doc_id, piece, start, len(part), zlib.crc32(part.tobytes())] += 1
    return found


def check_packed(rows, size: int) -> int:
    """Sequences are gapless from 0 and not too long; returns their number."""
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= size
    return len(held)


def test_op12(spark, sf, tmp_path):
    odd = cases.as_table(spark, cases.frame(spark), tmp_path / "odd")
    for folder in (sf, odd):
        got = packing.op12_packing(spark, folder).collect()
        docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
        assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == brute_pieces(docs)
        least = -(-sum(r.length for r in got) // 2048)
        assert check_packed(got, 2048) <= least * 1.02 + 1
    assert packing.op12_packing(spark, cases.as_table(spark, cases.empty(spark), tmp_path / "none")).count() == 0


def test_word_ids():
    with open(WORDS, "rb") as f:
        encoder = packing.WordEncoder(f.read())
    tokenizer, draw = Tokenizer.from_file(WORDS), random.Random(2)
    pieces = [" ", "  ", "\n", "\t", " ", "a", "The", "'s", "'ll", "Ünï", "日本", "🙂", "1", "23", "½", "-", "!?", ".", "<|endoftext|>", "<|", "́", "x", "É", "\x1c", "\x85", "\xa0", "Σ", "ΑΣ", "İ", "ß", "\x00", "\x7f", "<", "²", "word,", "don't", "x'S", "_", "Å", "¨"]
    single = ["".join(p) for c in range(0x21, 0x250) for p in (chr(c), f"a{chr(c)}b", chr(c) * 2, f"{chr(c)}!")]
    for text in single + ["".join(draw.choice(pieces) for _ in range(draw.randint(0, 12))) for _ in range(4000)]:
        assert np.frombuffer(encoder(text.encode()), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_bins_take_the_best_fit_and_close_the_fullest():
    bins = packing.OpenBins(10, 2)
    assert [bins.place(n) for n in (6, 7, 3, 4)] == [(0, 0), (1, 0), (1, 7), (0, 6)]  # both full
    assert [bins.place(n) for n in (6, 8)] == [(2, 0), (3, 0)]
    assert bins.place(5) == (4, 0)  # no space for 5: the bin of 8 closes
    assert bins.place(2) == (2, 6) and sorted(bins.open()) == [(2, 8), (4, 5)]


@pytest.mark.parametrize(("open_bins", "fan", "partitions"), [(4, 2, 12), (64, 32, 5), (1, 1, 3)])
def test_rounds_of_open_bins(spark, open_bins, fan, partitions):
    draw = random.Random(open_bins)
    made = [(k, draw.choice([1, 2, 3, 5, 20, 40, 64])) for k in range(3000)]
    df = spark.createDataFrame(made, "doc_id long, length long").repartition(partitions)
    got = packing.pack(df, 64, open_bins, fan).collect()
    assert Counter((r.doc_id, r.length) for r in got) == Counter(made)
    number = check_packed(got, 64)
    if open_bins == 64:
        assert number <= -(-sum(n for _, n in made) // 64) * 1.03 + 1


def test_sequences_hold_the_ids(spark):
    df = spark.createDataFrame([(1, "one two three " * 30), (2, None), (3, "four")], "doc_id long, text string")
    pieces = packing.pieces_of(df, WORDS, size=32)
    rows = packing.sequences(packing.pack(pieces, 32)).collect()
    ids = {(r.doc_id, r.piece): np.frombuffer(r.ids, "<u4").tolist() for r in pieces.collect()}
    assert sum(r.length for r in rows) == 90 + 1 + 1 + 2
    for r in rows:
        joined = [i for p in r.parts for i in ids[p.doc_id, p.piece]]
        assert np.frombuffer(r.ids, "<u4").tolist() == joined and len(joined) == r.length <= 32


# Lexical search


def brute_search(docs, items, most: int = 10) -> Counter:
    def terms(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))

    bags = [(d.doc_id, Counter(terms(d.text))) for d in docs]
    bags = [(k, b, b.total()) for k, b in bags if b]
    n_docs, n_terms = len(bags), sum(n for _, _, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    found = Counter()
    for item, text in {(i.item_id, i.text or "") for i in items}:
        scored = []
        for key, bag, n in bags:
            m = 100 - 90 + (90 * n * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * bag[t]) // (1000 * bag[t] + 8 * m)) for t in set(terms(text)) if t in bag)
            if score > 0:
                scored.append((-score, key is not None, key or 0))
        for rank, (score, known, key) in enumerate(sorted(scored)[:most], 1):
            found[item, rank, key if known else None, -score] += 1
    return found


def results(df) -> Counter:
    return Counter((r.item_id, r.rank, r.doc_id, r.score) for r in df.collect())


def test_op11_takes_awkward_rows(spark, tmp_path):
    folder = cases.as_table(spark, cases.frame(spark), tmp_path / "odd")
    items = [(1, "river STONE été"), (1, "river STONE été"), (1, "blue 2024"), (2, None), (3, " .,; "), (None, "maison words"), (4, "nowhere"), (5, "é" * 300_000), (6, "Straße x1 endoftext ½ 日本")]
    asked = cases.as_table(spark, spark.createDataFrame(items, "item_id long, text string"), folder, "benchmark")
    got = results(lexical.op11_lexical(spark, asked))
    assert got == brute_search(spark.read.parquet(f"{folder}/documents.parquet").collect(), spark.createDataFrame(items, "item_id long, text string").collect())
    none = cases.as_table(spark, cases.empty(spark), tmp_path / "none")
    cases.as_table(spark, spark.createDataFrame(items, "item_id long, text string"), none, "benchmark")
    assert lexical.op11_lexical(spark, none).count() == 0


def topics(count: int, seed: int):
    """Documents of eight subjects that share few words, in no order, and ties by copies."""
    draw = random.Random(seed)
    vocabulary = [[f"t{s}w{k}" for k in range(60)] for s in range(8)]
    made = []
    for k in range(count):
        subject = draw.choice(vocabulary)
        made.append((k, " ".join([*draw.choices(subject, k=draw.randint(5, 60)), *draw.choices(["and", "the", "of"], k=3)])))
        if draw.random() < 0.1:
            made.append((count + k, made[-1][1]))
    draw.shuffle(made)
    return made


def test_search_is_exact_in_blocks_and_visits_few_clusters(spark):
    docs = spark.createDataFrame(topics(2500, 1), "doc_id long, text string").repartition(4)
    items = spark.createDataFrame([(k, f"t{k % 8}w{k} t{k % 8}w{k + 1} t{k % 8}w{3 * k % 60} the") for k in range(40)] + [(99, "and the of")], "item_id long, text string")
    index = lexical.build_index(docs, cluster=16, partitions=4)
    assert sum(len(r["keys"]) for r in index.rows.select("keys").collect()) == docs.count()
    visits = [spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)]
    want = brute_search(docs.collect(), items.collect())
    assert results(lexical.search(index, items, block=7, visits=visits)) == want
    assert results(lexical.search(lexical.build_index(docs, cluster=300, partitions=2), items)) == want
    assert 0 < visits[0].value < 0.5 * visits[1].value


def test_bisection_brings_subjects_together():
    texts = topics(800, 3)
    bags = lexical.Bags([lexical.features_of(set(lexical.terms_of(t.encode()))) for _, t in texts])
    order = lexical.bisected(bags, 50)
    assert sorted(order.tolist()) == list(range(len(texts)))
    subjects = [texts[k][1][:2] for k in order]
    changes = sum(a != b for a, b in zip(subjects, subjects[1:], strict=False))
    assert changes < 0.5 * sum(a[1][:2] != b[1][:2] for a, b in zip(texts, texts[1:], strict=False))


def test_clusters_are_bounded():
    assert lexical.clusters_of(np.array([5, 5, 5, 100, 1, 1]), 3, 12) == [(0, 2), (2, 3), (3, 4), (4, 6)]
    assert lexical.clusters_of(np.array([]), 3, 12) == []
