"""Random short texts over awkward alphabets, against brute force."""

from __future__ import annotations

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from signalmill.llm import bpe, pii, quality, secrets, simhash
from tests.llm.test_groups_and_search import brute_fingerprint
from tests.llm.test_text_digests import base_personal, base_secrets, brute_quality

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def texts(alphabet: list[str], count: int, most: int, seed: int) -> list[str]:
    draw = random.Random(seed)
    return ["".join(draw.choice(alphabet) for _ in range(draw.randint(0, most))) for _ in range(count)]


@pytest.mark.parametrize("alphabet", ["a@.-b", "1.2@ a", "+1 (2).-", "4 1-10", "a@b.c+1 9-"])
def test_base_personal_spans(alphabet):
    for text in texts(list(alphabet), 3000, 40, 1):
        assert pii.base_spans(text) == sorted(base_personal(text), key=lambda s: (pii.ORDER[s[0]], s[1])), repr(text)


def test_encoding():
    tokenizer = Tokenizer.from_file(VOCABULARY)
    with open(VOCABULARY, "rb") as f:
        spec = f.read()
    pieces = [" ", "  ", "\n", "\t", " ", "a", "the", "'s", "'ll", "Ünï", "日本", "🙂", "1", "23", "½", "-", "!?", ".", "<|endoftext|>", "<|", "́", "​", "x", "É", "\x1c", "\x85"]
    for text in texts(pieces, 4000, 12, 2):
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        assert bpe.encode_text(spec, text) == ids, repr(text)
        assert bpe.decode_ids(spec, ids) == tokenizer.decode(ids, skip_special_tokens=False), repr(text)


def test_fingerprints_and_counts():
    for text in texts(["a", "B", "é", " ", "\n", "\t", "\x1c", " ", "#", "zz"], 2000, 30, 3):
        assert simhash.fingerprint(text) & (1 << 64) - 1 == brute_fingerprint(text), repr(text)
        assert quality.measures(text)[:5] == tuple(brute_quality(text)[i] for i in range(5)), repr(text)


def test_base_secrets(spark):
    pieces = ["password", "Token", "api_key", "secret", "=", ":", " ", '"', "'", "AKIA", "ABCD1234EFGH", "0123456789abcdef", "deadbeef", "é", "🙂", "\n", "_", "."]
    made = list(enumerate(texts(pieces, 1500, 14, 4)))
    df = spark.createDataFrame([(i, t, "en", "s") for i, t in made], "doc_id long, text string, lang string, source string").repartition(4)
    got = {r.doc_id: [(s.start, s.kind, s.end) for s in r.spans if s.base] for r in secrets.find_secrets(df).collect()}
    for i, text in made:
        assert got[i] == base_secrets(text), repr(text)
