"""Vector packing against the tokenizer, its limits and small instances solved by trying everything."""

import itertools
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from basalt.llm import vectorpack
from basalt.llm.common import tokenizer_path
from basalt.llm.vectorpack import Example, Limits
from basalt.llm.wordparts import WordEncoder

from .test_tokens import TEXTS


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))


def test_encoder(tokenizer):
    enc = WordEncoder()
    more = ["<|endoftext|> a", "a<|endoftext|>B", "<|END|>", "é e ́x", "İstanbul ŉ ǅ ß ẞ", "it's IT'S 's o'clock'", "don't.'t", "x y z\u0085w", "a\x1cb \x1f", "가 가", "Ω Σίσυφος ΣΑΣ", "ª º µ", "12a3 ½ ²"]
    alphabet = list("ab'st .,\n\t\r!é́ İß12<|>_ ​日") + ["<|endoftext|>", "'s", "'ll "]
    r = random.Random(5)
    more += ["".join(r.choice(alphabet) for _ in range(r.randrange(1, 25))) for _ in range(3000)]
    for t in [*TEXTS, *more]:
        want = tokenizer.encode(t or "", add_special_tokens=False).ids
        assert np.frombuffer(enc.encode(t), "<u4").tolist() == want, repr(t)
        assert np.frombuffer(enc.encode(t), "<u4").tolist() == want


def check(rows, ids, limits, whole=False):
    """Every id in one piece, checksums, places without gaps, limits; gives the lengths of the sequences."""
    by, pieces = {}, {}
    for r in rows:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["length"] == len(part) > 0 and r["doc_tokens"] == len(ids[r["doc_id"]])
        assert r["ids_crc32"] == zlib.crc32(np.asarray(part, "<u4").tobytes())
        by.setdefault(r["sequence_id"], []).append(r)
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
    for i, want in ids.items():
        at = 0
        for start, length in sorted(pieces[i]):
            assert start == at
            at += length
        assert at == len(want)
        assert not whole or len(pieces[i]) == 1 or len(want) > limits.tokens
    sizes = []
    for some in by.values():
        at = 0
        for r in sorted(some, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= limits.tokens and len(some) <= limits.segments and sum(r["loss_tokens"] for r in some) <= limits.loss
        sizes.append(at)
    return sizes


def test_no_padding(spark, tokenizer):
    ids = {k: [*tokenizer.encode(x or "", add_special_tokens=False).ids, 2] for k, x in enumerate([*TEXTS, *[t for t in TEXTS if t] * 3])}
    docs = spark.createDataFrame(list(enumerate([*TEXTS, *[t for t in TEXTS if t] * 3])), "doc_id long, text string").repartition(2)
    sizes = check(vectorpack.pack_examples(docs).collect(), ids, Limits())
    assert all(n == 4096 or n & (n - 1) == 0 for n in sizes) and sum(sizes) == sum(map(len, ids.values()))
    sizes = check(vectorpack.pack_examples(docs, cut=False).collect(), ids, Limits(), whole=True)
    small = Limits(64, 5, 64)
    check(vectorpack.pack_examples(docs, small).collect(), ids, small)


def test_prompts_bear_no_loss(spark, tokenizer):
    words = ["alpha beta", "gamma, delta!", "it's", "", None, "über alles " * 9]
    rows = [(k, a, b) for k, (a, b) in enumerate(itertools.product(words, words))]
    ids = {k: [*tokenizer.encode(a or "", add_special_tokens=False).ids, *tokenizer.encode(b or "", add_special_tokens=False).ids, 2] for k, a, b in rows}
    docs = spark.createDataFrame(rows, "doc_id long, question string, text string").coalesce(1)
    for limits in (Limits(48, 4, 20), Limits(40, 40, 7), Limits(200, 3, 200)):
        got = vectorpack.pack_examples(docs, limits, prompt="question").collect()
        check(got, ids, limits)
        assert sum(r["loss_tokens"] for r in got) == sum(len(tokenizer.encode(b or "", add_special_tokens=False).ids) + 1 for _, _, b in rows)


def test_odd_rows(spark):
    assert vectorpack.pack_examples(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = [(None, None), (None, "a"), (3, "b c"), (3, "b c"), (4, "")]
    plain = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = vectorpack.pack_examples(plain).collect()
    assert sum(r["length"] for r in got) == 1 + 2 + 3 + 3 + 1
    wide = plain.selectExpr("*", "'x' AS start", "'x' AS sequence_id", "'x' AS offset", "'x' AS prompt", "7 AS length")
    assert sorted(map(str, vectorpack.pack_examples(wide).collect())) == sorted(map(str, got))
    with pytest.raises(ValueError):
        vectorpack.pack_examples(plain, Limits(0))


def example(k, n, prompt=0):
    return Example(k, bytes(4 * n), n, prompt)


def fewest(items, limits):
    """The fewest sequences that hold whole items, by trying every way."""
    best = [len(items)]

    def go(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(items):
            best[0] = len(bins)
            return
        n, loss = items[k]
        for b in bins:
            if b[0] + n <= limits.tokens and b[1] < limits.segments and b[2] + loss <= limits.loss:
                b[0], b[1], b[2] = b[0] + n, b[1] + 1, b[2] + loss
                go(k + 1, bins)
                b[0], b[1], b[2] = b[0] - n, b[1] - 1, b[2] - loss
        go(k + 1, [*bins, [n, 1, loss]])

    go(0, [])
    return best[0]


def test_near_the_fewest():
    r, more, all_ = random.Random(7), 0, 0
    for _ in range(60):
        limits = Limits(20, r.choice([2, 3, 9]), r.choice([8, 12, 20]))
        items = [(n, r.randint(0, min(n, limits.loss))) for n in (r.randint(1, 20) for _ in range(8))]
        got = list(vectorpack.sequences((example(k, n, n - loss) for k, (n, loss) in enumerate(items)), limits, cut=False))
        assert sorted(e.doc_id for s in got for e, *_ in s) == list(range(8))
        least = fewest(sorted(items, reverse=True), limits)
        more, all_ = more + len(got) - least, all_ + least
    assert more <= 0.05 * all_


def test_largest_product_goes_first():
    # Left: 10 tokens, 3 segments, 4 loss tokens. The second example has the largest product of demand and what is left.
    (first, *_), *_ = vectorpack.sequences(iter([example(0, 6, 6), example(1, 6, 2), example(2, 1, 1)]), Limits(10, 3, 4), cut=False)
    assert first[0].doc_id == 1


def test_long_streams_stay_small():
    seen, most = [0], [0]

    def stream():
        for k in range(30_000):
            seen[0] += 1
            yield example(k, 1 + k * 7919 % 900)

    done = 0
    for s in vectorpack.sequences(stream(), Limits()):
        done += sum(e.start == e.n and start + length == e.n for e, start, length, _ in s)
        most[0] = max(most[0], seen[0] - done)
    assert seen[0] == 30_000 and most[0] <= vectorpack.POOL_EXAMPLES + 1
