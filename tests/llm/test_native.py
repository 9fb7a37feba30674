"""Quality rules and mixing of sources, against plain Python."""

import math
import random
import re
import struct
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from basalt.llm import mixing, quality
from basalt.llm.common import words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def repeat_words(ws):
    seen = Counter(tuple(ws[i : i + 5]) for i in range(len(ws) - 4))
    covered = {j for i in range(len(ws) - 4) if seen[tuple(ws[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(covered)


def base(text):
    t = text or ""
    ws = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    n, r = len(ws), repeat_words(ws)
    return n, sum(map(len, ws)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), r, n < 10 or 100 * r > 20 * n


TEXTS = [
    None, "", " \n\t ", "a", "a b c d e f g h i j k", "x y z w v " * 4, "a b c d e a b c d e f g h i j k l m n o p q r s t",
    "line one\nline one\n\n  \nline two\r\nline one", "né 日本語  wide  space ### $5 <b>", "tab\tand\vvt\fff and more words to make ten of them",
    "a a a a a a a a a a a a", " ".join(str(i % 37) for i in range(3000)), " ".join(map(str, range(2000))) + " 5 6 7 8 9 10",
]


def test_base_rules(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in quality.base_rules(df).collect()}
    assert got == {i: base(t) for i, t in enumerate(TEXTS)}


def test_words(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "text string").select(words(F.col("text")).alias("w"))
    assert [r["w"] for r in df.collect()] == [WORD.findall(t or "") for t in TEXTS]


def test_verdicts_against_plain_sums(spark):
    import zlib

    r = random.Random(1)
    good, junk = [f"w{i}" for i in range(60)], [f"%%x{i}" for i in range(20)]
    docs = [(i, " ".join(r.choice(good if i % 3 else junk) for _ in range(r.randint(12, 60)))) for i in range(120)]
    labels = [(i, 1 if i % 3 else 0, 0) for i, _ in docs if i % 2] + [(999, 1, 0), (None, 1, 1)]
    n = quality.BUCKETS

    def buckets(text):
        h = [zlib.crc32(w.encode()) for w in WORD.findall(text)]
        return [x % n for x in h] + [(a * 31 + b * 1_000_003 + 7) % n for a, b in zip(h, h[1:], strict=False)]

    trusted = {i for i, q, _ in labels if q == 1}
    raw, target = Counter(), Counter()
    for i, t in docs:
        raw.update(buckets(t))
        if i in trusted:
            target.update(buckets(t))
    c = quality.SMOOTHING
    ratio = lambda b: round(math.log((target[b] + c) / (raw[b] * target.total() / raw.total() + c)) * quality.SCALE)
    want = {}
    for i, t in docs:
        s = sum(map(ratio, buckets(t)))
        want[i] = (s, not base(t)[5] and s >= round(quality.THRESHOLD * quality.SCALE) * (len(buckets(t)) + quality.PRIOR_NGRAMS))
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("kept", F.lit("clash")).withColumn("n_words", F.lit("clash"))
    got = quality.quality(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert {x["doc_id"]: (x["ratio_sum"], x["kept"]) for x in got.collect()} == want
    assert {k for _, k in want.values()} == {True, False}


def test_quality_without_labels_and_rows(spark):
    docs = spark.createDataFrame([(1, " ".join(map(str, range(20)))), (1, " ".join(map(str, range(20)))), (None, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert sorted(r["kept"] for r in quality.quality(docs, labels).collect()) == [False, True, True]
    assert quality.quality(docs.limit(0), labels).count() == 0


def plain_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    total, open_, out = float(sum(sizes.values())), set(order), {}
    while open_:
        left = total - sum(out.values())
        shares = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if shares[s] > 3 * sizes[s]}
        if not over:
            return out | shares
        out |= {s: 3.0 * sizes[s] for s in over}
        open_ -= over
    return out


@pytest.mark.parametrize("seed", range(4))
def test_targets(spark, seed):
    r = random.Random(seed)
    sizes = {s: r.choice((0, 3, 50, 400, 9000)) for s in ["b", "a", "ä", "Z", "中", "", None][: r.randint(1, 7)]}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {x["source"]: x["target"] for x in mixing.targets(df).collect()}
    want = plain_targets(sizes)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 * (1 + want[k]) for k in want)


def xx(*longs):
    """Hash of whole numbers, as the engine's built-in gives it: each is hashed with the last hash as its seed."""
    h = 42
    for x in longs:
        h = xxhash.xxh64_intdigest(struct.pack("<q", x), h)
    return h - (1 << 64) if h >> 63 else h


def plain_permuted(i, n, seed, kind, *keys, rounds=8):
    a = math.isqrt(n)
    b = n // a
    for r in range(rounds):
        if i < a * b:
            x, y = divmod(i, b)
            i = x * b + (y + xx(seed, kind, *keys, r, x) % b) % b if r % 2 == 0 else (x + xx(seed, kind, *keys, r, y) % a) % a * b + y
        i = (i + xx(seed, kind, *keys, r) % n) % n
    return i


def plain_slots(targets, sizes, seed=0, block=mixing.BLOCK, shard_slots=mixing.SHARD_SLOTS):
    """(shard, slot, source, number, block) of every slot: each slot's variate is looked up in the sources' intervals."""
    order = [s for s in sorted(sizes, key=lambda s: (s is None, s or "")) if sizes[s]]
    number = {s: i for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    blocks = {s: -(-sizes[s] // block) for s in order}
    share = {s: math.floor(targets[s] * blocks[s] / sizes[s] * mixing.UNIT + 0.5) for s in order}
    whole = sum(share.values())
    total = math.floor(whole / mixing.UNIT + 0.5)
    shards = max(1, -(-total // shard_slots))
    edges = np.cumsum([share[s] for s in order])
    used, out = Counter(), []
    for k in range(-(-total // shards)):
        n = shards if k < total // shards else total % shards
        v = (xx(seed, 11, k) % mixing.UNIT + 0.5) / mixing.UNIT
        for j in range(n):
            s = order[int(np.searchsorted(edges, (j + v) / n * whole, "right"))]
            at = used[s]
            used[s] += 1
            if at < 3 * blocks[s]:
                out.append((plain_permuted(j, n, seed, 12, k), k, number[s], at, plain_permuted(at % blocks[s], blocks[s], seed, 13, number[s], at // blocks[s])))
    return out


def plain_taken(docs, targets, seed=0, block=mixing.BLOCK):
    """Words taken of each row, over streams in the order that the running sums give; rows equal in all are told apart by order."""
    sizes = Counter()
    for _, s, n in docs:
        sizes[s] += n
    number = {s: i for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    times = Counter((s, b) for _, _, s, _, b in plain_slots(targets, sizes, seed, block))
    groups = max(1, math.isqrt(len(docs)))
    hashed = lambda d, n: (xx(n) if d is None else xx(d, n)) % groups
    out, at = [], Counter()
    for d, s, n in sorted(docs, key=lambda x: (number[x[1]], hashed(x[0], x[2]), x[0] is not None, x[0] or 0, x[2])):
        out.append((d, s, n, sum(times[number[s], w // block] for w in range(at[s], at[s] + n))))
        at[s] += n
    return out


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000, 4099])
def test_permutation(spark, n):
    for keys in ((3,), (4, 1)):
        df = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), 5, 13, *(F.lit(k).cast("long") for k in keys)).alias("p"), "id")
        got = {x["id"]: x["p"] for x in df.collect()}
        assert sorted(got.values()) == list(range(n))
        assert got == {i: plain_permuted(i, n, 5, 13, *keys) for i in range(n)}


def test_permutations_look_random():
    fixed = followed = 0
    first = Counter()
    for seed in range(60):
        p = [plain_permuted(i, 101, seed, 13, 0, 0) for i in range(101)]
        fixed += sum(i == x for i, x in enumerate(p))
        followed += sum((b - a) % 101 == 1 for a, b in zip(p, p[1:], strict=False))
        first.update(x * 10 // 101 for x in p[:20])
    assert 35 < fixed < 90 and 35 < followed < 90  # 60 expected of both
    assert sum((first[k] - 120) ** 2 / 120 for k in range(10)) < 30


def test_counts_of_a_shard_are_multinomial():
    """Over many seeds: means and (co)variances of the counts of one shard are those of independent draws."""
    sizes = {"a": 6400, "b": 3200, "c": 6400}
    targets = {"a": 8000.0, "b": 4000.0, "c": 4000.0}
    seen = []
    for seed in range(400):
        count = Counter(s for shard, _, s, _, _ in plain_slots(targets, sizes, seed) if shard == 5)
        seen.append([count[k] for k in range(3)])
    x, p = np.array(seen), np.array([0.5, 0.25, 0.25])
    n = mixing.SHARD_SLOTS
    assert (x.sum(1) <= n).all() and np.abs(x.mean(0) - n * p).max() < 0.35
    want = n * (np.diag(p) - np.outer(p, p))
    assert np.abs(np.cov(x.T) - want).max() < 0.8


def random_docs(seed=2):
    r = random.Random(seed)
    return [(i, r.choice(["a", "b", "c", None]), r.choice((0, 1, 5, 200))) for i in range(400)] + [(7, "a", 200), (7, "a", 200), (None, "a", 5), (None, "a", 5), (None, None, 70), (1000, "tiny", 3), (1001, "none", 0)]


@pytest.mark.parametrize("seed", [0, 9])
def test_mix_against_plain_python(spark, monkeypatch, seed):
    docs = random_docs(seed)
    sizes = Counter()
    for _, s, n in docs:
        sizes[s] += n
    want = plain_taken(docs, plain_targets(sizes), seed)
    monkeypatch.setattr(mixing, "RUN", 3)  # long runs take their own way
    got = mixing.mixed(spark.createDataFrame(docs, "doc_id long, source string, size long"), seed).collect()
    key = lambda x: tuple(map(str, x))
    assert sorted(key((x["doc_id"], x["source"], x["size"], x["taken"])) for x in got) == sorted(map(key, want))


def test_mix_of_many_sources(spark):
    df = spark.range(100_000).selectExpr("id AS doc_id", "concat('s', id) AS source", "CASE WHEN id = 5 THEN 900000 ELSE 1 + id % 90 END AS size", "'clash' AS target", "'clash' AS start", "1 AS taken")
    rows = mixing.mixed(df)
    assert rows.columns == ["doc_id", "source", "size", "source_size", "target", "taken"]
    r = rows.selectExpr("count(*) n", "sum(size) s", "sum(taken) t", "sum(target) g", "max(taken / size) m").first()
    assert r["n"] == 100_000 and r["m"] <= 3 and abs(r["g"] / r["s"] - 1) < 1e-6
    # Half of the sources stop at three times their one or two blocks; what a draw gives them beyond that is not taken.
    assert 0.85 < r["t"] / r["s"] <= 1.01


def test_copies_without_ids(spark):
    """A third of all rows equal in everything: each gets a place, and reruns agree."""
    df = spark.range(6000).selectExpr("CASE WHEN id % 3 = 0 THEN NULL ELSE id END AS doc_id", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('s', id % 4) END AS source", "CASE WHEN id % 3 = 0 THEN 40L ELSE id % 90 END AS size")
    key = lambda rows: sorted((str(x["doc_id"]), x["source"], x["size"], x["taken"]) for x in rows.collect())
    got = key(mixing.mixed(df))
    assert len(got) == 6000 and all(t <= 3 * n for _, _, n, t in got) and got == key(mixing.mixed(df.repartition(7)))


def test_mix(spark):
    docs = random_docs()
    df = spark.createDataFrame(docs, "doc_id long, source string, size long")
    rows = mixing.mixed(df).collect()
    assert len(rows) == len(docs)
    assert all(x["taken"] <= 3 * x["size"] for x in rows)
    total = sum(x["size"] for x in rows)
    assert abs(sum({x["source"]: x["target"] for x in rows}.values()) - total) < 1e-6 * total
    for s in {x["source"] for x in rows}:
        taken, target = sum(x["taken"] for x in rows if x["source"] == s), next(x["target"] for x in rows if x["source"] == s)
        assert abs(taken - target) <= 0.05 * target + 2 * mixing.BLOCK, s
    key = lambda x: (str(x["doc_id"]), str(x["source"]), x["size"], x["taken"])
    assert sorted(map(key, rows)) == sorted(map(key, mixing.mixed(df).collect()))


def test_mix_with_clashing_columns(spark):
    plain = spark.createDataFrame([(k, f"s{k % 3}", 40 + k) for k in range(60)] + [(None, None, 5), (7, "s1", 47)], "doc_id long, source string, size long")
    wide = plain.selectExpr("*", "'x' AS source_size", "'x' AS target", "'x' AS taken", "'x' AS source_no", "'x' AS start", "'x' AS copies")
    key = lambda df: sorted(str(tuple(x)) for x in df.collect())
    assert mixing.mixed(wide).columns == mixing.mixed(plain).columns and key(mixing.mixed(wide)) == key(mixing.mixed(plain))


def test_mix_of_nothing(spark):
    schema = "doc_id long, source string, size long"
    assert mixing.mixed(spark.createDataFrame([], schema)).count() == 0
    assert [(x["target"], x["taken"]) for x in mixing.mixed(spark.createDataFrame([(1, "a", 0)], schema)).collect()] == [(0.0, 0)]
