"""Token files, packing and token counts against the tokenizers themselves."""

import io
import random
import zlib

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from basalt.llm import packing, tokencount, tokenfile
from basalt.llm.common import tokenizer_path
from basalt.llm.encode import Encoder

TEXTS = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "one two", "one.two, three\nfour five.\n\nsix", "\n", "a\n b", "tab\tb \tc", "it's I'm we'll", "x<|endoftext|> y <|endoftext|>",
    "über Ärger, naïve é!! %%% &&&", "日本 語 テ", "　x y", "a b c", "᠎ a b", "a​ b", "12 34 5a6 a1", "<s>hi</s> ▁ x▁ y", "😀 👍🏽 x", "\x00 a \x1c b", "ﬁ ɐɑ ĳ", "end.",
    "word " * 3000, "x" * 5000, "a.b.c .d. ..", "foo%%%\nBar&&& baz",
]


@pytest.fixture(scope="module")
def ids():
    t = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    return [[*t.encode(x or "", add_special_tokens=False).ids, 2] for x in TEXTS]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")


def test_encoder(ids):
    enc = Encoder()
    for _ in range(2):
        assert [[*np.frombuffer(b, "<u4").tolist(), 2] for b in enc.encode(TEXTS)] == ids


@pytest.mark.parametrize("bits", [1, 3, 7, 8, 11, 15, 16, 17, 24, 31, 32])
def test_bits(bits):
    r = np.random.default_rng(bits)
    values = r.integers(0, 1 << bits, 1001, dtype=np.uint64).astype("<u4")
    data = tokenfile.pack_bits(values, bits)
    assert len(data) == -(-1001 * bits // 8)
    assert (tokenfile.unpack_bits(data, bits, 1001) == values).all()


def test_shard_and_random_access():
    r, sink = np.random.default_rng(0), io.BytesIO()
    docs = [(k if k % 3 else None, r.integers(0, 50257, r.integers(0, 40)).astype("<u4")) for k in range(60)]
    w = tokenfile.Writer(sink, 17, 16)
    for k, x in docs:
        w.add(k, x)
    w.close()
    reader = tokenfile.Reader(io.BytesIO(sink.getvalue()))
    assert [(k, x.tolist()) for k, _, x in reader.documents()] == [(k, x.tolist()) for k, x in docs]
    assert [reader.document(k).tolist() for k in range(60)] == [x.tolist() for _, x in docs]
    whole = np.concatenate([x for _, x in docs])
    assert (reader.ids(100, 333) == whole[100:333]).all()
    assert tokenfile.bits_for(50257) == 16 and tokenfile.bits_for(65537) == 17
    with pytest.raises(ValueError):
        tokenfile.Reader(io.BytesIO(sink.getvalue()[:-3]))


def test_round_trip(spark, docs, ids):
    got = sorted(tokenfile.round_trip(docs).collect(), key=lambda r: r["doc_id"])
    start = 0
    for r, want in zip(got, ids, strict=True):
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(want), zlib.crc32(np.asarray(want, "<u4").tobytes()))
        start += len(want)


def test_round_trip_of_odd_rows(spark):
    assert tokenfile.round_trip(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = [(5, "b"), (5, "a"), (None, "x"), (-1, None)]
    got = tokenfile.round_trip(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("start").collect()
    assert [(r["doc_id"], r["start"]) for r in got] == [(None, 0), (-1, 2), (5, 3), (5, 5)]


@pytest.mark.parametrize("file_ids,file_docs", [(1, 1 << 20), (1 << 28, 3), (200, 5)])
def test_shards_in_several_files(spark, docs, ids, file_ids, file_docs, tmp_path):
    manifest = tokenfile.write(docs, str(tmp_path), shards=2, block_ids=64, file_ids=file_ids, file_docs=file_docs)
    rows = sorted(manifest.collect(), key=lambda r: (r["shard"], r["part"]))
    assert len(rows) > 4 and all(r["n_docs"] <= file_docs for r in rows)
    assert [r["base"] for r in rows] == [sum(x["n_ids"] for x in rows[:k]) for k in range(len(rows))]
    got = sorted(tokenfile.read(manifest).collect(), key=lambda r: r["doc_id"])
    at = np.cumsum([0, *map(len, ids)])
    assert [(r["start"], r["n_tokens"], r["ids_crc32"]) for r in got] == [(int(at[k]), len(x), zlib.crc32(np.asarray(x, "<u4").tobytes())) for k, x in enumerate(ids)]


def test_files_and_counts_with_clashing_columns(spark):
    plain = spark.createDataFrame([(1, "a b"), (2, None), (2, "c")], "doc_id long, text string")
    wide = plain.selectExpr("*", "'x' AS start", "'x' AS n_tokens", "'x' AS ids_crc32", "'x' AS ids", "'x' AS n_bytes", "'x' AS over_limit", "'x' AS base")
    for operator in (tokenfile.round_trip, tokencount.token_counts):
        assert sorted(map(tuple, operator(wide).collect())) == sorted(map(tuple, operator(plain).collect()))
        assert operator(wide).columns == operator(plain).columns


def test_pack(spark, docs, ids):
    rows = packing.pack(docs).collect()
    for r in rows:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] and r["ids_crc32"] == zlib.crc32(np.asarray(part, "<u4").tobytes())
    for i, want in enumerate(ids):
        mine = sorted((r["piece"], r["start"], r["length"]) for r in rows if r["doc_id"] == i)
        assert [m[0] for m in mine] == list(range(len(mine))) and sum(m[2] for m in mine) == len(want)
        assert all(m[2] == 1024 for m in mine[1:])
    check_places(rows)


def check_places(rows):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    return len(by)


def test_triples_are_fixed():
    # Two fit beside 500, the largest partner is 300, and no other pair has a longer second piece.
    fixed, left = packing.reduce_dominated({500: 4, 300: 4, 190: 4}, 1000)
    assert fixed[0] == (2, ((500, 2),))  # it fills the sequence
    fixed, left = packing.reduce_dominated({510: 4, 300: 4, 185: 4}, 1000)
    assert (4, ((510, 1), (300, 1), (185, 1))) in fixed and not left
    # 250 and 240 fit beside 510 as 300 and 150 do, and neither pair dominates the other.
    fixed, left = packing.reduce_dominated({510: 1, 300: 1, 250: 1, 240: 1, 150: 1}, 1000)
    assert not any(dict(parts).get(510) for _, parts in fixed)


@pytest.mark.parametrize("seed", range(300))
def test_reduction_loses_no_sequence(seed):
    """Against exhaustive search: what is fixed and the best packing of the rest are as few sequences as the best of all."""
    r = random.Random(seed)
    capacity = r.choice((10, 17, 30, 100))
    low = r.choice((1, capacity // 5, capacity // 4, capacity // 3))
    lengths = [r.randint(max(1, low), r.choice((capacity, capacity // 2 + 1))) for _ in range(r.randint(1, 9))]
    fixed, left = packing.reduce_dominated(counts(lengths), capacity)
    rest = [n for n, c in left.items() for _ in range(c)]
    assert sum(t for t, _ in fixed) + (exact(rest, capacity) if rest else 0) == exact(lengths, capacity)


def test_pack_with_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b", 9, 9, "x"), (2, None, 9, 9, "y")], "doc_id long, text string, length int, part int, offset string")
    assert packing.pack(df).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and packing.pack(df).count() == 2


def test_pack_of_odd_rows(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = [(1, "a b c")] * 700 + [(None, None)] * 50
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert len(got) == 750 and check_places(got) == -(-(700 * 4 + 50) // 1024)


def plain_best_fit(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [k for k, r in enumerate(rooms) if r >= n]
        if fits:
            rooms[min(fits, key=lambda k: rooms[k])] -= n
        else:
            rooms.append(capacity - n)
    return len(rooms)


def exact(lengths, capacity):
    best = [plain_best_fit(lengths, capacity)]
    lengths = sorted(lengths, reverse=True)

    def go(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(lengths):
            best[0] = len(rooms)
            return
        for room in set(rooms):
            if room >= lengths[k]:
                i = rooms.index(room)
                go(k + 1, [*rooms[:i], room - lengths[k], *rooms[i + 1 :]])
        go(k + 1, [*rooms, capacity - lengths[k]])

    go(0, [])
    return best[0]


def counts(lengths):
    return {n: lengths.count(n) for n in set(lengths)}


def used(patterns):
    out = {}
    for times, parts in patterns:
        for n, k in parts:
            out[n] = out.get(n, 0) + k * times
    return out


@pytest.mark.parametrize("seed", range(40))
def test_solver(seed):
    r = random.Random(seed)
    lengths = [r.randint(1, 20) for _ in range(r.randint(0, 9))]
    fixed, left = packing.reduce_dominated(counts(lengths), 20)
    rest = [n for n, k in left.items() for _ in range(k)]
    # Dominance: fixing these sets loses nothing.
    assert sum(t for t, _ in fixed) + exact(rest, 20) == exact(lengths, 20)
    assert sum(t for t, _ in packing.best_fit(left, 20)) == plain_best_fit(rest, 20)
    assert used(packing.solve(counts(lengths), 20)) == counts(lengths)


def test_large_instance():
    r = random.Random(1)
    many = {n: 5000 + r.randint(0, 100) + 7 * n for n in range(1, 1025)}
    patterns = packing.solve(many)
    assert used(patterns) == {n: k for n, k in many.items() if k}
    assert len(patterns) < 20_000
    # No packing takes fewer than the tokens fill, nor than there are pieces over half.
    least = max(-(-sum(n * k for n, k in many.items()) // 1024), sum(k for n, k in many.items() if n > 512))
    assert sum(t for t, _ in patterns) <= 1.01 * least


def test_token_counts(spark, docs):
    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in tokencount.token_counts(docs).collect()}
    want = {i: (len((t or "").encode()), len(sp.encode(t or "")), len(sp.encode(t or "")) > 4096) for i, t in enumerate(TEXTS)}
    assert got == want
    assert tokencount.token_counts(docs.limit(0)).count() == 0


def test_no_piece_has_an_inner_space():
    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    assert not [p for p in pieces if "▁" in p.lstrip("▁")]


def test_frequent_parts_of_all_rows(spark, monkeypatch):
    """The first tier counts every document, the last one as the first; few entries are kept on the way."""
    rows = [(k, " ".join(f"rare{k}x{j}" for j in range(20)) + " the of " + ("late " * (k > 1500)) + "y" * 30) for k in range(2000)] + [(9, None), (9, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    monkeypatch.setattr(tokencount, "SUMMARY_ENTRIES", 100)
    got = {r["part"]: r["n"] for r in tokencount.heavy_hitters(df).collect()}
    assert (got["the"], got["of"], got["late"]) == (2000, 2000, 499) and all(len(p) <= tokencount.TABLE_CHARS for p in got)
    assert set(tokencount.frequent_lengths(df, entries=3)) == {"the", "of", "late"}
    assert tokencount.frequent_lengths(df.limit(0)) == {}


def test_one_id_over_many_shards(spark):
    """Two thirds of the rows without an id: their range may end among them, and starts stay gapless."""
    df = spark.range(600).selectExpr("CASE WHEN id % 3 > 0 THEN NULL ELSE id END AS doc_id", "concat('t', id % 50, ' ', id) AS text", "1 AS start", "'x' AS ids_crc32")
    path = tokenfile.shared_dir(spark, "hot")
    manifest = tokenfile.write(df, path, shards=6)
    got = tokenfile.read(manifest).orderBy("start").collect()
    assert [r["start"] for r in got] == list(np.cumsum([0] + [r["n_tokens"] for r in got[:-1]]))
    ids = [r["doc_id"] for r in got]
    assert ids == [None] * 400 + sorted(i for i in ids if i is not None)
    assert max(r["n_docs"] for r in manifest.collect()) < 300
