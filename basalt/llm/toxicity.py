"""Toxicity: bags of subwords, averaged into a linear softmax, trained jointly in numpy.

A word is the mean of the vectors of its hashed character n-grams (with marks at its ends) and of itself; a window of
``WINDOW`` words is the mean of its words; a softmax over two classes reads the window. Vectors and softmax are trained
together by gradient descent. A text is as toxic as its most toxic window: training takes a document's label as "at
least one of its windows is toxic" (noisy or), so a few words decide about long texts, and misspelt words share n-grams
with known ones.

Labels are learnt from a bounded sample: at most ``TRAIN_ROWS`` rows of each class, of texts of at most ``TRAIN_CHARS``
characters, in the order of a hash of the id; rows held out (crc32 of the id modulo 5 is 0) are never among them. Every
text is scored as a whole.

Defined results: null and blank texts get the score of an empty window, the prior, which is below one half; without any
toxic or any clean label everything scores 0; rows that repeat an id are scored one by one; an empty table gives no rows.
``toxicity`` leaves out columns beside id and text; ``scored`` keeps all, and replaces one named score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches
from .encode import forget

BUCKETS = 1 << 16
DIMENSIONS = 8
WINDOW = 8
TRAIN_ROWS = 1500
TRAIN_CHARS = 20_000
#: Updates, of so many documents each; few labels are gone over more often.
STEPS = 2200
GROUP = 16
RATE = 0.5
#: Keeps buckets with few and small gradients from large steps.
STEADY = 0.05
#: The averaged vector is scaled by as much before the softmax.
GAIN = 8.0
PRIOR_LOGIT = -4.0
#: Words that one generation of a worker's cache holds, the longest of them, and words that are hashed at once.
CACHED_WORDS = 100_000
CACHED_CHARS = 64
HASHED_WORDS = 20_000
#: Rows that a task scores at once.
BATCH_ROWS = 400
HELD_OUT = 5
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_MARKS = str.maketrans(dict.fromkeys(".,;:!?|\"()[]{}", " "))


def word_grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words' n-grams of 3 to 5 characters, ends marked, and of the words themselves; and the word of each.

    All words lie in one array of code points, "<one><two>..", so that a step hashes the n-grams of every word.
    """
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    c = np.frombuffer(f"<{'><'.join(words)}>".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    end = np.cumsum(size)
    left = np.repeat(end, size) - np.arange(len(c))  # code points from here to the word's end
    word = np.repeat(np.arange(len(words)), size)
    buckets, owners = [], []
    with np.errstate(over="ignore"):
        h = c * _FACTOR
        for k in range(2, 6):
            h = (h[:-1] + c[k - 1 :]) * _FACTOR
            if k >= 3:
                at = np.flatnonzero(left[: len(h)] >= k)
                buckets.append(_bucket(h[at] + np.uint64(k)))
                owners.append(word[at])
        # The power of a word's last code point is 1, of the one before it the factor, and so on.
        power = np.ones(int(size.max()), np.uint64)
        power[1:] = np.multiply.accumulate(np.full(len(power) - 1, _FACTOR, np.uint64))
        buckets.append(_bucket(np.add.reduceat(c * power[left - 1], end - size) * _FACTOR + size.astype(np.uint64) * np.uint64(7)))
        owners.append(np.arange(len(words)))
    return np.concatenate(buckets), np.concatenate(owners)


def _bucket(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((h ^ (h >> np.uint64(32))) & np.uint64(BUCKETS - 1)).astype(np.int64)


def tokens(text: str | None) -> list[str]:
    """Lower-case words without punctuation; a word that repeats the one before it counts once."""
    found = text.lower().translate(_MARKS).split() if text else []
    return found[:1] + [b for a, b in zip(found, found[1:], strict=False) if a != b]


@dataclass
class Model:
    """One number for each bucket (vectors times the difference of the softmax's rows) is all that scoring needs."""

    vectors: np.ndarray
    softmax: np.ndarray
    bias: np.ndarray

    def gram_logits(self) -> np.ndarray:
        return GAIN * (self.vectors @ (self.softmax[1] - self.softmax[0]))

    def offset(self) -> float:
        return float(self.bias[1] - self.bias[0])


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers start[i] .. start[i] + size[i] - 1 of all i, one after another."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)


def train(texts: list[str], toxic: list[int], steps: int = STEPS, seed: int = 0, window_words: int = WINDOW) -> Model:
    """Vectors and softmax by stochastic gradient descent over small groups of documents.

    With ``window_words`` beyond the longest text the average of the whole bag goes into the softmax.
    """
    vocabulary: dict[str, int] = {}
    docs = [(np.array([vocabulary.setdefault(w, len(vocabulary)) for w in ws], np.int64), float(y)) for ws, y in ((tokens(t), y) for t, y in zip(texts, toxic, strict=True)) if ws]
    y = np.array([d[1] for d in docs])
    if not len(y) or y.min() == y.max():
        return Model(np.zeros((BUCKETS, DIMENSIONS), np.float32), np.zeros((2, DIMENSIONS), np.float32), np.array([0.0, 60.0 if len(y) and y.max() else -60.0]))
    known, grams, sizes = list(vocabulary), [], []
    for k in range(0, len(known), HASHED_WORDS):
        some = known[k : k + HASHED_WORDS]
        found, of = word_grams(some)
        grams.append(found[np.argsort(of, kind="stable")].astype(np.int32))
        sizes.append(np.bincount(of, minlength=len(some)))
    gram, gram_n = np.concatenate(grams), np.concatenate(sizes)
    gram_at = np.cumsum(gram_n) - gram_n
    weight = {1.0: 1.0, 0.0: min(1.0, 2 * y.sum() / (1 - y).sum())}

    rng = np.random.default_rng(seed)
    E = rng.normal(0, 0.05, (BUCKETS, DIMENSIONS)).astype(np.float32)
    W = rng.normal(0, 1.0, (2, DIMENSIONS)).astype(np.float32)
    b = np.array([0.0, PRIOR_LOGIT], np.float32)
    seen = np.zeros(BUCKETS)  # squared gradients so far: buckets with large ones take smaller steps
    done = 0
    while done < steps:
        order = rng.permutation(len(docs))
        for k in range(0, len(docs), GROUP):
            some = [docs[i] for i in order[k : k + GROUP]]
            rate = RATE * (1 - 0.9 * done / steps)
            done += 1
            words = np.concatenate([d[0] for d in some])
            lengths = np.array([len(d[0]) for d in some])
            windows = -(-lengths // window_words)
            place = np.arange(len(words)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            window = np.repeat(np.cumsum(windows) - windows, lengths) + place // window_words
            doc = np.repeat(np.arange(len(some)), windows)
            size = np.bincount(window)
            used, word = np.unique(words, return_inverse=True)
            g = gram[_ranges(gram_at[used], gram_n[used])]
            owner = np.repeat(np.arange(len(used)), gram_n[used])
            share = 1.0 / gram_n[used]
            u = W[1] - W[0]
            # einsum, as the threads of a BLAS product this small cost more than they spare
            logit = np.bincount(owner, np.einsum("ij,j->i", E, u)[g]) * share
            z = np.bincount(window, logit[word]) / size * GAIN + b[1] - b[0]
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            # Noisy or: a clean document wants every window clean, a toxic one at least one that isn't.
            clean = np.exp(np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-7)), len(some)))
            pull = np.array([(-c / max(1 - c, 1e-6) if t else 1.0) * weight[t] for (_, t), c in zip(some, clean, strict=True)])
            dz = p * pull[doc]
            dword = np.bincount(word, (dz / size)[window]) * share * GAIN
            dgram = np.bincount(g, dword[owner], BUCKETS)
            du = np.einsum("i,ij->j", dgram.astype(np.float32), E)
            seen += dgram * dgram
            E -= (rate * dgram / (np.sqrt(seen) + STEADY)).astype(np.float32)[:, None] * u
            W += np.stack([du, -du]).astype(np.float32) * 0.02 * rate / len(some)
            b += np.array([dz.sum(), -dz.sum()], np.float32) * 0.01 * rate / len(some)
    return Model(E, W, b)


class Scorer:
    """Scores of whole texts. Keeps a worker's words in two generations: when the newer one is full, the older one goes."""

    def __init__(self, gram_logits: np.ndarray, offset: float, window_words: int = WINDOW):
        self.gram_logits, self.offset, self.window = gram_logits.astype(np.float64), offset, window_words
        self.known: dict[str, float] = {}
        self.older: dict[str, float] = {}

    def words(self, words: list[str]) -> np.ndarray:
        """The mean logit of each word's n-grams."""
        out = []
        for k in range(0, len(words), HASHED_WORDS):
            some = words[k : k + HASHED_WORDS]
            gram, word = word_grams(some)
            out.append(np.bincount(word, self.gram_logits[gram], len(some)) / np.bincount(word, minlength=len(some)))
        return np.concatenate([np.zeros(0), *out])

    def score(self, texts: list[str | None]) -> np.ndarray:
        parts = [tokens(t) for t in texts]
        missing = set().union(*parts).difference(self.known) if parts else set()
        if len(self.known) + len(missing) > CACHED_WORDS:
            self.older, self.known = self.known, {}
            missing = set().union(*parts)
        again = missing & self.older.keys()
        self.known.update((w, self.older[w]) for w in again)
        new = list(missing - again)
        self.known.update(zip(new, self.words(new).tolist(), strict=True))
        get = self.known.__getitem__
        out = np.array([self._text(np.fromiter(map(get, p), float, len(p))) for p in parts])
        for w in new:
            if len(w) > CACHED_CHARS:
                del self.known[w]
        return out

    def _text(self, logits: np.ndarray) -> float:
        """The most toxic of the windows that start at every half window."""
        n, window = len(logits), self.window
        if n == 0:
            best = 0.0
        else:
            sums = np.concatenate([[0.0], np.cumsum(logits)])
            at = np.arange(0, max(1, n - window // 2), window // 2)
            end = np.minimum(at + window, n)
            best = ((sums[end] - sums[at]) / (end - at)).max()
        return 1 / (1 + np.exp(-min(max(best + self.offset, -60.0), 60.0)))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(HELD_OUT)) == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, doc_id: str = "doc_id", text: str = "text") -> Model:
    """Learns from the bounded sample; the ids are chosen first, so that no other text moves."""
    spark = docs.sparkSession
    known = labels.where(F.col("toxic").isNotNull() & F.col(doc_id).isNotNull() & ~held_out(F.col(doc_id))).groupBy(F.col(doc_id).alias("_id")).agg(F.max("toxic").alias("_toxic"))
    order = F.xxhash64(F.col("_id").cast("string"))
    chosen = [r for kind in (1, 0) for r in known.where(F.col("_toxic") == kind).orderBy(order, "_id").limit(rows).collect()]
    if not chosen:
        return train([], [])
    ids = F.broadcast(spark.createDataFrame(chosen, known.schema))
    sample = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).where(F.length("_text") <= TRAIN_CHARS).join(ids, "_id").orderBy("_id", "_text").limit(2 * rows).collect()
    return train([r["_text"] for r in sample], [int(r["_toxic"]) for r in sample])


def scored(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns of ``docs``, and score (a column of that name is replaced)."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast((model.gram_logits().astype(np.float32), model.offset()))
    docs = docs.drop("score")

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        forget()
        scorer = Scorer(*shared.value)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            scores = [scorer.score(column.slice(k, BATCH_ROWS).to_pylist()) for k in range(0, len(column), BATCH_ROWS)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate([np.zeros(0), *scores]), pa.float64())], names=[*batch.schema.names, "score"])

    return docs.mapInArrow(work, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))


def toxicity(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    out = scored(docs.select(doc_id, text), fit(docs, labels, rows, doc_id, text), text)
    return out.select(doc_id, held_out(F.col(doc_id)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
