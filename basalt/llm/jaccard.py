"""N-gram Jaccard join with Bayesian candidate pruning.

Documents are sets of five-word shingles (64-bit hashes); a shorter text with words is one shingle. Documents with equal
sets form a class; all that follows works on classes, so copies are never paired with each other.

1. Every class gets 128 MinHash values. ``BANDS`` bands of ``ROWS`` values find candidates: at a similarity of 0.8 a
   pair shares no band with probability (1 - 0.8^4)^24, 3 in a million.
2. Classes that share a band meet in cells of at most 2 x ``BLOCK`` members; a group with more is dealt over the pairs of
   its blocks. In a cell MinHash values (one byte each) are compared 16 at a time, and a pair is dropped as soon as the
   posterior probability that its similarity reaches the threshold, under a uniform prior, is below ``TOLERANCE``.
   A cell gives a spanning forest of the pairs that survive, never the pairs.
3. Components of that forest hold all surviving pairs. Their members meet again, in cells of bounded size, with their
   shingles, and every pair is verified exactly. Cells give each member's number of linked documents, and a forest.

Results per document: ``class_id``, the smallest doc_id that it is linked with directly or through others, and
``n_links``, the number of other documents whose similarity with it is at least the threshold.

Defined results: null texts and texts without words link with nothing (class_id is their own id); rows with equal texts
link with each other, also under one id; ids are 64-bit hashes of the sets, so two different sets are taken for one with
a probability of about n^2 / 2^65. A null doc_id counts in n_links, and is a class_id only where a class has no other.
Rows of one id, or without any, cost what rows with ids of their own cost. Texts are read whole, however long. Columns
beside id and text are left out, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stored, words
from .encode import forget

SHINGLE = 5
THRESHOLD = 0.8
HASHES = 128
BANDS, ROWS = 24, 4
BLOCK = 256
STEP = 16
TOLERANCE = 1e-7
#: Surviving pairs that a task holds before it turns them into a forest.
HELD_PAIRS = 200_000
#: Words of documents that a task turns into shingles at once.
BATCH_WORDS = 1 << 17
#: Tasks over which the rows of one group are dealt where they meet the group's row.
SALTS = 16
#: Members and shingles of a block in the exact stage.
EXACT_BLOCK, EXACT_WORDS = 128, 1 << 16

_MULTIPLIERS = np.random.default_rng(20_240_517).integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A finaliser of 64-bit values: xor-shifts and odd multiples."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles(word_hashes: np.ndarray, sizes: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of documents whose words lie one after another, sorted within each, and the document of each."""
    n = np.asarray(sizes, np.int64)
    starts = np.cumsum(n) - n
    w = word_hashes.astype(np.uint64)
    count = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    doc = np.repeat(np.arange(len(n)), count)
    at = np.repeat(starts, count) + np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    length = np.minimum(n, width)[doc]
    value = length.astype(np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            if len(at):
                more = np.where(k < length, w[np.minimum(at + k, len(w) - 1)], np.uint64(0))
                value = _mix(value * _P + more)
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    keep = np.ones(len(value), bool)
    keep[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    return value[keep], doc[keep]


def set_keys(value: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit key of each document's set: a sum of mixed members, so any order gives the same."""
    with np.errstate(over="ignore"):
        mixed = _mix(value ^ np.uint64(0xA5A5A5A5A5A5A5A5))
        total = np.zeros(n, np.uint64)
        if len(value):
            first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
            total[doc[first]] = np.add.reduceat(mixed, first)
        return _mix(total + np.bincount(doc, minlength=n).astype(np.uint64)).view(np.int64)


def minhash(value: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """(n, HASHES) 32-bit MinHash values; zeros for documents without shingles."""
    out = np.zeros((n, HASHES), np.uint32)
    if len(value):
        first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        rows = doc[first]
        with np.errstate(over="ignore"):
            for k, a in enumerate(_MULTIPLIERS):
                out[rows, k] = np.minimum.reduceat(((value * a) >> np.uint64(32)).astype(np.uint32), first)
    return out


def bands(signature: np.ndarray) -> np.ndarray:
    """(n, BANDS) 64-bit hashes of the bands; the band's number is part of its hash."""
    with np.errstate(over="ignore"):
        out = np.tile(np.arange(BANDS, dtype=np.uint64), (len(signature), 1))
        for r in range(ROWS):
            out = _mix(out * _P + signature[:, r : BANDS * ROWS : ROWS].astype(np.uint64))
    return out.view(np.int64)


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE, step: int = STEP, hashes: int = HASHES) -> list[int]:
    """Fewest matches after each step at which the posterior of reaching the threshold is not below the tolerance.

    One byte of two different values agrees with probability 1/256, so a similarity s matches with s + (1 - s) / 256.
    """
    s = (np.arange(20_000) + 0.5) / 20_000
    log_match, log_miss = np.log(s + (1 - s) / 256), np.log((1 - s) * 255 / 256)
    out = []
    for n in range(step, hashes + 1, step):
        for m in range(n + 1):
            weight = m * log_match + (n - m) * log_miss
            weight = np.exp(weight - weight.max())
            if weight[s >= threshold].sum() >= tolerance * weight.sum():
                out.append(m)
                break
    return out


def _columns(batch, *names: str) -> list:
    return [batch.column(batch.schema.get_field_index(n)) for n in names]


def _flat(lists) -> tuple[np.ndarray, np.ndarray]:
    """Values of an Arrow list column, and the size of each list (null: 0)."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return lists.flatten().to_numpy(zero_copy_only=False), sizes


def _bounded(batches: Iterator, column: int) -> Iterator:
    """Batches in parts of at most ``BATCH_WORDS`` list values (a longer list is a part of its own)."""
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        sizes = pc.fill_null(pc.list_value_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes, dtype=np.int64) // BATCH_WORDS
        cuts = np.r_[0, np.flatnonzero(part[1:] != part[:-1]) + 1, len(part)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b > a:
                yield batch.slice(a, b - a)
        pa.default_memory_pool().release_unused()


def word_hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def signed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text_key (a hash of the text), node (the key of its set; null without words), bands, signature (a byte of each MinHash value)."""

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        forget()
        for batch in _bounded(batches, 1):
            w, sizes = _flat(batch.column(1))
            value, doc = shingles(w, sizes)
            n = len(sizes)
            sig = minhash(value, doc, n)
            empty = sizes == 0
            low = np.ascontiguousarray(sig.astype(np.uint8))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * BANDS), pa.array(bands(sig).reshape(-1)))
            node = pa.array(set_keys(value, doc, n), mask=empty)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), node, lists, pa.array([x.tobytes() for x in low], pa.binary())], names=["doc_id", "text_key", "node", "bands", "signature"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, word_hashes(F.col(text)).alias("w"), F.xxhash64(text).alias("text_key")).mapInArrow(work, f"doc_id {kind}, text_key long, node long, bands array<long>, signature binary")


def _groups(batches: Iterator, key: str, rows: int = 8_000) -> Iterator:
    """Tables of whole groups of a partition that is sorted by key, of about so many rows."""
    import pyarrow as pa

    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            whole = pa.Table.from_batches(held)
            keys = whole.column(key).to_numpy()
            cut = int(np.searchsorted(keys, keys[-1], "left"))
            if cut:
                yield whole.slice(0, cut)
            held = whole.slice(cut).to_batches()
            del whole
            pa.default_memory_pool().release_unused()
    if held:
        yield pa.Table.from_batches(held)


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Each node's smallest reachable node, over edges a - b."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def _surviving(cell: np.ndarray, node: np.ndarray, signature: np.ndarray, least: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smaller node) that span the pairs within cells which pruning leaves."""
    n = len(cell)
    left, right, held, known = [], [], 0, []
    row = np.arange(n - 1)
    distance = 1
    while len(row):
        row = row[row + distance < n]
        row = row[cell[row] == cell[row + distance]]
        for k in range(0, len(row), 1 << 15):
            i = row[k : k + (1 << 15)]
            j = i + distance
            keep = node[i] != node[j]
            i, j = i[keep], j[keep]
            found = np.zeros(len(i), np.int64)
            for step, m in enumerate(least):
                part = slice(step * STEP, (step + 1) * STEP)
                found += (signature[i, part] == signature[j, part]).sum(1)
                keep = found >= m
                i, j, found = i[keep], j[keep], found[keep]
                if not len(i):
                    break
            left.append(i.astype(np.int32))
            right.append(j.astype(np.int32))
            held += len(i)
            if held >= HELD_PAIRS:  # a forest takes the place of the pairs so far
                known.append(_edges(node, np.concatenate(left), np.concatenate(right)))
                left, right, held = [], [], 0
        distance += 1
    if left:
        known.append(_edges(node, np.concatenate(left), np.concatenate(right)))
    if not known:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = (np.concatenate([e[k] for e in known]) for k in (0, 1))
    return _edges(np.concatenate([a, b]), np.arange(len(a)), np.arange(len(a)) + len(a))


def _edges(node: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    names, at = np.unique(node, return_inverse=True)
    label = _forest(len(names), at[i], at[j])
    moved = np.flatnonzero(label != np.arange(len(names)))
    return names[moved], names[label[moved]]


def _dealt(members: DataFrame, group: str, size: str, *extra: str) -> DataFrame:
    """Puts each member of a group of ``size`` blocks into the cells of its block with every block."""
    block = F.pmod(F.xxhash64("node", group), F.col(size)).cast("int")
    out = members.withColumn("block", block).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col(size).cast("int") - 1)))
    return out.select(F.xxhash64(group, F.least("block", "_other"), F.greatest("block", "_other")).alias("cell"), "node", "block", (F.col("block") == F.col("_other")).alias("own"), *extra)


def salted(rows: DataFrame, groups: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Rows (with ``node``) joined with one row of each group: the rows of a group are dealt over ``SALTS`` tasks."""
    each = groups.withColumnRenamed(key, "_key").withColumn("_salt2", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
    return (rows.hint("merge") if how == "inner" else rows).join(each, (F.col(key) == F.col("_key")) & (F.col("_salt") == F.col("_salt2")), how).drop("_key", "_salt", "_salt2")


def candidates(classes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Edges (a, b), b < a, that span all pairs which share a band and survive pruning."""
    rows = classes.select("node", F.explode("bands").alias("band"))
    sizes = rows.groupBy("band").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.col("band").alias("_band"), F.ceil(F.col("_n") / BLOCK).alias("blocks"))
    members = rows.join(sizes, F.col("band") == F.col("_band")).select("node", "band", "blocks")
    cells = _dealt(members.join(classes.select("node", "signature"), "node"), "band", "blocks", "signature")
    least = least_matches(threshold)

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for part in _groups(batches, "cell"):
            sig = np.frombuffer(b"".join(part.column("signature").to_pylist()), np.uint8).reshape(-1, HASHES)
            a, b = _surviving(part.column("cell").to_numpy(), part.column("node").to_numpy(), sig, least)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(work, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) of every node that has an edge.

    Every round sends each node to its smallest neighbour, twice over, and keeps the edges between what is left; rounds
    are stored, so neither the driver nor one task ever holds a component.
    """
    edges = stored(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    known = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = stored(both.groupBy("a").agg(F.min("b").alias("_b")).select(F.col("a").alias("node"), F.least("a", "_b").alias("root")), "parents")
        up = parent.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
        jump = stored(parent.join(up, F.col("root") == F.col("_n")).select("node", F.col("_r").alias("root")), "jumps")
        up = jump.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
        if known is None:
            known = jump
        else:
            known = stored(known.join(up, F.col("root") == F.col("_n"), "left").select("node", F.coalesce("_r", "root").alias("root")), "roots")
        for end in ("a", "b"):
            edges = edges.join(up, F.col(end) == F.col("_n")).withColumn(end, F.col("_r")).drop("_n", "_r")
        edges = stored(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")) if known is None else known


def _overlaps(value: np.ndarray, member: np.ndarray, n: int) -> np.ndarray:
    """(n, n) sizes of intersections, by products of slices of the incidence matrix."""
    out = np.zeros((n, n), np.float32)
    names, at, times = np.unique(value, return_inverse=True, return_counts=True)
    shared = times > 1
    column = np.cumsum(shared) - 1
    keep = shared[at]
    at, member = column[at[keep]], member[keep]
    order = np.argsort(at, kind="stable")
    at, member = at[order], member[order]
    width = 8192
    for start in range(0, int(shared.sum()), width):
        lo, hi = np.searchsorted(at, (start, start + width))
        part = np.zeros((n, width), np.float32)
        part[member[lo:hi], at[lo:hi] - start] = 1
        out += part @ part.T
    return out


def verified(members: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """node, root, n_docs, w (word hashes) -> rows (node, other, links): a forest's edges, and numbers of linked documents."""
    sizes = members.groupBy("root").agg(F.greatest(F.ceil(F.count(F.lit(1)) / EXACT_BLOCK), F.ceil(F.sum(F.size("w")) / EXACT_WORDS)).alias("blocks"))
    # Only groups of several blocks are looked up, few rows; members of one group meet them in ``SALTS`` places.
    blocks = salted(members, stored(sizes.where("blocks > 1"), "sizes"), "root", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    cells = _dealt(blocks, "root", "blocks", "n_docs", "w")

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for part in _groups(batches, "cell", 256):
            cell = part.column("cell").to_numpy()
            cuts = np.r_[np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]), len(cell)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                one = part.slice(lo, hi - lo).combine_chunks()
                node, block, n_docs = (one.column(c).to_numpy() for c in ("node", "block", "n_docs"))
                value, doc = shingles(*_flat(one.column("w").chunk(0)))
                size = np.bincount(doc, minlength=len(node))
                same = _overlaps(value, doc, len(node))
                linked = same >= threshold * (size[:, None] + size[None, :] - same) - 1e-6
                linked &= node[:, None] != node[None, :]
                if not one.column("own")[0].as_py():  # pairs of one block meet in the block's own cell
                    linked &= block[:, None] != block[None, :]
                links = linked @ n_docs.astype(np.int64)
                some = np.flatnonzero(links)
                if len(some):
                    a, b = _edges(node, *np.nonzero(linked))
                    yield pa.RecordBatch.from_arrays([pa.array(np.r_[node[some], a]), pa.array(np.r_[node[some], b]), pa.array(np.r_[links[some], np.zeros(len(a), np.int64)])], names=["node", "other", "links"])

    return cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(work, "node long, other long, links long")


def jaccard_join(docs: DataFrame, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, class_id, n_links of every document."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = stored(signed(docs), "signatures")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "text_key")).alias("first")
    classes = rows.where("node is not null").groupBy("node").agg(first, F.count(F.lit(1)).alias("n_docs"), F.first("bands").alias("bands"), F.first("signature").alias("signature"))
    classes = stored(classes.select("node", F.col("first.doc_id").alias("first_id"), F.col("first.text_key").alias("first_text"), "n_docs", "bands", "signature"), "classes")
    groups = components(candidates(classes, threshold))
    texts = class_texts(docs, groups.join(classes.select("node", "first_id", "first_text", "n_docs"), "node"))
    found = stored(verified(stored(_right_texts(texts), "members"), threshold), "links")
    links = found.where("links > 0").groupBy("node").agg(F.sum("links").alias("links"))
    exact = components(found.where("node != other").select(F.col("node").alias("a"), F.col("other").alias("b")))
    named = stored(classes.select("node", "first_id", "n_docs").join(exact, "node", "left").join(links, "node", "left"), "named")
    linked, alone = named.where("root is not null"), named.where("root is null").withColumn("class_id", F.col("first_id"))
    ids = linked.groupBy("root").agg(F.min("first_id").alias("class_id"))
    named = salted(linked, ids, "root").unionByName(alone).select(F.col("node").alias("_node"), "class_id", (F.col("n_docs") - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"))
    out = rows.select("doc_id", "node").join(named, F.col("node") == F.col("_node"), "left")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def class_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, root, n_docs, w of the rows of each class's first id and text: of one class a row, unless rows repeat.

    Ids may be null or shared by any number of rows, so rows meet classes by id and text. A row's text is of one class, so
    there are never more rows than documents.
    """
    same = docs["doc_id"].eqNullSafe(F.col("first_id")) & (F.xxhash64(docs["text"]) == F.col("first_text"))
    return docs.hint("merge").join(wanted, same).select("node", "root", "n_docs", word_hashes(F.col("text")).alias("w"))


def _right_texts(texts: DataFrame) -> DataFrame:
    """Rows whose text has the node's set (hashes of two texts may agree), one of each node."""

    at = texts.columns.index("w")

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in _bounded(batches, at):
            node, w = _columns(batch, "node", "w")
            value, doc = shingles(*_flat(w))
            right = set_keys(value, doc, batch.num_rows) == node.to_numpy()
            yield batch.filter(pa.array(right))

    return texts.mapInArrow(work, texts.schema).dropDuplicates(["node"])
