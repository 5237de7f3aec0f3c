"""N-gram Jaccard join: candidates by MinHash bands, Bayesian pruning, exact verification.

1. Each text becomes its set of word shingles; texts with the same set are one class entry from here on,
   so copies cost one row. Bands of MinHash values name buckets.
2. In a bucket of two entries or more, short signatures are compared a few values at a time; a pair goes
   on while the posterior probability that its similarity reaches the threshold is above TOLERANCE (uniform
   prior). What goes on ties its entries together; components of these ties are groups.
3. Inside a group, pairs are compared again value by value with the same rule, and what is left is verified
   on the whole sets. No pair leaves a task: each task returns its entries' numbers of links and a spanning
   forest of the verified links. Components of the forests are the classes.
Large buckets and groups are cut into blocks of entries, and each pair of blocks is its own task.

With 64 bands of 8 values a pair at similarity 0.8 shares no bucket with probability 8e-6, at 0.85 with
2e-9; the tolerance adds at most 1e-6 for each comparison. There are no caps. Sets are told apart by 128 bits;
the 64 bits that name them in buckets may be alike without loss, but for a pair of linked sets whose own 64 bits are.

Defined cases: null text is empty; a text without words is a class of its own with no links, copies
included; null doc_id is kept (a class of null ids alone has class_id null); equal rows link to each
other as copies do; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shingles as sh
from .common import kind_of, pick, row_key, settled, text_of
from .components import components

THRESHOLD = 0.8
BANDS, ROWS = 64, 8
SHORT = 64  # values of the short signature, one byte each
STEP = 16  # values compared at a time
TOLERANCE = 1e-6
BLOCK = 512  # entries


@lru_cache(maxsize=16)
def least_matches(threshold: float, bits: int, total: int, step: int = STEP) -> dict[int, int]:
    """After n values, the fewest matches for which P(similarity >= threshold | matches) is above TOLERANCE.

    The prior of the similarity is uniform; `bits` is the size of a value, so two different minima
    agree with probability 2 ** -bits."""
    grid = (np.arange(2000) + 0.5) / 2000
    agree = grid + (1 - grid) * 2.0**-bits
    out = {}
    for n in range(step, total + 1, step):
        for m in range(n + 1):
            like = m * np.log(agree) + (n - m) * np.log1p(-agree)
            like = np.exp(like - like.max())
            if like[grid >= threshold].sum() / like.sum() > TOLERANCE:
                out[n] = m
                break
    return out


def survivors(left: np.ndarray, right: np.ndarray, threshold: float, bits: int) -> np.ndarray:
    """Matrix of the pairs that the incremental comparison of signatures keeps."""
    alive = np.ones((len(left), len(right)), bool)
    matches = np.zeros(alive.shape, np.int32)
    done = 0
    for n, least in least_matches(threshold, bits, left.shape[1]).items():
        rows, cols = np.nonzero(alive)
        if not len(rows):
            break
        if 4 * len(rows) > alive.size:
            for k in range(done, n):
                matches += left[:, k, None] == right[None, :, k]
        else:
            for lo in range(0, len(rows), 100_000):
                r, c = rows[lo : lo + 100_000], cols[lo : lo + 100_000]
                matches[r, c] += (left[r, done:n] == right[c, done:n]).sum(axis=1, dtype=np.int32)
        alive &= matches >= least
        done = n
    return alive


def verified(left: list[np.ndarray], right: list[np.ndarray], alive: np.ndarray, threshold: float) -> np.ndarray:
    """Those of the `alive` pairs whose sets reach the threshold exactly."""
    out = np.zeros_like(alive)
    size_l, size_r = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    lower, upper = np.minimum.outer(size_l, size_r), np.maximum.outer(size_l, size_r)
    alive = alive & (lower >= threshold * upper - 1e-9)
    n = int(alive.sum())
    if not n:
        return out
    if n < 64:
        for i, j in zip(*np.nonzero(alive)):
            both = len(np.intersect1d(left[i], right[j], assume_unique=True))
            out[i, j] = both >= threshold * (size_l[i] + size_r[j] - both) - 1e-9
        return out
    rows, cols = np.flatnonzero(alive.any(axis=1)), np.flatnonzero(alive.any(axis=0))
    vl, vr = np.concatenate([left[i] for i in rows]), np.concatenate([right[j] for j in cols])
    shared = np.intersect1d(vl, vr)  # values of one side alone cannot meet
    at_l, at_r = np.searchsorted(shared, vl), np.searchsorted(shared, vr)
    in_l, in_r = shared[np.minimum(at_l, len(shared) - 1)] == vl if len(shared) else np.zeros(len(vl), bool), shared[np.minimum(at_r, len(shared) - 1)] == vr if len(shared) else np.zeros(len(vr), bool)
    of_l, of_r = np.repeat(np.arange(len(rows)), size_l[rows])[in_l], np.repeat(np.arange(len(cols)), size_r[cols])[in_r]
    at_l, at_r = at_l[in_l], at_r[in_r]
    both = np.zeros((len(rows), len(cols)), np.float32)
    for lo in range(0, len(shared), 4096):  # a slice of the vocabulary at a time bounds the matrices
        a, b = np.zeros((len(rows), 4096), np.float32), np.zeros((len(cols), 4096), np.float32)
        k = (at_l >= lo) & (at_l < lo + 4096)
        a[of_l[k], at_l[k] - lo] = 1
        k = (at_r >= lo) & (at_r < lo + 4096)
        b[of_r[k], at_r[k] - lo] = 1
        both += a @ b.T
    union = size_l[rows][:, None] + size_r[cols][None, :] - both
    sub = alive[np.ix_(rows, cols)] & (both >= threshold * union - 1e-9)
    out[np.ix_(rows, cols)] = sub
    return out


def _forest(n: int, pairs: tuple[np.ndarray, np.ndarray]) -> list[int]:
    """The least member of each of n entries' components."""
    up = list(range(n))
    for i, j in zip(pairs[0].tolist(), pairs[1].tolist()):
        while up[i] != i:
            up[i] = i = up[up[i]]
        while up[j] != j:
            up[j] = j = up[up[j]]
        if i != j:
            up[max(i, j)] = min(i, j)
    for i in range(n):
        up[i] = up[up[i]]
    return up


def prepared(docs: DataFrame) -> DataFrame:
    """doc_id, row (128-bit row key), n (shingles), entry (128 bits of the set), near (64 of them), short signature, bands; nulls where there is no word."""
    docs = pick(docs, "doc_id", "text").select("doc_id", row_key("doc_id", "text").alias("row"), text_of().alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = sh.mixed(np.arange(1, ROWS + 1, dtype=np.uint64)) | np.uint64(1)
        names = sh.mixed(np.arange(1, BANDS + 1, dtype=np.uint64) << np.uint64(32))
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                sets = sh.shingle_sets(part.column(2).to_pylist())
                has = [i for i, s in enumerate(sets) if len(s)]
                entry, short, bands = [None] * len(sets), [None] * len(sets), [None] * len(sets)
                if has:
                    values = sh.minhash([sets[i] for i in has], BANDS * ROWS)
                    small = (values[:, :: BANDS * ROWS // SHORT] >> np.uint32(3)).astype(np.uint8)
                    keys = sh.mixed((sh.mixed(values.reshape(-1, BANDS, ROWS).astype(np.uint64)) * weights).sum(axis=2, dtype=np.uint64) ^ names).astype(np.int64)
                    for k, i in enumerate(has):
                        entry[i], short[i], bands[i] = xxhash.xxh3_128_digest(sets[i].tobytes()), small[k].tobytes(), keys[k]
                near = [None if e is None else int.from_bytes(e[:8], "little", signed=True) for e in entry]
                yield pa.record_batch(
                    [part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(entry, pa.binary()), pa.array(near, pa.int64()), pa.array(short, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                    names=["doc_id", "row", "n", "entry", "near", "short", "bands"],
                )

    return docs.mapInArrow(run, f"doc_id {kind_of(docs, 'doc_id')}, row binary, n long, entry binary, near long, short binary, bands array<long>")


def _blocked(df: DataFrame, group: str, count: Column, member: str) -> DataFrame:
    """`df` with block_a, block_b and side: every pair of members of a group meets in exactly one (group, block_a, block_b)."""
    blocks = F.ceil(count / BLOCK).cast("int")
    own = F.pmod(F.xxhash64(member, F.lit(1)), blocks).cast("int")
    df = df.withColumn("own", F.when(blocks > 1, own).otherwise(0)).withColumn("other", F.explode(F.when(blocks > 1, F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(F.lit(0)))))
    return df.select("*", F.least("own", "other").alias("block_a"), F.greatest("own", "other").alias("block_b"), (F.col("own") > F.col("other")).alias("second")).drop("own", "other")


def _columns(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[list]]]:
    """Groups of sorted rows by their first `keys` columns, with the other columns as lists."""
    key, rest = None, None
    for batch in batches:
        names = list(zip(*[c.to_pylist() for c in batch.columns[:keys]]))
        cols = [c.to_pylist() for c in batch.columns[keys:]]
        lo = 0
        while lo < len(names):
            hi = lo + 1
            while hi < len(names) and names[hi] == names[lo]:
                hi += 1
            if names[lo] != key:
                if key is not None:
                    yield key, rest
                key, rest = names[lo], [[] for _ in cols]
            for mine, more in zip(rest, cols):
                mine += more[lo:hi]
            lo = hi
    if key is not None:
        yield key, rest


def _sides(key: tuple, second: list[bool]) -> tuple[list[int], list[int]]:
    if key[-1] == key[-2]:
        return (every := list(range(len(second)))), every
    return [i for i, s in enumerate(second) if not s], [i for i, s in enumerate(second) if s]


def ties(entries: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """u, v (values of `near`): forests of the pairs that share a bucket and pass the short signatures."""
    rows = entries.select("near", F.explode("bands").alias("band"))
    # counts and extremes are summed before they are moved, and buckets of one entry end here
    full = rows.groupBy("band").agg(F.min("near").alias("lo"), F.max("near").alias("hi"), F.count(F.lit(1)).alias("m")).where("lo <> hi").select("band", "m")
    met = rows.join(full, "band")
    met = _blocked(met, "band", F.col("m"), "near").join(entries.select("near", "short"), "near")
    met = met.select("band", "block_a", "block_b", "second", "near", "short")
    dealt = met.repartition("band", "block_a", "block_b").sortWithinPartitions("band", "block_a", "block_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u, v = set(), None
        for key, (second, near, short) in _columns(batches, 3):
            left, right = _sides(key, second)
            if not left or not right:
                continue
            values = np.frombuffer(b"".join(short), np.uint8).reshape(-1, SHORT)
            i, j = np.nonzero(survivors(values[left], values[right], threshold, 8))
            i, j = np.array(left)[i], np.array(right)[j]
            for x, root in enumerate(_forest(len(near), (i, j))):
                if root != x and near[x] != near[root]:
                    u.add((near[x], near[root]))
            if len(u) > 50_000:
                yield pa.record_batch([pa.array([x for x, _ in u], pa.int64()), pa.array([x for _, x in u], pa.int64())], names=["u", "v"])
                u = set()
        yield pa.record_batch([pa.array([x for x, _ in u], pa.int64()), pa.array([x for _, x in u], pa.int64())], names=["u", "v"])

    return dealt.mapInArrow(run, "u long, v long").distinct()


def links(docs: DataFrame, ready: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """entry, tied (an entry of its class, or itself), others (documents of other entries linked to it), for entries in groups; rows repeat."""
    copies = ready.where("entry is not null").groupBy("entry").agg(F.min("row").alias("row"), F.count(F.lit(1)).alias("copies"), F.min("near").alias("near"))
    # different sets with one `near` are one node of the ties, with the buckets of all of them
    entries = ready.where("entry is not null").groupBy("entry").agg(F.first("near").alias("near"), F.first("short").alias("short"), F.first("bands").alias("bands"))
    groups = components(ties(entries, threshold))
    sizes = groups.groupBy("root").agg(F.count(F.lit(1)).alias("m"))
    members = settled(copies.join(groups.join(sizes, "root"), copies["near"] == groups["node"]).select("entry", "row", "copies", "root", "m"))
    texts = pick(docs, "doc_id", "text").select(row_key("doc_id", "text").alias("row"), text_of().alias("text"))
    met = texts.join(members, "row").dropDuplicates(["row"])  # equal rows have one key

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                sets = [x.tobytes() for x in sh.shingle_sets(part.column(0).to_pylist())]
                yield pa.record_batch([pa.array(sets, pa.binary()), *[part.column(i) for i in range(1, 5)]], names=["set", "entry", "copies", "root", "m"])

    sets = met.select("text", "entry", "copies", "root", "m").mapInArrow(cut, "set binary, entry binary, copies long, root long, m long")
    dealt = _blocked(sets, "root", F.col("m"), "entry").select("root", "block_a", "block_b", "second", "entry", "copies", "set")
    dealt = dealt.repartition("root", "block_a", "block_b").sortWithinPartitions("root", "block_a", "block_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, (second, entry, copies, raw) in _columns(batches, 3):
            left, right = _sides(key, second)
            if not left or not right:
                continue
            sets = [np.frombuffer(x, np.uint64) for x in raw]
            values = sh.minhash(sets, 128)
            alive = survivors(values[left], values[right], threshold, 32)
            if left is right:
                alive = np.triu(alive, 1)
            linked = verified([sets[i] for i in left], [sets[j] for j in right], alive, threshold)
            weight = np.array(copies, np.int64)
            others = np.zeros(len(entry), np.int64)
            np.add.at(others, left, linked @ weight[right])
            np.add.at(others, right, linked.T @ weight[left])
            i, j = np.nonzero(linked)
            root = _forest(len(entry), (np.array(left)[i], np.array(right)[j]))
            keep = np.flatnonzero(others)
            yield pa.record_batch([pa.array([entry[x] for x in keep], pa.binary()), pa.array([entry[root[x]] for x in keep], pa.binary()), pa.array(others[keep])], names=["entry", "tied", "others"])

    return dealt.mapInArrow(run, "entry binary, tied binary, others long")


def join(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, row (row key), class_id (least doc_id of the class), n_links (documents linked to this one)."""
    ready = settled(prepared(docs))
    found = settled(links(docs, ready, threshold))
    roots = components(found.select(F.col("entry").alias("u"), F.col("tied").alias("v"))).withColumnsRenamed({"node": "entry"})
    others = found.groupBy("entry").agg(F.sum("others").alias("others"))
    per_entry = ready.where("entry is not null").groupBy("entry").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("least"))
    per_entry = per_entry.join(others, "entry", "left").join(roots, "entry", "left")
    per_entry = settled(per_entry.select("entry", "least", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "entry").alias("root")))
    classes = per_entry.groupBy("root").agg(F.min("least").alias("class_id"))
    named = per_entry.join(classes, "root").select("entry", "class_id", "n_links", "root")
    out = ready.select("doc_id", "row", "entry").join(named, "entry", "left")
    return out.select(
        "doc_id", "row", F.when(F.col("entry").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("root", "row").alias("class_key")
    )


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    return join(docs, threshold).select("doc_id", "class_id", "n_links")
