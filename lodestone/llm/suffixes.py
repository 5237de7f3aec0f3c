"""Suffix-array removal of long byte strings that occur more than once in a corpus.

A text is a row of windows of LENGTH bytes. Each window names an anchor: the GRAM bytes in it whose hash
is least (the last of equals), so equal windows have equal anchors wherever they stand. Windows in a row
with one anchor are a run; only runs whose anchor occurs again can hold a repeated window.

1. Runs are counted by (anchor, digest of the run's bytes). Equal runs are repeats as a whole.
2. Other runs go to shards by their anchor. A shard sorts all suffixes of its runs (Larsson-Sadakane
   refinement: only groups that still tie are sorted again, by ranks further on), takes common prefixes by
   Kasai's rule, all runs in step, and reports windows that share LENGTH bytes with a neighbour.
3. An anchor with more runs than a shard takes is dealt over several shards; each gives the sorted digests of
   its distinct windows by ranges, and shards are merged range by range with binary search.
4. The reported intervals of a row are joined and cut out.

`passages` uses the same steps on streams of words (TOKEN bytes a word), to find documents with PASSAGE words in a row that
another document has too, however they are written (case, blanks, marks).

Defined cases: null text is empty; texts shorter than LENGTH lose nothing; null doc_id is kept; equal rows are
copies and lose all their long strings alike, but are one document to `passages`; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_size, kind_of, pick, released, removed, row_key, settled, text_of, written
from .shingles import mixed, powers, word_hashes

LENGTH = 400
GRAM = 128
#: Bytes of a word in a stream, words of a passage, and words of an anchor in one.
TOKEN, PASSAGE, PASSAGE_GRAM = 3, 51, 12
#: Bytes that one suffix array takes, and runs of one anchor in a shard.
SHARD_BYTES = 400_000
SHARD_RUNS = 1_000
_BASE = np.uint64(0x5851F42D4C957F2D)
_BASE2 = np.uint64(0x2545F4914F6CDD1D)


class Sums:
    """Running sums of a polynomial over bytes, which give a hash of any stretch. Two different stretches of under 1024
    bytes that a text may hold have one hash by chance alone; longer ones are not asked for."""

    def __init__(self, data: np.ndarray, base: np.uint64 = _BASE):
        size = 1 << max(20, (len(data) + 1).bit_length())
        up, self.down = powers(int(base), size)
        self.total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=self.total[1:])

    def grams(self, n: int) -> np.ndarray:
        """Of the n bytes from each place."""
        return mixed((self.total[n:] - self.total[: len(self.total) - n]) * self.down[: len(self.total) - n])

    def stretches(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.total[end] - self.total[first]) * self.down[first])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each `width` neighbours, by running minima of blocks forwards and backwards."""
    n = len(x) - width + 1
    pad = -len(x) % width
    blocks = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def runs(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """text, first window, last window, anchor and digest of each run of windows with one anchor, as arrays in order. A run has
    at most 2 * length - gram bytes, as its anchor is inside of all its windows."""
    sizes = np.array([len(t) for t in texts], np.int64)
    windows = np.maximum(sizes - length + 1, 0)
    if not windows.any():
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    sums = Sums(np.frombuffer(b"".join(texts), np.uint8))
    h = sums.grams(gram)
    low = np.uint64(0xFFFFFFFF)
    least = sliding_min((h & ~low) | (low - np.arange(len(h), dtype=np.uint64)), length - gram + 1)
    chosen = (low - (least & low)).astype(np.int64)
    starts = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(texts)), windows)
    place = np.arange(len(owner)) + np.repeat(starts - (np.cumsum(windows) - windows), windows)
    chosen = chosen[place]
    fresh = np.ones(len(place), bool)
    fresh[1:] = (chosen[1:] != chosen[:-1]) | (owner[1:] != owner[:-1])
    heads = np.flatnonzero(fresh)
    first, last, at = place[heads], place[np.append(heads[1:], len(place)) - 1], chosen[heads]
    digest = mixed(sums.stretches(first, last + length) ^ mixed((at - first).astype(np.uint64)))
    text = owner[heads]
    return text, first - starts[text], last - starts[text], h[at].view(np.int64), digest.view(np.int64)


def suffix_array(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes with a separator after each text, start of each text, suffix array, rank).

    Separators are different and less than all bytes. Larsson-Sadakane: ranks by the first 7 bytes, then
    groups of equal rank are sorted by the rank that many places on, twice as far each time."""
    sizes = np.array([len(t) for t in texts])
    starts = np.cumsum(sizes + 1) - sizes - 1
    n = int((sizes + 1).sum())
    data = np.frombuffer(b"\0".join([*texts, bytes(7)]), np.uint8)
    seps = starts + sizes
    end = np.repeat(seps, sizes + 1).astype(np.int32)  # of the text that a place is in
    left = end - np.arange(n, dtype=np.int32)
    key = np.zeros(n, np.uint64)
    for k in range(7):  # nine bits each: a place after the end is less than any byte
        key <<= np.uint64(9)
        key |= np.where(left > k, data[k : n + k] + np.uint64(1), np.uint64(0))
    body = np.flatnonzero(left > 0).astype(np.int32)
    key = key[body]
    o = np.argsort(key)
    order, key = body[o], key[o]
    rank = np.empty(n, np.int32)
    rank[seps] = np.arange(len(texts))
    heads, size = _groups(key)
    rank[order] = len(texts) + np.repeat(heads, size)
    tied = np.repeat(size > 1, size)
    todo, h = order[tied], 7
    while len(todo):
        key2 = rank[todo].astype(np.int64) << 32 | rank[np.minimum(todo + np.int32(h), end[todo])]
        o = np.argsort(key2)
        todo, key2 = todo[o], key2[o]
        group = (key2 >> 32).astype(np.int32)
        whole, part = _groups(group), _groups(key2)
        rank[todo] = group + (np.repeat(*part) - np.repeat(*whole)).astype(np.int32)
        todo, h = todo[np.repeat(part[1] > 1, part[1])], 2 * h
    sa = np.empty(n, np.int32)
    sa[rank] = np.arange(n, dtype=np.int32)
    return data[:n], starts, sa, rank


def _groups(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of the runs of equal values."""
    fresh = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=fresh[1:])
    heads = np.flatnonzero(fresh)
    return heads, np.diff(heads, append=len(x))


def common_prefixes(data: np.ndarray, starts: np.ndarray, sa: np.ndarray, rank: np.ndarray, limit: int, least: int = 0) -> np.ndarray:
    """Bytes that each place's suffix shares with the one before it in the array, up to `limit`; 0 at places with fewer than
    `least` bytes to the end of their text.

    Kasai's rule (the next place shares one byte less at least), for all texts in step."""
    n, step = len(data), 16
    ends = np.append(starts[1:], n) - 1  # separators
    stop = np.repeat(ends, ends - starts + 1)
    padded = np.concatenate([data, np.zeros(step, np.uint8)])
    view = np.lib.stride_tricks.sliding_window_view(padded, step)
    lcp = np.zeros(n, np.int64)
    longest = int((ends - starts).max(initial=0))
    order = np.argsort(starts - ends, kind="stable")  # longest first
    first, last = starts[order], ends[order]
    size = last - first
    h = np.zeros(len(first), np.int64)
    for t in range(longest - max(0, least - 1)):
        m = int(np.searchsorted(-size, -(t + max(0, least - 1)), side="left"))  # texts with `least` bytes from t on
        i = first[:m] + t
        h[:m] = np.maximum(h[:m] - 1, 0)
        r = rank[i]
        j = sa[np.maximum(r - 1, 0)]
        room = np.minimum(last[:m] - i, stop[j] - j)
        room[r == 0] = 0
        room = np.minimum(room, limit)
        go = np.flatnonzero(h[:m] < room)
        while len(go):
            same = view[i[go] + h[go]] == view[j[go] + h[go]]
            run = np.where(same.all(axis=1), step, same.argmin(axis=1))
            h[go] += run
            go = go[(run == step) & (h[go] < room[go])]
        h[:m] = np.minimum(h[:m], room)
        lcp[i] = h[:m]
    return lcp


def repeated_windows(texts: list[bytes], length: int = LENGTH, owners: list[int] | None = None) -> list[np.ndarray]:
    """For each text, whether each of its windows occurs elsewhere among the texts or in the same text; with `owners`, in a text of another owner."""
    data, starts, sa, rank = suffix_array(texts)
    lcp = common_prefixes(data, starts, sa, rank, length, length)
    tied = lcp[sa] >= length  # with the suffix before
    heads = np.flatnonzero(~tied)
    if owners is None:
        several = np.diff(np.append(heads, len(sa))) > 1
    else:
        owner = np.repeat(np.array(owners), [len(t) + 1 for t in texts])[sa]
        several = np.minimum.reduceat(owner, heads) != np.maximum.reduceat(owner, heads)
    hit = np.empty(len(sa), bool)
    hit[sa] = np.repeat(several, np.diff(np.append(heads, len(sa))))
    return [hit[s : s + max(0, len(t) - length + 1)] for s, t in zip(starts.tolist(), texts)]


def _spans(first: int, hit: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Byte intervals that the marked windows cover; `first` is the place of the first window."""
    at = np.flatnonzero(hit)
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > length) + 1
    return [(first + int(x[0]), first + int(x[-1]) + length) for x in np.split(at, cut)]


def _window_digests(text: bytes, length: int) -> np.ndarray:
    """128 bits of each window, as structured values that sort."""
    data = np.frombuffer(text, np.uint8)
    out = np.empty(len(data) - length + 1, dtype=[("a", np.uint64), ("b", np.uint64)])
    out["a"], out["b"] = Sums(data).grams(length), Sums(data, _BASE2).grams(length)
    return out


def plain(texts: list) -> list[bytes]:
    return [t.encode("utf-8") if isinstance(t, str) else t for t in texts]


def words(texts: list[str]) -> list[bytes]:
    """TOKEN bytes for each word (letters, digits and underscores in a row, lower-cased) of each text."""
    return [h.view(np.uint8).reshape(-1, 8)[:, :TOKEN].tobytes() for h in word_hashes(texts)]


def _merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    """Intervals in order, joined where they touch or overlap."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def anchored(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, across: bool = False, form=plain) -> DataFrame:
    """row, lo, hi (first and last window), anchor, digest and own of every run.

    Equal runs of one text (periodic text has one for every period) are one row, with the bytes they cover in
    `own`, which is null otherwise; `across`, where repeats in one text don't count, the bytes of each of them."""
    interval = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):
            raw = form(batch.column(1).to_pylist())
            for part in by_size(range(len(raw)), map(len, raw), 500_000):
                text, lo, hi, anchor, digest = runs([raw[i] for i in part], length, gram)
                own: list[list[dict] | None] = [None] * len(text)
                order = np.lexsort((lo, digest, anchor, text))
                twin = np.ones(len(order), bool)
                twin[:1] = False
                for x in (text[order], anchor[order], digest[order]):
                    twin[1:] &= x[1:] == x[:-1]
                if twin.any():
                    heads = np.flatnonzero(~twin)
                    several = np.flatnonzero(np.diff(heads, append=len(order)) > 1)
                    for k in several.tolist():
                        same = order[heads[k] : heads[k + 1] if k + 1 < len(heads) else None]
                        covered = list(zip(lo[same].tolist(), (hi[same] + length).tolist()))
                        own[same[0]] = [{"a": a, "b": b} for a, b in (covered if across else _merged(covered))]
                    keep = np.sort(order[heads])
                    text, lo, hi, anchor, digest = (x[keep] for x in (text, lo, hi, anchor, digest))
                    own = [own[k] for k in keep.tolist()]
                rows = batch.column(0).take(pa.array(np.asarray(part)[text] if len(text) else [], pa.int64()))
                yield pa.record_batch([rows, *map(pa.array, (lo, hi, anchor, digest)), pa.array(own, interval)], names=["row", "lo", "hi", "anchor", "digest", "own"])

    return docs.select("row", "text").mapInArrow(run, "row binary, lo long, hi long, anchor long, digest long, own array<struct<a:long,b:long>>")


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, across: bool = False, once: bool = False, form=plain) -> DataFrame:
    """row, a, b: intervals of the bytes that `form` makes of `docs` (row, text: string or binary) which are covered by strings of `length` that
    occur again, or, `across`, in another row. `once`: at least one interval of each row that has any; a row with equal runs is not
    searched further."""
    spark = docs.sparkSession
    path = written(anchored(docs, length, gram, across, form))
    every = spark.read.parquet(path)
    times = F.sum(F.when(F.col("own").isNull(), 1).otherwise(2))
    # what is joined by anchor is settled before, so that the join sees a plain exchange on both sides and can split an anchor that many rows share
    again = settled(every.groupBy("anchor").agg(times.alias("m")).where("m > 1").select("anchor"))
    shared = settled(every.join(again, "anchor"))
    removed(spark, path)
    copies = F.when(F.min("row") != F.max("row"), 2).otherwise(1).cast("long") if across else times
    same = settled(shared.groupBy("anchor", "digest").agg(copies.alias("copies"), F.min(F.struct("row", "lo")).alias("rep")))
    kinds = settled(same.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1"))
    whole = shared.join(same.where("copies > 1").select("anchor", "digest"), ["anchor", "digest"]).select("row", F.explode(F.coalesce("own", F.array(F.struct(F.col("lo").alias("a"), (F.col("hi") + length).alias("b"))))).alias("s")).select("row", "s.a", "s.b")
    # one run of each kind stands for its copies; only anchors with several kinds go on
    reps = same.join(kinds, "anchor").select("anchor", "digest", "copies", "kinds", "rep.row", "rep.lo")
    if once:
        whole = settled(whole)
        undecided = reps.where("copies = 1").join(whole.select("row").distinct(), "row", "left_anti").select("anchor").distinct()
        reps = reps.join(settled(undecided), "anchor")
    released(spark)
    reps = reps.join(shared.groupBy("anchor", "digest").agg(F.min(F.col("hi") - F.col("lo")).alias("more")), ["anchor", "digest"])
    wanted = reps.groupBy("row").agg(F.collect_list(F.struct("anchor", "digest", "copies", "kinds", "lo", "more")).alias("wanted"))  # one text's runs

    cut_out = "anchor long, shard int, shards int, copies long, row binary, lo long, bytes binary"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                raw = form([batch.column(1)[k].as_py()])[0]
                row, out = batch.column(0)[k].as_py(), []
                for w in batch.column(2)[k].as_py():
                    shards = -(-w["kinds"] // SHARD_RUNS)
                    out.append((w["anchor"], w["digest"] % shards, shards, w["copies"], row, w["lo"], raw[w["lo"] : w["lo"] + w["more"] + length]))
                cols = list(zip(*out))
                yield pa.record_batch(
                    [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.binary()), pa.array(cols[5], pa.int64()), pa.array(cols[6], pa.binary())],
                    names=["anchor", "shard", "shards", "copies", "row", "lo", "bytes"],
                )

    pieces = docs.join(wanted, "row").select("row", "text", "wanted").mapInArrow(cut, cut_out).dropDuplicates(["anchor", "row", "lo"])
    dealt = pieces.repartition("anchor", "shard").sortWithinPartitions("anchor", "shard")

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def shard(rows: list[tuple]) -> pa.RecordBatch:
            out: list[tuple] = []
            texts = [r[6] for r in rows]
            numbers = {r[4]: k for k, r in enumerate(rows)}
            # a run that several rows have stands for all of them, so it is none's own
            hits = repeated_windows(texts, length, [numbers[r[4]] if r[3] == 1 else -1 - k for k, r in enumerate(rows)] if across else None)
            dealt_windows: dict[tuple, list] = {}
            for r, hit in zip(rows, hits):
                if r[3] == 1:
                    out += [(r[4], a, b, None, None, None, None) for a, b in _spans(r[5], hit, length)]
                if r[2] > 1:  # other shards have runs of this anchor
                    dealt_windows.setdefault((r[0], r[1], r[2]), []).append((r, hit))
            for (anchor, number, shards), mine in dealt_windows.items():
                digests = np.concatenate([_window_digests(r[6], length) for r, _ in mine])
                owner = np.repeat(np.arange(len(mine)), [len(h) for _, h in mine])
                place = np.concatenate([np.arange(len(h)) + r[5] for r, h in mine])
                done = np.concatenate([h | (r[3] > 1) for r, h in mine])
                o = np.lexsort((done, digests["b"], digests["a"]))
                first = np.ones(len(o), bool)
                first[1:] = digests[o[1:]] != digests[o[:-1]]
                o = o[first]  # those that are equal here are all marked
                ranges = 1 << max(0, int(shards - 1).bit_length())
                part = (digests["a"][o] >> np.uint64(64 - ranges.bit_length() + 1)).astype(np.int64) if ranges > 1 else np.zeros(len(o), np.int64)
                for p in range(ranges):
                    x = o[part == p]
                    owners = sorted(set(owner[x].tolist()))
                    blob = np.zeros(len(x), dtype=[("a", np.uint64), ("b", np.uint64), ("owner", np.int32), ("done", np.int32), ("place", np.int64)])
                    blob["a"], blob["b"], blob["place"], blob["done"] = digests["a"][x], digests["b"][x], place[x], done[x]
                    blob["owner"] = np.searchsorted(owners, owner[x])
                    out.append((None, None, None, anchor, p, blob.tobytes(), [mine[k][0][4] for k in owners]))
            cols = list(zip(*out)) or [()] * 7
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.binary()))
            return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], names=["row", "a", "b", "anchor", "part", "blob", "owners"])

        rows: list[tuple] = []
        total = 0
        for batch in batches:
            for r in zip(*[c.to_pylist() for c in batch.columns]):
                if rows and total > SHARD_BYTES and r[:2] != rows[-1][:2]:
                    yield shard(rows)
                    rows, total = [], 0
                rows.append(r)
                total += len(r[6])
        if rows:
            yield shard(rows)

    sorted_out = settled(dealt.mapInArrow(sort, "row binary, a long, b long, anchor long, part long, blob binary, owners array<binary>"))
    inside = sorted_out.where("row is not null").select("row", "a", "b")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def merged(lists: list[tuple[np.ndarray, list[bytes]]]) -> pa.RecordBatch:
            names: dict[bytes, int] = {}
            owners = [np.array([names.setdefault(o, len(names)) for o in theirs], np.int64)[x["owner"]] for x, theirs in lists]
            tables = [_table(x, o) for (x, _), o in zip(lists, owners)]
            while len(tables) > 1:
                tables = [_joined(*tables[i : i + 2]) if i + 1 < len(tables) else tables[i] for i in range(0, len(tables), 2)]
            table, who, row, a, b = tables[0], list(names), [], [], []
            for (x, _), o in zip(lists, owners):
                at = _places(table, x["a"], x["b"])
                hit = (x["done"] == 0) & ((table["low"][at] != table["high"][at]) | (table["done"][at] != 0) if across else table["shards"][at] > 1)
                mine, place = o[hit], x["place"][hit]
                order = np.lexsort((place, mine))
                mine, place = mine[order], place[order]
                first = np.ones(len(mine), bool)
                first[1:] = (mine[1:] != mine[:-1]) | (place[1:] - place[:-1] > length)
                heads = np.flatnonzero(first)
                row += [who[k] for k in mine[heads].tolist()]
                a += place[heads].tolist()
                b += (place[np.append(heads[1:], len(place)) - 1] + length).tolist() if len(heads) else []
            return pa.record_batch([pa.array(row, pa.binary()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["row", "a", "b"])

        key, lists = None, []
        dtype = [("a", np.uint64), ("b", np.uint64), ("owner", np.int32), ("done", np.int32), ("place", np.int64)]
        for batch in batches:
            for anchor, part, blob, owners in zip(*[c.to_pylist() for c in batch.columns]):
                if (anchor, part) != key and lists:
                    yield merged(lists)
                    lists = []
                key = (anchor, part)
                lists.append((np.frombuffer(blob, dtype), owners))
        if lists:
            yield merged(lists)

    split = sorted_out.where("blob is not null").select("anchor", "part", "blob", "owners").repartition("anchor", "part").sortWithinPartitions("anchor", "part")
    between = split.mapInArrow(merge, "row binary, a long, b long")
    found = whole.unionByName(inside).unionByName(between)
    if not across or once:
        return found
    # what was found in one of a text's equal runs is in the others too
    found = settled(found)
    twins = shared.where("own is not null").select("row", F.col("lo").alias("first"), (F.col("hi") + length).alias("end"), F.explode("own").alias("o")).select("row", "first", "end", (F.col("o.a") - F.col("first")).alias("on"))
    more = found.join(twins.where(F.col("on") != 0), "row").where("a >= first and b <= end")
    return found.unionByName(more.select("row", (F.col("a") + F.col("on")).alias("a"), (F.col("b") + F.col("on")).alias("b")))


def _table(x: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """A shard's windows, which are sorted and different, with the least and greatest owner, whether one is done, and the number of shards."""
    out = np.empty(len(x), dtype=[("a", np.uint64), ("b", np.uint64), ("low", np.int64), ("high", np.int64), ("done", np.int32), ("shards", np.int32)])
    out["a"], out["b"], out["low"], out["high"], out["done"], out["shards"] = x["a"], x["b"], owner, owner, x["done"], 1
    return out


def _places(table: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Where the digests (a, b) stand in a sorted table, or would stand: by binary search for the first half, then on to the second."""
    first, second = np.ascontiguousarray(table["a"]), np.ascontiguousarray(table["b"])
    at = np.searchsorted(first, a)
    while True:
        near = np.minimum(at, len(table) - 1)
        on = (at < len(table)) & (first[near] == a) & (second[near] < b) if len(table) else np.zeros(len(at), bool)
        if not on.any():
            return at
        at = at + on


def _joined(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Two tables as one."""
    if not len(x) or not len(y):
        return x if len(x) else y
    at = _places(x, y["a"], y["b"])
    near = np.minimum(at, len(x) - 1)
    same = (at < len(x)) & (x["a"][near] == y["a"]) & (x["b"][near] == y["b"])
    to, twin = at[same], y[same]
    x["low"][to], x["high"][to] = np.minimum(x["low"][to], twin["low"]), np.maximum(x["high"][to], twin["high"])
    x["done"][to] |= twin["done"]
    x["shards"][to] += twin["shards"]
    return np.insert(x, at[~same], y[~same])


def passages(docs: DataFrame, length: int = PASSAGE, gram: int = PASSAGE_GRAM) -> DataFrame:
    """The rows of `docs` (row, text) that have `length` words in a row which another row has too."""
    return repeats(docs, length * TOKEN, gram * TOKEN, across=True, once=True, form=words).select("row").distinct()


def deduplicated(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, the bytes kept, the removed intervals, and whether a passage of over 50 words stands in another document too."""
    docs = pick(docs, "doc_id", "text").select("doc_id", row_key("doc_id", "text").alias("row"), text_of().alias("text"))
    shared = settled(passages(docs).withColumn("repeated", F.lit(1)))
    released(docs.sparkSession)
    spans = settled(repeats(docs, length, gram).groupBy("row").agg(F.collect_set(F.struct("a", "b")).alias("spans")))
    released(docs.sparkSession)
    both = spans.join(shared, "row", "full")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                kept, gone, size = [], [], []
                for text, spans in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    raw, joined, out, at = text.encode("utf-8"), _merged([(s["a"], s["b"]) for s in spans or ()]), [], 0
                    for a, b in joined:
                        out.append(raw[at:a])
                        at = b
                    kept.append(b"".join([*out, raw[at:]]))
                    gone.append([{"a": a, "b": b} for a, b in joined])
                    size.append(len(raw))
                yield pa.record_batch([part.column(0), pa.array(size, pa.int64()), pa.array(kept, pa.binary()), pa.array(gone, kind), part.column(3)], names=["doc_id", "n_bytes", "kept", "removed", "repeated"])

    schema = f"doc_id {kind_of(docs, 'doc_id')}, n_bytes long, kept binary, removed array<struct<a:long,b:long>>, repeated int"
    return docs.join(both, "row", "left").select("doc_id", "text", "spans", F.coalesce("repeated", F.lit(0)).alias("repeated")).mapInArrow(run, schema)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256; repeated is 1 where a passage of over 50 words stands in another document too."""
    out = deduplicated(docs)
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda acc, s: acc + s["b"] - s["a"])
    return out.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "repeated")
