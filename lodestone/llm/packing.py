"""Best-fit-decreasing packing of tokenized documents into fixed-length sequences.

Lengths are whole numbers up to the capacity, so the bins that are alike (same room left) can be
kept as ranges of bin numbers, and documents of one length as ranges of ranks. A segment tree over
the capacities finds the tightest room that still fits in O(log capacity); each step places as many
documents as the range holds. The plan is the result of plain best-fit decreasing over all pieces,
but its size depends on the capacity and not on the number of documents, so the driver can make it
from a histogram. Tokenizing and placing stay distributed.

Defined cases: null text counts as empty (one piece: the end token); null doc_id is kept; equal
rows are packed once for each row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import kind_of, pick, settled, text_of

CAPACITY = 1024
END_ID = 2
#: Ranks of one length are numbered in blocks of about so many rows, so no length is one task's work: of SMALL_BLOCK rows while
#: that makes FEW_BLOCKS at most, as the driver holds a number for each block.
RANK_BLOCK, SMALL_BLOCK, FEW_BLOCKS = 50_000, 500, 32


# Fixed value: the pre-token pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _tokenizer_path(path: str | None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The letter by which a byte-level vocabulary writes each byte: itself where it shows, else one from code point 256 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def ranks(spec: dict) -> dict[bytes, int] | None:
    """The id of each token's bytes, where a tokenizer's file describes plain byte-level pair merging with ids in the order of merges."""
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    plain = plain and spec.get("normalizer") is None and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space", True)
    if not plain:
        return None
    letters, added = byte_letters(), {t["content"] for t in spec.get("added_tokens", ())}
    merged = [model["vocab"].get("".join(m if isinstance(m, list) else m.split(" ")), -1) for m in model["merges"]]
    if any(a >= b for a, b in zip(merged, merged[1:])) or merged and merged[0] < 0:
        return None
    return {bytes(letters[c] for c in token): i for token, i in model["vocab"].items() if token not in added}


class Encoder:
    """Ids of texts as the tokenizer gives them without special tokens around. Where its file describes plain pair merging, merging
    by rank gives the same ids with less work; texts that hold one of its added tokens, and other files, go to the tokenizer."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer, self.ranked = Tokenizer.from_file(path), None
        self.added = [t["content"] for t in spec.get("added_tokens", ())]
        if (merges := ranks(spec)) is not None:
            import tiktoken

            self.ranked = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=merges, special_tokens={})

    def _ids(self, text: str) -> list[int]:
        if self.ranked is None or any(token in text for token in self.added):
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        return self.ranked.encode_ordinary(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        return [np.array(self._ids(t), dtype="<u4").tobytes() for t in texts]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: the first may be shorter, all others are full."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's pieces."""
    path = _tokenizer_path(path)
    docs = pick(docs, "doc_id", "text").select("doc_id", text_of().alias("text"))
    end = np.array([END_ID], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                at, piece, start, length, crc = [], [], [], [], []
                for i, ids in enumerate(enc.encode(part.column(1).to_pylist())):
                    ids += end
                    for k, (s, n) in enumerate(_cuts(len(ids) // 4, capacity)):
                        at.append(i)
                        piece.append(k)
                        start.append(s)
                        length.append(n)
                        crc.append(zlib.crc32(ids[4 * s : 4 * (s + n)]))
                yield pa.record_batch(
                    [part.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return docs.mapInArrow(run, f"doc_id {kind_of(docs, 'doc_id')}, piece int, start long, length long, ids_crc32 long")


class Rooms:
    """Segment tree over the room left, 0..capacity: the tightest room of `need` or more that some bin has."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.any = [False] * (2 * self.size)
        self.ranges: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def _mark(self, room: int, value: bool) -> None:
        i = self.size + room
        while i and self.any[i] != value:
            self.any[i] = value
            i //= 2
            value = self.any[2 * i] or self.any[2 * i + 1] if i else value

    def push(self, room: int, first: int, count: int) -> None:
        if count and room:
            self.ranges[room].append((first, count))
            self._mark(room, True)

    def pop(self, room: int) -> tuple[int, int]:
        out = self.ranges[room].pop()
        if not self.ranges[room]:
            self._mark(room, False)
        return out

    def tightest(self, need: int) -> int | None:
        i = self.size + need
        if not self.any[i]:
            while i > 1 and (i & 1 or not self.any[i + 1]):
                i //= 2
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if self.any[2 * i] else 2 * i + 1
        return i - self.size


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[dict[int, list[tuple[int, int, int]]], int]:
    """For each length, (first rank, first bin, offset) of runs of ranks that go to successive bins; and the number of bins."""
    rooms, bins = Rooms(capacity), 0
    out: dict[int, list[tuple[int, int, int]]] = {}
    for length in sorted(counts, reverse=True):
        left, rank, runs = counts[length], 0, out.setdefault(length, [])

        def place(first: int, count: int, room: int, each: int) -> None:
            nonlocal rank
            for j in range(each):
                runs.append((rank, first, capacity - room + j * length))
                rank += count
            rooms.push(room - each * length, first, count)

        while left:
            room = rooms.tightest(length)
            if room is None:
                room, fresh = capacity, -(-left // (capacity // length))
                first, count, bins = bins, fresh, bins + fresh
            else:
                first, count = rooms.pop(room)
            each = room // length  # the bin just used stays the tightest until nothing more fits
            full = min(count, left // each)
            if full:
                place(first, full, room, each)
                left -= full * each
            if left and full < count:
                place(first + full, 1, room, left)
                left, full = 0, full + 1
            rooms.push(room, first + full, count - full)
    return out, bins


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """`cut` (as `pieces` gives it) with sequence_id and offset."""
    cut = settled(cut)
    total = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # capacity rows at most
    blocks = [max(1, -(-total.get(n, 0) // RANK_BLOCK), min(FEW_BLOCKS, total.get(n, 0) // SMALL_BLOCK)) for n in range(capacity + 1)]
    block = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.element_at(F.lit(blocks), F.col("length").cast("int") + 1).cast("long")).alias("block")
    dealt = cut.select("*", block)
    base: dict[tuple[int, int], int] = {}
    seen: dict[int, int] = {}
    # a row for each block: capacity * FEW_BLOCKS + pieces / RANK_BLOCK at most
    for r in sorted(dealt.groupBy("length", "block").agg(F.count(F.lit(1)).alias("n")).collect()):
        base[r["length"], r["block"]] = seen.get(r["length"], 0)
        seen[r["length"]] = seen.get(r["length"], 0) + r["n"]
    runs, _ = plan(total, capacity)
    tables = {n: tuple(np.array(x, dtype=np.int64) for x in zip(*v)) for n, v in runs.items()}
    ranked = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("length", "block").orderBy("doc_id", "piece", "ids_crc32")).cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, blk, rank = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("length", "block", "rank"))
            bins, offsets = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length):
                at = np.flatnonzero(length == n)
                r = rank[at] - 1 + np.array([base[n, x] for x in blk[at].tolist()], dtype=np.int64)
                ranks, firsts, offs = tables[n]
                k = np.searchsorted(ranks, r, side="right") - 1
                bins[at], offsets[at] = firsts[k] + r - ranks[k], offs[k]
            keep = [b.column(b.schema.get_field_index(c)) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.record_batch([*keep, pa.array(bins), pa.array(offsets)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(run, f"doc_id {kind_of(cut, 'doc_id')}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    return pack(pieces(docs, path, capacity), capacity)
