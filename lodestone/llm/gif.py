"""GIF as a media column: LZW both ways, palettes, disposal and transparency, timed frames, colour histograms.

`decode` reads any GIF 87a/89a; its LZW decoder works on whole runs of codes between clear codes with
numpy: the widths depend only on a code's place in its run, a table entry is a piece of earlier output,
and pointer doubling resolves such references. `store` writes payload bytes as pixels of frames with a
grey palette, so sample = palette index = byte.

Defined cases: null text is the empty text (one padding block); equal texts have equal results; null
doc_id is kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import kind_of, pick, text_of

BLOCK = 576  # the payload is a multiple of this, and it is the width of a stored frame
ROWS = 64  # of a stored frame, at most
DELAY = 10  # hundredths of a second
CLEAR, END = 256, 257
#: Codes between clears: the first adds no entry, then 4096 - 258 entries, one full-table code and the clear itself.
RUN = 4096 - 258 + 2


def _width_table(least: int, n: int) -> np.ndarray:
    """Bits of the code at each place after a clear code, for a minimum code size."""
    entries = (1 << least) + 1 + np.arange(n)
    width = np.floor(np.log2(np.maximum(entries, 1))).astype(np.int64) + 1
    return np.clip(width, least + 1, 12)


_W = _width_table(8, RUN)
_CUM = np.concatenate([[0], np.cumsum(_W)])


def lzw_encode(data: bytes) -> bytes:
    """The code stream of 8-bit samples, with a clear code when the table is full."""
    codes, table, new = [CLEAR], {}, 258
    add, get = codes.append, table.get
    it = iter(data)
    w = next(it, None)
    breaks = [1]  # where runs of codes start
    if w is not None:
        for b in it:
            k = w << 8 | b
            v = get(k)
            if v is not None:
                w = v
                continue
            add(w)
            if new < 4096:
                table[k] = new
                new += 1
            else:
                add(CLEAR)
                breaks.append(len(codes))
                table.clear()
                new = 258
            w = b
        add(w)
    add(END)
    ends = [*breaks[1:], len(codes)]
    width = np.concatenate([[9], *[_W[: e - s] for s, e in zip(breaks, ends)]])
    at = np.cumsum(width) - width
    value = np.array(codes, dtype=np.int64) << (at & 7)
    byte, n = at >> 3, int(at[-1] + width[-1] + 7 >> 3)
    out = np.zeros(n + 3, np.int64)
    for k in range(3):  # bits of different codes never meet, so adding is joining
        out += np.bincount(byte + k, weights=(value >> (8 * k)) & 255, minlength=n + 3).astype(np.int64)
    return out[:n].astype(np.uint8).tobytes()


def _expand(codes: np.ndarray, least: int) -> np.ndarray:
    """Samples of one run of codes without its clear or end code."""
    first = (1 << least) + 2
    ref = np.where(codes >= first, codes - first, -1)
    if (ref >= np.arange(len(codes))).any() or ((ref < 0) & (codes >= 1 << least)).any():
        raise ValueError("LZW code before its table entry")
    size, up = np.ones(len(codes), np.int64), ref.copy()
    while (m := up >= 0).any():
        at = up[m]
        size[m], up[m] = size[m] + size[at], up[at]
    start = np.cumsum(size) - size
    total = int(size.sum())
    here = np.arange(total)
    shift = np.where(ref >= 0, start[ref] - start, 0)
    src = here + np.repeat(shift, size)
    while True:
        nxt = src[src]
        if np.array_equal(nxt, src):
            break
        src = nxt
    value = np.zeros(total, np.uint8)
    lit = ref < 0
    value[start[lit]] = codes[lit]
    return value[src]


def lzw_decode(stream: bytes, least: int = 8) -> bytes:
    """Samples of a code stream with the given minimum code size."""
    clear, end, bits = 1 << least, (1 << least) + 1, 8 * len(stream)
    raw = np.frombuffer(stream + b"\0\0\0\0", np.uint8).astype(np.int64)
    out, pos, n = [], 0, RUN
    while pos < bits:
        width = _W[:n] if least == 8 and n <= RUN else _width_table(least, n)
        at = pos + (_CUM[: len(width)] if least == 8 and n <= RUN else np.cumsum(width) - width)
        fits = int(np.searchsorted(at + width, bits, side="right"))
        at, width = at[:fits], width[:fits]
        byte = at >> 3
        codes = ((raw[byte] | raw[byte + 1] << 8 | raw[byte + 2] << 16) >> (at & 7)) & ((1 << width) - 1)
        stops = np.flatnonzero((codes == clear) | (codes == end))
        if not len(stops) and fits == n:  # a writer that never clears a full table
            n *= 2
            continue
        k = int(stops[0]) if len(stops) else len(codes)
        if k:
            out.append(_expand(codes[:k], least).tobytes())
        if k == len(codes) or codes[k] == end:
            break
        pos, n = int(at[k] + width[k]), RUN
    return b"".join(out)


@dataclass
class Frame:
    """A frame as shown: RGBA of the whole canvas, its own rectangle, and how long it stays."""

    delay_ms: int
    left: int
    top: int
    width: int
    height: int
    canvas: np.ndarray  # height x width x 4

    def histogram(self, bins: int = 4) -> np.ndarray:
        """Pixels of the frame's rectangle by colour, `bins` steps for each of red, green and blue."""
        rgb = self.canvas[self.top : self.top + self.height, self.left : self.left + self.width, :3].reshape(-1, 3).astype(np.int64) * bins // 256
        return np.bincount((rgb[:, 0] * bins + rgb[:, 1]) * bins + rgb[:, 2], minlength=bins**3)


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while n := data[at]:
        parts.append(data[at + 1 : at + 1 + n])
        at += 1 + n
    return b"".join(parts), at + 1


def _palette(data: bytes, at: int, flags: int) -> tuple[np.ndarray | None, int]:
    if not flags & 0x80:
        return None, at
    n = 3 << (flags & 7) + 1
    return np.frombuffer(data[at : at + n], np.uint8).reshape(-1, 3), at + n


def frames(data: bytes) -> Iterator[Frame]:
    """The frames of a GIF in order, each as it appears on the canvas; one is held at a time."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    w, h, flags, _, _ = struct.unpack("<HHBBB", data[6:13])
    shared, at = _palette(data, 13, flags)
    canvas = np.zeros((h, w, 4), np.uint8)
    delay, disposal, clear = 0, 0, None
    while at < len(data) and data[at] != 0x3B:
        if data[at] == 0x21:
            label = data[at + 1]
            body, at = _blocks(data, at + 2)
            if label == 0xF9:
                delay, disposal = struct.unpack("<H", body[1:3])[0] * 10, body[0] >> 2 & 7
                clear = body[3] if body[0] & 1 else None
            continue
        if data[at] != 0x2C:
            raise ValueError("unknown GIF block")
        x, y, fw, fh, flags = struct.unpack("<HHHHB", data[at + 1 : at + 10])
        own, at = _palette(data, at + 10, flags)
        least = data[at]
        body, at = _blocks(data, at + 1)
        index = np.zeros(fw * fh, np.uint8)
        got = np.frombuffer(lzw_decode(body, least)[: fw * fh], np.uint8)
        index[: len(got)] = got
        index = index.reshape(fh, fw)
        if flags & 0x40:  # four passes
            order = np.concatenate([np.arange(s, fh, d) for s, d in ((0, 8), (4, 8), (2, 4), (1, 2))])
            plain = np.empty_like(index)
            plain[order] = index
            index = plain
        colours = own if own is not None else shared
        if colours is None:
            colours = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 3, axis=1)
        colours = np.concatenate([colours, np.zeros((256 - len(colours), 3), np.uint8)])
        before = canvas.copy() if disposal == 3 else None
        area = canvas[y : y + fh, x : x + fw]
        part = index[: area.shape[0], : area.shape[1]]
        paint = np.ones(part.shape, bool) if clear is None else part != clear
        area[paint, :3], area[paint, 3] = colours[part[paint]], 255
        yield Frame(delay, x, y, area.shape[1], area.shape[0], canvas.copy())
        if disposal == 2:
            area[:] = 0
        elif before is not None:
            canvas = before
        delay, disposal, clear = 0, 0, None


def decode(data: bytes) -> list[Frame]:
    return list(frames(data))


_GREY = np.repeat(np.arange(256, dtype=np.uint8), 3).tobytes()


def store(payload: bytes) -> bytes:
    """A GIF whose frames hold `payload` (a positive multiple of BLOCK bytes) row by row."""
    rows = len(payload) // BLOCK
    out = [b"GIF89a", struct.pack("<HHBBB", BLOCK, min(rows, ROWS), 0xF7, 0, 0), _GREY]
    for top in range(0, rows, ROWS):
        n = min(ROWS, rows - top)
        body = lzw_encode(payload[top * BLOCK : (top + n) * BLOCK])
        out += [b"\x21\xf9\x04", struct.pack("<BHB", 1 << 2, DELAY, 0), b"\0", b"\x2c", struct.pack("<HHHHB", 0, 0, BLOCK, n, 0), b"\x08"]
        for k in range(0, len(body), 255):
            part = body[k : k + 255]
            out += [bytes([len(part)]), part]
        out.append(b"\0")
    return b"".join([*out, b"\x3b"])


def samples(frame: Frame) -> bytes:
    """The payload bytes that a stored frame holds."""
    return frame.canvas[: frame.height, :, 0].tobytes()


def payload_of(shown: Iterable[Frame]) -> bytes:
    return b"".join(map(samples, shown))


def padded(text: str) -> tuple[int, bytes]:
    raw = text.encode("utf-8")
    return len(raw), raw + b"\xff" * (-len(raw) % BLOCK if raw else BLOCK)


def _mapped(docs: DataFrame, columns: list[tuple[str, pa.DataType, str]], row) -> DataFrame:
    """doc_id and, from `row(n_bytes, media, frames read back)`, `columns` (name, Arrow type, SQL type);
    each text is stored once and read back once."""
    docs = pick(docs, "doc_id", "text").select("doc_id", text_of().alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                rows = []
                for t in part.column(1).to_pylist():
                    n, payload = padded(t)
                    media = store(payload)
                    rows.append(row(n, media, frames(media)))
                cols = zip(*rows) if rows else [()] * len(columns)
                yield pa.record_batch([part.column(0), *[pa.array(c, kind) for c, (_, kind, _) in zip(cols, columns)]], names=["doc_id", *[c for c, _, _ in columns]])

    return docs.mapInArrow(run, f"doc_id {kind_of(docs, 'doc_id')}, " + ", ".join(f"{c} {sql}" for c, _, sql in columns))


def media_columns(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media (the GIF) and frames (delay, size, 64-bin colour histogram of each, as read back)."""
    frame = pa.struct([("delay_ms", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("colours", pa.list_(pa.int64()))])

    def row(n, media, shown):
        return n, media, [{"delay_ms": f.delay_ms, "width": f.width, "height": f.height, "colours": f.histogram().tolist()} for f in shown]

    columns = [("n_bytes", pa.int64(), "long"), ("media", pa.binary(), "binary"), ("frames", pa.list_(frame), "array<struct<delay_ms:int,width:int,height:int,colours:array<long>>>")]
    return _mapped(docs, columns, row)


def digests(docs: DataFrame) -> DataFrame:
    """Digests of the stored GIF, of the payload read back from it, and its timing and colours as `feature`."""

    def row(n, media, shown):
        sha, size, count, time, colours = hashlib.sha256(), 0, 0, 0, np.zeros(64, np.int64)
        for f in shown:
            part = samples(f)  # of BLOCK bytes at least
            sha.update(part)
            size, count, time, colours = size + len(part), count + 1, time + f.delay_ms, colours + f.histogram()
        grey = colours[[0, 21, 42, 63]].tolist()  # where red, green and blue are alike
        feature = f"{count} frames, {time} ms, " + ":".join(map(str, grey))
        return n, size, sha.hexdigest(), zlib.crc32(part[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature

    names = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
    kinds = [(pa.string(), "string") if c in ("payload_sha256", "media_sha256", "feature") else (pa.int64(), "long") for c in names]
    return _mapped(docs, [(c, *k) for c, k in zip(names, kinds)], row)
