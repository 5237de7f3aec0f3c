"""Personal data: exact base patterns, and a semi-Markov conditional random field over candidate spans.

The field scores whole spans (digits, separators, groups, check digits, the words before, the edges) for
each type, and the type after the one before. Its dynamic programme chooses boundaries and types together.
It is trained here by the log-likelihood of generated sentences with a fixed seed.

Limits: a span of the field has MAX_TOKENS tokens at most (so the programme is linear in the text), and lies
within AROUND characters, or up to twice as many to the next blank, of something that can start one: two digits
in a row, four digits with marks between, an at-sign or "at" in brackets. Base spans have no limits; they always
stay, and a span of the field is added where it meets no base span.

Defined cases: null text is empty; null doc_id is kept; equal rows give equal rows; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import kind_of, pick

KINDS = ("email", "ip", "card", "phone")
MAX_TOKENS = 24
AROUND = 40  # characters on each side of a digit or an at-sign

# The base patterns. A run of digits can start only one match, so the look-behind changes nothing but the time on long runs.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|\s+|.", re.S)
_TRIGGER = re.compile(r"[0-9]{2,}|[0-9](?:[^\w\n]{1,3}[0-9]){3}|@|[\[(] ?at ?[\])]", re.I)
_ON_AFTER = re.compile(r"[ ./-]{1,2}\(?[0-9]")
_ON_BEFORE = re.compile(r"[0-9]\)?[ ./-]{1,2}$")
_DATED = re.compile(r"(?<![0-9])(?:(?:19|20)[0-9]{2}([-/. ])[01]?[0-9]\1[0-3]?[0-9]|[0-3]?[0-9]([-/. ])[01]?[0-9]\2(?:19|20)[0-9]{2})(?![0-9])|[0-2]?[0-9]:[0-5][0-9]")
_YEAR_FIRST = re.compile(r"(?:19|20)[0-9]{2}(?![0-9])")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i & 1:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches around each at-sign: the longest run of local characters before it, not before the last match."""
    last, at = 0, text.find("@")
    while at >= 0:
        before = text[last:at]
        size = len(before) - len(before.rstrip(_LOCAL))
        last = at + 1  # no later match starts before it
        if size and (m := _DOMAIN.match(text, at + 1)):
            yield at - size, m.end()
            last = m.end()
        at = text.find("@", last)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base matches, sorted."""
    out = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum(map(str.isdigit, m.group())) <= 15:
                    out.append((m.start(), 3, m.end()))
    out.sort()
    return out


# Words that often stand before a kind of personal data.
_CUES = (
    frozenset("email mail e contact courriel correo write".split()),
    frozenset("ip host server address addr from client".split()),
    frozenset("card visa mastercard credit amex carte karte tarjeta pay".split()),
    frozenset("phone tel telephone call fax mobile cell telefon telefono sms whatsapp".split()),
)
_SHAPES = (
    re.compile(r"[A-Za-z0-9._%+-]+ ?(@|[\[(] ?at ?[\])]) ?[A-Za-z0-9-]+((\.| ?[\[(] ?dot ?[\])] ?)[A-Za-z0-9-]+)+", re.I),
    re.compile(r"[0-9]{1,3}( ?\. ?|\[\.\])[0-9]{1,3}( ?\. ?|\[\.\])[0-9]{1,3}( ?\. ?|\[\.\])[0-9]{1,3}"),
    re.compile(r"[0-9]{4}([ ./-]?)[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|[0-9]{4}([ ./-]?)[0-9]{6}\2[0-9]{5}"),
    re.compile(r"(\+|00)?[0-9]{0,3}[ ./-]?(\([0-9]{2,5}\))?([ ./-]?[0-9]{2,5}){2,5}"),
)
_DATE = re.compile(r"(19|20)[0-9]{2}[-/.][0-9]{1,2}[-/.][0-9]{1,2}|[0-9]{1,2}[-/.][0-9]{1,2}[-/.](19|20)[0-9]{2}|[0-9]{1,2}:[0-9]{2}(:[0-9]{2})?")
#: Ways to group a phone number: area, exchange and line; area in brackets; a leading zero and one or two groups; pairs.
_GROUPED = (
    re.compile(r"(\+?[0-9]{1,3}[ .-])?\(?[0-9]{3}\)?[ .-]{1,2}[0-9]{3}[ .-][0-9]{4}"),
    re.compile(r"\(?0[0-9]{1,4}\)?[ /-]([0-9]{5,8}|[0-9]{3,4}[ -][0-9]{3,4})"),
    re.compile(r"(\+[0-9]{1,3}[ .-]?(\(0\))?[0-9]{1,4}|0[0-9])([ .-][0-9]{2,4}){2,4}"),
)
N_FEATURES = 29


def span_features(text: str, a: int, b: int) -> np.ndarray | None:
    """Features of text[a:b] as one span; None where no kind of personal data can be."""
    s = text[a:b]
    digits = "".join(c for c in s if "0" <= c <= "9")
    mail = "@" in s or "at" in s.lower() and ("(" in s or "[" in s)
    if len(digits) < 4 and not mail or "\n" in s:
        return None
    f = np.zeros(N_FEATURES)
    n = len(digits)
    f[0] = 1
    f[1:5] = [bool(x.fullmatch(s)) for x in _SHAPES]
    f[5] = 4 <= n < 8
    f[6] = 8 <= n <= 9
    f[7] = 10 <= n <= 12
    f[8] = 13 <= n <= 19
    f[9] = n > 19
    f[10] = 13 <= n <= 19 and luhn(digits)
    f[11] = s[0] == "+" or s.startswith("00")
    f[12] = bool(_DATE.fullmatch(s))
    before, after = text[a - 1 : a], text[b : b + 1]
    f[13] = before.isalnum() or before in ("+", "@", ".", "-", "_", "#", "/") and before != ""
    f[14] = after.isalnum() or after in ("@", "-", "_", "/") and after != "" or (after == "." and text[b + 1 : b + 2].isalnum())
    words = {w.lower() for w in re.findall(r"[A-Za-z]+", text[max(0, a - 24) : a])[-3:]}
    f[15:19] = [bool(words & cue) for cue in _CUES]
    f[19] = len(digits) == len(s)
    f[20] = bool(_ON_AFTER.match(text, b))
    f[21] = bool(_ON_BEFORE.search(text[max(0, a - 4) : a]))
    f[22] = bool(_DATED.search(s))
    f[23] = bool(_YEAR_FIRST.match(s))
    f[25:28] = [bool(x.fullmatch(s)) for x in _GROUPED]
    f[28] = s.lstrip("(")[0] == "0"
    f[24] = max(map(len, re.findall(r"[0-9]+", s)), default=0) <= 2
    return f


def candidates(text: str, lo: int, hi: int) -> tuple[list[int], list[tuple[int, int, np.ndarray]]]:
    """Token ends from lo (that first), and (first token, end token, features) of the spans worth a score."""
    bounds = [lo, *[m.end() for m in _TOKEN.finditer(text, lo, hi)]]
    kinds = [text[p] if p < hi else " " for p in bounds]
    digits = np.concatenate([[0], np.cumsum([sum("0" <= c <= "9" for c in text[p:q]) for p, q in zip(bounds, bounds[1:])])]).astype(int)
    signs = np.concatenate([[0], np.cumsum([text[p] in "@([" for p in bounds[:-1]])]).astype(int)
    out = []
    for i in range(len(bounds) - 1):
        if not (kinds[i].isalnum() or kinds[i] in "+(") or i and kinds[i - 1].isalnum() and kinds[i] not in "+(" and kinds[i - 1].isdigit() == kinds[i].isdigit():
            continue
        for j in range(i + 1, min(len(bounds), i + 1 + MAX_TOKENS)):
            last = text[bounds[j] - 1]
            if last == "\n":
                break
            if (digits[j] - digits[i] >= 4 or signs[j] > signs[i]) and (last.isalnum() or last == ")"):
                f = span_features(text, bounds[i], bounds[j])
                if f is not None:
                    out.append((i, j, f))
    return bounds, out


def decode(text: str, lo: int, hi: int, model: tuple[np.ndarray, np.ndarray]) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the best segmentation of text[lo:hi]. State 0 is a token outside, 1 + kind a span."""
    bounds, spans = candidates(text, lo, hi)
    if not spans:
        return []
    weights, follow = model
    scored = (np.array([f for _, _, f in spans]) @ weights).tolist()
    t, reach = follow.tolist(), float(follow.max())
    ends: dict[int, list[tuple[int, list[float]]]] = {}
    for (i, j, _), row in zip(spans, scored):
        if max(row) + reach > 0:
            ends.setdefault(j, []).append((i, row))
    if not ends:
        return []
    states, low = range(len(KINDS) + 1), float("-inf")
    best, back = [[0.0] + [low] * len(KINDS)], [[None] * (len(KINDS) + 1)]
    for j in range(1, len(bounds)):
        prev = best[j - 1]
        y = max(states, key=lambda y: prev[y] + t[y][0])
        top, how = [prev[y] + t[y][0]] + [low] * len(KINDS), [(j - 1, y)] + [None] * len(KINDS)
        for i, row in ends.get(j, ()):
            for k, score in enumerate(row, 1):
                y = max(states, key=lambda y: best[i][y] + t[y][k])
                if (value := best[i][y] + t[y][k] + score) > top[k]:
                    top[k], how[k] = value, (i, y)
        best.append(top)
        back.append(how)
    out, j = [], len(bounds) - 1
    y = max(states, key=lambda y: best[j][y])
    while j > 0:
        i, before = back[j][y]
        if y:
            out.append((bounds[i], y - 1, bounds[j]))
        j, y = i, before
    return out[::-1]


def _generated(n: int, seed: int = 7) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Sentences with personal data and with what only looks like it."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("abcdefghilmnoprstu") for _ in range(r.randint(2, 8)))

    def card() -> str:
        body = "4" + d(14)
        full = next(body + c for c in "0123456789" if luhn(body + c))
        sep = r.choice(["", " ", "-", "."])
        return sep.join(full[i : i + 4] for i in range(0, 16, 4))

    def email() -> str:
        at, dot = r.choice([("@", "."), (" (at) ", "."), ("[at]", "[dot]"), (" [at] ", " [dot] ")])
        return word() + r.choice(["", ".", "_"]) + word() + at + word() + dot + r.choice(["com", "org", "net", "de"])

    def ip() -> str:
        return r.choice([".", "[.]", " . "]).join(str(r.randint(1, 254)) for _ in range(4))

    def phone() -> str:
        sep = r.choice([" ", "-", "."])
        pairs = sep.join(d(2) for _ in range(4))
        return r.choice([
            f"+{r.randint(1, 99)}{sep}{d(3)}{sep}{d(3)}{sep}{d(4)}", f"00{r.randint(30, 99)}{sep}{d(3)}{sep}{d(3)}{sep}{d(3)}", f"({d(3)}) {d(3)}-{d(4)}", f"0{d(3)}{sep}{d(3)}{sep}{d(3)}", f"0{d(1)}{sep}{pairs}", f"+{r.randint(30, 49)} {d(1)} {pairs}",
            f"0{d(3)} {d(7)}", f"0{d(2)}/{d(7)}", f"{d(3)}-{d(3)}-{d(4)}", f"1-{d(3)}-{d(3)}-{d(4)}", f"0{d(2)} {d(4)} {d(4)}", f"+{r.randint(30, 49)} (0){d(2)} {d(4)} {d(4)}", f"(0{d(2)}) {d(4)} {d(4)}",
        ])

    def other() -> str:
        wrong = next(x for x in iter(lambda: d(16), None) if not luhn(x))
        sep, year = r.choice(["", "", " ", "-"]), f"{r.choice(['19', '20'])}{d(2)}"
        month, day, hour, minute = f"{r.randint(1, 12):02d}", f"{r.randint(1, 28):02d}", f"{r.randint(0, 23):02d}", f"{r.randint(0, 59):02d}"
        cut = r.choice(["-", "/", ".", " "])
        return r.choice([
            wrong, sep.join(wrong[i : i + 4] for i in range(0, 16, 4)), cut.join([year, month, day]), cut.join([day, month, year]), " ".join([year, month, day, hour, minute]), f"{year}-{month}-{day}T{hour}:{minute}:{d(2)}",
            f"{day}.{month}.{year} {hour}:{minute}", f"{year}{month}{day}{hour}{minute}", f"{year}-{int(year) + 3}", " ".join(str(r.randint(10, 9999)) for _ in range(r.randint(3, 6))), ", ".join(str(r.randint(10, 99999)) for _ in range(4)),
            f"978-{d(1)}-{d(2)}-{d(6)}-{d(1)}", f"{r.randint(1, 89)}.{d(4)}, {r.randint(1, 179)}.{d(4)}", f"10.{d(1)}.{r.randint(300, 99999)}.{d(1)}", f"{d(1)} {d(3)} {d(3)}.{d(2)}", f"INV-{year}-{d(8)}", f"{r.randint(0, 9)}.{r.randint(0, 30)}.{r.randint(0, 30)}",
            d(r.randint(4, 12)), f"{d(3)},{d(3)}.{d(2)}", f"#{d(8)}", f"{d(4)}-{d(4)}", word() + "@" + word(), d(20), f"{word()}{d(6)}", d(16) + d(5), f"{d(5)}-{d(5)}-{d(5)}", f"{d(2)} x {d(2)} x {d(2)}",
        ])

    out = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(r.randint(1, 3)):
            text += " ".join(word() for _ in range(r.randint(1, 4))) + " "
            k = r.randint(0, 7)
            if k < 4:
                if r.random() < 0.5:
                    text += r.choice(sorted(_CUES[k])) + r.choice([" ", ": "])
                piece = (email, ip, card, phone)[k]()
                spans.append((len(text), k, len(text) + len(piece)))
            else:
                piece = other()
            text += piece + r.choice([" ", ", ", ". "])
        out.append((text, spans))
    return out


@lru_cache(maxsize=1)
def trained(sentences: int = 600, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Weights (features x kinds) and scores of a state after another that raise the log-likelihood of generated sentences, by
    adaptive gradient steps."""
    k = len(KINDS) + 1
    data = []
    for text, spans in _generated(sentences):
        bounds, found = candidates(text, 0, len(text))
        if not found:
            continue
        gold = {(a, b): kind for a, kind, b in spans}
        x = np.array([f for _, _, f in found])
        y, moves = np.zeros((len(found), len(KINDS))), np.zeros((k, k))
        step = {}
        for row, (i, j, _) in enumerate(found):
            if (kind := gold.get((bounds[i], bounds[j]))) is not None:
                y[row, kind] = 1
                step[i] = (j, kind + 1)
        at, state = 0, 0
        while at < len(bounds) - 1:
            at, new = step.get(at, (at + 1, 0))
            moves[state, new] += 1
            state = new
        by_end: dict[int, list[int]] = {}
        by_start: dict[int, list[int]] = {}
        for row, (i, j, _) in enumerate(found):
            by_end.setdefault(j, []).append(row)
            by_start.setdefault(i, []).append(row)
        first, last = np.array([i for i, _, _ in found]), np.array([j for _, j, _ in found])
        data.append((len(bounds), first, last, x, y, moves, by_end, by_start))
    w, t = np.zeros((N_FEATURES, len(KINDS))), np.zeros((k, k))
    seen, seen_t = np.full(w.shape, 1e-6), np.full(t.shape, 1e-6)
    total = np.logaddexp.reduce
    for _ in range(rounds):
        for n, first, last, x, y, moves, by_end, by_start in data:
            score = x @ w
            alpha, beta = np.full((n, k), -np.inf), np.zeros((n, k))
            alpha[0, 0] = 0
            into = np.full((n, k), -np.inf)  # the sum over what may stand before a segment that starts here
            for j in range(n):
                if j:
                    alpha[j, 0] = into[j - 1, 0]
                    if rows := by_end.get(j):
                        alpha[j, 1:] = total(into[first[rows], 1:] + score[rows], axis=0)
                into[j] = total(alpha[j][:, None] + t, axis=0)
            for j in range(n - 2, -1, -1):
                beta[j] = t[:, 0] + beta[j + 1, 0]
                if rows := by_start.get(j):
                    beta[j] = np.logaddexp(beta[j], total(t[:, None, 1:] + (score[rows] + beta[last[rows], 1:])[None], axis=(1, 2)))
            z = beta[0, 0]
            p = np.exp(into[first, 1:] + score + beta[last, 1:] - z)
            expected = np.zeros((k, k))
            expected[:, 0] = np.exp(alpha[:-1] + t[:, 0] + beta[1:, :1] - z).sum(axis=0)
            expected[:, 1:] = np.exp(alpha[first][:, :, None] + t[None, :, 1:] + (score + beta[last, 1:])[:, None, :] - z).sum(axis=0)
            grad, grad_t = x.T @ (y - p) - 1e-3 * w, moves - expected - 1e-3 * t
            grad_t[0, 0] = 0  # the scale of the others
            seen += grad**2
            seen_t += grad_t**2
            w += 0.5 * grad / np.sqrt(seen)
            t += 0.1 * grad_t / np.sqrt(seen_t)
    return w, t


def windows(text: str) -> list[tuple[int, int]]:
    """Surroundings of digits and at-signs, joined where they meet; they start and end at token edges of the text."""
    out: list[list[int]] = []
    for m in _TRIGGER.finditer(text):
        lo, hi = max(0, m.start() - AROUND), min(len(text), m.end() + AROUND)
        while lo and not text[lo - 1].isspace() and m.start() - lo < 2 * AROUND:
            lo -= 1
        while hi < len(text) and not text[hi].isspace() and hi - m.end() < 2 * AROUND:
            hi += 1
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [tuple(x) for x in out]


def find(text: str, model: tuple[np.ndarray, np.ndarray]) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and the spans that the field adds."""
    base = base_spans(text)
    added = []
    for lo, hi in windows(text):
        for a, k, b in decode(text, lo, hi, model):
            if not any(x < b and a < y for x, _, y in base):
                added.append((a, k, b))
    return base, added


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def spans(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text (and the columns `keep`), with `base` and `added`: arrays of (start, kind, end)."""
    docs = pick(docs, "doc_id", "text", *[c for c in keep if c not in ("doc_id", "text")])
    names = docs.columns
    schema = ", ".join(f"`{c}` {kind_of(docs, c)}" for c in names)
    model = trained()
    kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.string()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                found = [find(t or "", model) for t in part.column(1).to_pylist()]
                both = [pa.array([[{"start": a, "kind": KINDS[k], "end": b} for a, k, b in f[x]] for f in found], kind) for x in (0, 1)]
                yield pa.record_batch([*[part.column(i) for i in range(part.num_columns)], *both], names=[*names, "base", "added"])

    sql = "array<struct<start:int,kind:string,end:int>>"
    return docs.mapInArrow(run, f"{schema}, base {sql}, added {sql}")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, the number of base spans of each kind, base_sha256 and all spans."""
    docs = pick(docs, "doc_id", "text")
    model = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                found = [find(t or "", model) for t in part.column(1).to_pylist()]
                counts = [pa.array([sum(k == x for _, k, _ in base) for base, _ in found], pa.int64()) for x in range(len(KINDS))]
                sha = pa.array([hashlib.sha256(listed(base).encode()).hexdigest() for base, _ in found], pa.string())
                every = pa.array([listed(base + added) for base, added in found], pa.string())
                yield pa.record_batch([part.column(0), *counts, sha, every], names=["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])

    return docs.mapInArrow(run, f"doc_id {kind_of(docs, 'doc_id')}, " + "".join(f"n_{k} long, " for k in KINDS) + "base_sha256 string, spans string")


def masked(text: str, found: list[dict]) -> str:
    """`text` with each span replaced by its kind in brackets; of spans that overlap, the earlier and then the longer stays."""
    out, last = [], 0
    for s in sorted(found, key=lambda s: (s["start"], -s["end"])):
        if s["start"] >= last:
            out += [text[last : s["start"]], f"[{s['kind'].upper()}]"]
            last = s["end"]
        elif s["end"] > last:  # what sticks out of an earlier span goes as well
            last = s["end"]
    return "".join([*out, text[last:]])


def mask(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns doc_id, text and `keep` with every span of `text` replaced by its kind; a null text stays null."""
    docs = pick(docs, "doc_id", "text", *[c for c in keep if c not in ("doc_id", "text")])
    names, model = docs.columns, trained()

    def clean(text: str | None) -> str | None:
        if text is None:
            return None
        base, added = find(text, model)
        return masked(text, [{"start": a, "kind": KINDS[k], "end": b} for a, k, b in base + added]) if base or added else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                cols = list(batch.slice(lo, 512).columns)
                cols[1] = pa.array(map(clean, cols[1].to_pylist()), pa.string())
                yield pa.record_batch(cols, names=names)

    return docs.mapInArrow(run, ", ".join(f"`{c}` {kind_of(docs, c)}" for c in names))
