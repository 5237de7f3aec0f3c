"""Toxicity: a learned lexicon in a trie, met by Levenshtein automata, with scores from context windows.

1. Lexicon. From a bounded sample of labelled documents outside the held-out fold, words and word
   stems (prefixes) whose documents are toxic far more often than chance allows (binomial, corrected
   for the number of candidates). A stem is kept at the longest form that keeps nearly all its documents;
   the forms that this leaves out are judged by themselves, and the found words behind a stem are entries too.
2. Matching. Each distinct word meets the trie: stems must start it; whole entries of five letters or
   more may differ by one edit. The word's Levenshtein automaton runs along the trie; a test of shared
   one-letter deletions spares words that cannot match.
3. Context. A hit inside a window with quotation marks or words of reporting counts as quoted, others as
   direct or, with an edit, as misspelled. A logistic model over these counts gives the score. It is fitted on the
   same sample, and on two altered copies of each toxic text, as labels alone seldom show either: one with its terms
   misspelled, which is toxic still, and one with its terms reported in quotation marks, which is taken as not toxic.

Defined cases: null text is empty and gets the model's score for no hits; null doc_id is held out and
never used for learning; several labels of one doc_id count as toxic if one is; no usable label gives
0.0 for every document; equal rows have equal scores; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kind_of, pick, settled, text_of

#: At most about so many labelled documents are used for learning (chosen by a hash of doc_id).
SAMPLE_ROWS = 20_000
STEM = (3, 8)  # letters
FUZZY_FROM = 5
WINDOW = 6  # words on each side of a hit
CACHE_WORDS = 100_000
_WORD = re.compile(r"\w+").findall
# Marks and words of quotation in the corpus languages.
QUOTE_MARKS = "\"“”„«»‘’"
REPORTING = frozenset("said says quote quoted quoting wrote called dit disait cite sagte sagt zitat schrieb dijo dice cita".split())


def _features_of(text: str) -> set[str]:
    """Words ('w' before them) and stems ('s' before them) of a text."""
    out = set()
    for w in set(_WORD(text.lower())):
        if len(w) >= STEM[0]:
            out.add("w" + w)
            out.update("s" + w[:k] for k in range(STEM[0], min(len(w), STEM[1] + 1)))
    return out


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """text and toxic (0/1) of labelled documents outside the held-out fold, about `rows` of them at most."""
    docs = pick(docs, "doc_id", "text").select("doc_id", text_of().alias("text"))
    usable = pick(labels, "doc_id", "toxic").where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    share = rows / max(rows, usable.count())
    chosen = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    return settled(docs.join(F.broadcast(chosen), "doc_id").select("text", "toxic"))  # `chosen` has about `rows` rows


def learn_lexicon(labelled: DataFrame) -> dict[str, float]:
    """Stem ('s...') or word ('w...') -> log odds, from `sample`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                seen = (Counter(), Counter())
                for text, toxic in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    seen[1 if toxic else 0].update(_features_of(text))
                names = list(seen[0].keys() | seen[1].keys())
                yield pa.record_batch([pa.array(names, pa.string()), pa.array([seen[0][n] for n in names], pa.int64()), pa.array([seen[1][n] for n in names], pa.int64())], names=["feature", "clean", "toxic"])

    size = {r["toxic"]: r["n"] for r in labelled.groupBy((F.col("toxic") != 0).alias("toxic")).agg(F.count(F.lit(1)).alias("n")).collect()}
    clean, toxic = size.get(False, 0), size.get(True, 0)
    if not clean or not toxic:
        return {}
    counts = labelled.mapInArrow(run, "feature string, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    odd = (F.col("toxic") >= 4) & (F.col("toxic") * clean > 8 * F.col("clean") * toxic)
    rows = counts.select(F.count(F.lit(1)).alias("all"), F.collect_list(F.when(odd, F.struct("feature", "clean", "toxic"))).alias("found")).first()
    base, limit = math.log(toxic / (toxic + clean)), -math.log(max(rows["all"], 1))

    def sure(n0: int, n1: int) -> bool:
        return n1 * base + math.lgamma(n0 + n1 + 1) - math.lgamma(n0 + 1) - math.lgamma(n1 + 1) < limit

    found = {r["feature"]: (r["clean"], r["toxic"]) for r in rows["found"] if sure(r["clean"], r["toxic"])}
    extensions: dict[str, list[str]] = {}
    for f in found:
        extensions.setdefault("s" + f[1:-1] if f[0] == "s" else "s" + f[1 : STEM[1] + 1] if len(f) > STEM[1] + 1 else "s" + f[1:-1], []).append(f)
    kept: set[str] = set()

    def covered(f: str) -> bool:
        return f in kept or any("s" + f[1:k] in kept for k in range(STEM[0] + 1, len(f)))

    for f in sorted(found, key=lambda f: (len(f), f)):
        if covered(f):
            continue
        while nxt := [x for x in extensions.get(f, ()) if x != f and found[x][1] >= 0.9 * found[f][1]]:
            f = max(nxt, key=lambda x: (found[x][1], x))
        kept.add(f)  # what this form left out comes up later, by itself
    words = {f for f in found if f[0] == "w" and covered(f)}  # the forms behind a stem, for the trie
    return {f: math.log((found[f][1] + 0.5) / (toxic + 1)) - math.log((found[f][0] + 0.5) / (clean + 1)) for f in kept | words}


class Automaton:
    """Levenshtein automaton of a word for one edit: a state is the reachable (place, edits), a step reads a letter."""

    def __init__(self, word: str, edits: int = 1):
        self.word, self.edits = word, edits
        self.start = self._closed({(0, 0)})

    def _closed(self, state: set[tuple[int, int]]) -> frozenset:
        for i, e in list(state):
            while i < len(self.word) and e < self.edits:  # a letter of the word left out
                i, e = i + 1, e + 1
                state.add((i, e))
        return frozenset(state)

    def step(self, state: frozenset, letter: str) -> frozenset:
        out = set()
        for i, e in state:
            if i < len(self.word) and self.word[i] == letter:
                out.add((i + 1, e))
            if e < self.edits:
                out.add((i, e + 1))  # a letter more
                if i < len(self.word):
                    out.add((i + 1, e + 1))  # another letter
        return self._closed(out)

    def accepts(self, state: frozenset) -> bool:
        return any(i == len(self.word) for i, _ in state)


def _deletions(word: str) -> list[str]:
    return [word, *[word[:i] + word[i + 1 :] for i in range(len(word))]]


class Lexicon:
    """Trie of the entries. `match(word)` is (weight, exact, behind a stem) of the best entry, or None. Words near a form
    behind a stem are more often other forms of clean words than words near an entry that stands for itself."""

    def __init__(self, entries: dict[str, float]):
        self.stems = {f[1:]: w for f, w in entries.items() if f[0] == "s"}
        self.words = {f[1:]: w for f, w in entries.items() if f[0] == "w"}
        self.root: dict = {}
        self.near: set[str] = set()
        for word, weight in self.words.items():
            if len(word) >= FUZZY_FROM:
                node = self.root
                for c in word:
                    node = node.setdefault(c, {})
                node[""] = weight, any(word.startswith(x) for x in self.stems)
                self.near.update(_deletions(word))
        self.sizes = sorted({len(s) for s in self.stems})
        self.cache: dict[str, tuple] = {}

    def fuzzy(self, word: str) -> tuple[float, bool] | None:
        """The largest weight of an entry within one edit: the automaton and the trie walked together."""
        auto, best = Automaton(word), None
        todo = [(self.root, auto.start)]
        while todo:
            node, state = todo.pop()
            for letter, child in node.items():
                if letter == "":
                    if auto.accepts(state) and (best is None or (not child[1], child[0]) > (not best[1], best[0])):
                        best = child
                elif nxt := auto.step(state, letter):
                    todo.append((child, nxt))
        return best

    def match(self, word: str) -> tuple[float, bool, bool] | None:
        if (w := self.words.get(word)) is not None:
            return w, True, False
        for n in self.sizes:
            if (w := self.stems.get(word[:n])) is not None and len(word) >= n:
                return w, True, True
        if len(word) >= FUZZY_FROM - 1 and not self.near.isdisjoint(_deletions(word)) and (hit := self.fuzzy(word)) is not None:
            return hit[0], False, hit[1]
        return None

    def of_chunk(self, chunk: str) -> tuple:
        """Hits of a run of characters without blanks, remembered."""
        hits = tuple(h for w in _WORD(chunk.lower()) if (h := self.match(w)))
        if len(self.cache) >= CACHE_WORDS:
            self.cache.clear()
        self.cache[chunk] = hits
        return hits


def _quoted(chunks: list[str], i: int) -> bool:
    around = chunks[max(0, i - WINDOW) : i + WINDOW + 1]
    return sum(c[0] in QUOTE_MARKS or c[-1] in QUOTE_MARKS for c in around) >= 2 or any(w in REPORTING for c in around for w in _WORD(c.lower()))


def respelled(text: str, lexicon: Lexicon) -> str:
    """The text with a letter left out, doubled or changed in each word that is an entry of the trie."""

    def edit(m: re.Match) -> str:
        word = m[0]
        if len(word) < FUZZY_FROM or word.lower() not in lexicon.words:
            return word
        r = zlib.crc32(f"{word} {m.start()}".encode())
        at, letter = 1 + r % (len(word) - 2), chr(97 + r // 7 % 26)
        return word[:at] + ("", 2 * word[at], letter)[r // 256 % 3] + word[at + 1 :]

    return re.sub(r"\w+", edit, text)


def reported(text: str, lexicon: Lexicon) -> str:
    """The text with each term it has as someone's words."""
    return re.sub(r"\w+", lambda m: f'he said "{m[0]}"' if (hit := lexicon.match(m[0].lower())) and hit[1] else m[0], text)


#: What an altered copy of a text weighs beside the text.
COPY_WEIGHT = 0.1


def features(text: str, lexicon: Lexicon) -> list[float]:
    chunks = text.split()
    get, direct, quoted, fuzzy, forms, weight = lexicon.cache.get, 0, 0, 0, 0, 0.0
    for i, hits in enumerate(map(get, chunks)):
        if hits is None:
            hits = lexicon.of_chunk(chunks[i])
        if hits:
            is_quoted = _quoted(chunks, i)
            for w, exact, behind in hits:
                if is_quoted:
                    quoted += 1
                elif not exact:
                    fuzzy, forms = fuzzy + (not behind), forms + behind
                else:
                    direct += 1
                    weight = max(weight, w)
    share = lambda n: (n / max(1, len(chunks))) ** 0.25
    return [1.0, float(direct > 0), math.log1p(direct), math.log1p(quoted), math.log1p(fuzzy), weight / 10 * share(direct), share(fuzzy), math.log1p(forms), share(forms)]


_LEXICONS: dict[tuple, Lexicon] = {}


def _lexicon(entries: tuple) -> Lexicon:
    if entries not in _LEXICONS:
        _LEXICONS.clear()
        _LEXICONS[entries] = Lexicon(dict(entries))
    return _LEXICONS[entries]


def fit(x: np.ndarray, y: np.ndarray, count: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Weights of a ridge-penalized logistic model of rows that count so much each, by Newton's method."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (count * p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (count * (y - p)) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def learn(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> tuple[tuple, np.ndarray | None]:
    """(lexicon entries, weights) from the sample; weights are None without labels of both kinds."""
    labelled = sample(docs, labels, rows)
    entries = tuple(sorted(learn_lexicon(labelled).items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = _lexicon(entries)
        for batch in batches:
            rows: list[tuple[list[float], int, float]] = []
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows.append((features(text, lexicon), int(toxic != 0), 1.0))
                if toxic:
                    rows += [(features(copy, lexicon), y, COPY_WEIGHT) for copy, y in ((respelled(text, lexicon), 1), (reported(text, lexicon), 0)) if copy != text]
            x, y, count = zip(*rows) if rows else ((), (), ())
            yield pa.record_batch([pa.array(x, pa.list_(pa.float64())), pa.array(y, pa.int32()), pa.array(count, pa.float64())], names=["x", "y", "count"])

    got = labelled.mapInArrow(run, "x array<double>, y int, count double").groupBy("x", "y").agg(F.sum("count").alias("count")).collect()  # three times the sample's rows at most
    if len({r["y"] for r in got}) < 2:
        return entries, None
    got.sort(key=lambda r: (r["x"], r["y"]))
    return entries, fit(*(np.array([r[c] for r in got], float) for c in ("x", "y", "count")))


def scores(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, score, predicted (and the columns `keep`) of every document."""
    entries, weights = learn(docs, labels, rows)
    docs = pick(docs, "doc_id", "text", *[c for c in keep if c not in ("doc_id", "text")])
    names = docs.columns
    schema = ", ".join(f"`{c}` {kind_of(docs, c)}" for c in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = _lexicon(entries)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                if weights is None:
                    score = np.zeros(part.num_rows)
                else:
                    x = np.array([features(t or "", lexicon) for t in part.column(1).to_pylist()])
                    score = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
                cols = [part.column(i) for i in range(part.num_columns)]
                yield pa.record_batch([*cols, pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=[*names, "score", "predicted"])

    scored = docs.mapInArrow(run, f"{schema}, score double, predicted int")
    return scored.withColumn("held_out", held_out(F.col("doc_id")))
