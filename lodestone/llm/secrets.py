"""Secret scan in SQL expressions only: exact patterns, and entropy over sliding windows.

Positions come from splitting: `split` gives the text between a pattern's matches and
`regexp_extract_all` the matches, both by the same leftmost non-overlapping rule, so running lengths
give every start and end in code points. The running sums double their reach a step, so n matches
take n log n steps.

Entropy: candidate strings are runs of one character class (hex digits, or base64 letters) in what the
base spans and the allow-list's sequences leave of a text (both are blanked out, place by place). A fold
moves a window over the run. Its state is the window's character counts, one character of a string each,
and the sum of c * log2 c over them; a step takes one character out and one in, which changes two counts.
A window's entropy is log2(w) - sum / w. The run is a secret where its best window passes the class's
threshold, unless the allow-list knows its form (UUIDs, no digits or no letters, file paths). Time grows
with the length of a run, not with its square.

Defined cases: null text counts as empty; null doc_id is kept; equal rows give equal rows; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound, pick, text_of

# The patterns of the base kinds.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"  # the runs of [0-9a-f]+ that are long enough, as a run is one match
ASSIGN_LEAST, ACCESS_LEAST = 12, 18
KINDS = ("assign", "access", "hex")

#: class: (pattern of a candidate, window, least entropy in bits of the best window). A random key of one window passes
#: in about 95 of 100 cases (hex) and 75 of 100 (base64, where names with digits come close); longer keys more often.
CLASSES = {
    "entropy_hex": (r"(?<![A-Za-z0-9])[0-9A-Fa-f]{16,}(?![A-Za-z0-9])", 16, 2.85),
    "entropy_base64": (r"[A-Za-z0-9+/_=-]{20,}", 20, 3.8),
}
#: Forms that are no secrets though their entropy is high, and sequences that are none wherever they stand.
ALLOWED = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$|^[^0-9]*$|^[^A-Za-z]*$|^/?[a-z0-9_-]+/[a-z0-9_./-]+$"
SEQUENCES = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789")
_SPANS = "array<struct<start:int,end:int,found:string>>"
#: Counts of a window stand in a string for the characters from this one on; all candidates are of such characters.
_FIRST, _CHARACTERS = ord("+"), ord("z") - ord("+") + 1


def _power(k: Column) -> Column:
    return F.pow(F.lit(2), k).cast("int")


def running(sizes: Column) -> Column:
    """Running sums of an array: each step adds what stands 1, 2, 4, ... places before."""
    steps = F.when(F.size(sizes) > 1, F.sequence(F.lit(0), F.ceil(F.log2(F.size(sizes))).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, sizes, lambda acc, k: F.transform(acc, lambda x, i: x + F.when(i >= _power(k), F.get(acc, i - _power(k))).otherwise(0)))


def parts(text: Column, pattern: str) -> Column:
    """struct of the matches of a pattern (`found`) and what stands between them (`gaps`)."""
    return F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("gaps"))


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start,end,found>> of a pattern's matches, in code points, end exclusive."""

    def placed(p: Column) -> Column:
        ends = running(F.transform(p["found"], lambda hit, i: F.length(hit) + F.length(F.get(p["gaps"], i))))
        span = lambda hit, end: F.struct((end - F.length(hit)).alias("start"), end.alias("end"), hit.alias("found"))
        return F.zip_with(p["found"], ends, span)

    return F.coalesce(bound(parts(text, pattern), placed).cast(_SPANS), F.array().cast(_SPANS))


def blanked(text: Column, pattern: str, keep) -> Column:
    """The text with blanks in place of the matches that `keep` holds of."""

    def joined(p: Column) -> Column:
        return F.array_join(F.zip_with(p["gaps"], p["found"], lambda gap, hit: F.concat(gap, F.coalesce(F.when(keep(hit), F.repeat(F.lit(" "), F.length(hit))).otherwise(hit), F.lit("")))), "")

    return bound(parts(text, pattern), joined)


def best_entropy(run: Column, window: int) -> Column:
    """Bits of the best window of `window` characters in `run`."""
    bits = [0.0] + [c * math.log2(c) for c in range(1, window + 2)]
    grow = F.lit([b - a for a, b in zip(bits, bits[1:])])  # from c to c + 1 of one character
    # a count of c is the character c + 1; places in the string start with 1
    count = lambda counts, at: F.ascii(F.substring(counts, at, F.lit(1))) - 1
    put = lambda counts, at, n: F.overlay(counts, F.char(n + 1), at, F.lit(1))

    def folded(places: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            old, new, full = F.get(places, i - window), F.get(places, i), i >= window
            before = count(acc["counts"], old)
            left = F.when(full, put(acc["counts"], old, before - 1)).otherwise(acc["counts"])
            total = acc["sum"] - F.when(full, F.get(grow, before - 1)).otherwise(0.0)
            now = count(left, new)
            total = total + F.get(grow, now)
            return F.struct(put(left, new, now + 1).alias("counts"), total.alias("sum"), F.when(i >= window - 1, F.least(acc["least"], total)).otherwise(acc["least"]).alias("least"))

        start = F.struct(F.lit("\x01" * _CHARACTERS).alias("counts"), F.lit(0.0).alias("sum"), F.lit(1e9).alias("least"))
        return F.aggregate(F.sequence(F.lit(0), F.size(places) - 1), start, step, lambda acc: F.lit(math.log2(window)) - acc["least"] / window)

    letters = F.filter(F.split(run, ""), lambda c: c != "")
    return bound(F.transform(letters, lambda c: F.ascii(c) - (_FIRST - 1)), folded)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base and extra: arrays of (start, kind number, kind, end) in order."""
    text = F.col("text")
    df = pick(docs, "doc_id", "text").select("doc_id", text_of().alias("text"))
    # a plain containment test spares most texts the pattern that starts with ten different letters
    low = F.lower(text)
    hint = F.contains(text, F.lit("=")) | F.contains(text, F.lit(":"))
    hint = hint & (F.contains(low, F.lit("passw")) | F.contains(low, F.lit("secret")) | F.contains(low, F.lit("token")) | F.contains(low, F.lit("api")))
    none = F.array().cast(_SPANS)
    keeps = {
        ASSIGN: lambda hit: F.length(F.regexp_extract(hit, ASSIGN, 2)) >= ASSIGN_LEAST,
        ACCESS: lambda hit: F.length(hit) >= ACCESS_LEAST,
        HEX: lambda hit: F.lit(True),
    }
    met = {ASSIGN: hint, ACCESS: F.contains(text, F.lit("AKIA")), HEX: F.rlike(text, F.lit(HEX))}

    def kept(pattern: str) -> Column:
        return F.filter(F.when(met[pattern], matches(text, pattern)).otherwise(none), lambda s: keeps[pattern](s["found"]))

    df = df.select("doc_id", "text", *[kept(p).alias(k) for k, p in zip(KINDS, (ASSIGN, ACCESS, HEX))])
    for kind, pattern in zip(KINDS, (ASSIGN, ACCESS, HEX)):
        df = df.withColumn("text", F.when(F.size(kind) > 0, blanked(text, pattern, keeps[pattern])).otherwise(text))
    for sequence in SEQUENCES:
        df = df.withColumn("text", F.replace(text, F.lit(sequence), F.lit(" " * len(sequence))))
    df = df.withColumns({k: F.when(F.rlike(text, F.lit(p)), matches(text, p)).otherwise(none) for k, (p, _, _) in CLASSES.items()})

    def spans(col: str, order: int, kind: str) -> Column:
        return F.transform(F.col(col), lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("order"), F.lit(kind).alias("kind"), s["end"].alias("end")))

    base = F.array_sort(F.concat(*[spans(k, i, k) for i, k in enumerate(KINDS)]))
    df = df.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], base.alias("base"), *CLASSES)

    def fresh(kind: str, order: int) -> Column:
        _, window, least = CLASSES[kind]
        keep = lambda s: ~F.rlike(s["found"], F.lit(ALLOWED)) & (best_entropy(s["found"], window) >= least - 1e-9)
        return F.transform(
            F.filter(F.col(kind), keep), lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("order"), F.lit(kind).alias("kind"), s["end"].alias("end"))
        )

    extra = [fresh(kind, len(KINDS) + i) for i, kind in enumerate(CLASSES)]
    return df.select("doc_id", *[f"n_{k}" for k in KINDS], "base", F.array_sort(F.concat(*extra)).alias("extra"))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secrets(docs: DataFrame) -> DataFrame:
    found = scan(docs)
    return found.select(
        "doc_id", *[f"n_{k}" for k in KINDS], F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(F.array_sort(F.concat("base", "extra"))).alias("spans")
    )
