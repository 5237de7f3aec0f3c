"""Benchmark decontamination by spaced seeds, in DataFrame operations only.

A fixed mask chooses some of the tokens of a window and ignores the others, so a hash of the chosen ones still
meets where an ignored token was substituted. Seeds of all documents are joined with those of the benchmark;
each meeting names an item and a diagonal (place in the document minus place in the item). Around the
meetings whole diagonals are compared token by token: a document is contaminated where SPAN consecutive tokens
of an item (all of a shorter one) agree in SHARE of their places at least. The masks of a size meet every such
choice of agreeing places, wherever the others are; only masks for sizes that the benchmark has are used.

Tokens are runs of letters and digits, lower-cased. The benchmark's seeds are broadcast only while they are at most
BROADCAST_ROWS; beyond that the join is by shuffle.

Defined cases: null texts are empty; a benchmark item shorter than LEAST_TOKENS is searched for as an exact phrase, one without tokens never; equal items count
as the one with the least item_id; null doc_id is kept; equal rows give equal rows; an empty benchmark
contaminates nothing; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound, pick, row_key, settled, text_of

#: Places that a mask looks at, for items of SPAN tokens and more; MORE_MASKS meets what the others leave out.
MASKS = ((0, 1, 2, 3, 4), (0, 1, 3, 4, 7), (0, 2, 3, 5, 6), (0, 1, 4, 6, 7))
MORE_MASKS = ((0, 1, 2, 5, 9),)
#: For items of LEAST_TOKENS up to SPAN.
SHORT_MASKS = ((0, 1, 2, 4), (0, 3, 4, 5), (0, 1, 3, 6), (0, 1, 5, 7), (0, 2, 5, 6), (0, 1, 2, 3), (0, 1, 3, 4), (0, 2, 3, 4))
SPAN, SHARE = 13, 0.7
LEAST_TOKENS = 5
#: Diagonals of one text that are compared together.
DIAGONALS = 4096
BROADCAST_ROWS = 1_000_000


def tokens(text: Column) -> Column:
    """64-bit hashes of a text's tokens."""
    words = F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def masks_of(size: int) -> tuple[tuple[int, ...], ...]:
    """The masks for items of `size` tokens."""
    if size < LEAST_TOKENS:
        return (tuple(range(size)),)
    return MASKS + MORE_MASKS if size >= SPAN else tuple(m for m in SHORT_MASKS if m[-1] < size)


def seeds(df: DataFrame, masks: dict[tuple[int, ...], Column], *ids: str) -> DataFrame:
    """`ids`, place and seed: one row for each place of `tokens` and each mask whose condition holds."""
    size, width = F.size("tokens"), max(m[-1] for m in masks) + 1
    shifted = [F.col("tokens"), *[F.when(size > k, F.slice("tokens", k + 1, size)).otherwise(F.array().cast("array<bigint>")) for k in range(1, width)]]
    zipped = F.arrays_zip(*[s.alias(f"t{k}") for k, s in enumerate(shifted)])
    zipped = zipped.cast("array<struct<" + ",".join(f"t{k}:bigint" for k in range(width)) + ">>")
    placed = df.select(*ids, size.alias("size"), F.posexplode(zipped).alias("place", "w"))
    keys = [F.when(F.col(f"w.t{mask[-1]}").isNotNull() & asked, F.xxhash64(F.lit(sum(1 << k for k in mask)), *[F.col(f"w.t{k}") for k in mask])) for mask, asked in masks.items()]
    return placed.select(*ids, "place", F.explode(F.array(*keys)).alias("seed")).where("seed is not null")


def items(benchmark: DataFrame) -> DataFrame:
    """item_id and tokens of the distinct benchmark texts."""
    found = pick(benchmark, "item_id", "text").select("item_id", tokens(text_of()).alias("tokens")).where(F.size("tokens") > 0)
    return settled(found.groupBy("tokens").agg(F.min("item_id").alias("item_id")))


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """row, item_id, first and last (places of tokens in the document), agreeing: a row for each contaminated diagonal."""
    found = items(benchmark)
    held = found.select(F.xxhash64("tokens").alias("item"), "item_id", "tokens", F.size("tokens").alias("n"))
    kind = F.least(F.size("tokens"), F.lit(SPAN)).alias("kind")
    kinds = sorted(r["kind"] for r in found.select(kind).distinct().collect()) or [SPAN]  # SPAN numbers at most
    masks = dict.fromkeys(m for n in kinds for m in masks_of(n))
    asked = {m: F.least(F.col("size"), F.lit(SPAN)).isin([n for n in kinds if m in masks_of(n)]) for m in masks}
    wanted = settled(seeds(held, asked, "item", "n").select("item", "n", F.col("place").alias("item_place"), "seed").distinct())
    small = wanted.count() <= BROADCAST_ROWS
    keyed = pick(docs, "doc_id", "text").select(row_key("doc_id", "text").alias("row"), text_of().alias("text"))
    own = seeds(keyed.select("row", tokens(F.col("text")).alias("tokens")), {m: F.lit(True) for m in masks}, "row")
    met = own.join(F.broadcast(wanted) if small else wanted, "seed")
    met = settled(met.select("row", "item", "n", (F.col("place") - F.col("item_place")).alias("diagonal")).distinct())
    # a text meets its places once, and of each only the tokens beside the item go on; a list has at most DIAGONALS x masks x
    # the items that have one seed
    listed = met.groupBy("row", F.floor(F.col("diagonal") / DIAGONALS).alias("part")).agg(F.collect_list(F.struct("item", "n", "diagonal")).alias("met"))
    texts = keyed.join(listed, "row").dropDuplicates(["row", "part"])

    def beside(own: Column) -> Column:
        cut = lambda m: F.slice(own, F.greatest(m["diagonal"], F.lit(0)) + 1, m["n"] + F.least(m["diagonal"], F.lit(0)))
        return F.transform("met", lambda m: F.struct(m["item"].alias("item"), m["diagonal"].alias("diagonal"), cut(m).alias("inside")))

    texts = texts.select("row", F.explode(bound(tokens(F.col("text")), beside)).alias("m")).select("row", "m.item", "m.diagonal", "m.inside")
    both = texts.join(F.broadcast(held) if small else held, "item")
    shifted = F.concat(F.array_repeat(F.lit(None).cast("bigint"), F.greatest(-F.col("diagonal"), F.lit(0))), F.col("inside"))
    both = both.select("row", "item_id", "diagonal", F.transform(F.zip_with("tokens", shifted, lambda a, b: a.eqNullSafe(b)), lambda x: x.cast("int")).alias("agree"))
    # sums of all windows of SPAN places: a running sum, then differences
    both = both.withColumn("span", F.least(F.size("agree"), F.lit(SPAN)))
    running = F.aggregate("agree", F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
    both = both.withColumn("running", running)
    sums = F.transform(F.sequence(F.lit(0), F.size("agree") - F.col("span")), lambda i: F.get("running", i + F.col("span")) - F.get("running", i))
    both = both.withColumn("best", F.array_max(sums)).where(F.col("best") >= F.ceil(F.col("span") * SHARE))
    first = F.array_position("agree", 1) - 1
    last = F.size("agree") - F.array_position(F.reverse("agree"), 1)
    return both.select(
        "row", "item_id", (F.col("diagonal") + first).cast("long").alias("first"), (F.col("diagonal") + last).cast("long").alias("last"), F.aggregate("agree", F.lit(0), lambda a, x: a + x).cast("long").alias("agreeing")
    )


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, row, contaminated (0/1), n_items, items (item_ids, comma-joined), agreeing (tokens of the best overlap)."""
    found = overlaps(docs, benchmark).groupBy("row").agg(F.array_sort(F.collect_set("item_id")).alias("found"), F.max("agreeing").alias("agreeing"))
    out = pick(docs, "doc_id", "text").select("doc_id", row_key("doc_id", "text").alias("row")).join(found, "row", "left")
    return out.select(
        "doc_id", "row", F.col("found").isNotNull().cast("int").alias("contaminated"), F.coalesce(F.size("found"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce(F.array_join(F.transform("found", lambda x: x.cast("string")), ","), F.lit("")).alias("items"), F.coalesce("agreeing", F.lit(0)).cast("long").alias("agreeing"),
    )


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return report(docs, benchmark).drop("row")
