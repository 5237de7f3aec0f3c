"""Chat formatting by quotation linking, in DataFrame operations only.

1. A message's lines carry quote levels (the '>' before them). Lines of one level in a row are a passage; lines of
   level 0 are the message's own text, without lines that announce a quotation.
2. Passages are normalised (lower case, letters and digits only) and hashed; so are every message's own text and each
   of its lines. A passage that equals neither in its conversation is looked for as a run of words inside own texts
   (lines in a row, a paragraph wrapped anew, a sentence): a seed of up to SEED of its words names the messages, whose
   words are then compared. The source is the last earlier message of the same conversation, an equal one before one
   that holds the passage; else the first message anywhere that is equal, else the first that holds it.
3. A message answers the message its outermost quotation comes from, where that is in its conversation, else the message
   before. Conversations are put in reply order: a chain of messages that answer the one before is a segment; the
   segments that hang on a segment follow it, those on its last messages first. A walk around the tree of segments is a
   list of steps; pointer doubling sums the messages before each step, so the rounds grow with the logarithm of the number
   of segments, and nothing is longer than a row.

No step holds a conversation in one task: messages are numbered by ranges (`numbered`), what stands last before a message
is found in blocks of BLOCK messages and then over blocks (`latest`), and the rest are joins on single messages. Texts
are moved twice, to be numbered and for the result.

Defined cases: null text is empty; null conv_id is one conversation of its own, null turns come first; messages of one turn
and role stand in the order of a hash of their texts; equal rows are separate messages; an empty table gives an empty
result; other columns are ignored. Passages under LEAST characters are looked for in their own conversation only; passages
without letters or digits have no source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pick, settled

_MARK = r"^(?:[ \t]*>)+[ \t]?"
#: Normalised text shorter than this many characters links inside its conversation only.
LEAST = 12
#: Messages of a block.
BLOCK = 1000
#: Words of a seed.
SEED = 4
#: Wanted seeds are broadcast while they are at most so many.
BROADCAST_ROWS = 100_000
# How mail and chat programs announce a quotation.
ANNOUNCE = r"(?i)^\s*(on .{1,200} wrote:|am .{1,200} schrieb.{0,80}:|le .{1,200} a écrit ?:|el .{1,200} escribió:|-{2,} ?original message ?-{2,}|quote:)\s*$"


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def _key(norm: Column) -> Column:
    return F.when(norm != "", F.md5(norm.cast("binary")))


def _grams(words: Column, n: int) -> Column:
    """Hashes of every `n` words in a row."""
    places = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.xxhash64(F.array_join(F.slice(words, i, n), " ")))


def numbered(df: DataFrame, group: list[str], order: list[Column], name: str) -> DataFrame:
    """`name`: the place of each row in its group by `order`, from 1. Rows are dealt by ranges of group and order, so a large
    group is spread; its place is that in its range, after what ranges before hold of the group."""
    keys = [*[F.col(g).asc_nulls_first() for g in group], *order]
    dealt = settled(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("id__", F.monotonically_increasing_id()))
    dealt = dealt.withColumn("range__", F.shiftright("id__", 33))
    ranges = dealt.groupBy(*group, "range__").agg(F.min("id__").alias("first__"), F.count(F.lit(1)).alias("n__"))
    before = Window.partitionBy(*group).orderBy("range__").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range of a group
    ranges = ranges.withColumn("before__", F.coalesce(F.sum("n__").over(before), F.lit(0))).drop("n__")
    out = dealt.join(ranges, [*group, "range__"])
    return out.withColumn(name, (F.col("id__") - F.col("first__") + F.col("before__") + 1).cast("int")).drop("id__", "range__", "first__", "before__")


def latest(df: DataFrame, group: list[str], values: dict[str, Column]) -> DataFrame:
    """For each name, the greatest value (which grow with `at`) of the group's rows that stand before (smaller `at`)."""
    df = df.withColumn("block__", F.floor((F.col("at") - 1) / BLOCK))
    inside = Window.partitionBy(*group, "block__").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    tops = df.groupBy(*group, "block__").agg(*[F.max(v).alias(f"{n}_top__") for n, v in values.items()])
    over = Window.partitionBy(*group).orderBy("block__").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block of a group
    tops = tops.select(*group, "block__", *[F.max(f"{n}_top__").over(over).alias(f"{n}_before__") for n in values])
    df = df.withColumns({f"{n}_here__": F.max(v).over(inside) for n, v in values.items()}).join(tops, [*group, "block__"])
    return df.withColumns({n: F.coalesce(f"{n}_here__", f"{n}_before__") for n in values}).drop("block__", *[f"{n}_{x}__" for n in values for x in ("here", "before")])


def parsed(conversations: DataFrame) -> DataFrame:
    """The messages with conv (key), at (place in the conversation), own text and passages (level, text)."""
    df = pick(conversations, "conv_id", "turn", "role", "text").withColumn("text", F.coalesce("text", F.lit("")))
    df = df.withColumn("conv", F.coalesce(F.concat(F.lit("v"), F.col("conv_id").cast("string")), F.lit("n")))
    df = numbered(df, ["conv"], [F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.xxhash64("text").asc()], "at")
    lines = F.transform(
        F.split("text", r"\r?\n", -1),
        lambda x: F.struct(F.length(F.regexp_replace(F.regexp_extract(x, _MARK, 0), r"[^>]", "")).alias("level"), F.regexp_replace(x, _MARK, "").alias("line")),
    )
    df = df.withColumn("lines", lines)
    own = F.filter("lines", lambda x: (x["level"] == 0) & ~F.rlike(x["line"], F.lit(ANNOUNCE)))
    passages = F.aggregate(
        "lines",
        F.struct(F.lit(0).alias("level"), F.array().cast("array<struct<level:int,text:string>>").alias("done")),
        lambda acc, x: F.struct(
            x["level"].alias("level"),
            F.when(x["level"] == 0, acc["done"])
            .when(
                x["level"] == acc["level"],
                F.concat(F.slice(acc["done"], 1, F.size(acc["done"]) - 1), F.array(F.struct(x["level"].alias("level"), F.concat_ws("\n", F.element_at(acc["done"], -1)["text"], x["line"]).alias("text")))),
            )
            .otherwise(F.concat(acc["done"], F.array(F.struct(x["level"].alias("level"), x["line"].alias("text")))))
            .alias("done"),
        ),
        lambda acc: acc["done"],
    )
    passages = F.when(F.contains("text", F.lit(">")), passages).otherwise(F.array().cast("array<struct<level:int,text:string>>"))
    return df.select(
        "conv_id", "turn", "role", "conv", "at", F.trim(F.array_join(F.transform(own, lambda x: x["line"]), "\n")).alias("own"), F.transform(own, lambda x: x["line"]).alias("own_lines"), passages.alias("passages")
    )


def _before(asked: DataFrame, forms: DataFrame) -> DataFrame:
    """conv, at, number, source: the last message of `forms` (conv, at, hash) that stands before in the conversation."""
    both = asked.select("conv", "at", "number", "hash", F.lit(None).cast("int").alias("source"))
    both = both.unionByName(forms.select("conv", "at", F.lit(None).cast("int").alias("number"), "hash", F.col("at").alias("source")))
    found = latest(both, ["conv", "hash"], {"last": F.col("source")})
    return found.where("number is not null and last is not null").select("conv", "at", "number", F.col("last").alias("source"))


def _holding(asked: DataFrame, messages: DataFrame, *scope: str) -> DataFrame:
    """conv, at, hash: the messages whose own text has the words of an asked passage in a row; with `scope` 'conv', those of its conversation."""
    words = F.split("norm", " ")
    wanted = asked.select(*scope, "hash", "norm").distinct().withColumn("n", F.least(F.size(words), F.lit(SEED)))
    seed = F.coalesce(*[F.when(F.col("n") == n, F.array_min(_grams(words, n))) for n in range(1, SEED + 1)])
    wanted = settled(wanted.select(*scope, "hash", "norm", "n", seed.alias("seed")))
    sizes = sorted(r["n"] for r in wanted.select("n").distinct().collect())  # SEED numbers at most
    texts = messages.select("conv", "at", normalised(F.col("own")).alias("own"))
    if not sizes:
        return texts.where("false").select("conv", "at", F.lit("").alias("hash"))
    if scope:
        texts = texts.join(wanted.select(*scope).distinct(), [*scope], "left_semi")
    own = F.split("own", " ")
    seeds = texts.select("conv", "at", F.explode(F.array_distinct(F.concat(*[_grams(own, n) for n in sizes]))).alias("seed"))
    keys = wanted.select(*scope, "seed", "hash")
    met = seeds.join(F.broadcast(keys) if wanted.count() <= BROADCAST_ROWS else keys, [*scope, "seed"]).select("conv", "at", "hash")
    met = met.join(wanted.select("hash", "norm").distinct(), "hash").join(texts, ["conv", "at"])
    pad = lambda c: F.concat(F.lit(" "), F.col(c), F.lit(" "))
    return met.where(F.contains(pad("own"), pad("norm"))).select("conv", "at", "hash")


def _first(forms: DataFrame) -> DataFrame:
    """hash and the first message anywhere that has it."""
    return forms.groupBy("hash").agg(F.min(F.struct("conv", "at")).alias("first"))


def linked(messages: DataFrame) -> DataFrame:
    """conv, at, n_quotes, n_linked, level of the outermost linked passage, its source (source_conv, source_at)."""
    asked = messages.where(F.size("passages") > 0).select("conv", "at", F.posexplode("passages").alias("number", "passage"))
    asked = asked.select("conv", "at", "number", "passage.level", normalised(F.col("passage.text")).alias("norm"))
    asked = settled(asked.withColumn("hash", _key(F.col("norm"))))
    known = asked.where("hash is not null")
    long = F.length("norm") >= LEAST
    forms = messages.select("conv", "at", F.explode(F.array_distinct(F.concat(F.array(F.col("own")), F.col("own_lines")))).alias("form"))
    forms = forms.select("conv", "at", _key(normalised(F.col("form"))).alias("hash")).where("hash is not null")
    forms = settled(forms.join(known.select("hash").distinct(), "hash", "left_semi"))  # only what someone quotes
    passage = ["conv", "at", "number"]
    here = settled(_before(known, forms))
    rest = settled(known.join(here, passage, "left_anti"))
    here = settled(here.unionByName(_before(rest, _holding(rest, messages, "conv"))))
    away = (F.col("first.conv") != F.col("conv")) | (F.col("first.at") < F.col("at"))
    rest = rest.where(long).join(here, passage, "left_anti")
    anywhere = settled(rest.join(_first(forms), "hash").where(away).select(*passage, "first"))
    rest = settled(rest.join(anywhere, passage, "left_anti"))
    anywhere = anywhere.unionByName(rest.join(_first(_holding(rest, messages)), "hash").where(away).select(*passage, "first"))
    found = asked.join(here, passage, "left").join(anywhere, passage, "left")
    source = F.when(F.col("source").isNotNull(), F.struct(F.col("conv").alias("conv"), F.col("source").alias("at"))).otherwise(F.col("first"))
    found = found.select("conv", "at", "number", "level", source.alias("source"))
    return found.groupBy("conv", "at").agg(
        F.count(F.lit(1)).alias("n_quotes"), F.count("source").alias("n_linked"), F.min(F.when(F.col("source").isNotNull(), F.struct("level", "number", "source"))).alias("outermost")
    )


def offsets(joined: DataFrame) -> DataFrame:
    """conv, segment and `offset`, the messages before the segment in reply order, for conversations with segments that hang on another.

    `joined` has conv, at, segment, and hangs_on where a segment starts that hangs on an earlier message."""
    sizes = joined.groupBy("conv", "segment").agg(F.count(F.lit(1)).alias("size"))
    starts = joined.where("hangs_on is not null").select("conv", "segment", "hangs_on")
    parents = joined.select("conv", F.col("at").alias("hangs_on"), F.col("segment").alias("up"))
    hung = starts.join(parents, ["conv", "hangs_on"])
    hung = settled(numbered(hung, ["conv", "up"], [F.col("hangs_on").desc(), F.col("segment").asc()], "k"))
    if not hung.limit(1).count():
        return sizes.select("conv", "segment", F.lit(0).alias("offset")).where("false")
    roots = hung.select("conv").distinct().withColumn("segment", F.lit(1))
    nodes = hung.select("conv", "segment").unionByName(roots).join(sizes, ["conv", "segment"])
    # a walk around the tree enters and leaves each segment; from each step to the next one
    enter, leave = lambda c: 2 * F.col(c), lambda c: 2 * F.col(c) + 1
    firsts = hung.where("k = 1").select("conv", F.col("up").alias("segment"), F.col("segment").alias("child"))
    down = nodes.join(firsts, ["conv", "segment"], "left").select("conv", F.coalesce(enter("child"), leave("segment")).alias("step"), enter("segment").alias("from"), F.col("size").alias("sum"))
    siblings = hung.select("conv", "up", (F.col("k") - 1).alias("k"), F.col("segment").alias("sibling"))
    across = hung.join(siblings, ["conv", "up", "k"], "left").select("conv", F.coalesce(enter("sibling"), leave("up")).alias("step"), leave("segment").alias("from"), F.lit(0).cast("long").alias("sum"))
    begin = roots.select("conv", enter("segment").alias("step"), F.lit(None).cast("int").alias("from"), F.lit(0).cast("long").alias("sum"))
    walk = settled(down.unionByName(across).unionByName(begin))
    while walk.where("from is not null").limit(1).count():
        earlier = walk.select("conv", F.col("step").alias("from"), F.col("from").alias("next"), F.col("sum").alias("more"))
        further = walk.where("from is not null").join(earlier, ["conv", "from"]).select("conv", "step", F.col("next").alias("from"), (F.col("sum") + F.col("more")).alias("sum"))
        walk = settled(further.unionByName(walk.where("from is null")))
    return walk.where("step % 2 = 0").select("conv", (F.col("step") / 2).cast("int").alias("segment"), F.col("sum").alias("offset"))


def threads(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text (own), position, parent_turn, n_quotes, n_linked, source_conv, formatted: messages in reply order."""
    messages = settled(parsed(conversations))
    links = settled(linked(messages).select("conv", "at", "n_quotes", "n_linked", F.col("outermost.source").alias("source")))
    # an answer to the message just before continues its segment
    explicit = links.where((F.col("source.conv") == F.col("conv")) & (F.col("source.at") < F.col("at") - 1)).select("conv", "at", F.col("source.at").alias("hangs_on"))
    order = messages.select("conv", "at", "turn").join(explicit, ["conv", "at"], "left")
    order = latest(order, ["conv"], {"start": F.when(F.col("hangs_on").isNotNull(), F.col("at")), "previous": F.struct("at", "turn")})
    segment = F.when(F.col("hangs_on").isNotNull(), F.col("at")).otherwise(F.coalesce("start", F.lit(1)))
    joined = settled(order.select("conv", "at", "turn", "hangs_on", segment.alias("segment"), F.col("previous.turn").alias("before")))
    answered = joined.where("hangs_on is not null").select("conv", "at", "hangs_on")
    answered = answered.join(joined.select("conv", F.col("at").alias("hangs_on"), F.col("turn").alias("answered")), ["conv", "hangs_on"]).select("conv", "at", "answered")
    placed = joined.join(settled(offsets(joined)), ["conv", "segment"], "left")
    position = F.coalesce("offset", F.col("segment") - 1) + F.col("at") - F.col("segment") + 1
    placed = placed.select("conv", "at", position.cast("long").alias("position"), "hangs_on", "before").join(answered, ["conv", "at"], "left").join(links, ["conv", "at"], "left")
    placed = placed.select(
        "conv", "at", "position", F.when(F.col("hangs_on").isNotNull(), F.col("answered")).otherwise(F.col("before")).alias("parent_turn"),
        F.coalesce("n_quotes", F.lit(0)).cast("long").alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), F.expr("nullif(substring(source.conv, 2), '')").alias("source_conv"),
    )
    return messages.join(placed, ["conv", "at"]).select(
        "conv_id", "turn", "role", F.col("own").alias("text"), "position", "parent_turn", "n_quotes", "n_linked", "source_conv",
        F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), F.col("own")).alias("formatted"),
    )
