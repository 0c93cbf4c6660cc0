r"""Chat formatting by quotation linking, in DataFrame functions.

A message's lines are parsed by quote level: the number of `>` signs in front, with spaces between. Runs
of lines of one level are passages. A passage and the own text of each message are both cut into parts: the
whole, each paragraph, each line and each sentence, normalised (marks off, white space single, lower case) and
hashed. Parts meet by hash: first an earlier message of the same conversation (the latest one), else the
first message anywhere. A passage is linked by its longest part that meets an original, so a quote of some paragraphs, lines or sentences of a
message links; one that starts and ends inside sentences and lines doesn't. Whole passages meet originals anywhere,
however short; parts of passages meet those of other conversations from LEAST characters on. A message
answers the original of its shallowest linked passage in its conversation; messages are ordered by thread,
depth of reply and turn, and carry their text without quotes and attribution lines.

Originals are reduced to one row a hash before they are joined, so a text that a third of all messages
hold is one row; nothing is grouped by conversation, and the order is a range-partitioned sort. Very long
texts are parsed in time in proportion to their length.

Defined results: null text counts as empty and gives empty own text. Rows without conv_id or turn link with
nothing and come out with null thread_turn. A passage of white space is none. Rows that repeat conv_id and turn each come out; as originals
they are one message. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lucerna.llm.common import checkpoint

_QUOTE = r"^(?:[ \t]*>)+[ \t]?"
#: A line that says whose words follow, such as "On 3 May, Ann wrote:".
_ATTRIBUTION = r"(?i)^\s*(on\b.*\bwrote|am\b.*\bschrieb\b[^:]*|le\b.*\ba écrit|el\b.*\bescribió)\s*:\s*$"
#: Where a sentence or a paragraph ends.
_SENTENCE = r"\n\s*\n|(?<=[.!?…])\s+|(?<=[。！？])"
#: Marks of a run's start and of its text; in messages they count as white space.
_RUN, _BODY = "\x1e", "\x1f"
#: Shortest normalised part of a longer passage, in characters, that links to another conversation.
LEAST = 12


def _plain(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"[\s\x1e\x1f]+", " ")))


def _parsed(messages: DataFrame) -> DataFrame:
    """Columns lines (struct level, body), own (text without quotes), of each message."""
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: F.struct(F.length(F.regexp_replace(F.regexp_extract(x, _QUOTE, 0), "[^>]", "")).alias("level"), F.regexp_replace(x, _QUOTE, "").alias("body")))
    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").withColumn("lines", lines)
    has = F.exists("lines", lambda x: x["level"] > 0)
    keep = F.filter("lines", lambda x: (x["level"] == 0) & ~(has & x["body"].rlike(_ATTRIBUTION)))
    own = F.when(has, F.regexp_replace(F.array_join(F.transform(keep, lambda x: x["body"]), "\n"), r"^\n+|\n+$", "")).otherwise(F.coalesce("text", F.lit("")))
    return rows.withColumn("own", own).withColumn("has_quote", has)


def _passages(lines: Column) -> Column:
    """struct(level, text) of the runs of quoted lines of one level: lines are joined up to one text in which
    a new level has a mark in front, and that is cut at the marks."""
    before = F.concat(F.array(F.lit(-1)), F.transform(lines, lambda x: x["level"]))
    marked = F.zip_with(lines, F.slice(before, F.lit(1), F.size(lines)), lambda x, b: F.concat(F.when(x["level"] == b, F.lit("\n")).otherwise(F.concat(F.lit(_RUN), x["level"].cast("string"), F.lit(_BODY))), F.translate(x["body"], _RUN + _BODY, "  ")))
    runs = F.split(F.array_join(marked, ""), _RUN, -1)
    of = lambda r: F.struct(F.substring_index(r, _BODY, 1).cast("int").alias("level"), F.substring_index(r, _BODY, -1).alias("text"))
    return F.filter(F.transform(F.filter(runs, lambda r: r != ""), of), lambda p: p["level"] > 0)


def _hash(plain: Column) -> Column:
    return F.substring(F.sha2(plain.cast("binary"), 256), 1, 32)


def _parts(text: Column) -> Column:
    """Normalised parts by which a text is linked: the whole, its paragraphs, lines and sentences."""
    cuts = F.concat(F.array(text), F.split(text, r"\n\s*\n"), F.split(text, "\n"), F.split(text, _SENTENCE))
    return F.filter(F.array_distinct(F.transform(cuts, _plain)), lambda p: p != "")


def quotation_links(messages: DataFrame) -> DataFrame:
    """conv_id, turn, level, passage hash and the linked original (to_conv, to_turn; null if none)."""
    rows = _parsed(messages).where("conv_id is not null and turn is not null")
    originals = rows.select("conv_id", "turn", F.explode(_parts(F.col("own"))).alias("part")).select("conv_id", "turn", _hash(F.col("part")).alias("hash"))
    quotes = checkpoint(
        rows.where("has_quote").select("conv_id", "turn", F.explode(_passages(F.col("lines"))).alias("p"))
        .select("conv_id", "turn", F.col("p.level").alias("level"), _hash(_plain(F.col("p.text"))).alias("passage"), F.explode(_parts(F.col("p.text"))).alias("part"))
        .select("conv_id", "turn", "level", "passage", F.length("part").alias("n"), _hash(F.col("part")).alias("hash")).distinct()
    )
    wanted = quotes.select("hash").distinct()
    known = checkpoint(originals.join(wanted, "hash", "left_semi").distinct())
    near = (
        quotes.join(known.select(F.col("conv_id").alias("o_conv"), F.col("turn").alias("o_turn"), F.col("hash").alias("o_hash")), (F.col("hash") == F.col("o_hash")) & (F.col("conv_id") == F.col("o_conv")) & (F.col("o_turn") < F.col("turn")), "left")
        .groupBy("conv_id", "turn", "level", "passage", "n", "hash").agg(F.max("o_turn").alias("near_turn"))
    )
    first = known.groupBy("hash").agg(F.min(F.struct("conv_id", "turn")).alias("first"))
    linked = near.join(first, "hash", "left")
    elsewhere = ((F.col("n") >= LEAST) | (F.col("hash") == F.col("passage"))) & ((F.col("first.conv_id") != F.col("conv_id")) | (F.col("first.turn") < F.col("turn")))
    inside = F.struct("n", F.lit(1).alias("inside"), F.col("near_turn").alias("by"), F.lit(0).cast("long").alias("then"), F.col("conv_id").alias("to_conv"), F.col("near_turn").alias("to_turn"))
    other = F.struct("n", F.lit(0).alias("inside"), (-F.col("first.conv_id")).alias("by"), (-F.col("first.turn")).alias("then"), F.col("first.conv_id").alias("to_conv"), F.col("first.turn").alias("to_turn"))
    best = F.max(F.when(F.col("near_turn").isNotNull(), inside).when(elsewhere, other))
    return linked.groupBy("conv_id", "turn", "level", "passage").agg(best.alias("best")).select("conv_id", "turn", "level", F.col("passage").alias("hash"), "best.to_conv", "best.to_turn")


def conversations_by_reply(messages: DataFrame, most_rounds: int = 40) -> DataFrame:
    """conv_id, thread_turn, depth, turn, role, reply_to, n_quotes, n_linked, text (without quotes), in order."""
    links = checkpoint(quotation_links(messages))
    inside = F.col("to_conv") == F.col("conv_id")
    facts = links.groupBy("conv_id", "turn").agg(
        F.count("*").alias("n_quotes"), F.count("to_turn").alias("n_linked"),
        F.min(F.when(inside, F.struct("level", (-F.col("to_turn")).alias("back")))).alias("nearest"),
    ).select("conv_id", "turn", "n_quotes", "n_linked", (-F.col("nearest.back")).alias("reply_to"))
    # a reply is later than what it answers, so pointers end; each round doubles the steps they span
    jumps = checkpoint(facts.where("reply_to is not null").select("conv_id", "turn", F.col("reply_to").alias("to"), F.lit(1).cast("long").alias("depth")))
    for _ in range(most_rounds):
        far = jumps.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("to").alias("far"), F.col("depth").alias("more"))
        met = jumps.join(far, (F.col("conv_id") == F.col("c")) & (F.col("to") == F.col("t")), "left")
        if met.where("far is not null").isEmpty():
            break
        jumps = checkpoint(met.select("conv_id", "turn", F.coalesce("far", "to").alias("to"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")))
    else:
        raise RuntimeError("reply chains did not end")
    placed = facts.join(jumps.select("conv_id", "turn", F.col("to").alias("top"), "depth"), ["conv_id", "turn"], "left")
    rows = _parsed(messages).select("conv_id", "turn", "role", "own")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return (
        rows.join(placed, ["conv_id", "turn"], "left")
        .select("conv_id", F.when(F.col("conv_id").isNotNull(), F.coalesce("top", "turn")).alias("thread_turn"), zero("depth"), "turn", "role", "reply_to", zero("n_quotes"), zero("n_linked"), F.col("own").alias("text"))
        .orderBy("conv_id", "thread_turn", "depth", "turn", "role", "text")
    )
