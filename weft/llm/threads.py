"""Quotation linking of conversations. DataFrame functions only.

A line's quote level is the number of its leading ">" marks. Neighbouring lines of one level form a passage. Quoted passages and messages' own
passages are normalised and hashed; a quoted passage names as parent the latest earlier message of its conversation that holds the same passage
itself, else the first such message of the first other conversation. A passage that directly follows one of the next deeper level is also hashed together
with it: an answer below its quote looks the same one level up, so a message that answers what the inner quote says is preferred. A message without
such a quote answers the message before it. The result lists each conversation in reply order (thread by thread, a parent before its answers), without quotes.

Links make no cycle: within a conversation they go to earlier turns, to others down to conversations of smaller ids, and up only to conversations that quote no other one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weft.llm.common import written

MARKS = r"^[ \t>]*>[ \t]?"
#: A line that introduces a quote.
ATTRIBUTION = r"^[ \t]*(?:On|Am|Le|El)\b.{0,200}(?:wrote|schrieb|a écrit|escribió)[ \t]*:[ \t]*$"
#: Turns, or depths of a thread, numbered together; positions add up over such blocks, so that a long conversation is not one task's window.
BLOCK = 1000


def _level(line: Column) -> Column:
    marks = F.regexp_extract(line, MARKS, 0)
    return F.char_length(marks) - F.char_length(F.translate(marks, ">", ""))


def normal(passage: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(passage), r"[\s\p{Z}]+", " "))


def parsed(messages: DataFrame) -> DataFrame:
    """messages with own (text without quotes and their introductions) and passages: array of (level, hash, context, place); context is null without a deeper passage before."""
    plain = F.coalesce("text", F.lit(""))
    split = F.transform(F.split(plain, r"\r?\n"), lambda x: F.struct(_level(x).alias("level"), F.regexp_replace(x, MARKS, "").alias("line")))
    whole = F.array(F.struct(F.lit(0).alias("level"), plain.alias("line")))
    # a passage begins at a line with text after none, or of another level than the line before
    before = lambda i: F.get(F.col("__lines"), i - 1)
    begins = lambda x, i: (F.trim(x.line) != "") & ((i == 0) | (F.trim(before(i).line) == "") | (before(i).level != x.level))
    starts = F.filter(F.transform("__lines", lambda x, i: F.when(begins(x, i), i)), lambda i: i.isNotNull())
    text = lambda s, k: F.array_join(F.transform(F.slice("__lines", s + 1, F.coalesce(F.get("__starts", k + 1), F.size("__lines")) - s), lambda x: x.line), "\n")
    grouped = F.transform("__starts", lambda s, k: F.struct(F.get("__lines", s).level.alias("level"), text(s, k).alias("text")))
    paragraphs = F.transform(F.filter(F.split(plain, r"\r?\n[ \t]*\r?\n"), lambda p: F.trim(p) != ""), lambda p: F.struct(F.lit(0).alias("level"), p.alias("text")))
    introduces = lambda x, i: F.regexp_like(x.line, F.lit(ATTRIBUTION)) & (F.coalesce(F.get("__lines", i + 1).level, F.lit(0)) > 0)
    own_lines = F.filter("__lines", lambda x, i: (x.level == 0) & ~introduces(x, i))
    earlier = lambda i: F.get("__h", i - 1)
    return (
        messages.withColumn("__lines", F.when(F.contains(plain, F.lit(">")), split).otherwise(whole))
        .withColumn("__quoted", F.exists("__lines", lambda x: x.level > 0))
        .withColumn("own", F.when(F.col("__quoted"), F.trim(F.array_join(F.transform(own_lines, lambda x: x.line), "\n"))).otherwise(plain))
        # an introduction belongs to no passage
        .withColumn("__lines", F.when(F.col("__quoted"), F.transform("__lines", lambda x, i: F.struct(x.level.alias("level"), F.when((x.level == 0) & introduces(x, i), "").otherwise(x.line).alias("line")))).otherwise(F.col("__lines")))
        .withColumn("__starts", F.when(F.col("__quoted"), starts).otherwise(F.array().cast("array<int>")))
        .withColumn("__p", F.when(F.col("__quoted"), grouped).otherwise(paragraphs))
        .withColumn("__n", F.filter(F.transform("__p", lambda p: F.struct(p.level.alias("level"), normal(p.text).alias("t"))), lambda p: p.t != ""))
        .withColumn("__h", F.transform("__n", lambda p: F.struct(p.level.alias("level"), F.sha2(p.t, 256).alias("hash"))))
        .withColumn("passages", F.transform("__h", lambda p, i: F.struct(p.level.alias("level"), p.hash.alias("hash"), F.when((i > 0) & (earlier(i).level == p.level + 1), F.sha2(F.concat(p.hash, earlier(i).hash), 256)).alias("context"), i.alias("place"))))
        .drop("__lines", "__quoted", "__starts", "__p", "__n", "__h")
    )


def _near(own: DataFrame, quotes: DataFrame) -> DataFrame:
    """quotes with near: the latest earlier turn of the conversation that holds the key itself, or null. By blocks of turns, then over the blocks."""
    block = F.floor(F.col("turn") / BLOCK).alias("block")
    asked = quotes.select("conv_id", "key").distinct()
    said = own.join(asked, ["conv_id", "key"], "left_semi").select("conv_id", "key", "turn", block, F.col("turn").alias("said"))
    both = said.select("*", F.lit(1).alias("kind"), F.lit(None).cast("int").alias("level"), F.lit(None).cast("int").alias("place"), F.lit(None).cast("int").alias("confirmed")).unionByName(
        quotes.select("conv_id", "key", "turn", block, F.lit(None).cast("long").alias("said"), F.lit(0).alias("kind"), "level", "place", "confirmed")
    )
    inside = W.partitionBy("conv_id", "key", "block").orderBy("turn", "kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    tops = both.groupBy("conv_id", "key", "block").agg(F.max("said").alias("top"))
    tops = tops.withColumn("top", F.max("top").over(W.partitionBy("conv_id", "key").orderBy("block").rowsBetween(W.unboundedPreceding, -1)))
    placed = both.withColumn("near", F.max("said").over(inside)).filter("kind = 0").join(tops, ["conv_id", "key", "block"])
    return placed.select("conv_id", "turn", "level", "place", "confirmed", "key", F.coalesce("near", "top").alias("near"))


def _far(own: DataFrame, quotes: DataFrame) -> DataFrame:
    """quotes with parent_conv and parent_turn in another conversation."""
    holders = written(own.join(quotes.select("key").distinct(), "key", "left_semi").groupBy("key", "conv_id").agg(F.min("turn").alias("turn")), "holders")
    place = F.struct(F.col("conv_id").alias("c"), F.col("turn").alias("t"))
    spread = written(holders.groupBy("key").agg(F.min(place).alias("first"), F.max("conv_id").alias("last")), "spread")
    asked = written(quotes.join(spread, "key").filter("first.c <> conv_id or last <> conv_id"), "asked")
    still = holders.join(asked.select("conv_id").distinct(), "conv_id", "left_anti")  # in conversations that quote no other
    one = written(still.groupBy("key").agg(F.min(place).alias("one")), "one")
    two = written(still.join(one, "key").filter("conv_id <> one.c").groupBy("key").agg(F.min(place).alias("two")), "two")
    found = asked.join(one, "key", "left").join(two, "key", "left")
    parent = F.when(F.col("first.c") < F.col("conv_id"), F.col("first")).when(F.col("one.c") != F.col("conv_id"), F.col("one")).otherwise(F.col("two"))
    return found.withColumn("p", parent).filter("p is not null").select("conv_id", "turn", "level", "place", "confirmed", F.col("p.c").alias("parent_conv"), F.col("p.t").alias("parent_turn"))


def _threads(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, root, depth): first message of the thread and steps to it. turns: conv_id, turn, up (the parent's turn, or null).

    By doubled steps; a message that has come to its root takes no more.
    """
    begin = F.col("up").isNull()
    state = written(turns.select("conv_id", "turn", F.coalesce("up", "turn").alias("root"), F.when(begin, 0).otherwise(1).cast("long").alias("depth"), begin.alias("there")), "steps")
    while not state.filter("not there").isEmpty():
        ahead = state.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("next"), F.col("depth").alias("more"), F.col("there").alias("then"))
        moved = state.filter("not there").drop("there").join(ahead, ["conv_id", "root"])
        moved = moved.select("conv_id", "turn", F.col("next").alias("root"), (F.col("depth") + F.col("more")).alias("depth"), F.col("then").alias("there"))
        state = written(state.filter("there").unionByName(moved), "steps")
    return state.drop("there")


def _positions(threads: DataFrame) -> DataFrame:
    """(conv_id, turn, position, root, depth): messages before each one by thread, depth and turn. threads: also n, messages of that number."""
    rows = threads.withColumn("block", F.floor(F.col("depth") / BLOCK))
    before = lambda *by: W.partitionBy(*by)
    upto = lambda w: w.rowsBetween(W.unboundedPreceding, -1)
    summed = lambda over: F.coalesce(F.sum("n").over(upto(over)), F.lit(0))
    blocks = rows.groupBy("conv_id", "root", "block").agg(F.sum("n").alias("n"))
    roots = blocks.groupBy("conv_id", "root").agg(F.sum("n").alias("n")).withColumn("in_conv", summed(before("conv_id").orderBy("root"))).drop("n")
    blocks = blocks.withColumn("in_root", summed(before("conv_id", "root").orderBy("block"))).drop("n").join(roots, ["conv_id", "root"])
    rows = rows.withColumn("in_block", summed(before("conv_id", "root", "block").orderBy("depth", "turn"))).join(blocks, ["conv_id", "root", "block"])
    return rows.select("conv_id", "turn", (F.col("in_conv") + F.col("in_root") + F.col("in_block")).alias("position"), "root", "depth")


def _before(turns: DataFrame) -> DataFrame:
    """turns with the turn before each one."""
    rows = turns.withColumn("block", F.floor(F.col("turn") / BLOCK))
    inside = rows.withColumn("before", F.lag("turn").over(W.partitionBy("conv_id", "block").orderBy("turn")))
    blocks = rows.groupBy("conv_id", "block").agg(F.max("turn").alias("last")).withColumn("last", F.lag("last").over(W.partitionBy("conv_id").orderBy("block")))
    return inside.join(blocks, ["conv_id", "block"]).select("conv_id", "turn", "n", F.coalesce("before", "last").alias("before"))


def link(df: DataFrame) -> DataFrame:
    """conv_id, turn, role, text (without quotes), parent_conv_id, parent_turn, link (quote, order or root), quote_level, thread (first turn of the thread), depth, position.

    df: conv_id, turn, role, text; other columns are ignored. Null texts are empty and get the answers' links like others; rows with a null
    conversation or turn come through as roots of their own. Repeated rows repeat; messages with one number share links and position.
    An empty table gives no rows. Threads and depths count links within the conversation; a message that quotes another conversation begins a thread.
    """
    messages = parsed(df.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text"))
    # outer, for a plain explode makes a filter on the passages that would be pushed down and work them out anew for each line
    flat = messages.filter("conv_id is not null and turn is not null").select("conv_id", "turn", F.explode_outer("passages").alias("p")).filter("p is not null")
    keys = F.explode(F.filter(F.array(F.struct(F.col("p.hash").alias("key"), F.lit(0).alias("confirmed")), F.struct(F.col("p.context").alias("key"), F.lit(1).alias("confirmed"))), lambda k: k.key.isNotNull())).alias("k")
    keyed = flat.select("conv_id", "turn", "p.level", "p.place", keys).select("conv_id", "turn", "level", "place", "k.key", "k.confirmed")
    keyed = written(keyed.groupBy("conv_id", "turn", "level", "key", "confirmed").agg(F.min("place").alias("place")), "keys")
    own = keyed.filter("level = 0").select("conv_id", "turn", "key")
    near = written(_near(own, keyed.filter("level > 0")), "near")
    found = near.filter("near is not null").select("conv_id", "turn", "level", "place", "confirmed", F.col("conv_id").alias("parent_conv"), F.col("near").alias("parent_turn"), F.lit(0).alias("far")).unionByName(
        _far(own, near.filter("near is null").drop("near")).withColumn("far", F.lit(1))
    )
    # the outermost quote answers; then the one in the conversation itself, then one that its own quote confirms, then the first
    best = found.groupBy("conv_id", "turn").agg(F.min(F.struct("level", "far", (-F.col("confirmed")).alias("unsure"), "place", "parent_conv", "parent_turn")).alias("b"))
    turns = df.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn")).filter("conv_id is not null and turn is not null").groupBy("conv_id", "turn").agg(F.count("*").alias("n"))
    linked = _before(turns).join(best, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", "n", "b", "before", F.when(F.col("b").isNull(), F.col("before")).when(F.col("b.parent_conv") == F.col("conv_id"), F.col("b.parent_turn")).alias("up")
    )
    linked = written(linked, "linked")
    placed = _positions(_threads(linked).join(linked.select("conv_id", "turn", "n"), ["conv_id", "turn"]))
    joined = messages.join(linked.join(placed, ["conv_id", "turn"]).drop("n", "up"), ["conv_id", "turn"], "left")
    return joined.select(
        "conv_id",
        "turn",
        "role",
        F.col("own").alias("text"),
        F.when(F.col("b").isNotNull(), F.col("b.parent_conv")).when(F.col("before").isNotNull(), F.col("conv_id")).alias("parent_conv_id"),
        F.coalesce("b.parent_turn", "before").alias("parent_turn"),
        F.when(F.col("b").isNotNull(), "quote").when(F.col("before").isNotNull(), "order").otherwise("root").alias("link"),
        F.coalesce("b.level", F.lit(0)).alias("quote_level"),
        F.col("root").alias("thread"),
        "depth",
        "position",
    )
