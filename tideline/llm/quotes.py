"""Conversations in reply order, without quotes. DataFrame functions only.

A message's lines carry a quote level: how many quote marks they start with (blanks between marks allowed). Neighbouring lines of one level are a
passage; level 0 is what the author wrote. A passage's normalised text (lower case, letters and digits only) is hashed, and so is each of its lines. A quoted passage is linked
to the earliest message of the same conversation, before the quoting one, whose own text has it as a whole passage. Where there is none, its lines vote: of the earlier messages the one that
holds most of them, then the one with the rarest line, then the earliest. Lines that stand in more than COMMON messages of the conversation (greetings, signatures) have no vote; if no
other line is found, the earliest message decides that holds the first such line. The message replies to the one that its first linked passage quotes, at the lowest level, and without
a link to the message before it. Messages without links go on a strand; a message with a link starts a strand
at the message that it quotes. Reply order walks the strands: a message, the strands that start at it, then the next message of its own strand.
A sort key has one step a quote that leads to its strand, so its length follows the depth of quoting and not the length of a conversation.

Null and empty texts are messages without passages. Repeated turns are told apart by a number in order of text; extra columns are ignored. A quote that
matches nothing is removed all the same. Long texts are read whole, and an empty table gives no rows. Messages without a conversation (null conv_id) are cleaned like others, never linked, each a conversation of its own. Messages only link within their conversation, so a frequent passage can't grow a join beyond it, and a
passage that repeats in one conversation is one row (its earliest message) before the join; a line with a vote meets COMMON messages at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm._common import cut, table

#: Fixed value: the marks at the start of a quoted line.
MARKS = "^(?:[ \\t]*>)+"
PATH_STEP = 7
#: Messages of a conversation that hold a line, beyond which it says nothing about its origin.
COMMON = 8


def passages(messages: DataFrame) -> DataFrame:
    """msg, conv_id, place, level, body, hash: the runs of lines of one quote level, in order."""
    lines = messages.select("conv_id", "msg", F.posexplode(F.split(F.coalesce(F.col("text"), F.lit("")), "\n")).alias("i", "line"))
    mark = F.regexp_extract("line", MARKS, 0)
    lines = lines.withColumn("level", F.length(F.regexp_replace(mark, "[^>]", ""))).withColumn("line", F.regexp_replace("line", MARKS + " ?", ""))
    by = Window.partitionBy("conv_id", "msg").orderBy("i")
    lines = lines.withColumn("new", (F.col("level") != F.coalesce(F.lag("level").over(by), F.lit(-1))).cast("int"))
    lines = lines.withColumn("place", F.sum("new").over(by))
    p = lines.groupBy("conv_id", "msg", "place", "level").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "line"))), lambda s: s["line"]), "\n").alias("body"))
    plain = F.lower(F.regexp_replace("body", "[^\\p{L}\\p{N}]+", " "))
    return p.withColumn("plain", F.trim(plain)).withColumn("hash", F.xxhash64("plain"))


def hashed_lines(parts: DataFrame, *keys: str) -> DataFrame:
    """keys, at, hash: the lines of passages that have letters or digits, by place, hashed like passages."""
    lines = parts.select(*keys, F.posexplode(F.split("body", "\n")).alias("at", "body"))
    plain = F.trim(F.lower(F.regexp_replace("body", "[^\\p{L}\\p{N}]+", " ")))
    return lines.withColumn("plain", plain).where("plain <> ''").select(*keys, "at", F.xxhash64("plain").alias("hash"))


def number_messages(conversations: DataFrame) -> DataFrame:
    """The messages with msg, their number in the conversation from 0: by turn, then text. Without a conversation: any number of their own."""
    by = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select("conv_id", "turn", "role", "text")
    known = rows.where("conv_id is not null").withColumn("msg", (F.row_number().over(by) - 1).cast("long"))
    return known.unionByName(rows.where("conv_id is null").withColumn("msg", F.monotonically_increasing_id()))


def reply_links(messages: DataFrame, parts: DataFrame) -> DataFrame:
    """conv_id, msg, parent, linked: the message that each one answers (null: none before it)."""
    own = parts.where((F.col("level") == 0) & (F.col("plain") != ""))
    quotes = parts.where((F.col("level") > 0) & (F.col("plain") != ""))
    run, first = ("conv_id", "msg", "place", "level"), F.min("msg").alias("origin")
    # a whole passage: the earliest before the quote is the earliest of all, if there is one
    whole = quotes.select(*run, "hash").join(own.groupBy("conv_id", "hash").agg(first), ["conv_id", "hash"]).where("origin < msg").select(*run, F.lit(0).alias("rule"), F.lit(0).alias("a"), F.lit(0).alias("b"), "origin")
    # lines: those of few messages vote for all of these, others stand for the earliest
    held = hashed_lines(own, "conv_id", "msg").select("conv_id", "hash", "msg").distinct()
    use = held.groupBy("conv_id", "hash").agg(F.count("*").alias("n"), first)
    asked = hashed_lines(quotes, *run).groupBy(*run, "hash").agg(F.min("at").alias("at"))
    rare = held.join(use.where(F.col("n") <= COMMON).select("conv_id", "hash", "n"), ["conv_id", "hash"]).withColumnRenamed("msg", "origin")
    votes = asked.join(rare, ["conv_id", "hash"]).where("origin < msg").groupBy(*run, "origin").agg((-F.count("*")).alias("a"), F.min("n").alias("b"))
    common = asked.join(use.where(F.col("n") > COMMON), ["conv_id", "hash"]).where("origin < msg").select(*run, F.lit(2).alias("rule"), F.col("at").alias("a"), F.lit(0).alias("b"), "origin")
    found = whole.unionByName(votes.withColumn("rule", F.lit(1))).unionByName(common)
    hits = found.groupBy(*run).agg(F.min(F.struct("rule", "a", "b", "origin"))["origin"].alias("origin"))
    best = hits.groupBy("conv_id", "msg").agg(F.min(F.struct("level", "place", "origin")).alias("b"), F.count("*").alias("n_linked"))
    out = messages.select("conv_id", "msg").join(best.select("conv_id", "msg", F.col("b.origin").alias("origin"), "n_linked"), ["conv_id", "msg"], "left")
    before = F.when(F.col("msg") > 0, F.col("msg") - 1)
    return out.select("conv_id", "msg", F.coalesce("origin", before).alias("parent"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"))


def reply_order(links: DataFrame, most_rounds: int = 40) -> DataFrame:
    """conv_id, msg, depth, path: quotes that lead to the message's strand, and a sort key. Keys double their steps each round (pointer jumping)."""
    upto = Window.partitionBy("conv_id").orderBy("msg").rowsBetween(Window.unboundedPreceding, 0)
    origin = F.last(F.when(F.col("n_linked") > 0, F.col("parent")), ignorenulls=True).over(upto)
    d = links.select("conv_id", "msg", origin.alias("up"), F.lpad(F.conv(F.col("msg").cast("string"), 10, 36), PATH_STEP, "0").alias("path"), F.lit(0).alias("depth"))
    d = d.withColumn("depth", F.when(F.col("up").isNotNull(), 1).otherwise(0))
    for _ in range(most_rounds):
        d = cut(d)
        if d.where("up is not null").isEmpty():
            return d.select("conv_id", "msg", "depth", "path")
        u = d.select("conv_id", F.col("msg").alias("up"), F.col("up").alias("up2"), F.col("path").alias("path2"), F.col("depth").alias("depth2"))
        d = d.join(u, ["conv_id", "up"], "left").select("conv_id", "msg", F.col("up2").alias("up"), F.concat(F.coalesce("path2", F.lit("")), "path").alias("path"), (F.col("depth") + F.coalesce("depth2", F.lit(0))).alias("depth"))
    raise RuntimeError("quotes form a cycle")


def format_chats(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, reply_to, depth, position, n_quotes, n_linked, text of every message, quotes removed; position is the reply order."""
    messages = cut(number_messages(conversations))
    parts = cut(passages(messages))
    known = parts.where("conv_id is not null")
    links = cut(reply_links(messages.where("conv_id is not null"), known))
    order = reply_order(links)
    own = F.sort_array(F.collect_list(F.when(F.col("level") == 0, F.struct("place", "body"))))
    text = F.array_join(F.filter(F.transform(own, lambda s: F.trim(s["body"])), lambda b: b != ""), "\n")
    bodies = parts.groupBy("conv_id", "msg").agg(text.alias("clean"), F.count(F.when(F.col("level") > 0, 1)).alias("n_quotes"))
    same = messages["conv_id"].eqNullSafe(bodies["conv_id"]) & (messages["msg"] == bodies["msg"])
    out = messages.join(bodies, same, "left").select(messages["conv_id"], messages["msg"], "turn", "role", "clean", "n_quotes").join(links, ["conv_id", "msg"], "left").join(order, ["conv_id", "msg"], "left")
    turns = messages.select("conv_id", F.col("msg").alias("parent"), F.col("turn").alias("reply_to"))
    out = out.join(turns, ["conv_id", "parent"], "left")
    alone = F.when(F.col("conv_id").isNull(), F.col("msg"))
    position = F.row_number().over(Window.partitionBy("conv_id", alone).orderBy("path")) - 1
    return out.select("conv_id", "turn", "role", "reply_to", F.coalesce("depth", F.lit(0)).cast("long").alias("depth"), position.cast("long").alias("position"), F.coalesce("n_quotes", F.lit(0)).cast("long").alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), F.coalesce("clean", F.lit("")).alias("text"))


def op10_chat_formatting(spark, sf_dir: str) -> DataFrame:
    """Null and empty texts are messages without passages; repeated turns go by role, then text; null conversations are one a message; an empty table gives no rows."""
    return format_chats(table(spark, sf_dir, "conversations"))
