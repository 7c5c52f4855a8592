"""Quotation linking: messages are joined to the messages that they quote, and put in reply order without the quotes.

A quoted line begins with one or more `>`, with spaces between them allowed; their number is its level. Consecutive lines
of one level form a passage; lines that introduce a quotation ("... wrote:") belong to it. Passages and the unquoted
paragraphs and lines of every message are normalised (case, white space and final punctuation do not count) and hashed.
A message replies to the earlier message of its conversation that holds most of its first-level passages; of those with
equally many the latest. Deeper levels link the message to older ones in the same way, as references. A message without a
matching quotation replies to the one before it.

Cases: null text is empty, null turns come first. Rows equal in conversation and turn are messages of their own, in the
order of a hash; rows equal in all four columns are one message with its number of copies. A conversation that is null is
one conversation. A passage in several earlier messages counts for
the first that holds it, however short it is; one without a character left after normalising counts for none. Quoting oneself or a later message gives no link. Extra columns are dropped. Empty in, empty out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NO_TURN = -(1 << 62)
CHUNK_TURNS = 256  # turns ordered together
PART_MESSAGES = 256  # messages in one row of `conversations`
_MARKS = r"^[ \t]*((?:>[ \t]?)+)"
_INTRODUCTION = r"(?i)^.{0,200}\b(?:wrote|writes|schrieb|a écrit|escribió)\b.{0,100}:[ \t]*$"


def normalised(text: Column) -> Column:
    flat = F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))
    return F.regexp_replace(flat, r"[\s.!?,;:]+$", "")


def _level(line: Column) -> Column:
    return F.length(F.translate(F.regexp_extract(line, _MARKS, 1), " \t", ""))


def parsed(messages: DataFrame) -> DataFrame:
    """Per message: its own text, and its quoted passages as (level, passage)."""
    lines = F.transform(
        F.split(F.regexp_replace("text", "\r\n?", "\n"), "\n", -1),
        lambda x: F.struct(_level(x).alias("level"), F.regexp_replace(x, _MARKS, "").alias("line")),
    )
    rows = messages.withColumn("_lines", lines)
    # an introduction counts as part of the quotation only in front of one
    rows = rows.withColumn(
        "_own",
        F.filter(
            F.transform(
                "_lines",
                lambda x, i: F.when(
                    (x["level"] == 0)
                    & ~(
                        x["line"].rlike(_INTRODUCTION)
                        & (F.coalesce(F.get(F.col("_lines"), i + 1)["level"], F.lit(0)) > 0)
                    ),
                    x["line"],
                ),
            ),
            lambda x: x.isNotNull(),
        ),
    )
    # passages: a run of lines of one level becomes one text
    quoted = F.aggregate(
        "_lines",
        F.array().cast("array<struct<level:int,passage:string>>"),
        lambda done, x: F.when(
            (F.size(done) > 0) & (F.coalesce(F.element_at(done, -1)["level"], F.lit(0)) == x["level"]),
            F.concat(
                F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))),
                F.array(
                    F.struct(
                        x["level"].alias("level"),
                        F.concat(F.element_at(done, -1)["passage"], F.lit("\n"), x["line"]).alias("passage"),
                    )
                ),
            ),
        ).otherwise(F.concat(done, F.array(F.struct(x["level"].alias("level"), x["line"].alias("passage"))))),
    )
    has_quote = F.col("text").rlike(r"(?m)^[ \t]*>")
    return rows.withColumn(
        "passages",
        F.when(has_quote, F.filter(quoted, lambda p: p["level"] > 0)).otherwise(
            F.array().cast("array<struct<level:int,passage:string>>")
        ),
    ).withColumn(
        "own_text", F.when(has_quote, F.regexp_replace(F.array_join("_own", "\n"), r"^\s+|\s+$", "")).otherwise(F.col("text"))
    ).drop("_lines", "_own")


def _hash(text: Column) -> Column:
    return F.struct(F.xxhash64(text).alias("a"), F.hash(text, F.lit(17)).alias("b"))


def linked(conversations: DataFrame) -> DataFrame:
    """Per message: what it replies to, what else it quotes, its place in the conversation and its own text."""
    base = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    base = base.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies"))
    at = F.struct(F.coalesce("turn", F.lit(NO_TURN)).alias("turn"), F.xxhash64("role", "text").alias("id"))
    messages = parsed(base.withColumn("at", at))

    # the first message of a conversation that holds a paragraph or line of its own
    blocks = F.array_distinct(
        F.filter(
            F.transform(
                F.concat(
                    F.array("own_text"), F.split("own_text", r"\n\s*\n", -1), F.split("own_text", r"\n", -1)
                ),
                normalised,
            ),
            lambda x: x != "",
        )
    )
    quoting = messages.where(F.size("passages") > 0)
    asked = quoting.select(
        "conv_id",
        "at",
        F.explode("passages").alias("p"),
    ).select(
        "conv_id",
        "at",
        F.col("p.level").alias("level"),
        # a passage is looked up whole, by paragraph and line by line, as a reply may quote a part only
        F.explode(
            F.array_distinct(
                F.filter(
                    F.transform(
                        F.concat(
                            F.array("p.passage"), F.split("p.passage", r"\n\s*\n", -1), F.split("p.passage", "\n", -1)
                        ),
                        normalised,
                    ),
                    lambda x: x != "",
                )
            )
        ).alias("passage"),
    ).select(
        "conv_id", "at", "level", F.length("passage").alias("size"), _hash(F.col("passage")).alias("key")
    )
    wanted = asked.select("conv_id", "key").distinct()
    held = messages.select("conv_id", F.col("at").alias("source"), F.explode(blocks).alias("block")).select(
        "conv_id", "source", _hash(F.col("block")).alias("key")
    )
    first = held.groupBy("conv_id", "key").agg(F.min("source").alias("source"))
    first = first.join(
        wanted.select(F.col("conv_id").alias("_c"), F.col("key").alias("_k")),
        first["conv_id"].eqNullSafe(F.col("_c")) & (first["key"] == F.col("_k")),
        "left_semi",
    )
    found = asked.alias("q").join(
        first.alias("f"), F.col("q.conv_id").eqNullSafe(F.col("f.conv_id")) & (F.col("q.key") == F.col("f.key"))
    ).where("f.source < q.at").select("q.conv_id", "q.at", "q.level", "q.size", "f.source")
    votes = found.groupBy("conv_id", "at", "level", "source").agg(F.sum("size").alias("size"))
    direct = votes.groupBy("conv_id", "at").agg(
        F.max(F.when(F.col("level") == 1, F.struct("size", "source"))).alias("best"),
        F.sort_array(F.collect_set("source")).alias("quoted"),  # at most one entry for each quoted passage
    )

    joined = messages.alias("m").join(
        direct.alias("d"),
        F.col("m.conv_id").eqNullSafe(F.col("d.conv_id")) & (F.col("m.at") == F.col("d.at")),
        "left",
    )
    placed = _placed(messages.select("conv_id", "at"))
    return joined.join(
        placed.alias("p"), F.col("m.conv_id").eqNullSafe(F.col("p.conv_id")) & (F.col("m.at") == F.col("p.at"))
    ).select(
        F.col("m.conv_id").alias("conv_id"),
        F.col("m.turn").alias("turn"),
        F.col("m.role").alias("role"),
        F.col("m.copies").alias("copies"),
        F.col("p.place").alias("place"),
        _turn(F.coalesce(F.col("d.best.source"), F.col("p.before"))).alias("reply_to"),
        F.col("d.best").isNotNull().alias("by_quote"),
        F.transform(F.coalesce("d.quoted", F.array()), _turn).alias("quotes"),
        F.size("m.passages").alias("n_passages"),
        F.col("m.own_text").alias("own_text"),
    )


def _placed(keys: DataFrame) -> DataFrame:
    """Place of each message in its conversation, and the message before it.

    Ordered in chunks of turns, so that one long conversation is not ordered in one task; only the chunks, which are far
    fewer, are ordered per conversation.
    """
    keys = keys.withColumn("chunk", F.floor(F.col("at.turn") / CHUNK_TURNS))
    inside = Window.partitionBy("conv_id", "chunk").orderBy("at")
    rows = keys.withColumn("_row", F.row_number().over(inside)).withColumn("_lag", F.lag("at").over(inside))
    over = Window.partitionBy("conv_id").orderBy("chunk")
    chunks = (
        keys.groupBy("conv_id", "chunk")
        .agg(F.count("*").alias("_n"), F.max("at").alias("_last"))
        .select(
            F.col("conv_id").alias("_c"),
            F.col("chunk").alias("_k"),
            F.coalesce(F.sum("_n").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"),
            F.lag("_last").over(over).alias("_earlier"),
        )
    )
    return rows.join(chunks, rows["conv_id"].eqNullSafe(chunks["_c"]) & (rows["chunk"] == chunks["_k"])).select(
        "conv_id", "at", (F.col("_start") + F.col("_row")).alias("place"), F.coalesce("_lag", "_earlier").alias("before")
    )


def _turn(at: Column) -> Column:
    return F.when(at["turn"] > F.lit(NO_TURN), at["turn"])


def conversations(messages: DataFrame) -> DataFrame:
    """Messages in reply order (a reply after what it answers), without quotations; long conversations in parts."""
    entry = F.struct("place", "turn", "reply_to", "role", "own_text")
    return (
        linked(messages)
        .groupBy("conv_id", F.floor((F.col("place") - 1) / PART_MESSAGES).alias("part"))
        .agg(F.sort_array(F.collect_list(entry)).alias("messages"))
    )
