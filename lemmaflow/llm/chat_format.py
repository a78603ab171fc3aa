"""Chat formatting by prefix-target expansion, with built-in functions only.

Every assistant turn becomes an example of its own: all turns before it are context and only its reply is
trainable. A conversation that doesn't end with an assistant turn also gets a last example without a
trainable part, so that the output holds every turn.

A turn is written ``<s>[role=R]TEXT</s>``. In R and TEXT a backslash, ``<``, ``[`` and ``]`` become ``\\e``,
``\\l``, ``\\b`` and ``\\c``; so control strings never occur inside a text, and the way back is exact.

Defined cases: a null text or role counts as empty; rows with equal turn numbers are ordered by role, then
text, and repeated rows stay; a null turn comes first; a null conv_id is a conversation; columns beyond the
four named ones are ignored; an empty table gives no rows.

The expansion repeats the context of each target, so its output grows with the square of a conversation's
turns. That is the method; a conversation's turns must fit in one task.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The escapes, in the order in which they are put in; undone in reverse.
ESCAPES = [("\\", "\\e"), ("<", "\\l"), ("[", "\\b"), ("]", "\\c")]
ASSISTANT = "assistant"


def escape(text: Column) -> Column:
    for plain, written in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def unescape(text: Column) -> Column:
    for plain, written in reversed(ESCAPES):
        text = F.replace(text, F.lit(written), F.lit(plain))
    return text


def _head(role: Column) -> Column:
    return F.concat(F.lit("<s>[role="), escape(role), F.lit("]"))


def format_examples(conversations: DataFrame) -> DataFrame:
    """conv_id, target (position of the trainable turn, from 0; null: none), n_turns, formatted, loss_start, loss_length.

    The loss span is in code points of ``formatted``; n_turns counts the turns in it.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = (
        conversations.select("conv_id", F.struct("turn", role.alias("role"), text.alias("text")).alias("t"))
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list("t")).alias("turns"))
        .select(
            "conv_id",
            F.transform("turns", lambda t: t["role"]).alias("roles"),
            F.transform("turns", lambda t: _head(t["role"])).alias("heads"),
            F.transform("turns", lambda t: escape(t["text"])).alias("bodies"),
        )
    )
    segments = F.zip_with("heads", "bodies", lambda head, body: F.concat(head, body, F.lit("</s>")))
    last = F.size("roles") - 1
    targets = F.filter(F.sequence(F.lit(0), last), lambda i: (F.get("roles", i) == ASSISTANT) | (i == last))
    at = (
        turns.withColumn("segments", segments)
        .withColumn("i", F.explode(targets))
        .withColumn("trained", F.get("roles", F.col("i")) == ASSISTANT)
        .select(
            "conv_id",
            F.when(F.col("trained"), F.col("i")).alias("target"),
            (F.col("i") + 1).alias("n_turns"),
            F.array_join(F.slice("segments", F.lit(1), F.col("i")), "").alias("context"),
            F.get("heads", F.col("i")).alias("head"),
            F.get("bodies", F.col("i")).alias("body"),
            "trained",
        )
    )
    start = F.length("context") + F.length("head")
    return at.select(
        "conv_id",
        "target",
        "n_turns",
        F.concat("context", "head", "body", F.lit("</s>")).alias("formatted"),
        F.when(F.col("trained"), start).alias("loss_start"),
        F.when(F.col("trained"), F.length("body")).otherwise(0).alias("loss_length"),
    )


def read_turns(formatted: Column) -> Column:
    """The array of (role, text) that ``formatted`` holds."""
    parts = F.split(formatted, "</s>", -1)
    whole = F.filter(parts, lambda p: F.startswith(p, F.lit("<s>[role=")))
    return F.transform(
        whole,
        lambda p: F.struct(
            unescape(F.substring_index(F.substring(p, 10, 2**31 - 1), "]", 1)).alias("role"),
            unescape(F.substr(p, F.instr(p, F.lit("]")) + 1)).alias("text"),
        ),
    )


def read_back(examples: DataFrame) -> DataFrame:
    """One row per conversation, from nothing but the formatted examples."""
    loss = F.when(
        F.col("target").isNotNull(),
        F.struct("target", unescape(F.substr("formatted", F.col("loss_start") + 1, F.col("loss_length"))).alias("text")),
    )
    per = examples.groupBy("conv_id").agg(
        F.max_by("formatted", "n_turns").alias("longest"),
        F.sort_array(F.collect_list(loss)).alias("losses"),
        F.sum(F.length("formatted")).cast("long").alias("formatted_chars"),
        F.count("target").cast("long").alias("n_examples"),
    )
    said = per.select(
        "conv_id",
        read_turns(F.col("longest")).alias("turns"),
        F.array_join(F.transform("losses", lambda x: x["text"]), "").alias("loss"),
        "formatted_chars",
        "n_examples",
    )
    line = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return said.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(line, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
        "n_examples",
    )
