r"""Chat formatting in Spark expressions only.

The turns of a conversation are collected as structs, sorted, adjacent turns of a role merged by an array aggregation,
and all is concatenated. The format:

    <|begin|>ROLE<|body|>TEXT<|end|>                 a turn
    <|begin|>ROLE<|body|>TEXT<|next|>TEXT<|end|>     merged turns of one role

A control string inside a text or role gets a backslash after its first character, and one that has backslashes there
gets one more, so taking one away brings back the text: `</s>` becomes `<\/s>`, and `<\/s>` becomes `<\\/s>`.

Cases: a null text or role is empty, a null turn comes first, equal turns are ordered by role and text, and repeated rows
are turns of their own. A null id is a conversation. An empty table gives an empty result. Other columns aren't read. A
conversation becomes one row, so its turns meet in one task; that is what formatting it means.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BEGIN, BODY, NEXT, END = "<|begin|>", "<|body|>", "<|next|>", "<|end|>"
#: Fixed: strings that are control strings of this template or of common others, after their first character.
CONTROL = r"(\|[a-z_]{1,20}\||/?s>|/?INST\]|/?SYS>>)"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"([<\[])(\\*)" + CONTROL, r"$1\\$2$3")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"([<\[])\\(\\*)" + CONTROL, r"$1$2$3")


def format_conversations(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv and formatted."""
    safe = lambda c: escape(F.coalesce(F.col(c).cast("string"), F.lit("")))
    turns = df.groupBy(F.col(conv).alias(conv)).agg(F.sort_array(F.collect_list(F.struct(F.col(turn).alias("turn"), safe(role).alias("role"), safe(text).alias("text")))).alias("turns"))
    turns = turns.withColumn("indexed", F.transform("turns", lambda x, i: F.struct(x["role"].alias("role"), x["text"].alias("text"), i.alias("i"))))
    # a turn is written in full, or added to the one before it if that has its role: one array aggregation, in linear time
    piece = lambda x: F.when((x["i"] > 0) & (F.try_element_at(F.col("turns"), F.greatest(x["i"], F.lit(1)))["role"] == x["role"]), F.concat(F.lit(NEXT), x["text"])).otherwise(F.concat(F.when(x["i"] > 0, F.lit(END)).otherwise(F.lit("")), F.lit(BEGIN), x["role"], F.lit(BODY), x["text"]))
    return turns.select(conv, F.concat(F.array_join(F.transform("indexed", piece), ""), F.lit(END)).alias("formatted"))


def parse(df: DataFrame, formatted: str = "formatted") -> DataFrame:
    """Adds turns, an array of (role, text), read back from the output alone."""
    blocks = F.filter(F.split(formatted, r"<\|end\|>", -1), lambda b: F.length(b) > 0)
    body = lambda b: F.substring_index(b, BODY, -1)
    head = lambda b: F.substring_index(F.substring_index(b, BODY, 1), BEGIN, -1)
    turns = F.flatten(F.transform(blocks, lambda b: F.transform(F.split(body(b), r"<\|next\|>", -1), lambda t: F.struct(unescape(head(b)).alias("role"), unescape(t).alias("text")))))
    return df.withColumn("turns", turns)


def digests(df: DataFrame, loss_role: str = "assistant", formatted: str = "formatted") -> DataFrame:
    """Adds what the parsed turns hash to, and the text under the loss mask: the bodies of one role, nothing between."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["role"] == loss_role), lambda t: t["text"]), "")
    out = parse(df, formatted).withColumn("_loss", loss)
    return out.select(*df.columns, F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("_loss").cast("long").alias("loss_chars"), F.sha2("_loss", 256).alias("loss_sha256"), F.length(formatted).cast("long").alias("formatted_chars"))
