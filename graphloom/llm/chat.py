"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Each assistant turn becomes an example: all turns before it as context, its own text as the only trainable part. A
conversation that ends otherwise gives one more example, of all turns, with nothing to train on, so that every turn
can be read back. A turn is `<|im_start|>role\\ntext<|im_end|>\\n`; inside role and text `&` is written `&amp;`, `<|`
is written `&lt;|`, and in a role a line break is written `&nl;`, so no text can look like the template's marks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


def format_conversations(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each example: conv_id, example (from 0), last (it has all turns), formatted, loss_start, loss_chars.

    loss_start (from 1) and loss_chars tell the part of formatted under the loss mask, in code points; loss_chars
    is 0 where there is none. Turns go by number, then role, then text; a null text or role is empty, a null
    number comes first, null conv_ids make one conversation. An empty table gives no rows.
    """
    said = F.struct(F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    rows = turns.select(F.col(conv_id).alias("conv_id"), said.alias("t"))
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))

    def written(t: Column) -> Column:
        head = F.concat(F.lit(START), F.replace(escape(t["role"]), F.lit("\n"), F.lit("&nl;")), F.lit("\n"))
        body = escape(t["text"])
        return F.struct(F.concat(head, body, F.lit(f"{END}\n")).alias("s"), F.length(head).alias("head"), F.length(body).alias("body"), (t["role"] == "assistant").alias("target"))

    whole = whole.select("conv_id", F.transform("turns", written).alias("turns"))
    # the end of each turn in the text of all turns, by summing lengths once
    sizes = F.aggregate(
        F.transform("turns", lambda t: F.length(t["s"]).cast("long")),
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<long>").alias("ends")),
        lambda a, n: F.struct((a["at"] + n).alias("at"), F.concat(a["ends"], F.array(a["at"] + n)).alias("ends")),
        lambda a: a["ends"],
    )
    whole = whole.select("conv_id", F.array_join(F.transform("turns", lambda t: t["s"]), "").alias("all"), F.size("turns").alias("n"), F.arrays_zip(F.transform("turns", lambda t: t["head"]).alias("head"), F.transform("turns", lambda t: t["body"]).alias("body"), F.transform("turns", lambda t: t["target"]).alias("target"), sizes.alias("end")).alias("marks"))
    placed = F.transform("marks", lambda m, i: F.struct((i + 1 == F.col("n")).alias("last"), m["target"].alias("target"), m["end"].alias("end"), m["head"].alias("head"), m["body"].alias("body")))
    examples = whole.select("conv_id", "all", F.posexplode(F.filter(placed, lambda m: m["target"] | m["last"])).alias("example", "m"))
    tail = len(END) + 1
    body = F.when(F.col("m.target"), F.col("m.body")).otherwise(0)
    return examples.select("conv_id", "example", "m.last", F.substring("all", F.lit(1), F.col("m.end").cast("int")).alias("formatted"), (F.col("m.end") - tail - body + 1).cast("int").alias("loss_start"), body.alias("loss_chars"))


def read_back(examples: DataFrame) -> DataFrame:
    """One row for each conversation, from its examples alone: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_examples.

    formatted_chars counts the code points of the conversation's longest example, expanded_chars those of all.
    """
    loss = unescape(F.substring("formatted", F.col("loss_start"), F.col("loss_chars")))
    # a turn's part: role, a line break, text; the last part is what follows the last mark, a line break
    parts = F.filter(F.split("formatted", r"\Q" + END + r"\E\n"), lambda p: p != "")
    plain = F.transform(parts, lambda p: F.substring(p, F.lit(len(START) + 1), F.length(p)))
    turn = F.transform(plain, lambda p: F.concat(unescape(F.replace(F.substring_index(p, "\n", 1), F.lit("&nl;"), F.lit("\n"))), F.lit("\n"), unescape(F.substring(p, F.locate("\n", p) + 1, F.length(p))), F.lit("\n")))
    rows = examples.select("conv_id", F.struct("example", loss.alias("loss")).alias("l"), F.length("formatted").cast("long").alias("chars"), F.when(F.col("last"), F.size(parts)).alias("n_turns"), F.when(F.col("last"), F.sha2(F.array_join(turn, ""), 256)).alias("turns_sha256"))
    found = rows.groupBy("conv_id").agg(F.max("n_turns").cast("long").alias("n_turns"), F.max("turns_sha256").alias("turns_sha256"), F.array_sort(F.collect_list("l")).alias("l"), F.max("chars").alias("formatted_chars"), F.sum("chars").alias("expanded_chars"), F.count("*").alias("n_examples"))
    trained = F.array_join(F.transform("l", lambda x: x["loss"]), "")
    return found.select("conv_id", "n_turns", "turns_sha256", F.length(trained).cast("long").alias("loss_chars"), F.sha2(trained, 256).alias("loss_sha256"), "formatted_chars", "expanded_chars", "n_examples")
