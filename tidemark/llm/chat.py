"""Chat formatting with a grammar round trip, in DataFrame functions only.

    conversation = "<s>" ["\\"] turn*          turn = "[INST]" role "[/INST]" text "</s>"

A conversation is rendered as it is, read back by the parser, and compared with its source. If they differ, some
content reads as control text: it is rendered again one level up, with escapes, until both are identical. Level 1
marks the conversation with a backslash, doubles backslashes and puts one after the first character of each
control string. No control string is left in it then, and none arises where a text meets a mark, since each begins
with a bracket and has no other, so level 1 reads back whatever it is given; that is checked all the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEAD, OPEN, MID, CLOSE, MARK = "<s>", "[INST]", "[/INST]", "</s>", "\\"
LEVELS = (0, 1)
_CONTROL = r"(<|\[)(?=s>|/s>|INST\]|/INST\])"


def _escape(text: Column, level: int) -> Column:
    return text if level == 0 else F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), _CONTROL, r"$1\\")


def _unescape(text: Column, level: int) -> Column:
    return text if level == 0 else F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _turn(role: Column, text: Column, level: int) -> Column:
    return F.concat(F.lit(OPEN), _escape(role, level), F.lit(MID), _escape(text, level), F.lit(CLOSE))


def parse(rendered: Column, level: int) -> Column:
    """Array of (role, text) that a rendered conversation of a level holds."""
    body = F.substring(rendered, len(HEAD) + 1 + (level > 0), 2**31 - 1)
    turns = F.split(body, CLOSE)
    grammar = r"(?s)^\[INST\](.*?)\[/INST\](.*)$"
    return F.transform(
        F.slice(turns, 1, F.size(turns) - 1),
        lambda x: F.struct(_unescape(F.regexp_extract(x, grammar, 1), level).alias("role"), _unescape(F.regexp_extract(x, grammar, 2), level).alias("text")),
    )


def format_chat(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", train_on: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, level, turns (role, text as read back), loss (the spans to train on).

    Rows follow ``turn``; ties follow role, then text, and repeated rows are turns of their own. A null role or
    text counts as empty; a null turn comes first; null ids form one conversation. Texts and roles may be of any
    length and content. ``loss`` has the spans of ``formatted`` that hold the texts of ``train_on``, escapes included:
    start and length in code points, byte_start and byte_length in UTF-8. Other columns are ignored. No rows give no
    rows. A whole conversation is one string, so the longest must fit in a task.
    """
    source = turns.select(
        F.col(conv).alias("conv_id"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    row = source.select(
        "*",
        *(_turn(F.col("role"), F.col("text"), k).alias(f"turn_{k}") for k in LEVELS),
        *(_escape(F.col("text"), k).alias(f"text_{k}") for k in LEVELS),
    )
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    row = row.withColumns({f"{name}_{k}": F.sum(size(f"turn_{k}")).over(before) for k in LEVELS for name, size in (("end", F.length), ("byte_end", F.octet_length))})

    def span(k: int) -> Column:
        lead = len(HEAD) + (k > 0) - len(CLOSE)
        size, octets = F.length(f"text_{k}"), F.octet_length(f"text_{k}")
        fields = {"start": F.col(f"end_{k}") + lead - size, "length": size, "byte_start": F.col(f"byte_end_{k}") + lead - octets, "byte_length": octets}
        return F.struct(*[c.cast("long").alias(n) for n, c in fields.items()]).alias(f"span_{k}")

    row = row.select("conv_id", F.struct("end_0", "role", "text", "turn_0", "turn_1", *(span(k) for k in LEVELS)).alias("x"))
    held = row.groupBy("conv_id").agg(F.array_sort(F.collect_list("x")).alias("held"))
    held = held.select("conv_id", "held", F.transform("held", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("source"))
    now = held.select("*", *(F.lit(None).cast(t).alias(c) for c, t in (("formatted", "string"), ("level", "int"))), F.col("source").alias("turns"))

    def rendered(k: int) -> Column:
        return F.concat(F.lit(HEAD + MARK[: k > 0]), F.array_join(F.transform("held", lambda x: x[f"turn_{k}"]), ""))

    for k in LEVELS:
        now = now.withColumn("formatted", F.when(F.col("level").isNull(), rendered(k)).otherwise(F.col("formatted")))
        now = now.withColumn("turns", F.when(F.col("level").isNull(), parse(F.col("formatted"), k)).otherwise(F.col("turns")))
        now = now.withColumn("level", F.when(F.col("level").isNull() & (F.col("turns") == F.col("source")), k).otherwise(F.col("level")))
    masked = F.filter("held", lambda x: x["role"] == train_on)
    loss = F.when(F.col("level") == 0, F.transform(masked, lambda x: x["span_0"])).otherwise(F.transform(masked, lambda x: x["span_1"]))
    wrong = F.raise_error(F.concat(F.lit("no level of escapes reads back conversation "), F.col("conv_id").cast("string")))
    return now.select("conv_id", "formatted", F.when(F.col("level").isNull(), wrong).otherwise(F.col("level")).cast("int").alias("level"), "turns", loss.alias("loss"))


def masked_text(formatted: Column, level: Column, loss: Column) -> Column:
    """All text under the loss mask, cut out of ``formatted`` by its byte spans, without escapes."""

    def plain(piece: Column) -> Column:
        return F.when(level == 0, piece).otherwise(_unescape(piece, 1))

    # the bytes are taken once for a row, and a span of bytes is cut without counting characters
    pieces = F.transform(
        F.array(formatted.cast("binary")),
        lambda b: F.array_join(F.transform(loss, lambda s: plain(F.substring(b, s["byte_start"].cast("int") + 1, s["byte_length"].cast("int")).cast("string"))), ""),
    )
    return F.element_at(pieces, 1)


def digests(formatted: DataFrame) -> DataFrame:
    """The figures of the contract, all from what was read back out of ``formatted``: its turns and its loss mask."""
    turns = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    read = formatted.select("conv_id", "formatted", "turns", masked_text(F.col("formatted"), F.col("level"), F.col("loss")).alias("masked"))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length("masked").cast("long").alias("loss_chars"),
        F.sha2("masked", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
