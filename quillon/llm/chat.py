"""Operator 9: event-sourced reconstruction of conversations, and their chat format.

A log has events ``(conv_id, seq, kind, turn, role, text)``. Kinds: ``message`` (a whole
message), ``delta`` (a streamed piece, appended), ``edit`` (replaces a turn's text),
``regenerate`` (begins a turn anew and discards every later turn that came before it).
The log is partitioned by conversation once; sorting, folding and rendering all happen in
that partitioning, in built-in expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm._frames import pick

RESETS = ("message", "edit", "regenerate")


def fold(events: DataFrame, conv_col: str = "conv_id", seq_col: str = "seq", kind_col: str = "kind", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Final messages ``conv_id, turn, role, text`` of a log, in no order.

    Of a turn, the last ``message``, ``edit`` or ``regenerate`` counts (of several at one
    ``seq``: the greatest text) and the deltas after it, by ``seq``, then text. The role is the
    last that isn't null. Exact repeats of an event count once. Events without a
    conversation, a turn or a ``seq`` are dropped, as are unknown kinds; a null kind is
    a ``message``; a null text is an empty one. Texts of any length are kept whole, other columns are
    dropped, and an empty log gives an empty result.
    """
    log = pick(events, conv_id=conv_col, seq=seq_col, kind=kind_col, turn=turn_col, role=role_col, text=text_col)
    log = log.withColumn("kind", F.coalesce("kind", F.lit("message"))).withColumn("text", F.coalesce("text", F.lit("")))
    log = log.where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull() & F.col("seq").isNotNull() & F.col("kind").isin(*RESETS, "delta"))
    log = log.repartition("conv_id").dropDuplicates()
    earlier = Window.partitionBy("conv_id").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    log = log.withColumn("rewind", F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).over(earlier))
    log = log.where(F.col("rewind").isNull() | (F.col("seq") > F.col("rewind")))
    turn = Window.partitionBy("conv_id", "turn")
    reset = F.max(F.when(F.col("kind").isin(*RESETS), F.struct("seq", "text"))).over(turn)
    log = log.withColumn("reset", reset)
    pieces = F.when((F.col("kind") == "delta") & (F.col("reset").isNull() | (F.col("seq") > F.col("reset.seq"))), F.struct("seq", "text"))
    return log.groupBy("conv_id", "turn").agg(
        F.max_by("role", F.when(F.col("role").isNotNull(), F.struct("seq", "role"))).alias("role"),
        F.concat(F.coalesce(F.first("reset.text"), F.lit("")), F.array_join(F.transform(F.array_sort(F.collect_list(pieces)), lambda p: p["text"]), "")).alias("text"),
    )


def render(messages: DataFrame) -> DataFrame:
    """``conv_id, n_messages INT, rendered``: messages in turn order as ``<|role|>\\ntext<|end|>\\n``; a null role is ``unknown``."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("unknown")).alias("role"), "text"))), lambda m: F.concat(F.lit("<|"), m["role"], F.lit("|>\n"), m["text"], F.lit("<|end|>\n")))
    return messages.groupBy("conv_id").agg(F.count("*").cast("int").alias("n_messages"), F.array_join(parts, "").alias("rendered"))


def format_conversations(df: DataFrame) -> DataFrame:
    """``render(fold(df))``. A table without ``kind`` has whole messages, one without ``seq`` is in turn order."""
    have = {c: c for c in ("conv_id", "seq", "kind", "turn", "role", "text") if c in df.columns}
    own = pick(df, **have)
    for name, value in (("kind", F.lit("message")), ("seq", F.col("turn"))):
        if name not in have:
            own = own.withColumn(name, value)
    return render(fold(own))
