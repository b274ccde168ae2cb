"""Chat formatting by event-sourced reconstruction, from DataFrame and SQL functions only.

A log holds events of messages: `start` names the role, `delta` appends text, `edit` replaces the text
so far, `regenerate` drops it. Events are sorted by sequence within their message, so a long
conversation spreads over its messages; only final messages meet by conversation, to be rendered.

The template is <|im_start|>role\\ntext<|im_end|>\\n for each message. In texts, every `<|` (also one that
already has backslashes between the two characters) gets one more backslash there, which reading takes
out again, so no text can hold a control string. Roles are percent-encoded. The loss mask lists the
places (code points, end exclusive) of assistant texts in the formatted string.

Cases: null texts and roles are empty. Events of a message without a start have an empty role. Equal
sequence numbers are ordered by kind, role and text. Repeated conversation rows are separate messages.
Null conv_ids form one conversation, a null turn comes first. An empty log gives an empty result. Extra
columns are ignored.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from staycheck.llm.spans import bound, placed

START, END = "<|im_start|>", "<|im_end|>"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def events(conversations: DataFrame) -> DataFrame:
    """Rows by turn as a log: conv_id, message, seq, kind, role, text."""
    order = W.partitionBy("conv_id", "turn").orderBy("role", "text")
    rows = conversations.select("conv_id", "turn", "role", "text", F.row_number().over(order).alias("n"))
    message = F.struct("turn", "n")
    kinds = F.explode(F.array(F.lit("start"), F.lit("delta")))
    return rows.select("conv_id", message.alias("message"), "role", "text", kinds.alias("kind")).select(
        "conv_id", "message", F.when(F.col("kind") == "start", 0).otherwise(1).alias("seq"), "kind",
        F.when(F.col("kind") == "start", F.col("role")).alias("role"),
        F.when(F.col("kind") == "delta", F.col("text")).alias("text"))


def fold(log: DataFrame) -> DataFrame:
    """conv_id, message, role, text: each message as its events leave it. message is ordered like the
    conversation."""
    event = F.struct("seq", "kind", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    told = log.groupBy("conv_id", "message").agg(F.array_sort(F.collect_list(event)).alias("told"))
    since = "array_max(transform(es, (e, i) -> IF(e.kind IN ('edit', 'regenerate'), i, -1)))"
    kept = bound(since, "since", "transform(filter(es, (e, i) -> i >= since AND e.kind IN ('delta', 'edit')), e -> e.text)")
    starts = F.filter("told", lambda e: e["kind"] == "start")
    return told.select("conv_id", "message", F.coalesce(F.get(starts, F.lit(0))["role"], F.lit("")).alias("role"),
                       F.array_join(F.expr(bound("told", "es", kept)), "").alias("text"))


SPAN = "struct<start: bigint, end: bigint>"
TURN = "struct<start: bigint, role: string, text: string>"


def render(messages: DataFrame) -> DataFrame:
    """conv_id, formatted, mask (array of start, end)."""
    rows = messages.select("conv_id", F.struct(
        "message", F.url_encode("role").alias("role"), escaped(F.col("text")).alias("text")).alias("m"))
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("m")).alias("ms"))
    line = F.transform("ms", lambda m: F.concat(F.lit(START), m["role"], F.lit("\n"), m["text"], F.lit(END + "\n")))
    begin = f"at + {len(START) + 1} + length(x.role)"
    spans = placed("ms", f"{len(START) + len(END) + 2} + length(x.role) + length(x.text)",
                   f"named_struct('role', x.role, 'start', {begin}, 'end', {begin} + length(x.text))",
                   "struct<role: string, start: bigint, end: bigint>")
    mask = f"transform(filter({spans}, x -> x.role = 'assistant'), x -> named_struct('start', x.start, 'end', x.end))"
    return whole.select("conv_id", F.array_join(line, "").alias("formatted"), F.expr(f"cast({mask} AS array<{SPAN}>)").alias("mask"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, formatted, turns (array of start, role, text, under_mask), from formatted and mask alone.

    Marks of the mask and turns are sorted together by place: a turn is under the mask if a mark stands
    right before it."""
    parts = "slice(split(formatted, r'<\\|im_start\\|>'), 2, 1000000000)"
    text = f"substring(p, length(substring_index(p, '\\n', 1)) + 2, length(p) - length(substring_index(p, '\\n', 1)) - {len(END) + 2})"
    turns = placed(f"transform({parts}, p -> named_struct('role', substring_index(p, '\\n', 1), 'text', {text}))",
                   f"{len(START) + len(END) + 2} + length(x.role) + length(x.text)",
                   f"named_struct('start', at + {len(START) + 1} + length(x.role), 'role', x.role, 'text', x.text)", TURN)
    both = (f"array_sort(concat(transform(mask, k -> struct(k.start, 0 AS is_turn, '' AS role, '' AS text)), "
            f"transform({turns}, t -> struct(t.start, 1 AS is_turn, t.role, t.text))))")
    told = ("filter(transform(all, (x, i) -> struct(x.start, x.is_turn, x.role, x.text, coalesce(get(all, i - 1).is_turn = 0 "
            "AND get(all, i - 1).start = x.start, false) AS under_mask)), x -> x.is_turn = 1)")
    return formatted.select("conv_id", "formatted", F.transform(F.expr(bound(both, "all", told)), lambda p: F.struct(
        p["start"].alias("start"), F.url_decode(p["role"]).alias("role"), unescaped(p["text"]).alias("text"),
        p["under_mask"].alias("under_mask"))).alias("turns"))


def format_conversations(conversations: DataFrame) -> DataFrame:
    return render(fold(events(conversations)))
