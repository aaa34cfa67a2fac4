"""Chat formatting by event-sourced reconstruction, with DataFrame functions only.

The log has one row per event: ``conv_id``, ``seq`` and ``step`` (its place in the conversation), ``msg_id``, ``kind``, ``role``, ``text``.
``open`` starts a message in a role (its text, if any, comes first), ``delta`` appends text, ``edit`` replaces all text so
far, ``regenerate`` drops it. A message stands where its first event stands. The log is partitioned by conversation and
message, sorted by sequence and folded. Folding is associative (a run of events either replaces what came before or
appends to it), so it is done in two steps: runs of ``BLOCK`` sequence numbers, then the runs of a message; and so is
rendering: runs of messages, then the runs of a conversation. A hot conversation or message is spread over its runs.

Template: ``<|im_start|>role<|im_sep|>text<|im_end|>`` and a line feed for each turn. Inside roles and texts every backslash
is doubled, and a backslash is put after the first character of every control string, so nothing inside a text reads as
control; ``unescape`` is the exact inverse. The output keeps its segments, each with its loss flag: assistant texts
alone bear loss.

Defined results: a null role or text is empty; a null conversation id is a conversation; a null sequence number comes
first; an event that is logged again with all columns equal counts once; events of equal place are folded in the
order of kind, role and text, messages of equal place are rendered in the order of role and text; ``copies`` above one renders a
message that often; an empty log gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Strings that chat templates in use give a meaning.
CONTROL = ["<|im_start|>", "<|im_sep|>", "<|im_end|>", "<|endoftext|>", "<|eot_id|>", "<|start_header_id|>", "<|end_header_id|>",
           "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
BLOCK = 256


def _literal(text: str) -> str:
    return "\\Q" + text + "\\E"


def escape(text: Column) -> Column:
    """No control string is left, and ``unescape`` gives the text again."""
    heads = "|".join(f"(?:{_literal(c[0])})(?={_literal(c[1:])})" for c in CONTROL)
    return F.regexp_replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\")), heads, "$0\\\\")


def unescape(text: Column) -> Column:
    """A doubled backslash is one, a single one is none."""
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def reconstruct(events: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv_id, at, msg_id, role, text, copies) of the final messages; ``at``: struct of sequence and step."""
    has_copies = "copies" in events.columns
    event = F.struct("seq", "step", "kind", "role", "text", (F.col("copies") if has_copies else F.lit(1)).cast("int").alias("copies"))
    runs = (events.groupBy("conv_id", "msg_id", F.floor(F.col("seq") / block).alias("run"), F.floor(F.col("step") / block).alias("part"))
            .agg(F.array_sort(F.collect_set(event)).alias("ev")))
    folded = runs.selectExpr(
        "conv_id", "msg_id", "named_struct('seq', ev[0].seq, 'step', ev[0].step) AS at",
        "aggregate(sequence(1, size(ev)), 0, (a, i) -> if(ev[i - 1].kind <> 'delta', i, a)) AS last", "ev")
    folded = folded.selectExpr(
        "conv_id", "msg_id", "at", "last > 0 AS resets",
        "array_join(transform(slice(ev, greatest(last, 1), size(ev)), e -> if(e.kind = 'regenerate', '', coalesce(e.text, ''))), '') AS text",
        "try_element_at(filter(ev, e -> e.kind = 'open'), 1).role AS role", "try_element_at(filter(ev, e -> e.kind = 'open'), 1).copies AS copies")
    whole = folded.groupBy("conv_id", "msg_id").agg(F.array_sort(F.collect_list(F.struct("at", "resets", "text", "role", "copies"))).alias("r"))
    whole = whole.selectExpr("conv_id", "msg_id", "r[0].at AS at", "aggregate(sequence(1, size(r)), 0, (a, i) -> if(r[i - 1].resets, i, a)) AS last", "r")
    return whole.selectExpr(
        "conv_id", "msg_id", "at", "array_join(transform(slice(r, greatest(last, 1), size(r)), e -> e.text), '') AS text",
        "coalesce(try_element_at(filter(r, e -> e.role IS NOT NULL), 1).role, '') AS role", "coalesce(try_element_at(filter(r, e -> e.copies IS NOT NULL), 1).copies, 1) AS copies")


def render(messages: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv_id, formatted, segments array<struct<text, loss>>) of every conversation."""
    def segment(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    no = F.lit(False)
    turn = F.array(segment(F.concat(F.lit(START), escape(F.col("role")), F.lit(SEP)), no), segment(escape(F.col("text")), F.col("role") == "assistant"), segment(F.lit(END), no))
    rows = messages.select("conv_id", "at", "role", "text", "msg_id", F.flatten(F.array_repeat(turn, F.col("copies"))).alias("turn"))
    runs = (rows.groupBy("conv_id", F.floor(F.col("at.seq") / block).alias("run"), F.floor(F.col("at.step") / block).alias("part"))
            .agg(F.array_sort(F.collect_list(F.struct("at", "role", "text", "msg_id", "turn"))).alias("m")))
    runs = runs.selectExpr("conv_id", "m[0].at AS at", "flatten(transform(m, x -> x.turn)) AS segments")
    whole = runs.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("at", "segments"))).alias("r")).selectExpr("conv_id", "flatten(transform(r, x -> x.segments)) AS segments")
    return whole.selectExpr("conv_id", "array_join(transform(segments, s -> s.text), '') AS formatted", "segments")


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation: array<struct<role, text>>."""
    turns = F.split(formatted, _literal(END), -1)
    pattern = "(?s)^" + _literal(START) + "(.*?)" + _literal(SEP) + "(.*)$"
    return F.transform(F.slice(turns, F.lit(1), F.size(turns) - 1), lambda t: F.struct(
        unescape(F.regexp_extract(t, pattern, 1)).alias("role"), unescape(F.regexp_extract(t, pattern, 2)).alias("text")))


def log_of_rows(rows: DataFrame, chunk: int = 512) -> DataFrame:
    """An event log of finished turns (conv_id, turn, role, text): each opens its message and streams its text in deltas."""
    turns = rows.select("conv_id", "turn", "role", "text").groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies"))
    pieces = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"(?s).{{1,{chunk}}}"), F.lit(0))
    opened = F.struct(F.lit("open").alias("kind"), F.lit(None).cast("string").alias("text"))
    events = F.concat(F.array(opened), F.transform(pieces, lambda p: F.struct(F.lit("delta").alias("kind"), p.alias("text"))))
    message = F.concat_ws("\x1f", *[F.coalesce(F.md5(F.col(c).cast("binary")), F.lit("-")) for c in ("role", "text")], F.coalesce(F.col("turn").cast("string"), F.lit("-")))
    return turns.select("conv_id", F.col("turn").cast("long").alias("seq"), message.alias("msg_id"), "role", "copies", F.posexplode(events).alias("step", "e")).select(
        "conv_id", "seq", "step", "msg_id", "e.kind", "role", "e.text", "copies")
