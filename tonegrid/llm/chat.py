"""Chat formatting in budgeted windows (operator 4), DataFrame functions only.

A conversation becomes one or more training windows of at most ``budget``
tokens. Prefix sums of turn tokens choose turn-aligned spans: a window takes
new turns while they fit. Every window starts with the system turn (if the
conversation opens with one) and repeats a limited history of the turns just
before; repeated turns are masked, so each assistant text carries loss once.

Template (fixed values): ``<|im_start|>role<|im_sep|>text<|im_end|>\\n``. Inside
roles and texts a backslash follows every backslash and the first character of
every control string (``<|…``, ``<s>``, ``</s>``, ``[INST]``, ``[/INST]``,
``<<SYS>>``, ``<</SYS>>``); dropping the backslash after ``\\``, ``<`` and ``[``
gives the text back.

Tokens of a turn are a column of the input (``tokens``: counts of whichever
vocabulary, for instance those that operator 1 counts, joined by turn) plus
``TURN_TOKENS`` for the marks of a turn. Without such a column they are estimated
natively, as letter runs, digits and symbol runs.

Plan: one shuffle by conversation; a running sum, then the turns of a
conversation as one array (a conversation is one training text, so it is the
unit that must fit a row, and the unit of a task); windows and spans are
higher-order functions.

Cases: null roles and texts are empty; turns are ordered by turn number (null
first), then role and text, so ties and repeated rows are kept in a fixed
order; very long turns are kept whole: a turn over the budget stands alone in a
window; a null token count is estimated; a null conv_id is a conversation of its
own; an empty table gives no windows; other columns are ignored, whatever their
names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, SEP, CLOSE = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
BUDGET, HISTORY_TOKENS, HISTORY_TURNS, TURN_TOKENS = 1024, 256, 4, 4

_TOKEN = r"\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
_CONTROL = r"(\\|<(?=\||/?s>|</?SYS>>)|\[(?=/?INST\]))"
_ESCAPED = r"([\\<\[])\\"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, "$1\\\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1")


def _spans(budget: int, history_tokens: int, history_turns: int) -> str:
    """SQL: greedy window starts over turn numbers f … n-1, with the first turn of the repeated history.

    p holds prefix sums: p[k] tokens lie before turn k.
    """
    room = f"least({history_tokens}L, {budget}L - system_tokens - (p[i + 1] - p[i]))"
    history = f"coalesce(array_min(filter(sequence(greatest(f, i - {history_turns}), i), k -> p[i] - p[k] <= {room})), i)"
    fresh = f"named_struct('w', concat(a.w, array(named_struct('s', i, 'h', {history}))), 'used', system_tokens + p[i + 1] - p[{history}])"
    same = "named_struct('w', a.w, 'used', a.used + p[i + 1] - p[i])"
    fits = f"size(a.w) > 0 and a.used + p[i + 1] - p[i] <= {budget}L"
    start = "named_struct('w', cast(array() as array<struct<s:int,h:int>>), 'used', 0L)"
    greedy = f"aggregate(sequence(f, n - 1), {start}, (a, i) -> if({fits}, {same}, {fresh})).w"
    return f"if(n > f, {greedy}, array(named_struct('s', f, 'h', f)))"


def format_windows(
    conversations: DataFrame,
    key: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    budget: int = BUDGET,
    history_tokens: int = HISTORY_TOKENS,
    history_turns: int = HISTORY_TURNS,
    tokens: str | None = None,
) -> DataFrame:
    """(conv_id, window, first_turn, n_repeated, n_tokens, formatted, loss_spans) of every conversation.

    ``loss_spans``: (start, length) in code points of ``formatted``;
    ``n_repeated``: leading turns that an earlier window has already shown.
    """
    counted = conversations[tokens].cast("long") if tokens else F.lit(None).cast("long")
    turns = conversations.select(
        conversations[key].alias("conv_id"),
        conversations[turn].alias("turn"),
        F.coalesce(conversations[role].cast("string"), F.lit("")).alias("role"),
        F.coalesce(conversations[text].cast("string"), F.lit("")).alias("text"),
        counted.alias("tokens"),
    ).withColumn("tokens", F.coalesce("tokens", F.regexp_count("text", F.lit(_TOKEN)).cast("long")) + TURN_TOKENS)
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = turns.select("*", F.row_number().over(order).alias("k"), F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("upto"))
    gathered = numbered.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("k", "role", "text", "upto"))).alias("turns"))
    measured = gathered.select("conv_id", "turns", F.size("turns").alias("n"), F.concat(F.array(F.lit(0).cast("long")), F.transform("turns", lambda t: t["upto"])).alias("p"), F.expr("if(turns[0].role = 'system', 1, 0)").alias("f"))
    windows = measured.withColumn("system_tokens", F.expr("p[f]")).withColumn("w", F.expr(_spans(budget, history_tokens, history_turns)))
    each = windows.select("conv_id", "turns", "n", "p", "f", "system_tokens", "w", F.posexplode_outer("w").alias("window", "span"))
    each = each.select("*", F.expr("span.s").alias("s"), F.expr("span.h").alias("h"), F.expr("coalesce(try_element_at(w, window + 2).s, n)").alias("e"))
    shown = F.expr(
        "concat(if(f = 1, array(named_struct('role', turns[0].role, 'text', turns[0].text, 'fresh', window = 0)), cast(array() as array<struct<role:string,text:string,fresh:boolean>>)), "
        "if(e > h, transform(sequence(h, e - 1), k -> named_struct('role', turns[k].role, 'text', turns[k].text, 'fresh', k >= s)), cast(array() as array<struct<role:string,text:string,fresh:boolean>>)))"
    )
    marked = each.select("conv_id", "window", F.col("s").alias("first_turn"), F.expr("if(window = 0, 0, f + s - h)").alias("n_repeated"), F.expr("system_tokens + p[e] - p[h]").alias("n_tokens"), shown.alias("shown"))
    pieces = marked.withColumn(
        "pieces",
        F.transform("shown", lambda t: F.struct(F.concat(F.lit(OPEN), escape(t["role"]), F.lit(SEP)).alias("head"), escape(t["text"]).alias("body"), (t["fresh"] & (t["role"] == "assistant")).alias("loss"))),
    )
    loss = F.expr(
        "aggregate(pieces, named_struct('at', 0, 'spans', cast(array() as array<struct<start:int,length:int>>)), "
        f"(a, t) -> named_struct('at', a.at + char_length(t.head) + char_length(t.body) + {len(CLOSE)}, "
        "'spans', if(t.loss, concat(a.spans, array(named_struct('start', a.at + char_length(t.head), 'length', char_length(t.body)))), a.spans))).spans"
    )
    text_of = F.array_join(F.transform("pieces", lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE))), "")
    return pieces.select("conv_id", "window", "first_turn", "n_repeated", "n_tokens", text_of.alias("formatted"), loss.alias("loss_spans"))


def read_windows(windows: DataFrame) -> DataFrame:
    """(conv_id, turns, loss, formatted_chars): role and text of every turn, and the texts under the mask, read from the output alone."""
    parts = F.split("formatted", r"<\|im_end\|>\n")
    fresh = windows.select("conv_id", "window", "formatted", "loss_spans", F.slice(parts, F.col("n_repeated") + 1, F.size(parts) - 1 - F.col("n_repeated")).alias("parts"))
    read = fresh.select(
        "conv_id",
        "window",
        F.transform("parts", lambda t: F.struct(unescape(F.substring_index(t.substr(F.lit(len(OPEN) + 1), F.char_length(t)), SEP, 1)).alias("role"), unescape(F.substring_index(t, SEP, -1)).alias("text"))).alias("turns"),
        F.transform("loss_spans", lambda x: unescape(F.col("formatted").substr(x["start"] + 1, x["length"]))).alias("loss"),
        F.char_length("formatted").cast("long").alias("chars"),
    )
    grouped = read.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("window", "turns", "loss"))).alias("all"), F.sum("chars").alias("formatted_chars"))
    return grouped.select("conv_id", F.flatten(F.transform("all", lambda w: w["turns"])).alias("turns"), F.flatten(F.transform("all", lambda w: w["loss"])).alias("loss"), "formatted_chars")


def digests(windows: DataFrame) -> DataFrame:
    """One row per conversation: counts and hashes of what ``read_windows`` reads back."""
    read = read_windows(windows)
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss", "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"), F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")
