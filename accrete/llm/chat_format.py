"""Chat formatting with a grammar round trip.

Grammar (the control strings are those of CONTROLS; a plus sign after the role says that the turn's texts are escaped):

    conversation = turn*
    turn         = "<s>[INST]" role ["+"] "[/INST]" text "</s>"

A deterministic parser reads it back: up to the next "</s>", role up to the first "[/INST]" after "<s>[INST]". Each turn
is rendered as it is, parsed again, and compared with its source; a turn that comes back otherwise is escaped (a
backslash goes into every control string and before every backslash) and rendered again. A conversation is a sequence
of closed turns, so turns that come back whole do so in sequence too; the whole rendered text is still parsed once more
and must equal its source turns, or the job fails. Rendering, parsing and comparing are row expressions on turns, so a
long conversation is dealt over all tasks; only its rendered text is gathered, as the result asks for it.

Defined results: null texts and roles are empty; turns are ordered by turn (null first), then role and text, and repeated
rows stay repeated; conversations without rows don't exist; a null conv_id is a conversation of its own; texts of any
length are whole. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

OPEN, ROLE_END, CLOSE = "<s>[INST]", "[/INST]", "</s>"
#: What texts may not hold unescaped once a turn is escaped.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]")
ESCAPED = "+"
TRAINED_ROLE = "assistant"


def escape(text: Column) -> Column:
    """Reversible: no control string is left, as each has a backslash after its first character."""
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), r"([<\[])(?=/?s>|/?INST\])", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def render_turn(role: Column, text: Column, escaped: bool) -> Column:
    if escaped:
        return F.concat(F.lit(OPEN), escape(role), F.lit(ESCAPED + ROLE_END), escape(text), F.lit(CLOSE))
    return F.concat(F.lit(OPEN), role, F.lit(ROLE_END), text, F.lit(CLOSE))


def parse(rendered: Column) -> Column:
    """The turns of a rendered text: array of role, text and body (the text as rendered). Null if it isn't in the grammar."""
    closed = F.split(rendered, CLOSE)
    parts = F.slice(closed, 1, F.size(closed) - 1)

    def turn(part):
        inner = F.substr(part, F.lit(len(OPEN) + 1))
        head = F.substring_index(inner, ROLE_END, 1)
        body = F.substr(inner, F.length(head) + len(ROLE_END) + 1)
        escaped = F.endswith(head, F.lit(ESCAPED))
        bare = F.substr(head, F.lit(1), F.length(head) - 1)
        return F.struct(F.when(escaped, unescape(bare)).otherwise(head).alias("role"), F.when(escaped, unescape(body)).otherwise(body).alias("text"), body.alias("body"))

    well = F.forall(parts, lambda p: F.startswith(p, F.lit(OPEN)) & F.contains(F.substr(p, F.lit(len(OPEN) + 1)), F.lit(ROLE_END)))
    return F.when(well & (F.element_at(closed, -1) == ""), F.transform(parts, turn))


def masked(formatted: Column, spans: Column) -> Column:
    """The texts under the spans of a rendered text, unescaped."""

    def read(all_bytes: Column, s: Column) -> Column:
        text = F.decode(F.substring(all_bytes, (s["start"] * 4 + 1).cast("int"), ((s["end"] - s["start"]) * 4).cast("int")), "UTF-32")
        return F.when(s["escaped"], unescape(text)).otherwise(text)

    # four bytes a character, so that a span is found at once; the outer array makes the bytes once for all spans
    return F.flatten(F.transform(F.array(F.encode(formatted, "UTF-32")), lambda b: F.transform(spans, lambda s: read(b, s))))


def format_turns(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text) with rendered and escaped, each turn by itself."""
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("_plain", render_turn(F.col("role"), F.col("text"), False)).withColumn("_back", parse(F.col("_plain")))
    source = F.array(F.struct("role", "text"))
    back = F.transform("_back", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    rows = rows.withColumn("escaped", ~F.coalesce(back == source, F.lit(False)))
    return rows.withColumn("rendered", F.when(F.col("escaped"), render_turn(F.col("role"), F.col("text"), True)).otherwise(F.col("_plain"))).drop("_plain", "_back")


def format_chats(turns: DataFrame) -> DataFrame:
    """Per conversation: formatted, turns (role, text, body as read back from it), loss_spans and loss_texts.

    loss_spans: code points start and end (exclusive) in formatted of each text that is trained on, as it is rendered, and
    whether it is escaped there. loss_texts: what formatted holds under these spans, unescaped.
    """
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    rows = format_turns(turns).withColumn("_at", F.coalesce(F.sum(F.length("rendered")).over(before), F.lit(0)))
    head = F.when(F.col("escaped"), F.length(escape(F.col("role"))) + len(ESCAPED)).otherwise(F.length("role")) + len(OPEN) + len(ROLE_END)
    span = F.when(F.col("role") == TRAINED_ROLE, F.struct((F.col("_at") + head).alias("start"), (F.col("_at") + F.length("rendered") - len(CLOSE)).alias("end"), F.col("escaped")))
    each = F.struct("turn", "role", "text", "_at", "rendered", span.alias("span"))
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(each)).alias("_rows"))
    chats = chats.select(
        "conv_id",
        F.transform("_rows", lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text"))).alias("_source"),
        F.array_join(F.transform("_rows", lambda r: r["rendered"]), "").alias("formatted"),
        F.array_compact(F.transform("_rows", lambda r: r["span"])).alias("loss_spans"),
    )
    chats = chats.withColumn("turns", parse(F.col("formatted"))).withColumn("loss_texts", masked(F.col("formatted"), F.col("loss_spans")))
    same = F.coalesce(F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))) == F.col("_source"), F.lit(False))
    return chats.withColumn("turns", F.when(same, F.col("turns")).otherwise(F.raise_error(F.lit("a formatted conversation doesn't parse back to its turns")))).drop("_source")
