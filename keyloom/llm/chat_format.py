"""Chat formatting with a grammar round trip, in DataFrame functions alone.

A conversation is rendered as turns `<|im_start|>role LF text<|im_end|> LF`. A deterministic parser reads the
rendering back: it cuts at `<|im_start|>`, takes the role up to the first line feed and the text up to the closing
`<|im_end|> LF`, and undoes escapes. Where the turns recovered differ from the source, or a field holds `<|`, the fields that
conflict are escaped and the conversation is rendered and parsed again; what comes back then is the source, as escaping leaves
no control string and is undone exactly:

* `<`, backslashes, `|` gets one backslash more, in texts and roles;
* in a role, `%` becomes `%25` and a line feed `%0A`.

A field conflicts when undoing escapes changes it, or when it holds `<|`, or, for a role, a line feed or `%`.

Defined cases: null texts and roles are empty; a null conv_id is a conversation of its own; turns come by
(turn, role, text), nulls first, and repeated rows stay; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\|", r"<\\$1|")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"<\\(\\*)\|", r"<$1|")


def _escape_role(c: Column) -> Column:
    return escape(F.replace(F.replace(c, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def _unescape_role(c: Column) -> Column:
    return F.replace(F.replace(unescape(c), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def render(turns: Column) -> Column:
    """turns: array of (role, text), escaped as far as need be."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(START), t["role"], F.lit("\n"), t["text"], F.lit(END + "\n"))), "")


def parse(formatted: Column) -> Column:
    """The turns of a rendering as array of (role, text); null in place of a turn that breaks the grammar."""

    def turn(part):
        cut, closing = F.instr(part, "\n"), len(END) + 1
        whole = (cut > 0) & F.endswith(part, F.lit(END + "\n")) & (F.length(part) - cut >= closing)
        text = F.substr(part, cut + 1, F.length(part) - cut - closing)
        return F.when(whole & (F.instr(text, END) == 0), F.struct(_unescape_role(F.substr(part, F.lit(1), cut - 1)).alias("role"), unescape(text).alias("text")))

    parts = F.split(formatted, r"<\|im_start\|>", -1)
    return F.when(formatted == "", F.array().cast("array<struct<role:string,text:string>>")).otherwise(F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), turn))


def _escaped(turns: Column) -> Column:
    """Fields that conflict are escaped; the others stay as they are."""

    def turn(t):
        text, role = t["text"], t["role"]
        clean = (unescape(text) == text) & (F.instr(text, "<|") == 0)
        plain = (_unescape_role(role) == role) & (F.instr(role, "<|") == 0) & (F.instr(role, "\n") == 0) & (F.instr(role, "%") == 0)
        return F.struct(F.when(plain, role).otherwise(_escape_role(role)).alias("role"), F.when(clean, text).otherwise(escape(text)).alias("text"))

    return F.transform(turns, turn)


def _open(t):
    """Whether a field holds what may begin a control string."""
    return (F.instr(t["text"], "<|") > 0) | (F.instr(t["role"], "<|") > 0)


def format_chats(conversations: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, escaped (whether any field was), turns (read back), loss_text, round_trip.

    loss_text is what lies under the loss mask, unescaped: the texts of the loss role's turns, in order.
    """
    fields = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    source = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(fields)).alias("rows"))
    source = source.select("conv_id", F.transform("rows", lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text"))).alias("source"))
    drawn = source.withColumn("first", render(F.col("source"))).withColumn("escaped", ~F.coalesce(parse(F.col("first")) == F.col("source"), F.lit(False)) | F.exists("source", _open))
    drawn = drawn.withColumn("formatted", F.when(F.col("escaped"), render(_escaped(F.col("source")))).otherwise(F.col("first")))
    read = drawn.withColumn("turns", parse(F.col("formatted")))
    return read.select("conv_id", "formatted", "escaped", "turns", F.array_join(F.transform(F.filter("turns", lambda t: t["role"] == loss_role), lambda t: t["text"]), "").alias("loss_text"), (F.col("turns") == F.col("source")).alias("round_trip"))
