"""Chat formatting with a grammar round trip (DataFrame functions only).

A conversation is rendered as, for each turn in order:

    ### <role>: <text></turn>\\n

and a reader takes a conversation apart again with two rules: `</turn>\\n` ends a turn, the first
`: ` after `### ` ends its role. A backslash in a field starts a two-character code:

    \\b backslash    \\l <    \\h #    \\n new line    \\c :

A field is first rendered as it is. If the reader does not give it back, it is written again with
codes, where nothing of the grammar is left in the field, so the second reading always agrees.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, MIDDLE, CLOSE = "### ", ": ", "</turn>\n"
#: Character and code; the backslash comes first when writing and last when reading.
CODES = (("\\", "\\b"), ("<", "\\l"), ("#", "\\h"), ("\n", "\\n"), (":", "\\c"))


def _swap(value: Column, pairs) -> Column:
    for old, new in pairs:
        value = F.replace(value, F.lit(old), F.lit(new))
    return value


def escape(value: Column, role: bool = False) -> Column:
    return _swap(value, CODES if role else CODES[:3])


def unescape(value: Column) -> Column:
    return _swap(value, [(code, char) for char, code in reversed(CODES)])


def read_role(turn: Column) -> Column:
    """The role of one rendered turn (without its end mark), as the reader finds it."""
    return unescape(F.substring_index(F.substring(turn, len(OPEN) + 1, 2**30), MIDDLE, 1))


def read_text(turn: Column) -> Column:
    begin = F.locate(MIDDLE, turn, len(OPEN) + 1) + len(MIDDLE)
    return unescape(turn.substr(begin, F.lit(2**30)))


def parse(formatted: Column) -> Column:
    """array<struct<role, text>> of a rendered conversation."""
    turns = F.split(formatted, "</turn>\n")
    return F.transform(F.slice(turns, 1, F.size(turns) - 1), lambda t: F.struct(read_role(t).alias("role"), read_text(t).alias("text")))


def render_turn(role: Column, text: Column) -> Column:
    """One turn as it is if the reader gives it back, else with codes."""
    def written(r, t):
        return F.concat(F.lit(OPEN), r, F.lit(MIDDLE), t)

    plain = written(role, text)
    alone = ~F.contains(F.concat(plain, F.lit(CLOSE[:-1])), F.lit("\\")) & (F.locate(CLOSE[:-1], plain) == 0)
    back = alone & (read_role(plain) == role) & (read_text(plain) == text)
    return F.concat(F.when(back, plain).otherwise(written(escape(role, True), escape(text))), F.lit(CLOSE))


def format_conversations(rows: DataFrame, learn_role: str = "assistant") -> DataFrame:
    """conv_id, n_turns, formatted, loss (spans [start, end) of learnt text in code points), parsed, verified.

    Turns are ordered by (turn, role, text), null turns first, so repeated rows have a fixed place.
    Null role or text counts as empty. All turns of a conversation meet in one row, as its text is one
    value; turns are gathered before the shuffle. An empty table gives no rows, other columns are ignored.
    A conversation whose reading differs from its source raises an error.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    turn = F.struct(F.col("turn"), role.alias("role"), text.alias("text"), render_turn(role, text).alias("shown"))
    talks = rows.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    out = talks.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("source"), F.array_join(F.col("turns.shown"), "").alias("formatted"))
    out = out.withColumn("parsed", parse(F.col("formatted")))
    out = out.withColumn("verified", F.when(F.col("parsed") == F.col("source"), True).otherwise(F.raise_error(F.concat(F.lit("conversation does not read back: "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null")))).cast("boolean")))
    pieces = F.split("formatted", "</turn>\n")
    spans = F.aggregate(
        F.slice(pieces, 1, F.size(pieces) - 1), F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans")),
        lambda acc, t: F.struct(
            (acc["at"] + F.length(t) + len(CLOSE)).alias("at"),
            F.when(read_role(t) == learn_role, F.concat(acc["spans"], F.array(F.struct((acc["at"] + F.locate(MIDDLE, t, len(OPEN) + 1) + len(MIDDLE) - 1).alias("start"), (acc["at"] + F.length(t)).alias("end"))))).otherwise(acc["spans"]).alias("spans")),
        lambda acc: acc["spans"])
    return out.select("conv_id", F.size("parsed").cast("long").alias("n_turns"), "formatted", spans.alias("loss"), "parsed", "verified")
