"""Chat formatting (operator 4), in DataFrame functions only.

A finite-state machine over roles validates the order of turns; a declarative template turns each conversation into text
segments with a loss flag each.  Control characters inside texts and roles are escaped reversibly, so that the template's
marks never occur in them: the escape character becomes two of them, and the first character of every mark
becomes escape + code; no text keeps that character, and splitting at marks and undoing the escapes gives the turns back.

Defined results: null texts and roles are empty; turns are ordered by (turn, role, text), nulls first, so ties and repeated
rows have one order; a null conversation id is a conversation of its own; an empty table gives an empty result; extra
columns are ignored.  A conversation's turns meet in one row, because its text is one value: its formatted text must stay below the
2 GB that one value may hold.  Conversations are dealt apart.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Marks around roles and texts.  Every mark starts with `control`, the only character besides `escape` to be escaped."""

    control: str = "<"
    escape: str = "\\"
    code: str = "l"
    before_role: str = "<turn>"
    before_text: str = "<text>"
    after_text: str = "</turn>"
    loss_roles: tuple[str, ...] = ("assistant",)
    #: The machine: state -> role -> next state; a role that a state lacks leads to "invalid", which stays.
    machine: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            "start": {"system": "asked", "user": "user"},
            "asked": {"user": "user"},
            "user": {"assistant": "assistant"},
            "assistant": {"user": "user", "tool": "tool"},
            "tool": {"assistant": "assistant"},
        }
    )
    accepting: tuple[str, ...] = ("assistant",)

    def __post_init__(self) -> None:
        marks = (self.before_role, self.before_text, self.after_text)
        if len(set(marks)) < 3 or any(not m.startswith(self.control) or self.control in m[1:] for m in marks):
            raise ValueError("marks must differ and hold the control character at their start only")
        if len({self.control, self.escape, self.code}) < 3 or any(len(c) != 1 for c in (self.control, self.escape, self.code)):
            raise ValueError("control, escape and code must be three characters")


def escaped(text: Column, t: Template) -> Column:
    return F.replace(F.replace(text, F.lit(t.escape), F.lit(t.escape * 2)), F.lit(t.control), F.lit(t.escape + t.code))


def _split(text: Column, mark: str) -> Column:
    return F.split(text, r"\Q" + mark + r"\E", -1)


def unescaped(text: Column, t: Template) -> Column:
    """Pairs of the escape character stand for one; between them, escape + code stands for the control character."""
    return F.array_join(F.transform(_split(text, t.escape * 2), lambda x: F.replace(x, F.lit(t.escape + t.code), F.lit(t.control))), t.escape)


def final_state(roles: Column, t: Template) -> Column:
    """The machine's state after all roles."""
    moves = F.create_map(*(F.lit(x) for state, to in t.machine.items() for role, end in to.items() for x in (f"{state}\n{role}", end)))
    step = lambda state, role: F.coalesce(F.try_element_at(moves, F.concat(state, F.lit("\n"), role)), F.lit("invalid"))
    return F.aggregate(roles, F.lit("start"), step)


def format_conversations(df: DataFrame, template: Template = Template()) -> DataFrame:
    """(conv_id, n_turns, valid, segments, formatted): segments are (text, loss, start), in order, and join to `formatted`.

    `start` is the segment's first code point in the formatted text.
    """
    t = template
    loss = lambda role: role.isin(list(t.loss_roles)) if t.loss_roles else F.lit(False)
    given = df.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    parts = given.withColumn("head", F.concat(F.lit(t.before_role), escaped(F.col("role"), t), F.lit(t.before_text))).withColumn("body", escaped(F.col("text"), t))
    # Offsets are running sums over a conversation's rows; equal turns are alike, so their order among themselves doesn't matter.
    ahead = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size = F.char_length("head") + F.char_length("body") + F.lit(len(t.after_text))
    placed = parts.withColumn("at", F.sum(size).over(ahead) - size)
    turns = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "at", "head", "body"))).alias("turns"))

    def segments(x: Column) -> Column:
        body = x["at"] + F.char_length(x["head"])
        return F.array(
            F.struct(x["head"].alias("text"), F.lit(False).alias("loss"), x["at"].alias("start")),
            F.struct(x["body"].alias("text"), loss(x["role"]).alias("loss"), body.alias("start")),
            F.struct(F.lit(t.after_text).alias("text"), F.lit(False).alias("loss"), (body + F.char_length(x["body"])).alias("start")),
        )

    return turns.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        final_state(F.transform("turns", lambda x: x["role"]), t).isin(list(t.accepting)).alias("valid"),
        F.flatten(F.transform("turns", segments)).alias("segments"),
        F.array_join(F.transform("turns", lambda x: F.concat(x["head"], x["body"], F.lit(t.after_text))), "").alias("formatted"),
    )


def _pieces(formatted: Column, t: Template) -> Column:
    """What stands before each end mark, in order."""
    cut = _split(formatted, t.after_text)
    return F.slice(cut, 1, F.size(cut) - 1)


def _halves(piece: Column, t: Template) -> Column:
    """A piece's role and text, still escaped."""
    cut = _split(piece, t.before_text)
    return F.struct(F.replace(cut[0], F.lit(t.before_role), F.lit("")).alias("role"), cut[1].alias("text"))


def read_back(formatted: Column, template: Template = Template()) -> Column:
    """The turns (role, text) of a formatted text."""
    t = template
    undo = lambda h: F.struct(unescaped(h["role"], t).alias("role"), unescaped(h["text"], t).alias("text"))
    return F.transform(F.transform(_pieces(formatted, t), lambda x: _halves(x, t)), undo)


def loss_text(formatted: Column, segments: Column, template: Template = Template()) -> Column:
    """All text of `formatted` under the loss mask, unescaped, in order.

    Only places, lengths and flags are taken from the segments.  Where every place and length agrees with the lengths of what
    `formatted` holds between its marks, its pieces are the cuts (one pass); else it is cut at each place.
    """
    t = template
    masked = F.transform(F.filter(segments, lambda s, i: i % 3 == 1), lambda s: F.struct(s["start"].alias("start"), F.char_length(s["text"]).alias("size"), s["loss"].alias("loss")))
    ends = F.transform(masked, lambda m: m["start"] + m["size"] + len(t.after_text))
    before = F.concat(F.array(F.lit(0).cast("bigint")), F.slice(ends, 1, F.greatest(F.size(ends) - 1, F.lit(0))))
    halves = F.transform(_pieces(formatted, t), lambda x: _halves(x, t))
    rows = F.arrays_zip(halves.alias("half"), masked.alias("own"), before.alias("before"))
    head = len(t.before_role) + len(t.before_text)
    fits = F.forall(rows, lambda m: (m["own"]["start"] - m["before"] == F.char_length(m["half"]["role"]) + head) & (m["own"]["size"] == F.char_length(m["half"]["text"])))
    whole = F.array_join(F.transform(F.filter(rows, lambda m: m["own"]["loss"]), lambda m: unescaped(m["half"]["text"], t)), "")
    cut = F.array_join(F.transform(F.filter(masked, lambda m: m["loss"]), lambda m: unescaped(F.substring(formatted, (m["start"] + 1).cast("int"), m["size"]), t)), "")
    return F.when(F.coalesce(fits, F.lit(False)), whole).otherwise(cut)


# Conversation -7 of the query.
PROBE_TEXT = r"\### Assistant: </turn> ok"


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE_TEXT).alias("text")
    )
    made = format_conversations(given.unionByName(probe))
    read = made.select("conv_id", "valid", read_back(F.col("formatted")).alias("turns"), loss_text(F.col("formatted"), F.col("segments")).alias("loss"), F.char_length("formatted").cast("bigint").alias("formatted_chars"))
    whole = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"), F.char_length("loss").cast("bigint").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars", "valid"
    )


OP4_SQL = r"""
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT CAST(-7 AS BIGINT), CAST(0 AS BIGINT), 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT CAST(-7 AS BIGINT), CAST(1 AS BIGINT), 'assistant', '\### Assistant: </turn> ok'),
marked AS (
  SELECT *, length(replace(replace(text, '\', '\\'), '<', '\l')) + length(replace(replace(role, '\', '\\'), '<', '\l')) AS escaped_chars,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before,
    count(*) OVER (PARTITION BY conv_id) AS n
  FROM given)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(escaped_chars + length('<turn><text></turn>')) AS BIGINT) AS formatted_chars,
  bool_and(CASE WHEN i = 1 THEN role IN ('system', 'user') ELSE (before, role) IN (('system', 'user'), ('user', 'assistant'), ('assistant', 'user'), ('assistant', 'tool'), ('tool', 'assistant')) END)
    AND bool_or(i = n AND role = 'assistant') AS valid
FROM marked GROUP BY conv_id
"""
