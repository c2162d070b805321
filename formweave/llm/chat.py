"""Chat formatting: a finite-state machine over roles and a declarative template.

The template names, for each role, the control strings around its text and
whether its text is under the loss mask; the transitions say which role may
follow in which state.  Formatting yields, per conversation, the segments
(text, loss flag) in order, the joined string, and whether the roles form a
valid sequence; ``read_back`` parses the joined string again.

Control strings start with ``[`` or ``<``.  These two and the backslash are
escaped inside texts (backslash and a letter), so no text can imitate a mark,
and unescaping gives the text back exactly.

Edge cases: a null text is the empty text; a null or unlisted role gets marks
of its own and makes the conversation invalid, but is formatted all the same;
turns are ordered by turn (null first), then role, then text, so ties and
repeated rows have a defined order; an empty table gives an empty result; extra
columns are ignored.  A conversation is one row, as it is one training sample.

Only DataFrame functions are used.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """(opening, closing, loss) by role, and the machine as {state: {role: next state}}."""

    roles: dict[str, tuple[str, str, bool]] = field(
        default_factory=lambda: {
            "system": ("[SYS] ", " [/SYS]", False),
            "user": ("[INST] ", " [/INST]", False),
            "assistant": ("[OUT] ", "</s>", True),
        }
    )
    moves: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            "start": {"system": "briefed", "user": "asked"},
            "briefed": {"user": "asked"},
            "asked": {"assistant": "answered"},
            "answered": {"user": "asked"},
        }
    )
    accept: tuple[str, ...] = ("asked", "answered")


_ESCAPES = (("\\", "\\e"), ("[", "\\o"), ("<", "\\l"), ("]", "\\c"))
_TURN = r"(\[[A-Z]+(?: [^\]]*)?\] )([^\[<]*)( \[/[A-Z]+\]|</s>)"


def escape(text: Column, brackets: bool = False) -> Column:
    for plain, coded in _ESCAPES[: 4 if brackets else 3]:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    for plain, coded in _ESCAPES[::-1]:
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def _marks(role: Column, template: Template) -> tuple[Column, Column, Column]:
    opening = F.when(role.isNull(), F.lit("[NONE] "))
    closing, loss = F.when(role.isNull(), F.lit(" [/NONE]")), F.when(role.isNull(), F.lit(False))
    for name, (a, b, under) in template.roles.items():
        opening, closing, loss = opening.when(role == name, a), closing.when(role == name, b), loss.when(role == name, under)
    return opening.otherwise(F.concat(F.lit("[ROLE "), escape(role, True), F.lit("] "))), closing.otherwise(F.lit(" [/ROLE]")), loss.otherwise(F.lit(False))


def format_conversations(rows: DataFrame, template: Template | None = None) -> DataFrame:
    """conv_id, segments array<struct<text, loss>>, formatted, state, valid: one row a conversation."""
    template = template or Template()
    opening, closing, loss = _marks(F.col("role"), template)
    text = F.coalesce(F.col("text"), F.lit(""))
    turn = F.struct(F.col("turn").alias("turn"), F.col("role").alias("role"), text.alias("text"), opening.alias("opening"), closing.alias("closing"), loss.alias("loss"))
    turns = rows.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    moves = F.create_map(*[F.lit(x) for state, by in template.moves.items() for role, to in by.items() for x in (f"{state} {role}", to)])

    def step(state: Column, t: Column) -> Column:
        return F.coalesce(F.try_element_at(moves, F.concat(state, F.lit(" "), t["role"])), F.lit("invalid"))

    def pieces(t: Column) -> Column:
        return F.array(F.struct(t["opening"].alias("text"), F.lit(False).alias("loss")), F.struct(escape(t["text"]).alias("text"), t["loss"].alias("loss")), F.struct(t["closing"].alias("text"), F.lit(False).alias("loss")))

    state = F.aggregate("turns", F.lit("start"), step)
    out = turns.select("conv_id", F.flatten(F.transform("turns", pieces)).alias("segments"), state.alias("state"))
    return out.select("conv_id", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "state", F.col("state").isin(*template.accept).alias("valid"))


def read_back(formatted: Column, template: Template | None = None) -> Column:
    """array<struct<role, text, loss>> parsed from a formatted conversation (a null role reads as null)."""
    template = template or Template()
    zipped = F.arrays_zip(
        F.regexp_extract_all(formatted, F.lit(_TURN), F.lit(1)).alias("opening"),
        F.regexp_extract_all(formatted, F.lit(_TURN), F.lit(2)).alias("text"),
    )

    def turn(t: Column) -> Column:
        opening = t["opening"]
        role, loss = F.when(opening == "[NONE] ", F.lit(None).cast("string")), F.when(opening == "[NONE] ", F.lit(False))
        for name, (a, _, under) in template.roles.items():
            role, loss = role.when(opening == a, F.lit(name)), loss.when(opening == a, F.lit(under))
        other = unescape(F.substring(opening, F.lit(7), F.char_length(opening) - 8))
        return F.struct(role.otherwise(other).alias("role"), unescape(t["text"]).alias("text"), loss.otherwise(F.lit(False)).alias("loss"))

    return F.transform(zipped, turn)


def digests(formatted: DataFrame) -> DataFrame:
    """The formatted conversations' digests, all from what is read back."""
    back = formatted.select("conv_id", "formatted", "valid", read_back(F.col("formatted")).alias("turns"))
    all_text = F.array_join(F.transform("turns", lambda t: F.concat(F.coalesce(t["role"], F.lit("")), F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join(F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["text"]), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(all_text, 256).alias("turns_sha256"),
        F.char_length(learned).cast("bigint").alias("loss_chars"),
        F.sha2(learned, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("bigint").alias("formatted_chars"),
        "valid",
    )


#: The same digests straight from the table: lengths of marks and escapes are counted, not built.
SQL = r"""
WITH c AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), d AS (
  SELECT *, lag(role) OVER w AS before, row_number() OVER w AS k,
    length(text) + length(text) - length(replace(replace(replace(text, '\', ''), '[', ''), '<', ''))
    + CASE role WHEN 'system' THEN 13 WHEN 'user' THEN 15 WHEN 'assistant' THEN 10 END AS size
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(coalesce(role, '') || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(size)::BIGINT AS formatted_chars,
  bool_and(CASE WHEN k = 1 THEN role IN ('system', 'user')
    ELSE (before || '>' || role) IN ('system>user', 'user>assistant', 'assistant>user') END) AND bool_or(role = 'user') AS valid
FROM d GROUP BY conv_id
"""
