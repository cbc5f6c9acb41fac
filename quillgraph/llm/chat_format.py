"""Chat formatting: a finite-state machine over roles and a declarative template, in DataFrame functions only.

Rows of turns become one row per conversation with text segments and a loss flag for
each. Control strings inside texts are broken by a backslash after their first
character (and backslashes doubled), so that markers stay the only control strings and
the formatted text can be read back without loss. An invalid turn order is reported in
``valid`` and formatted all the same; nothing is dropped.

Defined results: turns are ordered by (turn, role, text), nulls first; null text and
null role count as empty; a null conversation id is a conversation of its own; repeated
rows are repeated turns; a role outside the template gets the general markers and no
loss; an empty table gives no rows; only the four named columns are read. A conversation
is one document of the output, so its turns meet in one row by design.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blank


@dataclass(frozen=True)
class Role:
    opens: str
    closes: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """Markers by role, the strings that texts may not contain, and the machine over roles."""

    roles: dict[str, Role]
    control: tuple[str, ...]
    other_open: tuple[str, str]
    other_close: str
    #: (state, role) -> state; anything else leads to "error", which nothing leaves.
    moves: dict[tuple[str, str], str] = field(default_factory=dict)
    start: str = "start"
    accepted: tuple[str, ...] = ()


INSTRUCT = Template(
    roles={
        "system": Role("<<SYS>>\n", "\n<</SYS>>\n"),
        "user": Role("[INST] ", " [/INST]"),
        "assistant": Role("<s> ", " </s>\n", loss=True),
    },
    control=("<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "<|", "|>"),
    other_open=("<|", "|>\n"),
    other_close="\n<|end|>\n",
    moves={
        ("start", "system"): "system",
        ("start", "user"): "user",
        ("system", "user"): "user",
        ("user", "assistant"): "assistant",
        ("assistant", "user"): "user",
    },
    accepted=("assistant",),
)


def escape(text: Column, template: Template) -> Column:
    starts = "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in template.control)
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), starts, r"$0\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _final_state(roles: Column, template: Template) -> Column:
    def step(state: Column, role: Column) -> Column:
        out = F.lit("error")
        for (at, what), to in template.moves.items():
            out = F.when((state == at) & (role == what), to).otherwise(out)
        return out

    return F.aggregate(roles, F.lit(template.start), step)


def format_chats(
    turns: DataFrame,
    template: Template = INSTRUCT,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """``id_col, n_turns, valid, segments array<struct<text, loss>>, formatted``: one shuffle, by conversation."""
    rows = turns.select(
        F.col(id_col), F.col(turn_col).alias("turn"), blank(F.col(role_col)).alias("role"), blank(F.col(text_col)).alias("text")
    )
    chats = rows.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))

    def marks(turn: Column) -> Column:
        def segments(opens: Column, closes: Column, loss: bool) -> Column:
            return F.array(
                F.struct(opens.alias("text"), F.lit(False).alias("loss")),
                F.struct(escape(turn["text"], template).alias("text"), F.lit(loss).alias("loss")),
                F.struct(closes.alias("text"), F.lit(False).alias("loss")),
            )

        before, after = template.other_open
        out = segments(F.concat(F.lit(before), escape(turn["role"], template), F.lit(after)), F.lit(template.other_close), False)
        for name, role in template.roles.items():
            out = F.when(turn["role"] == name, segments(F.lit(role.opens), F.lit(role.closes), role.loss)).otherwise(out)
        return out

    return chats.select(
        id_col,
        F.size("turns").cast("long").alias("n_turns"),
        _final_state(F.col("turns.role"), template).isin(*template.accepted).alias("valid"),
        F.flatten(F.transform("turns", marks)).alias("segments"),
    ).withColumn("formatted", F.array_join("segments.text", ""))


def read_turns(formatted: Column, template: Template = INSTRUCT) -> Column:
    """The turns that a formatted text holds, as ``array<struct<role, text>>`` without escapes."""
    before, after = template.other_open
    general = f"{re.escape(before)}.*?{re.escape(after)}.*?{re.escape(template.other_close)}"
    pattern = "(?s)" + "|".join([*(f"{re.escape(r.opens)}.*?{re.escape(r.closes)}" for r in template.roles.values()), general])

    def read(turn: Column) -> Column:
        def between(start: Column | int, stop: int) -> Column:
            start = start if isinstance(start, Column) else F.lit(start)
            return unescape(F.substring(turn, start + 1, F.length(turn) - start - stop))

        mid = F.locate(after, turn)
        out = F.struct(
            unescape(F.substring(turn, F.lit(len(before) + 1), mid - 1 - len(before))).alias("role"),
            between(mid - 1 + len(after), len(template.other_close)).alias("text"),
        )
        for name, role in template.roles.items():
            out = F.when(
                F.startswith(turn, F.lit(role.opens)),
                F.struct(F.lit(name).alias("role"), between(len(role.opens), len(role.closes)).alias("text")),
            ).otherwise(out)
        return out

    return F.transform(F.regexp_extract_all(formatted, F.lit(pattern), F.lit(0)), read)


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, without escapes."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def chat_digests(chats: DataFrame, template: Template = INSTRUCT, id_col: str = "conv_id") -> DataFrame:
    """Digests of what the output of ``format_chats`` says when it is read back."""
    back = chats.select(id_col, "valid", "formatted", read_turns(F.col("formatted"), template).alias("back"), loss_text(F.col("segments")).alias("loss"))
    return back.select(
        id_col,
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


def sql(template: Template = INSTRUCT, extra: str = "") -> str:
    """DuckDB SQL for ``chat_digests(format_chats(conversations))``; extra: a UNION ALL of further turns."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    breaks = lambda col: " + ".join(
        [f"length({col}) - length(replace({col}, '\\', ''))"]
        + [f"(length({col}) - length(replace({col}, {quote(c)}, ''))) // {len(c)}" for c in template.control]
    )
    other = len("".join(template.other_open)) + len(template.other_close)
    marks = " ".join(f"WHEN {quote(n)} THEN {len(r.opens + r.closes)}" for n, r in template.roles.items())
    marks = f"CASE role {marks} ELSE {other} + length(role) + {breaks('role')} END"
    loss = ", ".join(quote(n) for n, r in template.roles.items() if r.loss)
    steps = " OR ".join(f"(before {'IS NULL' if at == template.start else f'= {quote(at)}'} AND role = {quote(role)})" for (at, role) in template.moves)
    return f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations {extra}
), placed AS (
  SELECT *, lag(role) OVER w AS before, row_number() OVER w AS place, count(*) OVER (PARTITION BY conv_id) AS n
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role IN ({loss})), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (WHERE role IN ({loss})), '')) AS loss_sha256,
  CAST(sum(length(text) + {breaks('text')} + {marks}) AS BIGINT) AS formatted_chars,
  bool_and(coalesce({steps}, false) AND (place < n OR role IN ({', '.join(map(quote, template.accepted))}))) AS valid
FROM placed GROUP BY conv_id
"""
