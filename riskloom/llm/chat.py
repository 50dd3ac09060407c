"""Chat formatting with a loss mask, from a declarative template (operator 10).

Only DataFrame functions: the turns of a conversation become one array, a finite-state machine
over the roles runs along it as a fold, and each turn emits three segments (mark, text, mark)
with a loss flag.

Results in special cases: a null text is empty; a null role is written as an empty role and
makes the conversation ill-formed; turns with the same number are ordered by role, then text;
repeated rows are turns of their own; an empty table gives an empty table; columns other than
conv_id, turn, role and text are ignored, whatever their names. Ill-formed conversations are
formatted like all others and carry `well_formed = false`.

A conversation is one text, so its turns meet in one row; conversations are spread by conv_id.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_c = F.col


@dataclass(frozen=True)
class Template:
    """How a conversation is written down.

    `opening` holds `{role}`. `escapes` maps every character that may begin or end a mark, and
    the escape character itself, to the letter that stands for it after the escape character:
    an escaped text holds none of them, so no mark can appear in it. `moves` lists, by state,
    the roles that may follow and the state they lead to; `final` the states a conversation may
    end in. `loss_roles` are the roles whose texts are learned.
    """

    opening: str = "<|{role}|>"
    closing: str = "<|end|>"
    escape: str = "\\"
    escapes: dict[str, str] = field(default_factory=lambda: {"\\": "b", "<": "l", ">": "g", "|": "p"})
    loss_roles: tuple[str, ...] = ("assistant",)
    moves: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            "start": {"system": "briefed", "user": "asked"},
            "briefed": {"user": "asked"},
            "asked": {"assistant": "answered"},
            "answered": {"user": "asked"},
        }
    )
    final: tuple[str, ...] = ("answered",)


def escaped(text: Column, template: Template) -> Column:
    """The text without any character that a mark needs."""
    ordered = sorted(template.escapes, key=lambda ch: ch != template.escape)  # the escape character first
    for ch in ordered:
        text = F.replace(text, F.lit(ch), F.lit(template.escape + template.escapes[ch]))
    return text


def unescaped(text: Column, template: Template) -> Column:
    """The inverse of `escaped`: each pair goes back, the escape character's own pair last."""
    for ch in sorted(template.escapes, key=lambda ch: ch == template.escape):
        text = F.replace(text, F.lit(template.escape + template.escapes[ch]), F.lit(ch))
    return text


def machine_state(roles: Column, template: Template) -> Column:
    """The state after all roles; `rejected` once a role may not follow."""
    table = {f"{state}\n{role}": to for state, by in template.moves.items() for role, to in by.items()}
    moves = F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])
    step = lambda state, role: F.coalesce(F.element_at(moves, F.concat(state, F.lit("\n"), role)), F.lit("rejected"))
    return F.aggregate(roles, F.lit("start"), step)


def format_chats(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """One row per conversation: conv_id, n_turns, well_formed, segments, formatted.

    `segments` is an array of (text, loss); `formatted` is their texts in a row.
    """
    t = template or Template()
    rows = turns.select(
        "conv_id",
        F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("one"),
    )
    chats = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("one")).alias("turns"))
    before, after = t.opening.split("{role}")

    def segment(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    def of_turn(x: Column) -> Column:
        learned = x["role"].isin(*t.loss_roles) if t.loss_roles else F.lit(False)
        return F.array(
            segment(F.concat(F.lit(before), escaped(x["role"], t), F.lit(after)), F.lit(False)),
            segment(escaped(x["text"], t), learned),
            segment(F.lit(t.closing), F.lit(False)),
        )

    return chats.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        machine_state(F.transform("turns", lambda x: x["role"]), t).isin(*t.final).alias("well_formed"),
        F.flatten(F.transform("turns", of_turn)).alias("segments"),
    ).withColumn("formatted", F.concat_ws("", F.transform("segments", lambda s: s["text"])))


def read_back(chats: DataFrame, template: Template | None = None) -> DataFrame:
    """Adds `read_turns`, an array of (role, text) parsed from `formatted`, and `learned`, the
    unescaped text under the loss mask."""
    t = template or Template()
    before, after = t.opening.split("{role}")

    def turn(piece: Column) -> Column:
        inner = F.substr(piece, F.lit(len(before) + 1))
        return F.struct(
            unescaped(F.substring_index(inner, after, 1), t).alias("role"),
            unescaped(F.substr(inner, F.char_length(F.substring_index(inner, after, 1)) + F.lit(len(after) + 1)), t).alias("text"),
        )

    quoted = "".join(f"\\{x}" if not x.isalnum() else x for x in t.closing)
    pieces = F.split("formatted", quoted)  # the last piece is what follows the last mark: nothing
    return chats.withColumn("read_turns", F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), turn)).withColumn(
        "learned",
        F.concat_ws("", F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescaped(s["text"], t))),
    )


def chat_digest(chats: DataFrame, template: Template | None = None) -> DataFrame:
    """What can be read back from the formatted conversations, one row each."""
    spoken = F.concat_ws("", F.transform("read_turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))))
    return read_back(chats, template).select(
        "conv_id",
        F.size("read_turns").cast("long").alias("n_turns"),
        F.sha2(spoken, 256).alias("turns_sha256"),
        F.char_length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        "well_formed",
    )
