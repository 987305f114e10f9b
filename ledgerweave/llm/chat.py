"""Chat formatting: a role automaton, a declarative template, and loss flags.

The template names the strings around each role's text and the roles whose text
is learnt. The automaton has one state for each role that spoke last, and lists
which roles may follow. A turn that may not follow is marked and the automaton
goes on from its role, so its state is always the role of the turn before: one
ordered look-back within the conversation, which Spark spills as it needs.

Strings of the template that occur inside texts are escaped: a backslash stands
before every backslash and before every such string. Taking the backslashes away
from left to right gives the text back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerweave.llm.arrow import as_bytes

START, OTHER = "", "*"


@dataclass(frozen=True)
class Template:
    """around: role -> strings before and after its text ("*": any other role, whose name stands before the text).

    follows: role spoken last ("" at the start) -> roles that may speak.
    """

    around: dict[str, tuple[str, str]]
    learnt: frozenset[str]
    follows: dict[str, tuple[str, ...]]
    more: tuple[str, ...] = field(default=())

    def marks(self) -> list[str]:
        return sorted({x for pair in self.around.values() for x in pair if x} | set(self.more), key=lambda x: (-len(x), x))


INSTRUCT = Template(
    around={"system": ("<<SYS>>", "<</SYS>>"), "user": ("<s>[INST]", "[/INST]"), "assistant": ("<s>[ANS]", "</s>"), OTHER: ("<s>[ROLE]", "</s>")},
    learnt=frozenset({"assistant"}),
    follows={START: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)},
    more=("[INST]", "[/INST]", "[ANS]", "[ROLE]", "[NAME]", "<s>", "</s>"),
)
#: Between the name and the text of a role without an entry of its own.
NAME_END = "[NAME]"


def _pattern(template: Template) -> str:
    return "|".join(["\\\\", *map(re.escape, template.marks())])


def escaped(text: Column, template: Template) -> Column:
    return F.regexp_replace(text, f"({_pattern(template)})", "\\\\$1")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_chats(rows: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """One row per turn: conv_id, turn, role, segments, in_order, allowed.

    rows has conv_id, turn, role and text. segments are (text, loss): opening
    string, escaped text, closing string; their texts joined are the turn's
    output. A null text or role is empty; a null conv_id is a conversation of
    its own; turns go by turn (nulls first), then role and text, and a repeated
    row is a turn of its own. in_order tells whether the automaton allowed the
    turn, allowed what it would have taken. An empty table gives no rows.
    """
    told = rows.select(rows["conv_id"].cast("long").alias("conv_id"), rows["turn"].cast("long").alias("turn"), F.coalesce(rows["role"], F.lit("")).alias("role"), F.coalesce(rows["text"], F.lit("")).alias("text"))
    line = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    state = F.coalesce(F.lag("role").over(line), F.lit(START))
    allowed = F.create_map(*(F.lit(x) for s, roles in template.follows.items() for x in (s, "|".join(roles))))
    before, after = F.lit(None).cast("string"), F.lit(None).cast("string")
    for role, (a, b) in template.around.items():
        if role != OTHER:
            before, after = F.when(F.col("role") == role, a).otherwise(before), F.when(F.col("role") == role, b).otherwise(after)
    other = template.around[OTHER]
    named = F.concat(F.lit(other[0]), escaped(F.col("role"), template), F.lit(NAME_END))
    none = F.lit(False)
    segments = F.array(
        F.struct(F.coalesce(before, named).alias("text"), none.alias("loss")),
        F.struct(escaped(F.col("text"), template).alias("text"), F.col("role").isin(*template.learnt).alias("loss")),
        F.struct(F.coalesce(after, F.lit(other[1])).alias("text"), none.alias("loss")),
    )
    return (
        told.withColumn("allowed", F.coalesce(allowed[state], F.lit("")))
        .withColumn("in_order", F.array_contains(F.split("allowed", r"\|"), F.col("role")) & (F.col("role") != ""))
        .select("conv_id", "turn", "role", segments.alias("segments"), "in_order", "allowed")
    )


def read_turns(formatted: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """Role and text of each formatted turn, from its segments alone."""
    opening, body = F.col("segments")[0]["text"], F.col("segments")[1]["text"]
    role = unescaped(F.expr(f"substring(segments[0].text, {len(template.around[OTHER][0]) + 1}, char_length(segments[0].text) - {len(template.around[OTHER][0]) + len(NAME_END)})"))
    for name, (a, _) in template.around.items():
        if name != OTHER:
            role = F.when(opening == a, name).otherwise(role)
    chars = F.aggregate("segments", F.lit(0).cast("long"), lambda n, s: n + F.char_length(s["text"]))
    return formatted.select("conv_id", "turn", role.alias("role"), unescaped(body).alias("text"), F.col("segments")[1]["loss"].alias("loss"), chars.alias("chars"), "in_order")


def parse_flat(output: str, template: Template = INSTRUCT) -> list[tuple[str, str]]:
    """(role, text) of each turn of a conversation's joined output."""
    token = re.compile(rf"\\(.)|({_pattern(template)[3:]})|([^\\])", re.DOTALL)
    opens = {a: r for r, (a, _) in template.around.items()}
    turns, role, name, text, end = [], None, None, "", None
    for m in token.finditer(output):
        mark = m[2]
        if role is None:
            role, end, text = opens[mark], template.around[opens[mark]][1], ""
        elif mark == NAME_END and role == OTHER and name is None:
            name, text = text, ""
        elif mark is not None and mark == end:
            turns.append((name if role == OTHER else role, text))
            role = name = None
        else:
            text += m[1] if m[1] is not None else mark if mark is not None else m[3]
    return turns


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns sorted by conversation to one row each; only running digests are held."""
    now, out = None, []

    def closed() -> tuple:
        conv, n, turns, chars, loss, size, wrong = now
        return conv, n, turns.hexdigest(), chars, loss.hexdigest(), size, wrong

    def made() -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "turns_out_of_order"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    for b in batches:
        for conv, role, text, loss, chars, fine in zip(b["conv_id"].to_pylist(), as_bytes(b["role"]), as_bytes(b["text"]), b["loss"].to_pylist(), b["chars"].to_pylist(), b["in_order"].to_pylist(), strict=True):
            if now is None or now[0] != conv:
                if now is not None:
                    out.append(closed())
                now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
            now[1] += 1
            now[2].update(b"%b\n%b\n" % (role, text))
            if loss:
                now[3] += len(text.decode())
                now[4].update(text)
            now[5] += chars
            now[6] += not fine
        if len(out) >= 4096:
            yield made()
            out = []
    if now is not None:
        out.append(closed())
        yield made()


def chat_digests(rows: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """Counts and digests of each formatted conversation, read back from its segments.

    The rows of format_chats() come sorted by conversation, so this adds no
    shuffle. A digest of a whole conversation takes its turns one after another;
    a task holds one running digest, whatever the conversation's length.
    """
    return read_turns(format_chats(rows, template), template).mapInArrow(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, turns_out_of_order long")
