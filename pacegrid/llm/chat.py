"""Chat formatting by incremental black-box rendering.

The template is any function from a list of (role, text) turns to a string. Successive turn
prefixes are rendered and consecutive outputs compared: what a prefix adds is the turn's span.
A probe per turn, rendered with a string that doesn't occur in place of the text, locates the
text inside the span. A template whose output for a longer prefix doesn't begin with that for
the shorter one rewrites history; such conversations are marked and get no loss mask. Where an
assistant's text can't be located although history stands, an error says so: no text is lost
from the mask.

The template is called for every prefix, so work grows with the square of a conversation's
turns; a conversation is one string and one task's work.

Defined results: turns stand in the order (turn, role, text), null turns last; a null text or
role counts as empty; repeated rows are turns of their own; rows with a null conversation id
form one conversation; other columns are ignored; an empty table gives an empty table (the
query still adds its conversation -7).
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pacegrid.llm import common

Turns = list[tuple[str, str]]
Template = Callable[[Turns], str]

#: Code points that stand for a text in a probe; where all occur, they enclose a number.
PROBES = range(0xE000, 0xF900)

#: Control strings of the template.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[SAY]", "[ROLE]", "[/ROLE]")
_ANY = "|".join(map(re.escape, CONTROLS))
_INSIDE = re.compile(rf"(\\*)({_ANY})")
_ESCAPED = re.compile(rf"(\\+)({_ANY})")
_CONTROL = re.compile(rf"(?<!\\)(?:{_ANY})")
_HEAD = re.compile(r"<s>\[ROLE\](.*?) \[/ROLE\](\[INST\]|\[SAY\]) ", re.DOTALL)


#: Texts that the next turns' renderings escape again.
@functools.lru_cache(maxsize=64)
def escape(text: str) -> str:
    """n backslashes before a control string become 2n + 1; other text stays as it is."""
    return _INSIDE.sub(lambda m: m[1] * 2 + "\\" + m[2], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1][: len(m[1]) // 2] + m[2], text)


def default_template(turns: Turns) -> str:
    """``<s>[ROLE]role [/ROLE][INST] text [/INST]`` per turn, or ``[SAY] text </s>`` for the
    assistant's; a blank stands before each closing control string, so that no backslash of a
    text meets it."""
    out = []
    for role, text in turns:
        head = f"<s>[ROLE]{escape(role)} [/ROLE]"
        out.append(f"{head}[SAY] {escape(text)} </s>" if role == "assistant" else f"{head}[INST] {escape(text)} [/INST]")
    return "".join(out)


def parse(formatted: str) -> Turns:
    """The turns of a string that ``default_template`` made."""
    turns, at = [], 0
    while at < len(formatted):
        head = _HEAD.match(formatted, at)
        while head and (inner := _CONTROL.search(formatted, head.start(1), head.end(1))):
            head = None if inner else head
        if not head:
            raise ValueError(f"no turn at {at}")
        end = _CONTROL.search(formatted, head.end())
        turns.append((unescape(head[1]), unescape(formatted[head.end() : end.start() - 1])))
        at = end.end()
    return turns


def common_prefix(a: str, b: str) -> int:
    if b.startswith(a):
        return len(a)
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid - 1)
    return low


def render_incrementally(template: Template, turns: Turns) -> dict:
    """formatted, spans [(start, end)] of turns, texts [(start, end)] of their texts (None where
    the template changes what surrounds the text), and rewrites: the turns at which the output
    so far was changed."""
    before, spans, texts, rewrites = "", [], [], []
    for k, (role, _) in enumerate(turns):
        now = template(turns[: k + 1])
        kept = common_prefix(before, now)
        if kept < len(before):
            rewrites.append(k)
        spans.append((kept, len(now)))
        texts.append(locate(template, turns[:k], role, now))
        before = now
    return {"formatted": before, "spans": spans, "texts": texts, "rewrites": rewrites}


def unused(text: str) -> str:
    """A string that doesn't occur in ``text``."""
    single = (chr(c) for c in PROBES)
    numbered = (f"{chr(PROBES[0])}{k}{chr(PROBES[-1])}" for k in itertools.count())
    return next(p for p in itertools.chain(single, numbered) if p not in text)


def locate(template: Template, past: Turns, role: str, now: str) -> tuple[int, int] | None:
    probe = unused(now)
    shown = template([*past, (role, probe)])
    if shown.count(probe) == 1:
        start = shown.index(probe)
        after = start + len(probe)
        end = len(now) - (len(shown) - after)
        if start <= end and now.startswith(shown[:start]) and now.endswith(shown[after:]):
            return start, end
    return None


FIELDS = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, history_rewritten boolean"


def format_conversations(rows: DataFrame, template: Template = default_template, read_back: Callable[[str], Turns] = parse, undo: Callable[[str], str] = unescape, keep_text: bool = True) -> DataFrame:
    """One row per conversation: digests read back from the formatted string, its length,
    whether the template rewrites history and, with ``keep_text``, the string itself and the
    (start, end) pairs of its loss mask over the assistant's texts.

    A formatted conversation is one string, so its turns meet in one row.
    """
    id_type = rows.schema["conv_id"].dataType.simpleString()
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turn = F.struct(F.col("turn").isNull().alias("late"), F.col("turn"), text("role").alias("role"), text("text").alias("text"))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    grouped = grouped.select(F.col("conv_id").alias("id"), F.expr("transform(turns, t -> t.role)").alias("roles"), F.expr("transform(turns, t -> t.text)").alias("texts"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()

    def one(roles: list[str], texts: list[str]) -> dict:
        found = render_incrementally(template, list(zip(roles, texts, strict=True)))
        out, back = found["formatted"], read_back(found["formatted"])
        mask = [] if found["rewrites"] else [at for (role, _), at in zip(back, found["texts"], strict=True) if role == "assistant"]
        if None in mask:
            raise ValueError("the template changes what stands around an assistant's text: no loss mask")
        loss = "".join(undo(out[a:b]) for a, b in mask)
        return {
            "n_turns": len(back),
            "turns_sha256": sha("".join(f"{role}\n{text}\n" for role, text in back)),
            "loss_chars": len(loss),
            "loss_sha256": sha(loss),
            "formatted_chars": len(out),
            "history_rewritten": bool(found["rewrites"]),
            "formatted": out,
            "loss_mask": [{"start": a, "end": b} for a, b in mask],
        }

    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    kinds = {"n_turns": pa.int64(), "turns_sha256": pa.string(), "loss_chars": pa.int64(), "loss_sha256": pa.string(), "formatted_chars": pa.int64(), "history_rewritten": pa.bool_()}
    kinds |= {"formatted": pa.string(), "loss_mask": span} if keep_text else {}

    def run(batches):
        for batch in batches:
            found = [one(r, t) for r, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([x[k] for x in found], kind) for k, kind in kinds.items())], ["id", *kinds])

    schema = f"id {id_type}, {FIELDS}" + ", formatted string, loss_mask array<struct<start:int,end:int>>" * keep_text
    return grouped.mapInArrow(run, schema).withColumnRenamed("id", "conv_id")


def op8_chat_formatting(spark, sf_dir: str) -> DataFrame:
    rows = common.read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], rows.schema)
    # Formatted apart, so that a conversation -7 of the table isn't taken for a part of this one.
    return format_conversations(rows, keep_text=False).unionByName(format_conversations(more, keep_text=False))
