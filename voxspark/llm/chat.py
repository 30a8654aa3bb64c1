"""Chat formatting by incremental black-box rendering.

A template is any function from a list of ``(role, text)`` turns to a string; nothing is known of its
inside. Successive prefixes of a conversation are rendered and each output is compared with the one
before: where it extends it, what was added is the span of the new turn; where it does not, the
template rewrites history, and that turn is marked. Inside a span, two probe texts in place of the
turn's own show where its text begins and ends, so that loss falls on assistant texts alone.

The templates here mark turns with control strings and break such strings inside texts with a
backslash, which is undone when the output is read back.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turns = list[tuple[str, str]]
Template = Callable[[Turns], str]

#: Control strings of both templates; none of them stands unbroken inside an escaped text.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>")
_ESCAPED = re.compile("|".join([r"\\", *map(re.escape, CONTROLS)]))
_UNESCAPED = re.compile(r"\\(.)", re.DOTALL)

SPANS = "array<struct<role:string,start:int,stop:int,text_start:int,text_stop:int,rewrites:boolean>>"


def escape(text: str) -> str:
    """``text`` with backslashes doubled and a backslash after the first character of each control string."""
    return _ESCAPED.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return _UNESCAPED.sub(r"\1", text)


def inst_template(turns: Turns) -> str:
    """Instructions in ``[INST]`` marks, answers after them, closed by ``</s>``; other roles name themselves."""
    out = []
    for role, text in turns:
        body = escape(text)
        if role == "user":
            out.append(f"<s>[INST] {body} [/INST]")
        elif role == "assistant":
            out.append(f" {body} </s>")
        else:
            out.append(f"<<SYS>>{escape(role)}\n{body}\n<</SYS>>\n")
    return "".join(out)


def im_template(turns: Turns) -> str:
    """Each turn between ``<|im_start|>`` with its role and ``<|im_end|>``."""
    return "".join(f"<|im_start|>{escape(role)}\n{escape(text)}<|im_end|>\n" for role, text in turns)


def last_turn_only(turns: Turns) -> str:
    """A template that rewrites history: only the last turn keeps its text. For tests and as a warning."""
    return "".join(f"<|im_start|>{r}\n{escape(t) if i == len(turns) - 1 else '...'}<|im_end|>\n" for i, (r, t) in enumerate(turns))


_PARSE_INST = re.compile(r"<s>\[INST\] (?P<user>.*?) \[/INST\]|<<SYS>>(?P<role>.*?)\n(?P<other>.*?)\n<</SYS>>\n| (?P<assistant>.*?) </s>", re.DOTALL)


def parse_inst(formatted: str) -> Turns:
    """The turns of an output of ``inst_template``."""
    turns, at = [], 0
    while at < len(formatted):
        m = _PARSE_INST.match(formatted, at)
        if m is None:
            raise ValueError(f"not an output of the template from character {at} on")
        if m["user"] is not None:
            turns.append(("user", unescape(m["user"])))
        elif m["assistant"] is not None:
            turns.append(("assistant", unescape(m["assistant"])))
        else:
            turns.append((unescape(m["role"]), unescape(m["other"])))
        at = m.end()
    return turns


def _shared(a: str, b: str) -> int:
    """Length of the common prefix."""
    if b.startswith(a):
        return len(a)
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[lo:mid] == b[lo:mid] else (lo, mid - 1)
    return lo


def locate(template: Template, turns: Turns) -> tuple[str, list[tuple]]:
    """The output for ``turns``, and for each its role, span, text span and whether history was rewritten.

    A span that a later prefix rewrites is marked there; spans are offsets into the last output, and
    empty for turns from which later ones took the text away.
    """
    before, spans = "", []
    for k in range(1, len(turns) + 1):
        now = template(turns[:k])
        kept = _shared(before, now)
        rewrites = kept < len(before)
        role = turns[k - 1][0]
        probes = [template([*turns[: k - 1], (role, probe)]) for probe in ("A", "B")]
        head = _shared(*probes)
        tail = _shared(probes[0][::-1], probes[1][::-1])
        stop = max(head, len(now) - tail)
        if rewrites:
            spans = [(r, min(a, kept), min(b, kept), min(c, kept), min(d, kept), w) if b > kept else (r, a, b, c, d, w) for r, a, b, c, d, w in spans]
        spans.append((role, kept, len(now), head, stop, rewrites))
        before = now
    return before, spans


def _gathered(rows: DataFrame) -> DataFrame:
    """A row for each conversation, with its turns in order."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))


def format_conversations(rows: DataFrame, template: Template = inst_template) -> DataFrame:
    """``conv_id, formatted, spans`` for each conversation of ``rows`` (conv_id, turn, role, text).

    Turns come in the order of ``turn``, ties by role and text. Null roles and texts count as empty;
    rows without a conv_id are one conversation of their own; repeated rows are repeated turns; other
    columns are left alone. An empty table gives an empty result. A conversation is one value, so
    it must fit into a task; rendering its prefixes costs its length times its number of turns.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = [locate(template, [(t["role"], t["text"]) for t in turns]) for turns in frame["turns"]]
            keys = ("role", "start", "stop", "text_start", "text_stop", "rewrites")
            yield pd.DataFrame({"conv_id": frame["conv_id"], "formatted": [f for f, _ in made], "spans": [[dict(zip(keys, s)) for s in spans] for _, spans in made]})

    return _gathered(rows).mapInPandas(run, f"conv_id long, formatted string, spans {SPANS}")


def read_back(formatted: DataFrame) -> DataFrame:
    """``conv_id, turns, loss_texts, rewrites`` from ``format_conversations`` with ``inst_template``: the turns
    as parsed, and the unescaped text under the loss mask."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame(
                {
                    "conv_id": frame["conv_id"],
                    "turns": [[{"role": r, "text": t} for r, t in parse_inst(f)] for f in frame["formatted"]],
                    "loss_texts": [[unescape(f[s["text_start"] : s["text_stop"]]) for s in spans if s["role"] == "assistant"] for f, spans in zip(frame["formatted"], frame["spans"])],
                    "rewrites": [any(s["rewrites"] for s in spans) for spans in frame["spans"]],
                    "formatted_chars": [len(f) for f in frame["formatted"]],
                }
            )

    return formatted.mapInPandas(run, "conv_id long, turns array<struct<role:string,text:string>>, loss_texts array<string>, rewrites boolean, formatted_chars long")
