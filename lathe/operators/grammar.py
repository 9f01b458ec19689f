"""The grammar of an answering block, as a finite automaton over its tokens.

    <assistant>{"thought":STRING,"response":STRING}</assistant>
    <assistant>{"thought":STRING,"tool_call":{"name":TOOL,"arguments":OBJECT}}</assistant>

A stretch of tokens is a map from each state that it may begin in to the state that it ends in, with the
place of the first token that is not allowed; maps of neighbouring stretches compose. So long texts are cut
into stretches, all stretches of a batch advance together, a numpy step a token, and a text's stretches are
folded at the end. Braces within arguments are counted beside the states: a stretch knows how far it goes
down and where it ends, and the one in which the outermost brace closes is run again from there.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lathe.functions.protocol import SPECIALS

#: Tokens of a stretch.
STRETCH = 512
BAD = 0


@dataclass(frozen=True)
class Automaton:
    """``step[state, token]`` is the next state (0: not allowed), ``depth[state, token]`` what a token adds to
    the open braces of arguments; ``counting`` marks the states in which they count."""

    names: tuple[str, ...]
    step: np.ndarray
    depth: np.ndarray
    counting: np.ndarray
    start: int
    done: int
    closed: int

    @property
    def inner(self) -> int:
        """The state in arguments that are open, outside of strings."""
        return self.names.index("arguments")


@cache
def automaton(tools: tuple[str, ...]) -> Automaton:
    """The automaton for some tool names. Tokens are code points, 255 at most, and the special tokens from 256 on."""
    special = {s: 256 + i for i, s in enumerate(SPECIALS)}
    names, edges, counted = ["bad"], [], []
    any_of = lambda low, high: range(low, high)

    def state(name: str) -> int:
        if name not in names:
            names.append(name)
        return names.index(name)

    def edge(a: str, tokens, b: str, add: int = 0):
        for t in tokens:
            edges.append((state(a), t, state(b), add))

    def word(a: str, text: str, b: str):
        edge(a, [special.get(text, ord(text[0]))], b)

    def string(name: str, after: str):
        """Printable characters to the closing quote; an escape takes one plain character with it."""
        edge(f"{name} opens", [34], name)
        edge(name, any_of(32, 256), name)
        edge(name, [92], f"{name} escape")
        edge(name, [34], after)
        edge(f"{name} escape", any_of(32, 127), name)

    word("block", "<assistant>", "message")
    word("message", "{", "thought key")
    word("thought key", '"thought":', "thought opens")
    string("thought", "after thought")
    word("after thought", ",", "action key")
    word("action key", '"response":', "response opens")
    string("response", "message ends")
    word("action key", '"tool_call":', "call")
    word("call", "{", "name key")
    word("name key", '"name":', "name opens")
    edge("name opens", [34], "name ")
    for tool in tools:  # a trie of the names
        for i, c in enumerate(tool):
            edge(f"name {tool[:i]}", [min(ord(c), 255)], f"name {tool[: i + 1]}")
        edge(f"name {tool}", [34], "after name")
    word("after name", ",", "arguments key")
    word("arguments key", '"arguments":', "arguments open")
    edge("arguments open", [123], "arguments", 1)
    for quoted in ("arguments", "arguments string"):
        edge(quoted, any_of(32, 256), quoted)
        edge(quoted, [92], f"{quoted} escape")
        edge(f"{quoted} escape", any_of(32, 256), quoted)
    edge("arguments", [34], "arguments string")
    edge("arguments string", [34], "arguments")
    edge("arguments", [123], "arguments", 1)
    edge("arguments", [125], "arguments", -1)
    word("call ends", "}", "message ends")
    word("message ends", "}", "block ends")
    word("block ends", "</assistant>", "done")
    n = len(names)
    step, depth = np.zeros((n, 256 + len(SPECIALS)), np.int16), np.zeros((n, 256 + len(SPECIALS)), np.int8)
    for a, t, b, add in edges:  # later edges of a state win
        step[a, t], depth[a, t] = b, add
    counted = np.array([x.startswith("arguments") and x not in ("arguments key", "arguments open") for x in names])
    return Automaton(tuple(names), step, depth, counted, names.index("block"), names.index("done"), names.index("call ends"))


_SPECIAL = re.compile("|".join(map(re.escape, sorted(SPECIALS, key=len, reverse=True))))
_ID = {s: 256 + i for i, s in enumerate(SPECIALS)}


def tokens(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of a text, and at which of its characters each begins."""
    ids = np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"), 255).astype(np.int16)
    keep = np.ones(len(ids), bool)
    for m in _SPECIAL.finditer(text):
        ids[m.start()] = _ID[m[0]]
        keep[m.start() + 1 : m.end()] = False
    at = np.flatnonzero(keep)
    return ids[at], at


def run_together(a: Automaton, data: np.ndarray, begin: np.ndarray, size: np.ndarray, state: np.ndarray, open_braces: np.ndarray) -> tuple[np.ndarray, ...]:
    """Advance many lanes a token at a time: (end state, braces open, least of them, tokens taken before a bad one)."""
    state, level = state.astype(np.int64), open_braces.astype(np.int64)
    least, taken = level.copy(), np.zeros(len(state), np.int64)
    live = np.flatnonzero((size > 0) & (state != BAD))
    i = 0
    while len(live):
        t = data[begin[live] + i].astype(np.int64)
        s = state[live]
        new, add = a.step[s, t].astype(np.int64), a.depth[s, t].astype(np.int64)
        level[live] += add
        least[live] = np.minimum(least[live], level[live])
        new[(add < 0) & (level[live] == 0)] = a.closed
        state[live] = new
        ok = new != BAD
        taken[live[ok]] += 1
        i += 1
        live = live[ok & (size[live] > i)]
    return state, level, least, taken


def judged(a: Automaton, texts: Sequence[str | None], stretch: int = STRETCH) -> list[tuple[bool, int | None, str] | None]:
    """Of each text: whether it is a whole block, at which character it goes wrong (its length, if it only stops
    too early; null, if nothing is wrong), and the state that it reached."""
    parts = [tokens(t or "") for t in texts]
    n = np.array([len(p[0]) for p in parts], np.int64)
    data = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.int16)
    first = np.cumsum(n) - n
    # a text's first stretch begins in the start state; later ones in any state, with braces counted from 0
    many = -(-n // stretch)
    text = np.repeat(np.arange(len(n)), many)
    place = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
    begin, size = first[text] + place * stretch, np.minimum(stretch, n[text] - place * stretch)
    states = np.arange(1, len(a.names))
    lane, lane_state = np.nonzero(np.where(place[:, None] == 0, states[None, :] == a.start, True))
    far = 1 << 40  # open braces that a stretch cannot close
    end, level, least, taken = run_together(a, data, begin[lane], size[lane], states[lane_state], np.where(a.counting[states[lane_state]], far, 0))
    of = np.full((len(text), len(a.names)), -1, np.int64)
    of[lane, states[lane_state]] = np.arange(len(lane))
    now, braces, good = np.full(len(n), a.start), np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
    for k in range(int(many.max(initial=0))):  # fold: the k-th stretch of all texts that have one and are still right
        x = np.flatnonzero((place == k) & (now[text] != BAD))
        who = text[x]
        got = of[x, now[who]]
        counts = a.counting[now[who]]
        closes = counts & (braces[who] + least[got] - far <= 0)
        for i in np.flatnonzero(closes).tolist():  # at most one stretch a text
            e, lv, _, tk = run_together(a, data, begin[x[i : i + 1]], size[x[i : i + 1]], now[who[i : i + 1]], braces[who[i : i + 1]])
            now[who[i]], braces[who[i]], good[who[i]] = e[0], lv[0], good[who[i]] + tk[0]
        rest = ~closes
        go, w = got[rest], who[rest]
        braces[w] = level[go] - np.where(counts[rest], far - braces[w], 0)
        now[w] = end[go]
        good[w] += taken[go]
    out = []
    for t, (_, at), state, k in zip(texts, parts, now.tolist(), good.tolist(), strict=True):
        if t is None:
            out.append(None)
            continue
        wrong = None if state == a.done and k == len(at) else int(at[k]) if k < len(at) else len(t)
        out.append((wrong is None, wrong, a.names[state]))
    return out


VERDICT = "struct<valid:boolean,bad_at:int,state:string>"


def block_verdicts(blocks: DataFrame, text: str, tools: Sequence[str], name: str = "verdict") -> DataFrame:
    """``blocks`` with a verdict on each text: ``valid``; ``bad_at``, the first character that the grammar does
    not allow (the text's length, if it stops too early); and the ``state`` there. Null texts have none."""
    known = tuple(sorted(tools))
    kind = pa.struct([("valid", pa.bool_()), ("bad_at", pa.int32()), ("state", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton(known)
        for b in batches:
            got = judged(a, b.column(text).to_pylist())
            found = pa.array([None if g is None else dict(zip(("valid", "bad_at", "state"), g, strict=True)) for g in got], kind)
            yield pa.RecordBatch.from_arrays([*b.columns, found], names=[*b.schema.names, name])

    return blocks.mapInArrow(run, T.StructType([*blocks.schema.fields, T.StructField(name, T._parse_datatype_string(VERDICT))]))


def allowed(tools: Sequence[str], state: str) -> list[int]:
    """The tokens that may come next: what a mask lets through."""
    a = automaton(tuple(sorted(tools)))
    return np.flatnonzero(a.step[a.names.index(state)]).tolist()
