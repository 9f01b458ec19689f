"""The automaton against the grammar taken one token at a time."""

import random
import re

from lathe.functions.protocol import SPECIALS
from lathe.operators import grammar as G

TOOLS = ("calc", "calculate", "now")
TOKEN = re.compile("(?s)" + "|".join([*(re.escape(t) for t in sorted(SPECIALS, key=len, reverse=True)), "."]))
FIXED = {"block": "<assistant>", "{": "{", "thought": '"thought":', ",": ","}


class Walk:
    """A block read by a list of what must come next."""

    def __init__(self, text):
        self.tokens, self.i = [(m[0], m.start()) for m in TOKEN.finditer(text)], 0

    def take(self, ok):
        if self.i >= len(self.tokens) or not ok(self.tokens[self.i][0]):
            raise ValueError
        self.i += 1
        return self.tokens[self.i - 1][0]

    def word(self, *options):
        return self.take(lambda t: t in options)

    def plain(self, low=32, high=256):
        return self.take(lambda t: t not in SPECIALS and low <= min(ord(t), 255) < high)

    def string(self):
        self.word('"')
        while (c := self.plain()) != '"':
            if c == "\\":
                self.plain(32, 127)

    def arguments(self):
        self.word("{")
        depth, quoted = 1, False
        while depth:
            c = self.plain()
            if c == "\\":
                self.plain()
            elif c == '"':
                quoted = not quoted
            elif not quoted:
                depth += (c == "{") - (c == "}")

    def name(self):
        got = ""
        while True:
            c = self.take(lambda t: t not in SPECIALS and (t == '"' and got in TOOLS or t != '"' and any(n.startswith(got + t) for n in TOOLS)))
            if c == '"':
                return
            got += c

    def block(self):
        self.word("<assistant>")
        self.word("{")
        self.word('"thought":')
        self.string()
        self.word(",")
        if self.word('"response":', '"tool_call":') == '"response":':
            self.string()
        else:
            self.word("{")
            self.word('"name":')
            self.word('"')
            self.name()
            self.word(",")
            self.word('"arguments":')
            self.arguments()
            self.word("}")
        self.word("}")
        self.word("</assistant>")
        if self.i < len(self.tokens):
            raise ValueError


def plain(text):
    w = Walk(text)
    try:
        w.block()
        return True, None
    except ValueError:
        return False, w.tokens[w.i][1] if w.i < len(w.tokens) else len(text)


def texts():
    rng = random.Random(1)
    said = lambda: "".join(rng.choice(["a", "b", '\\"', "\\\\", "é", "漢", " ", "{", "}", "\\n", "x" * rng.randint(1, 40)]) for _ in range(rng.randint(0, 8)))
    args = lambda d=0: "{" + ",".join(f'"{rng.choice("pqr")}":' + (f'"{said()}"' if d > 2 or rng.random() < 0.6 else args(d + 1)) for _ in range(rng.randint(0, 3))) + "}"
    out = []
    for _ in range(1500):
        t = '<assistant>{"thought":"' + said() + ('","response":"' + said() + '"}</assistant>' if rng.random() < 0.5 else '","tool_call":{"name":"' + rng.choice(TOOLS) + '","arguments":' + args() + "}}</assistant>")
        if rng.random() < 0.6:
            for _ in range(rng.randint(1, 2)):
                i = rng.randrange(len(t) + 1)
                t = t[:i] + rng.choice(['"', "{", "}", "\\", "\n", "<user>", '"name":', "x", ""]) + t[i + rng.randint(0, 1) :]
        out.append(t[: rng.randrange(len(t) + 1)] if rng.random() < 0.05 else t)
    deep = '<assistant>{"thought":"' + "a" * 20_000 + '","tool_call":{"name":"calc","arguments":' + '{"a":' * 3000 + '"' + "}" * 2000 + '\\""' + "}" * 3000 + "}}</assistant>"
    return [*out, "", None, deep, deep + "x", deep[:-30]]


def test_verdicts_in_stretches_of_any_length(spark):
    a, all_texts = G.automaton(tuple(sorted(TOOLS))), texts()
    want = [None if t is None else plain(t) for t in all_texts]
    for stretch in (3, 7, 512):
        assert [g and g[:2] for g in G.judged(a, all_texts, stretch)] == want
    assert sum(w is not None and w[0] for w in want) > 500
    df = spark.createDataFrame(list(enumerate(all_texts)), "id int, t string").repartition(3)
    got = {r.id: r.verdict for r in G.block_verdicts(df, "t", TOOLS).collect()}
    assert [got[i] and (got[i].valid, got[i].bad_at) for i in range(len(all_texts))] == want
    assert G.block_verdicts(df.limit(0), "t", TOOLS).count() == 0


def test_mask_of_allowed_tokens():
    assert G.allowed(TOOLS, "block") == [256 + SPECIALS.index("<assistant>")]
    assert G.allowed(TOOLS, "name ") == [ord("c"), ord("n")]
    assert G.allowed(TOOLS, "name calc") == [ord('"'), ord("u")]
