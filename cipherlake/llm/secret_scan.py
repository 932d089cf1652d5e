"""Secret scans: all rules as one minimal deterministic automaton.

The rules' patterns are parsed, turned into one automaton by subset construction, minimised, and
kept as a transition array over byte classes. A batch is cut where two bytes in a row send every
state back to the start, and all pieces advance together, one byte at a time: one pass over the
bytes serves all rules and gives the places where their matches end. From an end the rule's
reversed automaton finds the leftmost start, and from there the rule's own finds the longest
match; matches of a rule don't overlap, and one whose last run is too short is dropped.

Null and empty texts have no spans. Each input row gives one row, a null id and repeated rows
included; other columns do not matter; an empty table gives none. Offsets are code points, end
exclusive. Spans of different kinds may overlap and are all reported.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text as T
from .shared import table


def _either(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_NAME = "(?:" + "|".join(map(_either, ("password", "passwd", "secret", "token"))) + "|" + _either("api") + "_?" + _either("key") + ")"


class Rule(NamedTuple):
    kind: str
    pattern: str
    least: int = 1  # characters that the run at the end of the pattern must have


#: The base kinds come first, in their listed order; the others follow. Patterns are of letters, classes, groups and repetitions.
RULES = (
    Rule("assign", _NAME + """["']?\\x20*[:=]\\x20*["']?[A-Za-z0-9+/_.=-]+""", 8),
    Rule("access", "AKIA[A-Z0-9]+", 12),
    Rule("hex", "[0-9a-f]{32,}"),
    Rule("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("code_host", "gh[pousr]_[A-Za-z0-9]+", 36),
    Rule("chat", "xox[abprs]-[A-Za-z0-9-]+", 10),
    Rule("maps_key", "AIza[A-Za-z0-9_-]+", 35),
    Rule("payment", "sk_live_[A-Za-z0-9]+", 16),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
)
BASE = 3


class Automaton(NamedTuple):
    byte_class: np.ndarray  # uint8[256]
    step: np.ndarray  # int32[states * classes], flat next-state offsets
    accept: np.ndarray  # int64[states], a bit for each rule
    reset: np.ndarray  # bool[classes, classes], after which two bytes only the start state is possible
    dead: int  # the state that nothing leads out of, or -1


def parse(pattern: str) -> tuple:
    """The tree of a pattern: ('set', bytes), ('cat', parts), ('or', parts), ('rep', part, least, most or None)."""
    at = 0

    def char() -> int:
        nonlocal at
        c = pattern[at]
        at += 1
        if c == "\\":
            c = pattern[at]
            at += 1
            if c == "x":
                at += 2
                return int(pattern[at - 2 : at], 16)
        if ord(c) > 127:
            raise ValueError(f"not an ASCII pattern: {pattern}")
        return ord(c)

    def atom() -> tuple:
        nonlocal at
        if pattern[at] == "(":
            at += 3 if pattern.startswith("(?:", at) else 1
            inner = either()
            at += 1  # the closing bracket
            return inner
        if pattern[at] == "[":
            at += 1
            chars: set[int] = set()
            while pattern[at] != "]":
                low = high = char()
                if pattern[at] == "-" and pattern[at + 1] != "]":
                    at += 1
                    high = char()
                chars.update(range(low, high + 1))
            at += 1
            return ("set", frozenset(chars))
        if pattern[at] in ".^$|)*+?{":
            raise ValueError(f"unsupported at {at}: {pattern}")
        return ("set", frozenset([char()]))

    def repeated() -> tuple:
        nonlocal at
        part = atom()
        while at < len(pattern) and pattern[at] in "*+?{":
            if pattern[at] == "{":
                end = pattern.index("}", at)
                low, _, high = pattern[at + 1 : end].partition(",")
                part = ("rep", part, int(low), int(high) if high else None if "," in pattern[at:end] else int(low))
                at = end + 1
            else:
                part = ("rep", part, *{"*": (0, None), "+": (1, None), "?": (0, 1)}[pattern[at]])
                at += 1
        return part

    def either() -> tuple:
        nonlocal at
        options: list[list[tuple]] = [[]]
        while at < len(pattern) and pattern[at] != ")":
            if pattern[at] == "|":
                at += 1
                options.append([])
            else:
                options[-1].append(repeated())
        return ("or", [("cat", x) for x in options])

    tree = either()
    if at < len(pattern):
        raise ValueError(f"unsupported at {at}: {pattern}")
    return tree


def reverse(tree: tuple) -> tuple:
    """The tree of the pattern's matches read backwards."""
    if tree[0] == "set":
        return tree
    if tree[0] == "rep":
        return ("rep", reverse(tree[1]), *tree[2:])
    parts = [reverse(x) for x in tree[1]]
    return (tree[0], parts[::-1] if tree[0] == "cat" else parts)


def shortest(tree: tuple) -> tuple:
    """The tree without what may repeat at its end: it ends where the pattern's matches first do."""
    kind, arg, *bounds = tree
    if kind == "rep":
        return (kind, arg, bounds[0], bounds[0])
    if kind == "or":
        return (kind, [shortest(x) for x in arg])
    return (kind, [*arg[:-1], shortest(arg[-1])]) if kind == "cat" and arg else tree


class _Nfa:
    def __init__(self) -> None:
        self.edges: list[list[tuple[frozenset[int], int]]] = []
        self.free: list[list[int]] = []

    def state(self) -> int:
        self.edges.append([])
        self.free.append([])
        return len(self.edges) - 1

    def add(self, tree: tuple, at: int) -> int:
        """Append a tree after state ``at``; the state in which it ends."""
        kind, arg, *bounds = tree
        end = self.state()
        if kind == "set":
            self.edges[at].append((arg, end))
            return end
        if kind == "cat":
            for part in arg:
                at = self.add(part, at)
            self.free[at].append(end)
            return end
        if kind == "or":
            for part in arg:
                self.free[self.add(part, at)].append(end)
            return end
        least, most = bounds
        for _ in range(least):
            at = self.add(arg, at)
        self.free[at].append(end)
        if most is None:
            self.free[self.add(arg, end)].append(end)
        for _ in range((most or least) - least):
            at = self.add(arg, at)
            self.free[at].append(end)
        return end

    def closure(self, states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for x in self.free[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(seen)


def compile_trees(trees: list[tuple], anywhere: bool) -> Automaton:
    """The minimal automaton that reports which trees end at a byte, begun at the first byte or anywhere."""
    nfa = _Nfa()
    start, final = nfa.state(), {}
    for bit, tree in enumerate(trees):
        begin = nfa.state()
        nfa.free[start].append(begin)
        final[nfa.add(tree, begin)] = 1 << bit
    order = sorted({chars for edges in nfa.edges for chars, _ in edges}, key=sorted)
    groups: dict[tuple[bool, ...], int] = {}
    byte_class = np.array([groups.setdefault(tuple(b in s for s in order), len(groups)) for b in range(256)], np.uint8)
    sample = {c: b for b, c in reversed(list(enumerate(byte_class.tolist())))}
    again = {start} if anywhere else set()
    first = nfa.closure({start})
    names, rows, todo = {first: 0}, [], [first]
    table: list[dict[int, set[int]]] = []
    for edges in nfa.edges:
        by: dict[int, set[int]] = {}
        for chars, to in edges:
            for c in {int(byte_class[x]) for x in chars}:
                by.setdefault(c, set()).add(to)
        table.append(by)
    for current in todo:
        row = []
        for c in range(len(sample)):
            after = nfa.closure({x for s in current for x in table[s].get(c, ())} | again)
            if after not in names:
                names[after] = len(names)
                todo.append(after)
            row.append(names[after])
        rows.append(row)
    step = np.array(rows, np.int64)
    accept = np.array([functools.reduce(int.__or__, (final.get(s, 0) for s in states), 0) for states in names], np.int64)
    # Moore's refinement: states are one if they accept the same and lead to the same
    label = np.unique(accept, return_inverse=True)[1]
    while True:
        finer = np.unique(np.column_stack([label, label[step]]), axis=0, return_inverse=True)[1].ravel()
        if finer.max() == label.max():
            break
        label = finer
    # a state for each label, numbered by where it first appears, so the start stays 0
    chosen = np.sort(np.unique(label, return_index=True)[1])
    rank = np.empty(chosen.size, np.int64)
    rank[label[chosen]] = np.arange(chosen.size)
    small = rank[label[step[chosen]]]
    accept = accept[chosen]
    after_two = small[small]  # [state, first class, second class]
    dead = np.flatnonzero((small == np.arange(small.shape[0])[:, None]).all(1) & (accept == 0))
    return Automaton(byte_class, (small * len(sample)).astype(np.int32).ravel(), accept, (after_two == 0).all(0), int(dead[0]) if dead.size and not anywhere else -1)


class Rules(NamedTuple):
    """All rules at once, for where matches first end, and each rule read forwards and backwards from a given byte."""

    every: Automaton
    onward: list[Automaton]
    back: list[Automaton]


@functools.cache
def compile_rules(rules: tuple[Rule, ...]) -> Rules:
    trees = [parse(r.pattern) for r in rules]
    return Rules(compile_trees([shortest(t) for t in trees], True), [compile_trees([t], False) for t in trees], [compile_trees([reverse(t)], False) for t in trees])


def ends(data: np.ndarray, offsets: np.ndarray, dfa: Automaton) -> tuple[np.ndarray, np.ndarray]:
    """Where matches end (after which byte), in order, and a bit for each rule that does.

    The bytes are cut where two in a row send every state back to the start; all pieces advance together."""
    if not data.size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    classes = dfa.byte_class[data]
    cut = np.zeros(data.size + 1, bool)
    cut[1:-1] = dfa.reset[classes[:-1], classes[1:]][: data.size - 1] if data.size > 1 else False
    cut = np.concatenate([[False], cut[:-1]])[: data.size + 1]
    cut[offsets] = True
    cut[0] = True
    starts = np.flatnonzero(cut[:-1])
    lengths = np.diff(np.append(starts, data.size))
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    width = int(dfa.byte_class.max()) + 1
    hot = np.zeros(dfa.step.size, bool)
    hot[np.flatnonzero(dfa.accept) * width] = True
    state = np.zeros(starts.size, np.int32)
    live = np.searchsorted(-lengths, -np.arange(int(lengths[0])), "left")
    where, which = [], []
    for at, n in enumerate(live.tolist()):
        state = dfa.step[state[:n] + classes[starts[:n] + at]]
        hit = np.flatnonzero(hot[state])
        if hit.size:
            where.append(starts[hit] + at + 1)
            which.append(dfa.accept[state[hit] // width])
    if not where:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at, bits = np.concatenate(where), np.concatenate(which)
    order = np.argsort(at)
    return at[order], bits[order]


def walk(dfa: Automaton, text: bytes, at: int, stop: int, by: int) -> tuple[int, int]:
    """From byte ``at`` on towards ``stop``: how many bytes the shortest and the longest match take; 0 if none."""
    width, classes, step = int(dfa.byte_class.max()) + 1, dfa.byte_class, dfa.step
    state = first = last = 0
    for n in range(abs(stop - at)):
        state = int(step[state + int(classes[text[at + n if by > 0 else at - 1 - n]])])
        if state == dfa.dead * width:
            break
        if dfa.accept[state // width]:
            first, last = first or n + 1, n + 1
    return first, last


def spans(text: bytes, at: list[int], bits: list[int], rules: tuple[Rule, ...], every: Rules) -> list[tuple[int, int, int]]:
    """(start, rule, end) in bytes of the matches that end as given, leftmost and longest, without overlap in a rule, in order.

    The first end of a rule belongs to its leftmost match: that is so for patterns of which no match begins inside another and ends before it can."""
    out = []
    for k, rule in enumerate(rules):
        done = 0
        for end in (e for e, b in zip(at, bits) if b >> k & 1):
            if end <= done:
                continue
            size = walk(every.back[k], text, end, done, -1)[1]
            if not size:
                continue
            least, most = walk(every.onward[k], text, end - size, len(text), 1)
            done = end - size + most
            # the run at the end of the pattern begins with the last byte of the shortest match
            if most - least + 1 >= rule.least:
                out.append((end - size, k, done))
    return sorted(out)


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, numbers of base matches, the digest of their spans, and all spans of each document."""
    every = compile_rules(rules)
    none = hashlib.sha256(b"").hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch, "text"):
                data, offsets = T.buffers(part.column("text"))
                at, bits = ends(data, offsets, every.every)
                n = part.num_rows
                counts, digests, texts = np.zeros((BASE, n), np.int64), [none] * n, [""] * n
                first = np.searchsorted(at, offsets, "right")
                for i in np.flatnonzero(np.diff(first)).tolist():
                    a, b = first[i], first[i + 1]
                    text = data[offsets[i] : offsets[i + 1]].tobytes()
                    found = spans(text, (at[a:b] - offsets[i]).tolist(), bits[a:b].tolist(), rules, every)
                    place = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])  # code points before a byte
                    named = [(k, f"{rules[k].kind}:{place[x]}:{place[y]}") for x, k, y in found]
                    for k, _ in named:
                        if k < BASE:
                            counts[k, i] += 1
                    digests[i] = hashlib.sha256(",".join(x for k, x in named if k < BASE).encode()).hexdigest()
                    texts[i] = ",".join(x for _, x in named)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, counts), pa.array(digests, pa.string()), pa.array(texts, pa.string())], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: secrets of every document."""
    return scan(table(spark, sf_dir, "documents"))
