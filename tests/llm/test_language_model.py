"""The language model against a plain version that goes bit by bit, and what it should do."""

from __future__ import annotations

import math
import os
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from cipherlake.llm import _text as T
from cipherlake.llm import context_mixing as M
from tests.llm import brute

DATA = "/root/testdata/sf0.01"


class Plain:
    """Counts of the training texts in dictionaries, and the probability of a text's known tokens, one bit after the other."""

    def __init__(self, rows):
        self.wide = max(14, 10 + 16)
        listed = [(brute.held(d, 7), self.tokens(t)) for d, t in rows]
        self.n, self.code = Counter(), {}
        self.after, self.classes = defaultdict(Counter), defaultdict(float)
        for held, (words, codes, contexts, histories) in listed:
            for w, c, x, h in zip(words, codes, contexts, histories):
                self.code[w] = c
                if not held:
                    self.n[w] += 1
                    self.after[h][c] += 1
                    for k in range(3):
                        for depth in range(M.CLASS + 1):
                            self.classes[k, x[k], depth, c >> (M.CODE - depth)] += 1
        self.total, self.kinds = sum(self.n.values()), len(self.n)
        once, twice = (sum(v == x for v in self.n.values()) for x in (1, 2))
        self.discount = min(0.95, max(0.1, once / max(once + 2 * twice, 1)))
        self.new = min(max(self.discount * self.kinds / max(self.total, 1), 1e-6), 0.5)
        self.mass = Counter()
        leaves = defaultdict(float)
        for w, v in self.n.items():
            leaves[self.code[w]] += v - self.discount
        for c, v in leaves.items():
            for depth in range(M.CODE + 1):
                self.mass[depth, c >> (M.CODE - depth)] += max(v, 0)

    def tokens(self, text):
        t = M.Tokens(*T.buffers(pa.array([text or ""])))
        words = [*brute.WORD.findall((text or "").translate(brute.LOW)), "\n"]
        return words, t.code.tolist(), list(zip(*(c.tolist() for c in t.contexts()))), t.history(self.wide).tolist()

    def weight(self, depth, prefix):
        return self.mass[depth, prefix] + M.LEAST_MASS * 2 ** (M.CODE - depth)

    def text(self, doc_id, text):
        """Natural log of the probability of the known tokens, and the words that are new."""
        held = brute.held(doc_id, 7)
        words, codes, contexts, histories = self.tokens(text)
        weights, slope, bend = M.first_mix().astype(float), np.zeros((3, 3, 5)), np.full((3, 3, 5), M.DAMPING)
        out, hits, fresh, new = 0.0, [], 0, []
        step = M.FIRST_STEP
        for i, (w, code, context, history) in enumerate(zip(words, codes, contexts, histories)):
            if i == step:
                weights = np.clip(weights + slope / bend, -0.5, 2)
                slope[:] = 0
                step *= 4
            share = (fresh + M.NEW_PRIOR * self.new) / (i + M.NEW_PRIOR)
            followers = self.after[history]
            guess, often = max(((c, v) for c, v in followers.items()), key=lambda x: (x[1], x[0]), default=(0, 0))
            whole = sum(followers.values())
            scale = max(whole / 63, 1)  # counts travel in six bits
            often, whole = round(often / scale), round(whole / scale)
            if not held:
                often, whole = often - (guess == code), whole - 1
            made = often > 0
            run = next((k for k in range(3) if len(hits) <= k or not hits[-1 - k]), 3)
            hits.append(made and guess == code)
            if self.n[w] == 0:
                out += math.log(share)
                fresh += 1
                new.append(w)
                continue
            out += math.log(1 - share)
            q = M.TRUST[min(often, 3) - 1, run] * min(often / max(whole, 1), 1) if made else 0
            state, path = (1 + (run > 0) if made else 0), 1.0
            for j in range(M.CODE):
                part = sum(j >= p for p in M.PARTS) - 1
                prefix, bit = code >> (M.CODE - j), code >> (M.CODE - 1 - j) & 1
                zero, one = self.weight(j + 1, prefix * 2), self.weight(j + 1, prefix * 2 + 1)
                x = [math.log(one / zero), 0, 0, 0, 0]
                if part == 0:
                    for k in range(3):
                        seen = [self.classes.get((k, context[k], j + 1, prefix * 2 + b), 0.0) for b in (0, 1)]
                        x[1 + k] = math.log((seen[1] + M.STRENGTH * one / (zero + one)) / (seen[0] + M.STRENGTH * zero / (zero + one)))
                x = [min(max(v, -14), 14) for v in x]
                if state:
                    plain = sum(a * b for a, b in zip(M.first_mix()[part, 0], x))
                    up = guess >> (M.CODE - 1 - j) & 1
                    before = q + (1 - q) * path
                    path *= 1 / (1 + math.exp(-plain if up else plain))
                    right = min(max((q + (1 - q) * path) / before, 1e-4), 1 - 1e-4)
                    x[4] = (1 if up else -1) * math.log(right / (1 - right))
                z = min(max(float(weights[part, state] @ x), -14), 14)
                p = 1 / (1 + math.exp(-z))
                out += math.log(p if bit else 1 - p)
                slope[part, state] += (bit - p) * np.array(x)
                bend[part, state] += p * (1 - p) * np.array(x) ** 2
                if state and up != bit:
                    state = 0
            out += math.log(self.n[w] - self.discount) - math.log(self.weight(M.CODE, code))
        return out, new


def _corpus():
    r = random.Random(5)
    words = [a + b for a in ("th", "ing", "er", "on", "qu", "Zo") for b in ("a", "e", "est", "ly", "x")]
    rows = [(k, " ".join(r.choice(words[: 10 + k % 20]) for _ in range(r.choice((0, 3, 20, 60, 300))))) for k in range(60)]
    rows += [(100 + k, rows[5 + k % 3][1] + " and a tail") for k in range(20)]
    return rows + [(200, None), (201, ""), (None, "no id here"), (7, "One id twice"), (7, "one id twice")]


def test_score_is_that_of_the_plain_mixer(spark):
    rows = _corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    plain = Plain(rows)
    known = 0
    for r in M.score(docs.where("doc_id is not null and doc_id <> 7").unionByName(docs.where("doc_id is null or doc_id = 7"))).collect():
        if r["doc_id"] is None or r["doc_id"] == 7:
            continue
        want, new = plain.text(r["doc_id"], dict(rows)[r["doc_id"]])
        if new:
            assert r["score"] * math.log(10) < want  # new words cost their spelling besides
        else:
            known += 1
            assert r["score"] * math.log(10) == pytest.approx(want, rel=2e-4, abs=2e-3), r
    assert known > 40


def test_score_does_not_depend_on_the_partitions(spark):
    rows = _corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one, many = ({(r["doc_id"], r["n_tokens"]): r["score"] for r in M.score(docs.repartition(n)).collect()} for n in (1, 7))
    assert one.keys() == many.keys()
    assert not {k: (one[k], many[k]) for k in one if one[k] != pytest.approx(many[k], rel=1e-6)}


def test_counts_of_contexts_are_exact(spark):
    """The follower that came more often is foretold, however often both came; a text that repeats another is cheap."""
    rows = [(7 * k + 1, "p q left") for k in range(300)] + [(9000 + k, "p q right") for k in range(500)]
    r = random.Random(2)
    long = [" ".join(f"w{r.randrange(5000)}" for _ in range(200)) for _ in range(60)]
    rows += [(20000 + k, t) for k, t in enumerate(long)] + [(30000, long[0]), (30001, long[1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {d["doc_id"]: d for d in M.score(docs).collect()}
    assert got[9001]["score"] > got[1]["score"]
    for copy, first in ((30000, 20000), (30001, 20001)):
        assert got[copy]["bits_per_byte"] < 0.5 * min(got[20002 + k]["bits_per_byte"] for k in range(50))
        assert got[first]["n_tokens"] == got[copy]["n_tokens"]


def test_better_than_the_base_on_held_out_texts(spark):
    if not os.path.isdir("/root/testdata/sf0.1"):
        pytest.skip("no test tables here")
    got = M.query(spark, "/root/testdata/sf0.1").where("held_out").toPandas()
    assert (got["score"] > got["base_score"]).mean() > 0.8
    assert got["score"].sum() > got["base_score"].sum()
