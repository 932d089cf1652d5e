"""Plain Python versions of the operators' contracts, one text at a time, for tests."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
NONE = hashlib.sha256(b"").hexdigest()


def sha(text: str | bytes) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def held(doc_id, n: int) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % n == 2


def lm_base(rows: list[tuple]) -> list[tuple]:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score) of each (doc_id, text)."""
    listed = [(d, held(d, 7), [*WORD.findall((t or "").translate(LOW)), "\n"]) for d, t in rows]
    seen = Counter(x for _, h, tokens in listed if not h for x in tokens)
    total = sum(seen.values())
    scale = total + len(seen) + 1
    return [(d, h, len(tokens), sum(x in seen for x in tokens), total, sum(math.log10((seen[x] + 1) / scale) for x in tokens)) for d, h, tokens in listed]


def quality_base(text: str | None) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)"""
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = defaultdict(list)
    for i in range(len(words) - 2):
        windows[tuple(words[i : i + 3])].append(i)
    repeated = {i + k for places in windows.values() if len(places) > 1 for i in places for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(repeated), len(words) < 50 or 100 * len(repeated) > 50 * len(words)


def luhn(digits: str) -> bool:
    values = [int(c) for c in digits[::-1]]
    return (sum(values[::2]) + sum(sum(divmod(2 * v, 10)) for v in values[1::2])) % 10 == 0


def personal(text: str | None) -> list[tuple[str, int, int]]:
    text = text or ""
    digits = lambda s: re.sub("[^0-9]", "", s)
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(digits(s)) <= 19 and luhn(digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    ]
    return [(kind, m.start(), m.end()) for kind, pattern, ok in rules for m in re.finditer(pattern, text) if ok(m[0])]


def secrets(text: str | None) -> list[tuple[int, int, str, int]]:
    """(start, rank, kind, end) of the base spans, in order."""
    text = text or ""
    either = lambda w: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w)
    names = "|".join([*map(either, ("password", "passwd", "secret", "token")), f"{either('api')}_?{either('key')}"])
    out = [(m.start(), 0, "assign", m.end()) for m in re.finditer(rf"""({names})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 8]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


def item_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def contamination(text: str | None, items: list[tuple]) -> tuple:
    """(n_words, n_hit, n_items, items_sha256)"""
    words = item_words(text)
    at = defaultdict(list)
    for i, w in enumerate(words):
        at[w].append(i)
    hit, found = set(), set()
    for item_id, item in items:
        w = item_words(item)
        for window in [w[i : i + 10] for i in range(max(1, len(w) - 9))] if w else []:
            for i in at.get(window[0], ()):
                if words[i : i + len(window)] == window:
                    hit.update(range(i, i + len(window)))
                    found.add(str(item_id))
    return len(words), len(hit), len(found), sha(",".join(sorted(found)))


def shingles(text: str | None) -> set[tuple]:
    words = WORD.findall((text or "").translate(LOW))
    return {tuple(words[i : i + 4]) for i in range(max(1, len(words) - 3))} if words else set()


def near(rows: list[tuple]) -> dict:
    """doc_id: (n_shingles, component_id)"""
    sets = {d: shingles(t) for d, t in rows}
    where = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            where[x].append(d)
    shared = Counter((a, b) for docs in where.values() for i, a in enumerate(docs) for b in docs[i + 1 :])
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), n in shared.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {d: (len(s), find(d)) for d, s in sets.items()}
