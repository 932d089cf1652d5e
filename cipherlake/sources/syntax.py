"""Sources as tokens, and what names stand for in them.

A lexer for each family of languages tells names, strings and comments apart, so that a rule for
code does not fire in a comment and a name glued to others does not count. Python sources are read
by the language's own parser, which resolves imports, aliases and simple assignments.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cipherlake.sources.files import language

#: Tokens of a file at most; beyond, the file is marked as truncated.
MOST_TOKENS, ALIAS_DEPTH = 262_144, 8


class Token(NamedTuple):
    kind: str  # name, string, comment
    text: str
    start: int
    end: int


_SLASH = r"(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))"
_HASH = r"(?P<comment>\#[^\n]*)"
_STRING = r"""(?P<string>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`)"""
_NAME = r"(?P<name>[A-Za-z_$][\w$]*(?:(?:\.|::)[A-Za-z_$][\w$]*)*)"
_LEXERS = {kind: re.compile("|".join(forms), re.S) for kind, forms in {"slash": (_SLASH, _STRING, _NAME), "hash": (_HASH, _STRING, _NAME)}.items()}
FAMILY = {"python": "hash", "ruby": "hash"}


def tokens(text: str, lang: str) -> Iterator[Token]:
    """Names (with what they are qualified by), strings and comments, in order."""
    for m in _LEXERS[FAMILY.get(lang, "slash")].finditer(text):
        yield Token(m.lastgroup, m[0], m.start(), m.end())


_BINDING = re.compile(r"""\b(?:const|let|var|final|static|String|&str|auto|val)?\s*([A-Za-z_$][\w$]*)\s*(?::\s*[^=\n]{1,40})?=\s*(?:(["'])((?:\\.|(?!\2)[^\\\n])*)\2|([A-Za-z_$][\w$]*))\s*[;,\n)]""")


def bindings(text: str, lang: str) -> dict[str, str]:
    """Names bound once to a string, directly or over other names, up to a depth."""
    bare = "".join(" " * len(x.text) if x.kind == "comment" else text[x.start : x.end] for x in _with_gaps(text, lang))
    direct: dict[str, str] = {}
    alias: dict[str, str] = {}
    seen: dict[str, int] = {}
    for m in _BINDING.finditer(bare):
        seen[m[1]] = seen.get(m[1], 0) + 1
        if m[2]:
            direct[m[1]] = m[3]
        else:
            alias[m[1]] = m[4]
    once = {n for n, c in seen.items() if c == 1}
    out = {n: v for n, v in direct.items() if n in once}
    for name in alias:
        at, depth = name, 0
        while at in alias and at in once and depth < ALIAS_DEPTH:
            at, depth = alias[at], depth + 1
        if at in out and name in once:
            out[name] = out[at]
    return out


def _with_gaps(text: str, lang: str) -> Iterator[Token]:
    done = 0
    for t in tokens(text, lang):
        if t.start > done:
            yield Token("gap", text[done : t.start], done, t.start)
        yield t
        done = t.end
    if done < len(text):
        yield Token("gap", text[done:], done, len(text))


def python_calls(text: str) -> list[tuple[str, int, int]]:
    """(canonical name, line, column) of every call: imports and aliases are resolved, a rebound name is not."""
    tree = ast.parse(text)
    known: dict[str, str] = {}
    bound: dict[str, int] = {}
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            for a in node.names:
                known[a.asname or a.name.split(".")[0]] = a.name if a.asname else a.name.split(".")[0]
                bound[a.asname or a.name.split(".")[0]] = bound.get(a.asname or a.name.split(".")[0], 0) + 1
        elif isinstance(node, ast.ImportFrom):
            for a in node.names:
                known[a.asname or a.name] = f"{node.module or ''}.{a.name}"
                bound[a.asname or a.name] = bound.get(a.asname or a.name, 0) + 1
        elif isinstance(node, ast.Assign):
            for t in node.targets:
                if isinstance(t, ast.Name):
                    bound[t.id] = bound.get(t.id, 0) + 1
                    if isinstance(node.value, (ast.Name, ast.Attribute)):
                        known[t.id] = ast.unparse(node.value)
        elif isinstance(node, (ast.FunctionDef, ast.ClassDef)):
            bound[node.name] = bound.get(node.name, 0) + 1
            known.pop(node.name, None)

    def canonical(name: str) -> str:
        for _ in range(ALIAS_DEPTH):
            head, dot, rest = name.partition(".")
            if head not in known or bound.get(head, 0) != 1 or known[head] == head:
                break
            name = known[head] + dot + rest
        return name

    calls = [n for n in ast.walk(tree) if isinstance(n, ast.Call) and isinstance(n.func, (ast.Name, ast.Attribute))]
    return sorted((canonical(ast.unparse(n.func)), n.lineno, n.col_offset + 1) for n in calls)


def go_imports(text: str) -> list[tuple[str, int]]:
    """(path, line) of the import specs of a Go source; strings elsewhere are none."""
    out, block = [], False
    for at, line in enumerate(text.split("\n"), 1):
        code = line.split("//")[0].strip()
        if re.match(r"import\s*\($", code):
            block = True
        elif block and code == ")":
            block = False
        elif m := re.match(r'(import\s+)?(?:[\w.]+\s+)?"([^"]+)"$', code):
            if block or m[1]:
                out.append((m[2], at))
    return out


def constructors(text: str, lang: str, name: str) -> list[tuple[int, str]]:
    """(line, arguments) of every ``new name(...)`` outside comments and strings; arguments are simple ones."""
    bare = "".join(re.sub(r"[^\n]", " ", t.text) if t.kind in ("comment", "string") else t.text for t in _with_gaps(text, lang))
    return [(bare.count("\n", 0, m.start()) + 1, re.sub(r"\s+", " ", m[1]).strip()) for m in re.finditer(rf"\bnew\s+{re.escape(name)}\s*\(([^()]*)\)", bare)]


def template_view(text: str) -> str:
    """Template regions blanked, so that places stay."""
    return re.sub(r"\{\{.*?\}\}|\{%.*?%\}", lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.S)


class Hit(NamedTuple):
    rule_id: str
    line: int
    column: int
    match: str
    method: str


def hits(text: str, lang: str, rules: list[tuple[str, str, str]]) -> tuple[list[Hit], str]:
    """Matches of rules (id, languages, pattern) in names, strings and resolved values, each rule and span once; and how it went."""
    mine = [(i, re.compile(p)) for i, scope, p in rules if scope in ("*", "any") or lang in re.split(r"[,|; ]+", scope) or lang in ("typescript", "tsx") and "javascript" in re.split(r"[,|; ]+", scope)]
    if not mine:
        return [], "not_applicable"
    text, out, status = template_view(text), {}, "complete"
    place = lambda at: (text.count("\n", 0, at) + 1, at - (text.rfind("\n", 0, at) + 1) + 1)
    known = bindings(text, lang)
    for n, t in enumerate(tokens(text, lang)):
        if n == MOST_TOKENS:
            status = "truncated"
            break
        if t.kind == "comment":
            continue
        for rule, pattern in mine:
            for m in pattern.finditer(t.text):
                glued = t.kind == "name" and (m.start() and t.text[m.start() - 1] not in ".:" or m.end() < len(t.text) and t.text[m.end()] not in ".:")
                if not glued:
                    at = t.start + m.start()
                    out.setdefault((rule, at, t.start + m.end()), Hit(rule, *place(at), m[0], "syntax"))
            if t.kind == "name" and t.text in known and (m := pattern.search(known[t.text])) and not re.match(r"\s*(?::[^=\n]{1,40})?=[^=]", text[t.end : t.end + 60]):
                out.setdefault((rule, t.start, t.end), Hit(rule, *place(t.start), m[0], "binding"))
    if lang == "python":
        try:
            for name, line, column in python_calls(text):
                for rule, pattern in mine:
                    if m := pattern.fullmatch(name):
                        out.setdefault((rule, line, -column), Hit(rule, line, column, m[0], "call"))
        except (SyntaxError, ValueError, RecursionError):
            status = "partial"
    return sorted(out.values(), key=lambda h: (h.line, h.column, h.rule_id)), status


SCHEMA = "path string, status string, rule_id string, line int, column int, match string, method string"
_ARROW = pa.schema([(c.split()[0], pa.int32() if c.endswith(" int") else pa.string()) for c in SCHEMA.split(", ")])


def detect(files: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Hits in the sources among files (path, text); a source without hits gives one row without a rule."""
    listed = list(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                found, status = hits(r["text"], r["lang"], listed)
                rows += [(r["path"], status, *h) for h in found] or [(r["path"], status, None, None, None, None, None)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_ARROW)], schema=_ARROW)

    return files.select("path", "text", language(F.col("path")).alias("lang")).where("lang is not null and text is not null").mapInArrow(run, SCHEMA)
