"""Null and repeated ids, clashing columns and very long texts, with the values that come out; secret rules against the re module."""

from __future__ import annotations

import base64
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest

from cipherlake.llm import _text as T
from cipherlake.llm import byte_bpe, decontaminate, html_extract, near_dup, pii, quality, secret_scan, toxicity
from tests.llm import brute
from tests.llm.test_contracts import FILLER, ITEM

TEXT = " ".join(FILLER * 5)
OTHER = " ".join(FILLER[::-1] * 5)


def _rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_near_duplicates_without_ids_and_with_shared_ones(spark):
    third = " ".join(f"{w}{k}" for k in range(5) for w in FILLER)
    rows = [(1, TEXT), (None, TEXT), (5, OTHER), (5, OTHER), (5, OTHER), (6, OTHER), (None, third), (None, third), (3, TEXT), (3, "something else altogether here"), (None, None), (9, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = _rows(near_dup.report(docs), "doc_id", "component_id", "kept")
    assert got == sorted([(1, 1, True), (None, 1, False), (5, 5, True), (5, 5, True), (5, 5, True), (6, 5, False), (None, None, True), (None, None, True), (3, 1, False), (3, 3, True), (None, None, True), (9, 9, True)], key=str)
    kept = _rows(near_dup.keep(docs), "doc_id", "text")
    assert kept == sorted([(1, TEXT), (5, OTHER), (None, third), (3, "something else altogether here"), (None, None), (9, "")], key=str)


def test_leaks_by_row(spark):
    rows = [(7, f"x {ITEM} y"), (7, "short"), (None, ITEM), (None, "clean"), (8, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    want = [(d, *brute.contamination(t, [(1, ITEM)])[:2]) for d, t in rows]
    for limit in (decontaminate.BROADCAST_BYTES, 0):
        assert _rows(decontaminate.contamination(docs, bench, limit=limit), "doc_id", "n_words", "n_hit") == sorted(want, key=str)
    assert _rows(decontaminate.remove(docs, bench), "doc_id", "text") == sorted([(7, "short"), (None, "clean"), (8, None)], key=str)


def test_personal_data_by_row(spark):
    rows = [(k, f"{FILLER[k % 20]} {FILLER[k * 7 % 20]} n{k}") for k in range(300)] + [(None if k % 2 else 1000 + k, f"n{k} 李明 Xanthippe R2D2 wrote x@y.example") for k in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    clean = [r["text"] for r in pii.sanitise(docs).collect()]
    assert len(clean) == len(rows)
    for text in clean:
        assert not any(x in text for x in ("Xanthippe", "李明", "R2D2", "x@y"))
    assert pii.general("R2D2") == "<NUMBER>" and pii.general("Anna") == "<NAME>" and pii.general("word") == "<WORD>"


def test_many_entities_in_one_text(spark):
    text = "\n".join(f"contact user{i}@ex.example" for i in range(20_000))
    docs = spark.createDataFrame([(1, text), (2, "clean words")], "doc_id long, text string")
    began = time.time()
    got = {r["doc_id"]: r for r in pii.report(docs).collect()}
    assert got[1]["n_email"] == 20_000 and got[2]["n_email"] == 0
    assert time.time() - began < 60


def test_byte_bpe_of_one_letter():
    import tiktoken

    with open(byte_bpe.vocabulary(), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    enc = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
    r = random.Random(1)
    for text in ["x" * 100_000, "ab" * 50_000, *("".join(r.choice("abxe tion") for _ in range(n)) for n in (1, 2, 3, 50, 500) for _ in range(50))]:
        assert byte_bpe.by_rank(text.encode(), ranks) == enc.encode_ordinary(text)


def test_clashing_columns_stay(spark):
    rows = [(k, f"{TEXT} {k}", "a", "b", "c") for k in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __text string, salt string, kept string")
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    for df in (decontaminate.remove(docs, bench), pii.sanitise(docs)):
        assert df.columns == docs.columns and df.count() == 4
    kept = near_dup.keep(docs.withColumnRenamed("__text", "n_shingles"))
    assert kept.columns == ["doc_id", "text", "n_shingles", "salt", "kept"] and kept.count() == 1


def test_pages_by_row(spark):
    page = "<body><nav>menu</nav><article>" + "".join(f"<p>{'word ' * 30}{k}.</p>" for k in range(3)) + "</article></body>"
    rows = [(1, "u", page), (1, "u", page), (None, None, page), (2, "v", None), (3, "w", ""), (4, "x", page.replace("word ", "word " * 300))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS text", "2 AS n_chars")
    got = html_extract.extract(pages).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["n_chars"] == len(r["text"]) and "menu" not in r["text"]
        assert (r["text"] == "") == (r["page_id"] in (2, 3))


def test_secrets_against_re():
    rules = secret_scan.RULES
    every = secret_scan.compile_rules(rules)
    head = {"access": 4, "code_host": 4, "chat": 5, "maps_key": 4, "payment": 8}
    group = re.compile(secret_scan._NAME + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")

    def plain(text):
        out = []
        for k, rule in enumerate(rules):
            for m in re.finditer(rule.pattern, text):
                size = len(group.match(m[0])[1]) if rule.kind == "assign" else len(m[0]) - head.get(rule.kind, 0)
                if size >= rule.least:
                    out.append((m.start(), k, m.end()))
        return sorted(out)

    r = random.Random(3)
    bits = ["password", "Secret", "token", "api_key", "apiKey", ":", "=", " ", "  ", '"', "'", "abcdefgh", "x", "AKIA", "ABCDEFGHIJKL", "0123456789", "deadbeef", "a" * 31, "b" * 32, "-----BEGIN ", "RSA ", "PRIVATE KEY-----", "ghp_", "Z" * 36, "xoxb-", "AIza", "q" * 35, "sk_live_", "eyJ", "abcdefgh.", ".", "\n", "é", "--", "_"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 40))) for _ in range(4000)] + ["a" * 50_000, "token=" + "x" * 50_000]
    data, offsets = T.buffers(pa.array(texts))
    at, fired = secret_scan.ends(data, offsets, every.every)
    first = np.searchsorted(at, offsets, "right")
    for i, text in enumerate(texts):
        raw = data[offsets[i] : offsets[i + 1]].tobytes()
        place = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
        got = secret_scan.spans(raw, (at[first[i] : first[i + 1]] - offsets[i]).tolist(), fired[first[i] : first[i + 1]].tolist(), rules, every)
        assert [(place[a], k, place[b]) for a, k, b in got] == plain(text), text


def test_learning_takes_one_text_for_an_id(spark):
    docs = spark.createDataFrame([(k % 40, f"{TEXT} {'you idiot' if k % 2 else 'fine'} {k}") for k in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in range(40)], "doc_id long, quality int, toxic int")
    assert quality.keep(docs, quality.learn(docs, labels)).columns == docs.columns
    assert toxicity.rate(docs, toxicity.learn(docs, labels)).count() == 400


def test_toxicity_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    try:
        docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    except Exception:
        pytest.skip("no test tables here")
    got = toxicity.rate(docs, toxicity.learn(docs, labels)).join(labels, "doc_id").where("held_out").toPandas().dropna(subset=["toxic"])
    hit = ((got["predicted"] == 1) & (got["toxic"] == 1)).sum()
    # about a quarter of the labels 1 stand on texts without any sign of it
    assert hit / (got["toxic"] == 1).sum() > 0.65 and hit / max((got["predicted"] == 1).sum(), 1) > 0.95


def test_recall_at_the_threshold(spark):
    """Pairs just above the similarity are found, and none below it."""
    r = random.Random(9)
    rows, want = [], {}
    for k in range(150):
        words = [f"w{r.randrange(10**6)}" for _ in range(203)]
        other = list(words)
        other[: 22 if k % 2 else 24] = [f"v{r.randrange(10**6)}" for _ in range(22 if k % 2 else 24)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
        a, b = ({tuple(x[i : i + 4]) for i in range(200)} for x in (words, other))
        want[2 * k + 1] = 100 * len(a & b) >= 80 * len(a | b)
    got = {x["doc_id"]: x["component_id"] == x["doc_id"] - 1 for x in near_dup.report(spark.createDataFrame(rows, "doc_id long, text string")).collect() if x["doc_id"] % 2}
    assert got == want and any(want.values()) and not all(want.values())


def test_divided_buckets_lose_nothing(spark, monkeypatch):
    """With every bucket treated as large the links are those of the plain version."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    monkeypatch.setattr(near_dup, "LARGE", 1)
    want = brute.near([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dup.report(docs).collect()} == want


def test_pages_of_the_table(spark):
    """Every page's text is that of a plain reader of its article."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__()
            self.open, self.out = [], []

        def handle_starttag(self, tag, attrs):
            if tag not in ("meta", "br"):
                self.open.append((tag, dict(attrs).get("class") or ""))
            self.out.append(" ") if tag not in ("b", "a") else None

        def handle_endtag(self, tag):
            while self.open and self.open.pop()[0] != tag:
                pass
            self.out.append(" ") if tag not in ("b", "a") else None

        def handle_data(self, data):
            tags = {t for t, _ in self.open}
            if "article" in tags and not tags & {"script", "style", "nav", "footer", "aside", "form"} and not {c for _, c in self.open} & {"ad", "comments"}:
                self.out.append(data)

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r["text"] for r in html_extract.extract(pages).collect()}
    for r in pages.collect():
        reader = Reader()
        reader.feed(r["html"] or "")
        assert got[r["page_id"]] == " ".join("".join(reader.out).split()), r["page_id"]
