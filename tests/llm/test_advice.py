"""Cases that a review found."""

from __future__ import annotations

from cipherlake.llm import decontaminate, html_extract, pii
from tests.llm.test_contracts import FILLER, ITEM


def _line(k: int, size: int) -> str:
    return f"{k}." + "x" * (size - len(f"{k}."))


def test_html_every_body_without_a_mark():
    """A huge block moves no bound, short closing paragraphs stay, and what lies between two bodies goes."""
    for sizes in ([500] * 20 + [1_000_000], [30, 300, 300, 300, 35, 38]):
        listed = [_line(k, n) for k, n in enumerate(sizes)]
        assert html_extract.main_text("<body>" + "".join(f"<p>{x}</p>" for x in listed) + "</body>") == " ".join(listed)
    listed = [_line(k, n) for k, n in enumerate([300] * 3 + [10] * 50 + [300] * 3)]
    got = html_extract.main_text("<body>" + "".join(f"<div>{x}</div>" for x in listed) + "</body>").split(" ")
    assert got[:3] == listed[:3] and got[-3:] == listed[-3:] and len(got) <= 10


def test_html_marked_article_is_read_by_windows():
    """Inside a mark the sums decide as well, and a mark without a surge does not hide the body beside it."""
    text = [_line(k, 300) for k in range(6)]
    counter = "".join(f"<div>{k}</div>" for k in range(10, 60))
    page = "<article>" + "".join(f"<p>{x}</p>" for x in text[:3]) + counter + "".join(f"<p>{x}</p>" for x in text[3:]) + "</article>"
    got = html_extract.main_text(page).split(" ")
    assert [x for x in got if len(x) > 2] == text and len(got) <= 10
    assert html_extract.main_text("<article><p>Loading</p></article>" + "".join(f"<p>{x}</p>" for x in text)).endswith(" ".join(text))
    assert html_extract.main_text("<article><p>Loading</p></article>") == "Loading"


def _padded(k: int, text: str) -> str:
    return text + " " + " ".join(f"{FILLER[(k + i) % 20]}" for i in range(20))


def test_terms_of_rare_entities(spark):
    """An entity in one text, or in its copies only, has disclosing terms; a copy does not make them surer."""
    rows = [(k, _padded(k, f"row{k % 97} wrote")) for k in range(3000)]
    rows += [(9000 + k, _padded(0, "Xanthippe wrote to x@y.example about")) for k in range(3)]
    rows = [(k, f"{text} n{k if k < 9000 else 9000}") for k, text in rows]
    spans = {r["doc_id"]: r["spans"] for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(spans[k] == "" for k in range(3000))
    assert all("term:0:9" in spans[9000 + k].split(",") and "term:10:15" not in spans[9000 + k].split(",") for k in range(3))


def test_terms_anywhere_in_the_document(spark):
    """A disclosing term goes in every document that holds the entity, also far from it, and where the id is null."""
    rows = [(k, _padded(k, f"wrote n{k}")) for k in range(400)]
    rows += [(1000 + k, f"z{k} Xanthippe sent x@y.example") for k in range(6)]
    rows += [(2000, "Xanthippe " + _padded(3, "") + " x@y.example"), (None, "x@y.example " + _padded(5, "") + " Xanthippe")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for r in pii.sanitise(docs).collect():
        assert "Xanthippe" not in r["text"] and "x@y" not in r["text"]


def test_leaks_without_an_id(spark):
    """A row without an id has the hits of its own text, and those alone."""
    rows = [(None, f"x {ITEM} y"), (None, "nothing of the sort"), (None, None), (1, ITEM), (2, "clean")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    got = sorted((r["n_words"], r["n_hit"] > 0, r["n_items"], r["contaminated"]) for r in decontaminate.contamination(docs, bench).where("doc_id is null").collect())
    assert got == [(0, False, 0, False), (4, False, 0, False), (17, True, 1, True)]
    assert sorted(str(r["text"]) for r in decontaminate.remove(docs, bench).collect()) == ["None", "clean", "nothing of the sort"]
