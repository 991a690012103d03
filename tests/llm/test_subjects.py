import random
import re

import pytest
import regex
from hypothesis import given, settings, strategies as st

from gridloom.llm import subjects
from gridloom.llm.pages import decode, paragraphs
from gridloom.llm.subjects import subjects_of

COMMON = "the a plan list was with of result left morning".split()
WORDS = {s: [f"{s}{c}{d}" for c in "abcdef" for d in "xy"] for s in ("law", "food", "sport", "none")}
DOCS = "doc_id bigint, lang string, raw_bytes binary, text string, subject string"


def page(r, topics, menu="law food sport"):
    body = [" ".join(r.sample(COMMON, 4) + (r.sample(WORDS[t], 4) if t else [])) for t in topics]
    html = f"<html><body><nav><a>{menu}</a></nav>" + "".join(f"<p>{b}</p>" for b in body) + "<ul><li>lawax foodby</li></ul><footer>sportax sportby</footer></body></html>"
    return html.encode(), "\n".join(body)


def corpus(n, seed=3):
    r = random.Random(seed)
    docs, truth = [], {}
    for i in range(n):
        topics = [t for t in r.choice([["law"] * 3, ["food"] * 4, ["sport"] * 2 + ["food"], ["law", "law", "sport"], ["none"] * 3, [None, None]])]
        raw, text = page(r, topics)
        docs.append((i, "en", bytearray(raw), text, "clash"))
        truth[i] = {t for t in topics if t in ("law", "food", "sport")}
    return docs, truth


def test_held_out_accuracy(spark, monkeypatch):
    monkeypatch.setattr(subjects, "RANK", 8)
    docs, truth = corpus(400)
    extra = [(1000, None, None, None, ""), (1001, "en", bytearray(b"\xff\xfe\x00junk"), "   ", ""), (1002, "en", bytearray(b"<html></html>"), "x", ""), (None, "en", bytearray(b"<p>lawax lawbx</p>"), "t", "")]
    labels = [(i, s, "r") for i in range(0, 160) for s in (truth[i] or {"none"})] + [(3, "unknown", "r"), (99999, "law", "r"), (None, "law", "r"), (4, None, "r")]
    got = subjects_of(spark.createDataFrame(docs + extra, DOCS), spark.createDataFrame(labels, "doc_id bigint, subject string, text string"), ["food", "law", "sport"])
    rows = got.collect()
    assert len(rows) == len({(x.doc_id, x.subject) for x in rows})
    found = {(x.doc_id, x.subject) for x in rows}
    want = {(i, s) for i, t in truth.items() for s in t if i >= 160}
    held = {x for x in found if x[0] >= 160}
    assert len(held & want) / len(want) > 0.95 and len(held & want) / len(held) > 0.95


@pytest.mark.parametrize("docs,labels", [(0, 0), (20, 0), (0, 20)])
def test_empty(spark, docs, labels):
    rows, truth = corpus(20)
    df = spark.createDataFrame(rows[:docs], DOCS)
    lab = spark.createDataFrame([(i, "law") for i in range(labels)], "doc_id bigint, subject string")
    assert subjects_of(df, lab, ["law"]).count() == 0


@given(st.text(st.characters(max_codepoint=127), max_size=60))
@settings(max_examples=300, deadline=None)
def test_words_of_ascii_text(text):
    assert re.findall(subjects.ASCII_WORD, text.lower()) == regex.findall(subjects.WORD, text.lower())


def test_pages():
    raw = "<html><nav><a>menu</a></nav><h1>T</h1><p class='c'>Öl &amp; <b>Salz</b></p><div>zwei</div><ul><li><p>no</p></li></ul><footer><p>no</p></footer></html>"
    assert paragraphs(raw.encode(), "t") == ["Öl &  Salz", "zwei"]
    assert paragraphs(raw.encode("cp1252"), "t")[0] == "Öl &  Salz"
    assert paragraphs(raw.encode(), " \n") == paragraphs(raw.encode(), None) == []
    assert paragraphs(None, "a b c d e f\nshort") == ["a b c d e f"]
    assert decode("<p>список и часть</p>".encode("cp1251")) == "<p>список и часть</p>"
    assert decode("<p>漢字とかな</p>".encode("shift_jis")) == "<p>漢字とかな</p>"
    assert decode("<p>ñandú</p>".encode("utf-8")) == "<p>ñandú</p>"
