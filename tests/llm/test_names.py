"""Ids with dots, ticks and the names of an operator's own columns."""

import pytest

from tributary.llm import bpe, html, licenses, pii, quality, secrets, tokencounts

TEXT = 'Released under the MIT License. password = "hunter2xK91q" mail a@b.org'
OPERATORS = {
    "licenses": (licenses.scan, ["license", "start", "end", "edits", "substitutions", "insertions", "deletions"]),
    "secrets": (secrets.scan, ["rule", "start", "end", "checksum", "sha256"]),
    "pii": (pii.scan, ["kind", "start", "end", "disguised", "sha256"]),
    "tokencounts": (tokencounts.count, ["n_tokens"]),
    "bpe": (bpe.encode, ["tokens", "n_tokens", "round_trip"]),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_any_id_name(spark, name):
    scan, own = OPERATORS[name]
    for column in ("a.b", "a`b", "text id", "id", *own, own[0].upper()):
        df = spark.createDataFrame([("x", TEXT, 1)], "i string, t string, `start` int" if column != "start" else "i string, t string, other int").toDF(column, "the.text", "other")
        out = scan(df, id_column=column, text_column="the.text")
        want = ["_" + c if c.lower() == column.lower() else c for c in own]
        assert out.columns == [column, *want] and [r[0] for r in out.collect()] == ["x"] * out.count() and out.count() > 0


def test_page_id_names(spark):
    for column in ("a.b", "text", "N_Blocks"):
        df = spark.createDataFrame([(1, "<p>one<p>two", "x")], "i int, h string, text2 string").toDF(column, "h.t", "html")
        out = html.extract(df, id_column=column, html_column="h.t")
        assert out.columns == [column, *("_" + c if c == column.lower() else c for c in ("text", "n_blocks", "n_content"))]
        assert tuple(out.first()) == (1, "one\ntwo", 2, 2)


def test_decode_any_name(spark):
    df = bpe.encode(spark.createDataFrame([(1, "día 日本 🎉"), (2, ""), (3, None), (4, "x" * 10_000)], "doc_id int, text string")).select("doc_id", "tokens")
    for column, to in (("a.b", "text"), ("tokens", "tokens"), ("to`k", "decoded_text")):
        out = bpe.decode(df.toDF("doc_id", column), tokens_column=column, to=to)
        assert {r.doc_id: r[to] for r in out.collect()} == {1: "día 日本 🎉", 2: "", 3: None, 4: "x" * 10_000}


def test_quality_report_takes_any_name(spark):
    df = spark.createDataFrame([(1, "A sensible sentence with enough words.", "h")], "`a.b` int, `c.d` string, `e.f` string")
    assert [r.doc_id for r in quality.report(df, id_column="a.b", text_column="c.d", host_column="e.f").collect()] == [1]


def test_e_mail_of_many_labels():
    text = "to a@" + "x." * 12 + "org now"
    assert [(k, text[a:b]) for k, a, b, *_ in pii.find(text)] == [("email", text[3:-4])]
