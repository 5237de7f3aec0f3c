"""Nulls, empty and long texts, repeated rows, empty tables and extra columns with clashing names, for every operator."""

import pytest

from lodestone.llm import decontamination, gif, html, jaccard, packing, pii, quotes, secrets, suffixes, toxicity

LONG = "lorem ipsum dolor sit amet " * 1500
DOCS = [(1, "plain words of a short text here", "en"), (1, "plain words of a short text here", "en"), (2, None, None), (None, "", "x"), (None, None, None), (3, LONG, "en"), (4, LONG, "en"), (5, "\x00 ퟿ é token: AAAABBBBCCCC1 a@b.co", "")]
#: Names that the operators use inside, and one that differs from `text` in case alone.
CLASH = ("row", "spans", "entry", "length", "TEXT", "rank", "score", "tokens")

OPERATORS = {
    "suffixes": (suffixes.digests, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "repeated"]),
    "secrets": (secrets.secrets, ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]),
    "packing": (packing.pack_documents, ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]),
    "jaccard": (jaccard.classes, ["doc_id", "class_id", "n_links"]),
    "pii": (pii.report, ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]),
    "gif": (gif.digests, ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]),
}


def docs(spark, rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    names = [*df.columns, *CLASH]
    return df.select("*", *[F.lit(i) for i, _ in enumerate(CLASH)]).toDF(*names)


@pytest.fixture(scope="module")
def edge_docs(spark):
    spark.conf.set("spark.sql.caseSensitive", "false")
    return docs(spark, DOCS)


@pytest.mark.parametrize("name", OPERATORS)
def test_documents(spark, edge_docs, name):
    run, columns = OPERATORS[name]
    out = run(edge_docs)
    assert out.columns == columns
    rows = out.collect()
    if name != "packing":
        assert sorted((r[0] is None, r[0] or 0) for r in rows) == sorted((d[0] is None, d[0] or 0) for d in DOCS)
        twins = [tuple(r) for r in rows if r[0] == 1]
        assert twins[0] == twins[1]
    else:
        assert sum(r["piece"] == 0 for r in rows) == len(DOCS)
    empty = run(docs(spark, []))
    assert empty.columns == columns and empty.collect() == []


def test_jaccard_edges(edge_docs):
    got = sorted((tuple(r) for r in jaccard.classes(edge_docs).collect()), key=repr)
    assert got.count((1, 1, 1)) == 2 and (3, 3, 1) in got and (4, 3, 1) in got and (2, 2, 0) in got and got.count((None, None, 0)) == 2


def test_suffix_edges(edge_docs):
    got = {r["doc_id"]: r for r in suffixes.digests(edge_docs).collect() if r["doc_id"]}
    assert got[3]["n_removed"] == got[4]["n_removed"] == len(LONG) and got[3]["n_spans"] == 1 and got[2]["n_bytes"] == 0
    assert [got[i]["repeated"] for i in (1, 2, 3, 4)] == [0, 0, 1, 1]


def test_toxicity_edges(spark, edge_docs):
    labels = spark.createDataFrame([(1, 0), (2, None), (None, 1), (3, 1), (3, 0)], "doc_id long, toxic int")
    for l in (labels, labels.where("false")):
        rows = toxicity.scores(edge_docs, l).collect()
        assert len(rows) == len(DOCS) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert toxicity.scores(docs(spark, []), labels).collect() == []


def test_decontamination_edges(spark, edge_docs):
    bench = spark.createDataFrame([(7, "plain words of a short text here"), (6, "Plain words of a SHORT text here!"), (8, None), (9, "too short"), (None, None)], "item_id long, text string")
    rows = decontamination.contamination(edge_docs, bench).collect()
    assert len(rows) == len(DOCS) and [(r["doc_id"], r["items"]) for r in rows if r["contaminated"]] == [(1, "6"), (1, "6")]
    assert not any(r["contaminated"] for r in decontamination.contamination(edge_docs, bench.where("false")).collect())
    assert decontamination.contamination(docs(spark, []), bench).collect() == []


def test_html_edges(spark):
    schema = "page_id long, url string, html string, row int, TEXT int"
    pages = spark.createDataFrame([(1, None, None, 0, 0), (None, "http://a/", "", 0, 0), (2, "http://a/x", "<p>x" * 3000, 0, 0), (3, "u", "no markup &amp; all", 0, 0), (3, "u", "no markup &amp; all", 0, 0)], schema)
    got = sorted((tuple(r) for r in html.extract(pages).collect()), key=repr)
    assert (1, None, "", 0) in got and (None, "http://a/", "", 0) in got and got.count((3, "u", "no markup & all", 15)) == 2
    assert (2, "http://a/x", "\n".join("x" * 3000), 5999) in got
    assert html.extract(pages.where("false")).collect() == []


def test_quotes_edges(spark):
    schema = "conv_id long, turn long, role string, text string, conv int, AT int"
    conv = spark.createDataFrame([(None, None, None, None, 0, 0), (1, 0, "user", "", 0, 0), (1, 0, "user", "", 0, 0), (1, None, None, "> > > x", 0, 0)], schema)
    got = quotes.threads(conv).collect()
    assert len(got) == 4 and sorted(r["position"] for r in got if r["conv_id"] == 1) == [1, 2, 3]
    assert quotes.threads(conv.where("false")).collect() == []
