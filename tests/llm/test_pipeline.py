"""The pipeline's stages on a small corpus: what each takes out, and what stays."""

import random

import corpus_pipeline as cp
import pyarrow as pa
import pytest


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    text = lambda n: " ".join(word() for _ in range(n))
    item = text(20)
    rows = []
    for i in range(200):
        toxic = i % 4 == 1
        rows.append((i, text(40) + (" slurword vileword" if toxic else ""), "en", "s", 0))
    base = rows[2][1]
    rows += [(300, base, "en", "s", 0), (301, base + " extra", "en", "s", 0), (302, text(30) + " " + item + " " + text(10), "en", "s", 0), (303, text(9) + " mail a.b@c.org", "en", "s", 0), (304, None, None, None, None), (305, text(3000), "en", "s", 0)]
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(folder + "/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 1)) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(folder + "/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(folder + "/benchmark.parquet")
    return folder, rows


def test_stages(spark, corpus):
    folder, rows = corpus
    docs = spark.read.parquet(folder + "/documents.parquet")
    stages = dict(cp.STAGES)
    assert list(stages) == ["toxicity", "jaccard_join", "decontamination", "pii", "packing"]
    ids = lambda df: {x["doc_id"] for x in df.select("doc_id").collect()}
    clean = stages["toxicity"](spark, docs, folder)
    assert clean.columns == docs.columns and ids(clean) == {i for i, *_ in rows if i >= 200 or i % 4 != 1}
    single = stages["jaccard_join"](spark, docs, folder)
    assert ids(docs) - ids(single) == {300, 301} and single.count() == len(rows) - 2
    kept = stages["decontamination"](spark, docs, folder)
    assert ids(docs) - ids(kept) == {302}
    masked = {x["doc_id"]: x for x in stages["pii"](spark, docs, folder).collect()}
    assert masked[303]["text"].endswith("mail [EMAIL]") and masked[303]["n_chars"] == len(masked[303]["text"]) and masked[304]["text"] is None
    assert all(masked[i]["text"] == t for i, t, *_ in rows if i != 303)
    out = cp.run(spark, folder).collect()
    assert {x["doc_id"] for x in out} == {i for i, *_ in rows if i >= 200 or i % 4 != 1} - {300, 301, 302}


def test_empty_input(spark, corpus):
    folder, _ = corpus
    docs = spark.read.parquet(folder + "/documents.parquet").where("false")
    for _, stage in cp.STAGES:
        assert stage(spark, docs, folder).collect() == []


@pytest.mark.parametrize("name", ["toxicity", "jaccard_join", "pii", "packing"])
def test_batches_are_small(spark, corpus, name):
    """A task holds little of its rows at a time, however long the texts are."""
    folder, _ = corpus
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(limit)
    dict(cp.STAGES)[name](spark, spark.read.parquet(folder + "/documents.parquet"), folder)
    long_rows = spark.range(0, 9_000, 1, 1).selectExpr("id", "repeat('x', 2000) as text")  # 18 MB, under 10,000 rows
    sizes = lambda batches: (pa.record_batch([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "size"]) for b in batches)
    got = long_rows.mapInArrow(sizes, "n long, size long").collect()
    assert sum(x["n"] for x in got) == 9_000 and max(x["size"] for x in got) < 1.1 * cp.BATCH_BYTES
    spark.conf.set(limit, 1 << 20)  # who asks for less gets less
    cp.small_batches(spark)
    assert spark.conf.get(limit) == str(1 << 20)
    spark.conf.unset(limit)
