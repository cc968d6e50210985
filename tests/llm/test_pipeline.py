"""The pipeline on a small corpus with one case for each stage."""

import random

import pytest


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    r = random.Random(4)
    plain = [f"plain{k}" for k in range(300)]
    noise = lambda n: " ".join(r.choice(plain) for _ in range(n))
    item = " ".join(f"q{k}" for k in range(30))
    rows, labels = [], []
    for i in range(600):
        toxic = i % 4 == 0
        text = noise(40) + (" grumbleworth" if toxic else "")
        rows.append((i, text, "en", f"s{i % 5}", len(text)))
        if i % 2 == 0:
            labels.append((i, 1, int(toxic)))
    base = noise(60)
    rows += [(1000 + i, base + (" end" if i else ""), "en", "s0", len(base)) for i in range(3)]
    rows += [(2000, f"{noise(20)} {item}", "en", "s1", 0), (2001, f"{noise(20)} mail ann.lee7@mail.example.com", "en", "s1", 0), (2002, None, None, None, None)]
    at = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def test_stages(spark, corpus, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    columns, ids = docs.columns, [{r[0] for r in docs.select("doc_id").collect()}]
    assert len(corpus_pipeline.STAGES) == 5
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, corpus).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert docs.columns[: len(columns)] == columns
        if k < 4:
            assert docs.columns == columns
        ids.append({r[0] for r in docs.select("doc_id").collect()})
    assert ids[0] - ids[1] == {i for i in range(600) if i % 4 == 0}
    assert ids[1] - ids[2] == {1001, 1002}
    assert ids[2] - ids[3] == {2000}
    assert ids[3] == ids[4]
    mail = spark.read.parquet(f"{tmp_path}/3").filter("doc_id = 2001").first()["text"]
    assert "ann.lee7@" not in mail and "@mail.example.com" in mail
    whole = corpus_pipeline.run(spark, corpus)
    assert sorted(map(str, whole.collect())) == sorted(map(str, docs.collect()))


def test_empty_corpus(spark, corpus, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{corpus}/documents.parquet").limit(0)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, corpus).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert docs.count() == 0
