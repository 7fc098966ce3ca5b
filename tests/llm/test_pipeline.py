"""The pipeline's stages on a small folder of tables."""

import random

import pytest

import corpus_pipeline


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    rng = random.Random(12)
    text = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    item = text(40)
    rows = [(i, text(80), f"s{i % 12}") for i in range(300)]
    rows += [(300 + i, f"{text(30)} vile rotten {text(30)}", f"s{i % 12}") for i in range(150)]
    near = text(100)
    rows += [(500 + i, f"{near} e{i}", f"s{i % 12}") for i in range(20)]
    rows += [(600, f"{text(30)} {item} {text(20)}", "s1"), (601, None, None), (602, "", "s2")]
    at = tmp_path_factory.mktemp("tables")
    docs(rows).write.parquet(f"{at}/documents.parquet")
    labels = [(i, 1, int(300 <= i < 450)) for i in range(450) if i % 2]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at), rows


def test_stages_keep_and_drop(spark, folder):
    at, rows = folder
    table = spark.read.parquet(f"{at}/documents.parquet")
    kept = {name: {r.doc_id for r in stage(spark, table, at).collect()} for name, stage in corpus_pipeline.STAGES}
    every = {r[0] for r in rows}
    clean = set(range(300)) | {601, 602}
    assert clean <= kept["toxicity"] and len(kept["toxicity"] & set(range(300, 450))) < 8
    assert kept["line dedup"] == every
    assert kept["n-gram join"] == every - set(range(501, 520))
    assert kept["benchmark decontamination"] == every - {600}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, table, at).columns == table.columns


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder[0])
    ids = {r.doc_id for r in out.collect()}
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "copy_no", "mix_order"]
    assert 600 not in ids and len(ids & set(range(500, 520))) <= 1
