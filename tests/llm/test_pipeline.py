"""The corpus pipeline: what each stage does to planted cases, each judged on its own input."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from coverwell.llm.common import staged

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghijklm") for _ in range(r.randint(2, 8)))
    prose = lambda n: "\n".join(" ".join(word() for _ in range(12)) for _ in range(n))
    item = " ".join(word() for _ in range(25))
    clean = [(i, prose(r.randint(4, 12))) for i in range(80)]
    junk = [(200 + i, "$%& " * (30 + i)) for i in range(5)] + [(210, "too short")]
    lines = [(300 + i, prose(5) + "\nsubscribe to our letter today\n" + prose(5)) for i in range(12)]
    near = [(400, prose(20))]
    near.append((401, near[0][1].rsplit(" ", 1)[0] + " changed"))
    leak = [(500, prose(4) + "\n" + item + "\n" + prose(4))]
    rows = [(i, t, "en", r.choice("ab"), len(t)) for i, t in clean + junk + lines + near + leak]
    folder = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), {i for i, _ in clean}, {i: t for i, t, *_ in rows}


def test_stages(spark, world):
    folder, clean, texts = world
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, folder), "test")
        seen.append((name, {x.doc_id for x in docs.select("doc_id").collect()}, docs))
    ids = [s[1] for s in seen]
    assert not ids[0] & {200, 201, 202, 203, 204, 210} and clean <= ids[0]
    assert ids[1] == ids[0]
    holds = seen[1][2].where(F.col("text").contains("subscribe to our letter")).select("doc_id").collect()
    assert [x.doc_id for x in holds] == [300]
    assert ids[1] - ids[2] == {401}
    assert ids[2] - ids[3] == {500} and clean <= ids[3]
    assert seen[3][2].columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert {"copies", "taken"} <= set(seen[4][2].columns) and ids[4] <= ids[3]


def test_run(spark, world):
    folder, *_ = world
    assert corpus_pipeline.run(spark, folder).count() > 0


def test_stages_on_empty_tables(spark, world):
    folder, *_ = world
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, folder), "empty")
        assert docs.count() == 0


def test_stages_on_awkward_rows(spark, world):
    folder, *_ = world
    rows = [(1, None, None, None, None), (None, None, "en", "a", 0), (None, "", None, "a", 0), (2, "x " * 50, "en", None, 100), (2, "x " * 50, "en", None, 100)]
    docs = spark.createDataFrame(rows, DOCS)
    for _, stage in corpus_pipeline.STAGES:
        staged(stage(spark, docs, folder), "awkward").count()
