"""The pipeline's stages, each against what brute force keeps of the stage before it."""

import re

from pyspark.sql import functions as F

import corpus_pipeline
from parchment.llm import decontam, quality

from .test_operators import base_secrets, components

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "secrets", "pieces"]
    at = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).persist()
        at[name] = docs
    rows = {name: {r.doc_id: r for r in df.collect()} for name, df in at.items()}
    for name in ("quality", "near_duplicates", "decontamination", "secrets"):
        assert at[name].columns == at["documents"].columns
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.train(at["documents"], labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2))
    assert set(rows["quality"]) == {r.doc_id for r in quality.score(at["documents"], model).where("predicted = 1").collect()} and 0 < len(rows["quality"]) < len(rows["documents"])
    groups = components([(i, r.text) for i, r in rows["quality"].items()], 5)
    assert set(rows["near_duplicates"]) == {i for i, (_, least) in groups.items() if i == least}
    matcher = decontam.Matcher([(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()], 0.1, 20)
    assert set(rows["decontamination"]) == {i for i, r in rows["near_duplicates"].items() if not matcher.find(r.text)}
    assert set(rows["secrets"]) == set(rows["decontamination"]) == set(rows["pieces"])
    for i, r in rows["secrets"].items():
        assert not base_secrets(r.text) and r.n_chars == len(r.text)
        if not base_secrets(rows["decontamination"][i].text) and "[SECRET]" not in r.text:
            assert r.text == rows["decontamination"][i].text
    whole = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert {i: list(r.ids) for i, r in whole.items()} == {i: list(r.ids) for i, r in rows["pieces"].items()}
    assert re.fullmatch("[0-9a-f]{64}", next(iter(whole.values())).decoded_sha256)


def test_stages_on_odd_tables(spark, tmp_path):
    fields = "doc_id long, text string, lang string, source string, n_chars long, __text string"
    good = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(30).collect()]
    rows = [(i, t, "en", "s", len(t), "x") for i, t in enumerate(good)] + [(3, good[3], "en", "s", 0, "x"), (4, good[9], None, None, None, None), (None, good[5], None, None, None, None), (77, None, None, None, None, None), (78, "", "en", "s", 0, "x"), (79, "word " * 50_000, "en", "s", 250_000, "x")]
    for name, some in (("odd", rows), ("empty", [])):
        at = f"file://{tmp_path}/{name}"
        spark.createDataFrame(some, fields).write.parquet(f"{at}/documents.parquet")
        for table in ("labels", "benchmark"):
            spark.read.parquet(f"{SF}/{table}.parquet").write.parquet(f"{at}/{table}.parquet")
        docs = spark.read.parquet(f"{at}/documents.parquet")
        for stage, f in corpus_pipeline.STAGES[:-1]:
            before = docs.count()
            docs = f(spark, docs, at).persist()
            assert docs.columns == fields.replace(" long", "").replace(" string", "").split(", ") and docs.count() <= before, stage
        kept = {(r.doc_id, r.text) for r in docs.collect()}
        assert len(kept) == docs.count() and docs.where("doc_id is null").count() <= 1
        assert corpus_pipeline.run(spark, at).count() == docs.count()
