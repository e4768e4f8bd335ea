import random

import corpus_pipeline
import pytest

from palimpsest.llm import language, secrets

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, SF)
        after.write.parquet(str(base / name))
        out.append((name, docs, spark.read.parquet(str(base / name))))
        docs = out[-1][2]
    return out


def test_stages_keep_the_columns_and_only_drop_rows(stages):
    for name, before, after in stages[:-1]:
        assert after.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        a, b = before.select("doc_id").collect(), after.select("doc_id").collect()
        assert {r.doc_id for r in b} <= {r.doc_id for r in a} and len(b) == len({r.doc_id for r in b})
        if name == "secrets":
            assert len(a) == len(b)


def test_decisions_take_effect(stages):
    by = {name: (before, after) for name, before, after in stages}
    assert by["quality"][1].count() < by["quality"][0].count()
    assert by["near_duplicates"][1].count() < by["near_duplicates"][0].count()
    assert not any(secrets.base_spans(r.text) for r in by["secrets"][1].collect())
    before, after = by["packing"]
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()}


def test_run_equals_the_stages(spark, stages):
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == sorted(tuple(r) for r in stages[-1][2].collect())


def test_queries_are_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))


def test_language_stage_rejects_what_no_machine_learned(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    rng = random.Random(1)
    odd = [
        "Это обычный русский текст о погоде и городе, который здесь никто не учил. " * 5, "这是一个没有学过的语言的文本。" * 8, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz     ") for _ in range(600)), "Ã©Ã¨Ã¼Â§Ã¶ÃŸâ‚¬Ã±Ã³ " * 10,
        "Tämä on suomenkielinen teksti, jota mallit eivät ole oppineet tuntemaan, ja se on melko pitkä. " * 3, "Ten tekst jest po polsku i nie powinien zostać rozpoznany przez maszyny uczone innych języków. " * 3,
    ]
    model = language.train(docs)
    rows = docs.unionByName(spark.createDataFrame([(10**9 + k, t, None) for k, t in enumerate(odd)], docs.schema))
    kept = {r.doc_id for r in language.keep_identified(rows, model, corpus_pipeline.LEAST_LANGUAGE_SCORE).collect()}
    assert kept == {r.doc_id for r in docs.collect()}
