"""The stages one after the other on the smallest tables, each on what the one before kept."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidewell.llm import decontam, toxicity
from tidewell.llm.lineage import stored

DATA = Path("/root/testdata/sf0.001")
with_tables = pytest.mark.skipif(not DATA.is_dir(), reason="no test tables")


@with_tables
def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels, bench = (spark.read.parquet(f"{DATA}/{n}.parquet") for n in ("labels", "benchmark"))
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "minhash_near_dedup", "suffix_array_dedup", "decontamination", "byte_bpe"]
    schema, before = docs.schema, docs
    for name, stage in corpus_pipeline.STAGES:
        after = stored(stage(spark, before, str(DATA)), name)
        assert 0 < after.count() <= before.count()
        if name == "byte_bpe":
            assert after.count() == before.count() and after.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            break
        assert after.schema == schema
        if name == "toxicity":
            ok = {r["doc_id"] for r in toxicity.toxicity(before, labels).where("predicted = 0").collect()}
            assert {r["doc_id"] for r in after.collect()} == ok
        if name == "decontamination":
            hit = {r["doc_id"] for r in decontam.find(before, bench).collect()}
            assert {r["doc_id"] for r in after.collect()} == {r["doc_id"] for r in before.collect()} - hit
        before = after


@with_tables
def test_run_is_the_stages(spark):
    out = corpus_pipeline.run(spark, str(DATA))
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 100


def small_tables(spark, folder, docs, labels, items):
    docs = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars int")
    docs = docs.withColumns({k: F.lit(v) for k, v in {"part": 1, "z": 2, "digest": 3, "key": 4, "score": 5, "comp": 6, "c0": 7}.items()})
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


def test_nulls_repeats_and_clashing_names(spark, tmp_path):
    rng = random.Random(1)
    item, passage, long = words(rng, 30), words(rng, 40), words(rng, 4000)
    docs = [(k, words(rng, 60), "xx", "s", 1) for k in range(40)]
    docs += [(100, None, None, None, None), (101, "", "xx", "s", 0), (None, words(rng, 50), "xx", "s", 1), (None, None, None, None, None), (102, " .,", "xx", "s", 3)]
    docs += [(103, long, "xx", "s", 1), (104, long, "xx", "s", 1), (0, docs[0][1], "xx", "s", 1), (0, words(rng, 60), "xx", "s", 1)]
    docs += [(105, words(rng, 30) + " " + item + " " + words(rng, 30), "xx", "s", 1)]
    docs += [(110 + k, words(rng, 30) + " " + passage + " " + words(rng, 30), "xx", "s", 1) for k in range(3)]
    sf = small_tables(spark, tmp_path / "t", docs, [(k, 1, 0) for k in range(40)] + [(None, None, None), (5, 0, None)], [(1, item), (2, None), (3, "")])
    before = spark.read.parquet(f"{sf}/documents.parquet")
    got = {}
    for name, stage in corpus_pipeline.STAGES:
        after = stored(stage(spark, before, sf), name)
        if name != "byte_bpe":
            assert after.schema == before.schema
            assert all(r["part"] == 1 and r["z"] == 2 and r["c0"] == 7 for r in after.collect())
        got[name] = [r["doc_id"] for r in after.collect()]
        before = after
    assert len(got["toxicity"]) == len(docs)  # labels of one kind reject nothing
    kept = got["minhash_near_dedup"]
    assert 103 in kept and 104 not in kept and kept.count(0) == 1 and kept.count(None) == 2
    assert set(got["minhash_near_dedup"]) == set(got["suffix_array_dedup"])
    assert set(got["suffix_array_dedup"]) - set(got["decontamination"]) == {105}
    assert sorted(map(str, got["byte_bpe"])) == sorted(map(str, got["decontamination"]))
    out = corpus_pipeline.run(spark, sf)
    assert sorted(str(r["doc_id"]) for r in out.collect()) == sorted(map(str, got["byte_bpe"]))


def test_empty_tables(spark, tmp_path):
    sf = small_tables(spark, tmp_path / "t", [], [], [])
    assert corpus_pipeline.run(spark, sf).isEmpty()
