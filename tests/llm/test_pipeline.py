"""The pipeline's stages on a small corpus: what is planted goes, the rest stays."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entries
import corpus_pipeline
from strandloom.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(12)
    text = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    rows, labels = [], []
    for i in range(400):
        t = text(rng.randrange(30, 120))
        bad = i % 8 == 0
        rows.append([i, t + (". you vile horrid nasty" if bad else "."), "en", "s", 0])
        labels.append((i, 1, int(bad)))
    passage, item = text(70), text(40)
    near = text(100).split()
    rows.append([1000, "first part " + passage + " then", "en", "s", 0])
    rows.append([1001, text(40) + " " + passage + " " + text(20), "en", "s", 0])
    for k in range(3):
        # two words differ, so that no run of 50 words is left to cut
        copy = list(near)
        for at in (20, 69):
            copy[at] = f"e{k}{at}"
        rows.append([1100 + k, " ".join(copy), "en", "s", 0])
    rows.append([1200, text(30) + " " + item + " " + text(10), "en", "s", 0])
    rows += [[1300, None, None, None, None], [1301, "", "en", "s", 0], [None, text(40), "en", "s", 0]]
    d = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame([tuple(r) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stages(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    cols, ids = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = corpus_pipeline.save(stage(spark, docs, corpus))
        ids[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == cols
            assert docs.count() <= before.count()
        if name == "line_dedup":
            cut = {r.doc_id: r for r in docs.collect()}
            assert len(cut[1000].text.split()) == 73 and len(cut[1001].text.split()) == 60
            assert cut[1001].n_chars == len(cut[1001].text) and cut[1300].text is None
    everyone = {r.doc_id for r in spark.read.parquet(f"{corpus}/documents.parquet").select("doc_id").collect()}
    gone = everyone - ids["toxicity"]
    assert {i for i in range(0, 400, 8)} - gone == set() and len(gone) <= 52
    assert ids["line_dedup"] == ids["toxicity"]
    assert ids["line_dedup"] - ids["minhash_near_dedup"] == {1101, 1102}
    assert ids["minhash_near_dedup"] - ids["benchmark_decontamination"] == {1200}
    assert ids["bpe_encode_decode"] == ids["benchmark_decontamination"]
    assert {r.doc_id for r in corpus_pipeline.run(spark, corpus).collect()} == ids["bpe_encode_decode"]


def test_an_empty_corpus(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, corpus)
    assert docs.count() == 0


def test_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 11))
    assert set(registry.QUERIES) | {"pipeline"} <= set(entries.queries())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "minhash_near_dedup", "benchmark_decontamination", "bpe_encode_decode"]


def test_one_row_of_each_group_of_near_duplicates_stays(spark):
    long = {c: " ".join(f"{c}{k}" for k in range(200)) for c in "abcdef"}
    near = {c: t + f" {c}new" for c, t in long.items()}
    rows = [
        (1, long["a"]), (None, near["a"]), (None, long["b"]), (None, near["b"]), (2, long["c"]), (2, long["c"]),
        (3, long["d"]), (4, near["d"]), (4, long["e"]), (None, long["f"]), (None, long["f"]), (None, None), (None, None),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.text and r.text[0]) for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()]
    assert sorted(got, key=str) == sorted([(1, "a"), (None, "b"), (2, "c"), (3, "d"), (4, "e"), (None, "f"), (None, None), (None, None)], key=str)


def test_columns_named_like_working_ones_stay(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet").limit(30)
    names = ["_score", "_cut", "_hits", "_h", "_doc", "_runs", "_near_id", "_near_h", "_near_out", "cut", "hits"]
    docs = corpus_pipeline.save(docs.select("*", *(F.concat(F.lit(n), F.col("doc_id").cast("string")).alias(n) for n in names)))
    want = {r.doc_id: tuple(r[n] for n in names) for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, corpus)
        assert out.columns == docs.columns, name
        assert all(tuple(r[n] for n in names) == want[r.doc_id] for r in out.collect()), name


def test_rows_are_decided_one_by_one(spark, corpus):
    near = " ".join(f"z{k}" for k in range(90))
    docs = spark.createDataFrame([(0, near), (1, near), (1, "a text of its own that nobody else has"), (None, near)], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.text[:1]) for r in corpus_pipeline.drop_near_duplicates(spark, docs, corpus).collect())
    assert got == [("0", "z"), ("1", "a")]
