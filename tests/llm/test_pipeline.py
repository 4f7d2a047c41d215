"""The pipeline's stages one by one, on the given documents and on odd ones."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from __spark_entry__ import queries

SF = "/root/testdata/sf0.01"
NAMES = dict(P.STAGES)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_order_and_registration():
    assert [name for name, _ in P.STAGES] == ["toxicity", "simhash near-dedup", "benchmark decontamination", "mixing", "sharding"]
    assert queries()["pipeline"] is P.run


def test_every_stage_takes_odd_documents(spark, documents):
    clash = {name: F.lit("mine") for name in ("score", "predicted", "epoch", "position", "tokens", "key", "doc", "salt", "component_id", "rank")}
    odd = spark.createDataFrame(
        [(None, None, None, None, None), (1, "", "en", None, 0), (2, "word " * 30_000, "en", "s", 1), (2, "word " * 30_000, "en", "s", 1), (3, None, "en", "s", 1)],
        documents.schema,
    ).withColumns(clash)
    for name, stage in P.STAGES:
        out = stage(spark, odd, SF)
        assert out.columns[: len(odd.columns)] == odd.columns
        if name not in ("simhash near-dedup", "mixing"):
            assert out.count() == odd.count()
        empty = stage(spark, odd.limit(0), SF)
        assert empty.columns == out.columns and empty.count() == 0


def test_near_copies_keep_one_of_each_group(spark, documents):
    kept = NAMES["simhash near-dedup"](spark, documents, SF)
    assert kept.select("text").distinct().count() == kept.count()
    assert kept.join(documents, "doc_id", "left_semi").count() == kept.count()


def test_near_copies_with_changed_words_go(spark, documents):
    """Copies go in which one word of 13, 17 or 31 is another; texts that share a third of their words stay."""
    texts, wanted = [], []
    for f in range(12):
        base = [f"w{f}x{n}" for n in range(60 + 30 * f)]
        texts.append(" ".join(base))
        wanted.append(texts[-1])
        for step in (13, 17, 31):
            texts.append(" ".join("other" if n % step == step - 1 else w for n, w in enumerate(base)))
        texts.append(" ".join(base[: len(base) // 3] + [f"o{f}x{n}" for n in range(len(base) * 2 // 3)]))
        wanted.append(texts[-1])
    rows = spark.createDataFrame([(n, t, "en", "s", len(t)) for n, t in enumerate(texts)], documents.schema)
    kept = [r["text"] for r in NAMES["simhash near-dedup"](spark, rows, SF).select("text").collect()]
    assert sorted(kept) == sorted(wanted)


def test_leaked_documents_go(spark, documents):
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = documents.collect()
    planted = {r["doc_id"] for r in rows if any(i in r["text"] for i in items)}
    kept = {r["doc_id"] for r in NAMES["benchmark decontamination"](spark, documents, SF).select("doc_id").collect()}
    gone = {r["doc_id"] for r in rows} - kept
    assert planted and planted <= gone and len(gone) <= 1.2 * len(planted) + 3


def test_rows_with_null_or_repeated_ids(spark, documents):
    """Copies and leaks go by row: null ids are not spared, and a clean row stays beside a leaked one of its id."""
    item = spark.read.parquet(f"{SF}/benchmark.parquet").filter("length(text) > 60").first()["text"]
    clean, other = (" ".join(f"{w}{n}" for n in range(30)) for w in ("clean", "other"))
    ids = [None, None, 7, 7, 8, 8]
    rows = lambda *texts: spark.createDataFrame([(i, t, "en", "s", 1) for i, t in zip(ids, texts)], documents.schema)
    left = NAMES["benchmark decontamination"](spark, rows(item, clean, item, other), SF).select("doc_id", "text").collect()
    assert sorted(map(tuple, left), key=str) == sorted([(None, clean), (7, other)], key=str)
    left = NAMES["simhash near-dedup"](spark, rows(clean, other, clean, clean, other, other), SF).select("doc_id", "text").collect()
    assert sorted(map(tuple, left)) == [(7, clean), (8, other)]


def test_toxic_documents_go(spark, documents):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = NAMES["toxicity"](spark, documents, SF).select("doc_id").join(labels, "doc_id")
    counts = {r["toxic"]: r["count"] for r in kept.groupBy("toxic").count().collect()}
    all_ = {r["toxic"]: r["count"] for r in labels.groupBy("toxic").count().collect()}
    assert counts.get(1, 0) <= 0.5 * all_[1] and counts[0] >= 0.98 * all_[0]


def test_mixing_leaves_nothing_out(spark, documents):
    mixed = NAMES["mixing"](spark, documents, SF)
    assert mixed.columns == documents.columns
    assert documents.exceptAll(mixed).count() == 0
