import numpy as np
import pytest
from odd import CLASH
from pyspark.sql import functions as F

from layerloom.llm import quality_classifier as qc
from layerloom.llm import quality_rules as qr
from layerloom.llm._spark import held_out
from layerloom.llm._stats import RATIOS, labelled_ratios, ratios, with_counts

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")


@pytest.fixture(scope="module")
def sample(tables):
    return labelled_ratios(*tables, "quality", 5000)


def test_sample_leaves_the_fold_out(tables, sample):
    x, y = sample
    documents, labels = tables
    assert len(x) == labels.filter(~held_out("doc_id")).count() and x.shape[1] == len(RATIOS)
    assert len(labelled_ratios(documents, labels, "quality", 50)[1]) == 50
    nulls = labels.selectExpr("cast(null as bigint) as doc_id", "quality", "toxic").unionByName(labels.selectExpr("doc_id", "cast(null as int) as quality", "toxic"))
    assert len(labelled_ratios(documents, nulls, "quality", 50)[1]) == 0


def test_classifier_on_the_fold(tables, sample):
    documents, labels = tables
    model = qc.learn(*sample)
    assert 0 < len(model.rules) < 200 and all(1 <= len(p) <= qc.DEPTH for p, _ in model.rules)
    scored = qc.quality_scores(documents.select("doc_id", "text"), model).select("row.doc_id", "score", "predicted")
    assert scored.count() == documents.count()
    rows = scored.join(labels, "doc_id").filter(held_out("doc_id")).collect()
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)


def test_column_equals_numpy(tables, sample):
    model = qc.learn(*sample)
    counted = with_counts(tables[0].select("doc_id", "text").limit(200), "text")
    rows = counted.select(model.column().alias("score"), *[c.alias(k) for k, c in ratios().items()]).toPandas()
    assert np.allclose(rows["score"], model.score(rows[list(RATIOS)].to_numpy(float)))


def test_degenerate_samples(docs):
    empty = np.zeros((0, len(RATIOS)))
    assert qc.learn(empty, np.zeros(0, int)).score(np.zeros((1, len(RATIOS))))[0] == 0.5
    some = np.random.default_rng(1).random((20, len(RATIOS)))
    assert qc.learn(some, np.ones(20, int)).score(some)[0] > 0.9
    assert qc.learn(np.zeros((20, len(RATIOS))), np.arange(20) % 2).rules == ()
    assert qr.learn(empty, np.zeros(0, int)) == [] and qr.learn(some, np.ones(20, int)) == []
    scored = qc.quality_scores(docs([(1, None), (2, "")], CLASH), qc.learn(some, np.ones(20, int)))
    assert scored.filter("score between 0 and 1").count() == 2


def test_rules_on_the_fold(tables, sample):
    documents, labels = tables
    rules = qr.learn(*sample)
    assert 1 <= len(rules) <= qr.MOST_RULES and all(str(r) for r in rules)
    out = qr.quality_rules(documents, rules)
    rows = out.join(labels, "doc_id").filter(held_out("doc_id")).collect()
    good = [r for r in rows if r["quality"] == 1]
    assert np.mean([r["rule"] == 0 for r in good]) > 0.98
    assert np.mean([not r["kept"] for r in rows if r["quality"] == 0]) > 0.8
    assert all(r["kept"] == (not r["base_failed"] and r["rule"] == 0) for r in rows)
    assert all(r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) for r in rows)


def test_covering_finds_planted_conjunctions():
    random = np.random.default_rng(3)
    x = random.random((3000, len(RATIOS)))
    bad = ((x[:, 2] > 0.8) & (x[:, 6] > 0.5)) | (x[:, 8] > 0.9)
    rules = qr.learn(x, (~bad).astype(int))
    caught = np.zeros(len(x), bool)
    for r in rules:
        caught |= qr._covers(x, r.conditions)
    assert (caught & bad).sum() > 0.95 * bad.sum() and (caught & ~bad).sum() < 0.02 * bad.sum()


def test_odd_rows(docs, odd_rows):
    found = qr.quality_rules(docs(odd_rows, CLASH), [])
    rows = found.collect()
    assert len(rows) == len(odd_rows) and found.columns == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "rule", "kept"]
    assert {r["doc_id"]: r["n_words"] for r in rows if r["doc_id"] in (1, 2, 3, 6, 14)} == {1: 0, 2: 0, 3: 0, 6: 80, 14: 30_000}
    assert qr.quality_rules(docs([]), []).count() == 0


def test_fold(spark):
    import zlib

    rows = spark.range(50).select("id", held_out("id").alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0) for r in rows)
    assert spark.range(1).select(F.lit(None).cast("bigint").alias("i")).select(held_out("i")).first()[0] is False


def test_base_counts_equal_sql(spark):
    """All documents of the smallest tables, in another engine: counts of words, symbols, lines and repeats."""
    duckdb = pytest.importorskip("duckdb")
    from layerloom.llm import queries

    folder = "/root/testdata/sf0.001"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    expected = db.execute(queries.OP9_BASE_SQL)
    columns = [c[0] for c in expected.description]
    found = queries.op9_quality_rules(spark, folder)
    assert sorted(map(tuple, found.select(columns).collect())) == sorted(expected.fetchall())
    assert found.filter("base_failed and kept").isEmpty()
