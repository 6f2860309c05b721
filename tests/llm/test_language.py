import itertools

import numpy as np
import pyarrow as pa
import pytest
from odd import CLASH
from pyspark.sql import functions as F

from layerloom.llm import language_id as li
from layerloom.llm._spark import held_out

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def model(documents):
    return li.learn_from(documents, ~held_out("doc_id"), sample=80)


def test_forward_backward_equals_enumeration():
    random = np.random.default_rng(1)
    for languages, lengths in ((3, [4, 0, 5, 1]), (1, [3, 2])):
        bounds = np.concatenate([[0], np.cumsum(lengths)])
        e, a = random.normal(size=(bounds[-1], languages)), random.normal(size=(languages, languages))
        found = li.forward_backward(e.astype(np.float32), bounds, a)
        for s, t in zip(bounds, bounds[1:]):
            total = np.zeros((t - s, languages))
            for path in itertools.product(range(languages), repeat=int(t - s)):
                weight = np.exp(sum(e[s + k, y] for k, y in enumerate(path)) + sum(a[x, y] for x, y in zip(path, path[1:])))
                for k, y in enumerate(path):
                    total[k, y] += weight
            if t > s:
                assert np.allclose(found[s:t], total / total.sum(axis=1, keepdims=True), atol=1e-5)


def test_held_out_accuracy(documents, model):
    assert model.languages == ("de", "en", "es", "fr")
    out = li.identify(documents.select("doc_id", "text"), model, keep_spans=False).select("row.doc_id", "lang_pred", "score")
    rows = out.join(documents, "doc_id").filter(held_out("doc_id")).collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in rows]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_words_of_switched_text_are_labelled(documents, model):
    parts = [documents.filter((F.col("lang") == x) & (F.col("n_chars") > 300)).orderBy("doc_id").first()["text"].split()[:25] for x in ("en", "de", "fr")]
    words = li.words_of(pa.array([" ".join(sum(parts, []))]))
    labels = np.array(model.languages)[model.posteriors(words).argmax(axis=1)]
    truth = np.repeat(["en", "de", "fr"], 25)
    assert (labels == truth).mean() > 0.85
    assert np.diag(model.transitions).min() > (model.transitions - 99 * np.eye(4)).max()  # staying is likelier than switching


def test_odd_rows(docs, model, odd_rows):
    rows = [*odd_rows, (20, "123 456 !!"), (21, "the and of"), (22, "— …")]
    out = li.identify(docs(rows, CLASH), model).select("row.doc_id", "lang_pred", "score", "spans").collect()
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in out}
    assert len(out) == len(rows)
    assert all(found[i] == ("und", 0.0) for i in (1, 2, 3, 11, 20, 22)) and found[21][0] == "en" and found[21][1] > 0.5
    spans = next(r["spans"] for r in out if r["doc_id"] == 14)
    assert spans[0]["start"] == 0 and spans[-1]["end"] == 30_000 and all(a["end"] == b["start"] for a, b in zip(spans, spans[1:]))
    assert li.identify(docs([]), model).count() == 0


def test_features_do_not_depend_on_company(monkeypatch):
    weights = np.random.default_rng(2).normal(size=(li.BUCKETS, 3)).astype(np.float32)
    score = lambda texts: li.words_of(pa.array(texts)).scores(weights)
    alone = {t: score([t])[0] for t in ("Haus,", "ÉTÉ", "été", "a")}
    words = li.words_of(pa.array([" ".join(alone), "a été Haus,"]))
    together = words.scores(weights)[words.kinds]
    expected = [*alone.values(), alone["a"], alone["été"], alone["Haus,"]]
    assert np.allclose(together, np.array(expected), atol=1e-4) and np.allclose(alone["ÉTÉ"], alone["été"])
    monkeypatch.setattr(li, "KINDS", 2)
    assert np.allclose(words.scores(weights)[words.kinds], together)


def test_languages_of_long_texts_only_are_learned(spark):
    r = np.random.default_rng(3)
    words = {"xx": ["lom", "tarik", "venu", "ossa"], "yy": ["grabel", "hust", "pfin", "zwek"]}
    text = {k: lambda n, w=w: " ".join(r.choice(w, n)) for k, w in words.items()}
    rows = [(i, text["xx"](80_000), "xx") for i in range(4)] + [(10 + i, text["yy"](60), "yy") for i in range(30)]
    model = li.learn_from(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), F.lit(True))
    assert model.languages == ("xx", "yy")
    assert li.predict(model, pa.array([text["xx"](9), text["yy"](9), text["xx"](90_000)]))[0] == ["xx", "yy", "xx"]


def test_a_sample_stays_bounded_where_one_id_has_many_rows(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(li, "learn", lambda texts, languages: seen.append(len(texts)))
    rows = spark.range(5000).selectExpr("1 as doc_id", "concat('word ', id) as text", "'xx' as lang")
    li.learn_from(rows.unionAll(spark.range(100).selectExpr("id", "'other'", "'yy'")), F.lit(True), sample=4900)
    li.learn_from(rows, F.lit(True), sample=10)
    assert seen[1] <= 120


def test_degenerate_models(docs, spark):
    none = li.learn([], [])
    assert [r["lang_pred"] for r in li.identify(docs([(1, "word")]), none).collect()] == ["und"]
    one = li.learn(["ein wort"], ["de"])
    assert [(r["lang_pred"], r["score"]) for r in li.identify(docs([(1, "word")]), one).collect()] == [("de", 1.0)]
    nothing = li.learn_from(docs([(1, "x"), (2, None)]), F.lit(True))  # no language is known
    assert nothing.languages == ()
    blank = li.learn(["", " "], ["a", "b"])
    assert blank.languages == ()
