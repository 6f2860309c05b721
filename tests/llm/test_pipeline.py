import corpus_pipeline as cp
import pytest
from odd import CLASH

from layerloom.llm import queries
from layerloom.llm.near_dedup import reference as near
from layerloom.llm.substring_dedup import reference as substrings

DATA = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The input and the result of every stage, written and read again."""
    root, out = tmp_path_factory.mktemp("stages"), []
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for name, stage in cp.STAGES:
        stage(spark, docs, DATA).write.parquet(str(root / name))
        result = spark.read.parquet(str(root / name))
        out.append((name, docs, result))
        docs = result
    return out


def test_order_and_columns(stages):
    assert [s[0] for s in stages] == ["language_id", "quality", "near_dedup", "substring_dedup", "packing"]
    assert all(result.columns == COLUMNS for _, _, result in stages[:-1])


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_filters_keep_clean_documents_unchanged(spark, stages):
    good = {r["doc_id"] for r in spark.read.parquet(f"{DATA}/labels.parquet").filter("quality = 1").collect()}
    for _, before, after in stages[:2]:
        a, b = texts(before), texts(after)
        assert all(a[i] == t for i, t in b.items()) and good & set(a) <= set(b)
    bad = {r["doc_id"] for r in spark.read.parquet(f"{DATA}/labels.parquet").filter("quality = 0").collect()}
    assert len(bad & set(texts(stages[1][2]))) < 0.2 * len(bad)


def test_near_duplicates_equal_brute_force(stages):
    before, after = texts(stages[2][1]), texts(stages[2][2])
    expected = near(list(before.items()), 5, 80)
    assert set(after) == {i for i, (_, c) in expected.items() if i == c} and len(after) < len(before)


def test_substrings_equal_brute_force(stages):
    before, after = texts(stages[3][1]), texts(stages[3][2])
    expected = substrings(list(before.items()))
    assert set(after) == set(before)
    for i, text in before.items():
        if expected[i][1]:
            assert len(after[i].split()) == expected[i][0] - expected[i][1]
        else:
            assert after[i] == text
    assert all(r["n_chars"] == len(r["text"]) for r in stages[3][2].collect() if expected[r["doc_id"]][1])


def test_run_equals_the_stages(spark, stages):
    packed = cp.run(spark, DATA)
    assert packed.columns == stages[4][2].columns
    key = lambda df: sorted((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in df.collect())
    assert key(packed) == key(stages[4][2])


def test_stages_take_odd_rows(spark, docs, odd_rows):
    df = docs(odd_rows, CLASH + " gone_id text_key lead other size")
    for name, stage in cp.STAGES[1:]:
        out = stage(spark, df, DATA)
        out.collect()
        assert name == "packing" or out.columns == df.columns
    known = df.selectExpr(*[f"'de' as lang" if c == "lang" else f"`{c}`" for c in df.columns])
    assert cp.identify_language(spark, known, DATA).columns == df.columns
    for _, stage in cp.STAGES:
        assert stage(spark, df.limit(0), DATA).count() == 0


@pytest.mark.parametrize("n", [2, 3, 4])
def test_clean_mixed_texts_stay(spark, docs, n):
    """Documents of halves, or of equal parts of all languages, are kept however many languages there are."""
    known = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("lang is not null")
    languages = sorted(r["lang"] for r in known.select("lang").distinct().collect())[:n]
    known = known.filter(known["lang"].isin(languages)).select(COLUMNS)
    some = {c: [r["text"] for r in known.filter(known["lang"] == c).filter("n_chars between 800 and 4000").orderBy("doc_id").limit(6).collect()] for c in languages}
    mixed = [(10**9 + k, "\n".join(" ".join(t.split()[:100]) for t in parts)) for k, parts in enumerate(zip(*some.values(), strict=True))]
    rows = docs([*mixed, (10**9 + 50, "12 34 -- 56")])
    kept = cp.identify_language(spark, known.unionByName(rows), DATA).filter("doc_id >= 1000000000")
    assert {r["doc_id"] for r in kept.collect()} == {i for i, _ in mixed}


def test_every_operator_has_one_query():
    names = sorted(queries.queries(), key=lambda n: int(n[2:].split("_")[0]))
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 11))
    assert cp.ORACLE_SQL is None and set(queries.oracle_sql()) <= set(names)
