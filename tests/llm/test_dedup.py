import hashlib
import random

import pytest
from odd import CLASH, switched
from pyspark.sql import functions as F

from layerloom.llm import near_dedup as nd
from layerloom.llm import substring_dedup as sd
from layerloom.llm.components import components


def substring(df, **more):
    out = sd.substring_dedup(df, **more)
    return [(r[0], r["n_words"], r["n_removed"], hashlib.sha256(r["kept_text"].encode()).hexdigest(), [tuple(x) for x in r["removed"]]) for r in out.collect()]


def test_substrings_of_odd_rows(docs, odd_rows):
    rows = [(i, t) for i, t in odd_rows if i is not None]
    expected = sd.reference(rows)
    for blocks, ranges in ((1, 1), (5, 3), (40, 10**6)):
        found = {r[0]: r[1:4] for r in substring(docs(odd_rows, CLASH), n_blocks=blocks, n_ranges=ranges) if r[0] is not None}
        assert found == expected
    assert expected[7][1] == 80 and expected[9][1] == 80 and expected[13][1] == 80 and expected[6][1] == 0
    nulls = [r for r in substring(docs(odd_rows)) if r[0] is None]
    assert sorted(r[1:3] for r in nulls) == [(0, 0), (80, 0)]


@pytest.mark.parametrize("seed,window", [(0, 13), (1, 3), (2, 1)])
def test_substrings_of_random_rows(docs, seed, window):
    r = random.Random(seed)
    pool = [" ".join(r.choice("abcdefgh") + str(r.randrange(4)) for _ in range(r.randrange(1, 30))) for _ in range(12)]
    rows = [(i * 3 - 20, "\n".join(r.choice(pool) for _ in range(r.randrange(6)))) for i in range(60)]
    r.shuffle(rows)
    found = {x[0]: x[1:4] for x in substring(docs(rows), window=window, n_blocks=4)}
    assert found == sd.reference(rows, window)


def test_intervals_are_maximal_and_repeats_of_an_id_stay(docs):
    words = [f"w{i}" for i in range(40)]
    rows = [(1, " ".join(words)), (2, "x " + " ".join(words[:20]) + " y " + " ".join(words[20:])), (3, "a " * 30), (3, "a " * 30)]
    found = {(r[0], tuple(r[4])) for r in substring(docs(rows), n_blocks=2)}
    assert (2, ((1, 21), (22, 42))) in found and [r[2] for r in substring(docs(rows)) if r[0] == 3] == [0, 0]


def test_words_that_polynomials_confuse(docs):
    a, b = switched(2048)
    rows = [(1, " ".join([a] * 14)), (2, " ".join([b] * 14)), (3, " ".join([a] * 13))]
    assert {r[0]: r[1:3] for r in substring(docs(rows), n_blocks=3, n_ranges=2)} == {1: (14, 0), 2: (14, 0), 3: (13, 13)}
    rows = [(k, f"{x} one {x} two") for k, x in enumerate((a, b, a.upper(), b))]
    assert {r[0]: r[2] for r in near(docs(rows))} == {0: 0, 1: 1, 2: 0, 3: 1}


def test_prefixes_that_agree_by_chance_remove_nothing(docs, monkeypatch):
    monkeypatch.setattr(sd, "PREFIX", 4)
    r = random.Random(8)
    rows = [(i, " ".join(str(r.randrange(10**6)) for _ in range(60))) for i in range(40)] + [(50, "a b " * 20), (51, "b a " * 20)]
    assert {x[0]: x[1:4] for x in substring(docs(rows), n_blocks=7, n_ranges=3)} == sd.reference(rows)


def test_many_equal_rows(docs):
    rows = [(7, "a b c d e f g h i j k l m n")] * 300 + [(8, "a b c d e f g h i j k l m o")] * 300 + [(None, None)] * 300
    found = sorted(((r[0] or 0), r[2]) for r in substring(docs(rows), n_blocks=3, n_ranges=2))
    assert found == [(0, 0)] * 300 + [(7, 0)] * 300 + [(8, 13)] * 300


def test_substrings_of_nothing(docs):
    assert substring(docs([])) == []
    assert substring(docs([(1, None)])) == [(1, 0, 0, hashlib.sha256(b"").hexdigest(), [])]
    with pytest.raises(ValueError):
        sd.substring_dedup(docs([]), window=0)


def near(df, ngram=3, percent=85):
    return [(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in nd.near_dedup(df, ngram=ngram, percent=percent).collect()]


def test_near_duplicates_of_odd_rows(docs, odd_rows):
    rows = [(i, t) for i, t in odd_rows if i is not None]
    for ngram, percent in ((3, 85), (5, 80)):
        expected = nd.reference(rows, ngram, percent)
        found = near(docs(odd_rows, CLASH), ngram, percent)
        assert {r[0]: r[1:3] for r in found if r[0] is not None} == expected
        assert all(r[3] == (r[0] == r[2] or r[0] is None) for r in found) and len(found) == len(odd_rows)
        assert [r[2:] for r in found if r[0] is None] == [(None, True)] * 2


def families(seed, n_families=12, size=12, edits=6):
    """Families of texts around a base; some members are close to the base only, some to each other, some to none."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(4))
    rows, i = [], 100
    for _ in range(n_families):
        base = [word() for _ in range(r.randrange(20, 120))]
        for _ in range(r.randrange(1, size)):
            text = list(base)
            for _ in range(r.randrange(edits)):
                text[r.randrange(len(text))] = word()
            rows.append((i, " ".join(text)))
            i += r.randrange(1, 4)
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,ngram,percent", [(0, 3, 85), (1, 5, 80)])
def test_near_duplicates_of_families(docs, seed, ngram, percent):
    rows = families(seed)
    found = {r[0]: r[1:3] for r in near(docs(rows), ngram, percent)}
    expected = nd.reference(rows, ngram, percent)
    assert found == expected and len({c for _, c in expected.values()}) < len(rows)


def test_large_family_is_cut_into_cells(docs, monkeypatch):
    monkeypatch.setattr(nd, "PART", 8)
    monkeypatch.setattr(nd, "SKETCHES", 8)
    rows = families(5, n_families=2, size=90, edits=9)
    assert {r[0]: r[1:3] for r in near(docs(rows))} == nd.reference(rows, 3, 85)


def test_rows_sent_for_a_large_unconnected_bucket(spark):
    members = spark.range(100_000).select(F.lit(1).alias("key"), "id", F.col("id").alias("comp"))
    cells = nd._grid(members, "key", F.ceil(F.lit(100_000) / nd.SKETCHES)).groupBy("x", "y").count().collect()
    parts = -(-100_000 // nd.SKETCHES)
    assert sum(r["count"] for r in cells) == 100_000 * parts and len(cells) == parts * (parts + 1) // 2
    assert max(r["count"] for r in cells) < 2.2 * nd.SKETCHES


def test_rows_of_an_id_are_told_apart_by_their_texts(spark, docs):
    df = docs([(1, "a b c d e f g"), (2, "a b c d e f g"), (2, "quite another text of some more words"), (3, None)])
    out = nd.near_dedup(df, keep_key=True).join(df.select(F.col("doc_id").alias("i"), "text", F.xxhash64("text").alias("k")), (F.col("i") == F.col("doc_id")) & (F.col("k") == F.col("text_key")))
    assert {(r["doc_id"], r["text"], r["kept"]) for r in out.collect() if r["doc_id"] < 3} == {(1, "a b c d e f g", True), (2, "a b c d e f g", False), (2, "quite another text of some more words", True)}


def test_equal_texts_meet_no_pairs(docs):
    rows = [(i, "one two three four five six") for i in range(400, 0, -1)]
    assert {r[2] for r in near(docs(rows))} == {1}
    assert near(docs([])) == [] and near(docs([(5, " ")])) == [(5, 0, 5, True)]


def test_repeated_ids(docs):
    same = near(docs([(1, "a b c d"), (1, "a b c d"), (2, "a b c d")]))
    assert sorted(same) == [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False)]
    found = near(docs([(1, "a b c d"), (2, "a b c d"), (2, "x y z w"), (3, "x y z w"), (3, "a b c d")]))
    assert sorted((i, c) for i, _, c, _ in found) == [(1, 1), (2, 1), (2, 2), (3, 1), (3, 2)]


def test_odd_sketches_estimate_similarity():
    import numpy as np

    random_ = np.random.default_rng(1)
    base = random_.integers(0, 2**63, 1000).astype(np.uint64)
    for shared in (1000, 950, 919, 850, 500):
        other = np.concatenate([base[:shared], random_.integers(0, 2**63, 1000 - shared).astype(np.uint64)])
        similarity = shared / (2000 - shared)
        sketches = [nd.odd_sketch(nd.minhash(np.unique(s))) for s in (base, other)]
        bits = int(np.bitwise_count((sketches[0] ^ sketches[1]).view(np.uint64)).sum())
        estimate = 1 + nd.BITS / (4 * nd.SAMPLES) * np.log(max(1e-9, 1 - 2 * bits / nd.BITS))
        assert abs(estimate - similarity) < 0.15
        if similarity >= 0.85:
            assert bits <= nd.most_different_bits(85)


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 102), (101, 102), (7, 7), (None, 3)]
    links = spark.createDataFrame(chain, "a bigint, b bigint")
    found = dict(map(tuple, components(links).collect()))
    assert found == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}
    assert components(links.filter(F.lit(False))).count() == 0
