import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def make(spark, rows, extra=""):
    """Documents from (id, text) pairs; extra: columns with names that operators use themselves."""
    df = spark.createDataFrame([(i, t, None, "s", len(t or "")) for i, t in rows], SCHEMA)
    for c in extra.split():
        df = df.selectExpr("*", f"'x' as `{c}`")
    return df


@pytest.fixture(scope="session")
def docs(spark):
    return lambda rows, extra="": make(spark, rows, extra)


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, blanks, odd bytes, repeats and one long text."""
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdé") for _ in range(r.randrange(1, 7)))
    line = lambda n: " ".join(word() for _ in range(n))
    base = line(80)
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "a"), (5, "A  b\tc"), (6, base), (7, base), (8, base.replace("a", "A")), (9, base + " tail"), (10, "x" * 5000)]
    rows += [(11, "\x1c\x85   "), (12, "日本 語 😀 é"), (13, line(30) + "\n" + base + "\n" + line(30)), (14, line(30_000)), (None, base), (None, None), (15, "a b\x00c\r\n\r\na b\x00c")]
    return rows
