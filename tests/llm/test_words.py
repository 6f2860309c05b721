import random
import re

import numpy as np
import pyarrow as pa
import pytest
from odd import switched

from layerloom.llm import _words as w
from layerloom.llm._stats import count_texts, slices


def texts(seed, n=300):
    r = random.Random(seed)
    return [None if r.random() < 0.05 else "".join(r.choice("ab \n\t\r\x0b\x0cé日#*!.|") for _ in range(r.randrange(40))) for _ in range(n)]


def split(t):
    return [x for x in re.split(r"[\x20\x09-\x0D]+", t or "") if x]


@pytest.mark.parametrize("seed", range(3))
def test_words_and_windows(seed):
    rows = texts(seed)
    data, offsets = w.buffers(pa.array(rows, pa.string()))
    starts, ends, bounds = w.word_spans(data, offsets)
    words = [x for t in rows for x in split(t)]
    assert [data[a:b].tobytes().decode() for a, b in zip(starts, ends)] == words
    assert np.diff(bounds).tolist() == [len(split(t)) for t in rows]
    hashes = w.word_hashes(data, starts, ends)
    assert len(set(hashes.tolist())) == len(set(words))
    lower = w.word_hashes(data, starts, ends, lower=True)
    assert len(set(lower.tolist())) == len({x.encode().lower() for x in words})
    inside = np.flatnonzero(w.windows_inside(bounds, 3))
    windows = w.window_hashes(hashes, 3)[inside]
    expected = [tuple(split(t)[i : i + 3]) for t in rows for i in range(len(split(t)) - 2)]
    assert len(windows) == len(expected) and len(set(windows.tolist())) == len(set(expected))


def test_slices_of_columns_and_large_spans(monkeypatch):
    rows = texts(9)
    column = pa.array(rows, pa.string())
    a, b = w.buffers(column.slice(10, 50)), w.buffers(pa.array(rows[10:60], pa.string()))
    assert a[0].tobytes() == b[0].tobytes() and a[1].tolist() == b[1].tolist()
    chunked = pa.chunked_array([column.slice(0, 7), column.slice(7)])
    assert w.buffers(chunked)[0].tobytes() == w.buffers(column)[0].tobytes()
    assert w.buffers(pa.chunked_array([], pa.string()))[1].tolist() == [0]
    data, offsets = w.buffers(column)
    starts, ends, bounds = w.word_spans(data, offsets)
    whole = w.word_hashes(data, starts, ends), w.window_hashes(w.word_hashes(data, starts, ends), 3)
    monkeypatch.setattr(w, "SPAN", 16)
    assert (w.word_hashes(data, starts, ends) == whole[0]).all() and (w.window_hashes(whole[0], 3) == whole[1]).all()


@pytest.mark.parametrize("size", [8, 31, 32, 33, 64, 1024, 2048, 4096])
@pytest.mark.parametrize("seed", [0, 1])
def test_switched_words_and_windows_differ(size, seed):
    pair = switched(size)
    data, offsets = w.buffers(pa.array([*pair, pair[0].upper(), pair[0]]))
    starts, ends, bounds = w.word_spans(data, offsets)
    hashes = w.word_hashes(data, starts, ends, seed=seed)
    assert len(set(hashes.tolist())) == 3 and hashes[0] == hashes[3]
    lower = w.word_hashes(data, starts, ends, lower=True, seed=seed)
    assert len(set(lower.tolist())) == 2 and lower[0] == lower[2] == hashes[0]
    letters = w.word_hashes(data, np.arange(len(data)), np.arange(1, len(data) + 1), seed=seed)
    windows = w.window_hashes(letters, size, seed)[np.arange(4) * size]
    assert len(set(windows.tolist())) == 3 and windows[0] == windows[3]


def test_seeds_are_independent():
    data, offsets = w.buffers(pa.array(["some words " + "x" * 40]))
    starts, ends, _ = w.word_spans(data, offsets)
    a, b = (w.word_hashes(data, starts, ends, seed=k) for k in (0, 1))
    assert not (a == b).any() and w.window_hashes(a, 2)[0] != w.window_hashes(a, 2, seed=1)[0]


def test_a_long_word_needs_little_memory():
    import tracemalloc

    size = 30_000_000
    data, offsets = np.full(size, 97, np.uint8), np.array([0, size])
    tracemalloc.start()
    w.word_hashes(data, np.array([0]), np.array([size]))
    assert tracemalloc.get_traced_memory()[1] < 2 * size
    tracemalloc.stop()


def test_counts_tell_long_lines_and_words_apart():
    a, b = switched(2048)
    found = count_texts(pa.array([f"{a}\n{b}\n{a}", f"{a} {b} {a} {b} {b} {a}"]))
    assert found["n_dup_lines"].tolist() == [1, 0] and found["n_repeat_words"].tolist() == [0, 0] and found["n_same"].tolist() == [0, 1]


def test_counts_equal_brute_force():
    rows = [*texts(4, 1500), None, "", "\n", "\n\n a\n a\na", "a\n", "x y z x y z", "a a a a"]
    found = count_texts(pa.array(rows, pa.string()))
    for i, t in enumerate(rows):
        t, words = t or "", split(t)
        grams = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        covered = {k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)}
        lines, seen, again = t.split("\n"), set(), 0
        for line in lines:
            if split(line):
                again += line in seen
                seen.add(line)
        expected = {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in t), "n_dup_lines": again, "n_repeat_words": len(covered),
                    "n_lines": len(lines), "n_bangs": t.count("!"), "n_same": sum(a == b for a, b in zip(words, words[1:]))}
        assert {k: int(found[k][i]) for k in expected} == expected, t


def test_batches_are_cut_by_bytes():
    batch = pa.RecordBatch.from_pydict({"text": ["x" * 100] * 10 + ["y" * 1000, None, "z"]})
    parts = [p.num_rows for p in slices(batch, "text", 500)]
    assert sum(parts) == 13 and max(parts) <= 3
