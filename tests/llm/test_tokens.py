import random
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from odd import CLASH
from tokenizers import Tokenizer

from layerloom.llm import bpe, packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def own():
    return bpe.encoder(PATH)


def odd_texts(n=3000):
    r = random.Random(3)
    parts = ["a", "b", "the", "ing", " ", "  ", "\n", "\t", "\r\n", "é", "ß", "日本", "😀", "1", "23", "!", "--", "'s", "'ll", " ", "　", "\x00", "​", "é", "<|endoftext|>", "aaaa", "Ġ", "ÿ", "\x1c", "\x85", "٣", "Ⅷ", "²"]
    return ["".join(r.choice(parts) for _ in range(r.randrange(1, 14))) for _ in range(n)]


def test_encoding_equals_the_library(own, library):
    for text in odd_texts():
        expected = library.encode(text, add_special_tokens=False).ids
        ids = own.encode(text)
        assert ids.tolist() == expected and packing.library_encoder(PATH).encode(text).tolist() == expected, text
        assert own.decode_bytes(ids).decode("utf-8", "replace") == library.decode(expected, skip_special_tokens=False)


def test_all_code_points_are_cut_alike(own, library):
    for base in range(0, 0x110000, 512):
        chars = [chr(c) for c in range(base, base + 512) if not 0xD800 <= c < 0xE000]
        if chars:
            text = "|".join(f"a{c}b {c}1{c}{c} {c}" for c in chars)
            expected = library.encode(text, add_special_tokens=False).ids
            assert own.encode(text).tolist() == expected and packing.library_encoder(PATH).encode(text).tolist() == expected


def test_long_runs_are_linear(own, library):
    text = "a" * 30_000 + " " * 30_000 + "ab" * 30_000 + "ÿĀ" * 5_000
    assert own.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("unit", ["ab", " ", "\n", "abc", "ÿĀ", "a", "=-"])
def test_time_of_one_pre_token_grows_with_its_length(own, library, unit):
    def seconds(n):
        text = unit * n
        began = time.process_time()
        ids = own.word(text.encode())
        return time.process_time() - began, list(ids), text

    (a, _, _), (b, ids, text) = min(seconds(200_000) for _ in range(2)), min(seconds(400_000) for _ in range(2))
    assert b < 2.6 * a + 0.05 and b < 12
    assert ids == library.encode(text, add_special_tokens=False).ids


def test_long_texts_are_cut_where_a_pre_token_starts(monkeypatch, own, library):
    monkeypatch.setattr(bpe, "PART", 5)
    for text in [*odd_texts(800), "one two  three\n four 's " * 40]:
        assert own.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("text", [" " * 1_000_000, "\n" * 1_000_000, "ab" * 500_000])
def test_packing_of_long_runs(docs, library, text):
    out = sorted(packing.best_fit_packing(docs([(1, text)]), PATH).collect(), key=lambda r: r["piece"])
    assert [x for r in out for x in r["ids"]] == [*library.encode(text, add_special_tokens=False).ids, 0]


def test_groups_of_long_and_of_equal_documents(docs):
    sizes = lambda out: Counter(r["sequence_id"] >> 32 for r in out)
    long = packing.best_fit_packing(docs([(i, f"{i} word " * 800) for i in range(40)]), PATH, size=16, group=400, keep_ids=False).collect()
    assert len(long) > 3000 and max(sizes(long).values()) < 700 and len(sizes(long)) > 4
    full = Counter(r["sequence_id"] for r in long if r["length"] == 16)
    assert set(full.values()) == {1} and all(r["offset"] == 0 for r in long if r["length"] == 16)
    equal = packing.best_fit_packing(docs([(1, "equal texts")] * 900), PATH, group=100, keep_ids=False).collect()
    assert len(equal) == 900 and max(sizes(equal).values()) < 250
    assert len({(r["sequence_id"], r["offset"]) for r in equal}) == 900


def test_a_word_is_what_merging_by_rank_gives(own):
    r = random.Random(5)

    def merged(word):
        parts = [own.v.ids[bytes([b])] for b in word]
        while pairs := [(own.v.merge[p][0], k) for k, p in enumerate(zip(parts, parts[1:])) if p in own.v.merge]:
            k = min(pairs)[1]
            parts[k : k + 2] = [own.v.merge[parts[k], parts[k + 1]][1]]
        return tuple(parts)

    for _ in range(1500):
        word = bytes(r.choice(b"aeinorst \xc3\xa9h") for _ in range(r.randrange(1, 18)))
        assert own.word(word) == merged(word)


def test_the_table_of_words_is_bounded(monkeypatch):
    e = bpe.Encoder(bpe.Vocabulary(PATH))
    monkeypatch.setattr(bpe, "KEPT", 5)
    monkeypatch.setattr(bpe, "PAIRS", 5)
    text = " ".join(odd_texts(200))
    assert e.encode(text).tolist() == bpe.encoder(PATH).encode(text).tolist() and len(e) <= 5 and len(e.pairs) <= 5


def test_round_trip_of_odd_rows(docs, odd_rows, library):
    out = bpe.bpe_round_trip(docs(odd_rows, CLASH), PATH).collect()
    texts = {i: t for i, t in odd_rows if i is not None}
    assert len(out) == len(odd_rows)
    for r in out:
        if r["doc_id"] is not None:
            text = texts[r["doc_id"]] or ""
            assert r["ids"] == library.encode(text, add_special_tokens=False).ids and r["decoded"] == text and r["n_tokens"] == len(r["ids"])
    assert bpe.bpe_round_trip(docs([]), PATH).count() == 0
    assert bpe.encoder(PATH).decode_bytes(np.array([own_byte(0xC3)], np.uint32)).decode("utf-8", "replace") == "�"


def own_byte(b):
    return bpe.encoder(PATH).v.ids[bytes([b])]


def reference_bins(lengths, size):
    """Best fit decreasing by looking at every open bin."""
    free, out = [], []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fitting = [(f, k) for k, f in enumerate(free) if f >= lengths[i]]
        if fitting:
            _, k = min(fitting)
        else:
            free.append(size)
            k = len(free) - 1
        free[k] -= lengths[i]
        out.append(k)
    return len(free)


@pytest.mark.parametrize("seed,size", [(0, 10), (1, 64), (2, 2048), (3, 1)])
def test_best_fit_decreasing(seed, size):
    lengths = np.random.default_rng(seed).integers(1, size + 1, 400)
    bins, offsets = packing.best_fit_decreasing(lengths, size)
    assert bins.max() + 1 == reference_bins(lengths.tolist(), size)
    for b in range(bins.max() + 1):
        inside = np.argsort(offsets[bins == b])
        own = lengths[bins == b][inside]
        assert own.sum() <= size and offsets[bins == b][inside].tolist() == [0, *np.cumsum(own)[:-1]]


def test_packing_of_odd_rows(docs, odd_rows, library):
    size = 64
    out = packing.best_fit_packing(docs(odd_rows, CLASH), PATH, size=size).collect()
    texts = {i: t or "" for i, t in odd_rows if i is not None}
    pieces = {}
    for r in out:
        pieces.setdefault(r["doc_id"], []).append(r)
    for i, text in texts.items():
        ids = [*library.encode(text, add_special_tokens=False).ids, 0]
        own = sorted(pieces[i], key=lambda r: r["piece"])
        assert [x for r in own for x in r["ids"]] == ids and [r["piece"] for r in own] == list(range(len(own)))
        assert all(r["length"] == size for r in own[1:]) and [r["start"] for r in own] == [0, *np.cumsum([r["length"] for r in own])[:-1]]
        assert all(r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in own)
    sequences = {}
    for r in out:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for found in sequences.values():
        found.sort()
        assert [o for o, _ in found] == [0, *np.cumsum([n for _, n in found])[:-1]] and sum(n for _, n in found) <= size
    assert len(sequences) <= sum(r["length"] for r in out) / size * 1.05 + 2
    assert packing.best_fit_packing(docs([]), PATH).count() == 0
    grouped = packing.best_fit_packing(docs(odd_rows), PATH, size=size, group=4)
    assert grouped.count() == len(out) and grouped.select("sequence_id").distinct().count() >= len(sequences)


def test_white_space_is_the_patterns():
    import regex

    space = regex.compile(r"\s").fullmatch
    assert all(bool(space(chr(c))) == bool(bpe.RUNS.fullmatch(chr(c) * 2)) for c in range(0x110000))
