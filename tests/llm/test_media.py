import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from odd import CLASH

from layerloom.llm import media as md


def payloads():
    random = np.random.default_rng(1)
    return [b"\xff" * 576, bytes(576), bytes(range(256)) * 9, random.bytes(576 * 7), b"\xff\x00" * 288, random.bytes(576 * 400)]


def test_round_trip():
    found = payloads()
    for p, stored in zip(found, md.encode_all(found), strict=True):
        assert stored[:2] == b"\xff\xd8" and stored[-2:] == b"\xff\xd9"
        assert b"".join(t.tobytes() for t in md.decode(stored)) == p
    assert md.encode_all(found[:1]) == md.encode_all(found)[:1]  # company changes nothing


@pytest.mark.parametrize("units", [1, 2, 8, 340, 341, 342, 343, 1009, 4001, 100_003])
def test_shapes_hold_everything(units):
    shapes = md.shapes(units * md.UNIT)
    assert sum(w * h for w, h in shapes) == units * md.UNIT
    assert all(0 < 8 * w <= 65_535 and 0 < 8 * h <= 65_535 and w * h % md.UNIT == 0 for w, h in shapes)


def test_payloads_too_long_for_one_image(monkeypatch):
    monkeypatch.setattr(md, "MOST_BLOCKS", 48)
    monkeypatch.setattr(md, "MOST_BYTES", 48 * 48)
    p = np.random.default_rng(2).bytes(576 * 13)
    stored = md.encode_all([p])[0]
    thumbs = md.decode(stored)
    assert len(thumbs) > 1 and b"".join(t.tobytes() for t in thumbs) == p


def test_a_long_text_needs_a_few_times_its_bytes():
    import tracemalloc

    size = 576 * 30_000
    text = np.random.default_rng(4).integers(32, 127, size, dtype=np.uint8).tobytes().decode()
    batch = pa.RecordBatch.from_pydict({"id": [1], "text": [text]})
    tracemalloc.start()
    (found,) = md._store(False)(iter([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.column("payload_sha256").to_pylist() == [hashlib.sha256(text.encode()).hexdigest()]
    assert peak < 7 * size + 200e6


def test_lanes_do_not_change_what_is_written_or_read(monkeypatch):
    found = payloads()
    stored = md.encode_all(found)
    monkeypatch.setattr(md, "LANES", 3)
    assert md.encode_all(found) == stored
    for p, x in zip(found, stored, strict=True):
        assert b"".join(t.tobytes() for t in md.decode(x)) == p


def _write_bits(symbols):
    out = "".join(symbols)
    out += "1" * (-len(out) % 8)
    return bytes(int(out[i : i + 8], 2) for i in range(0, len(out), 8)).replace(b"\xff", b"\xff\0")


def _code(table, symbol):
    value, length = md._codes(table)[symbol]
    return f"{value:0{length}b}"


def _amount(n):
    size = abs(n).bit_length()
    return size, (f"{n if n > 0 else n + (1 << size) - 1:0{size}b}" if size else "")


def test_a_colour_image_with_ac_coefficients_is_read():
    """An image of 2 x 1 MCUs, sampling 2x1 for luminance, two tables, AC runs and a step of 16."""
    dc = ([0, 0, 0, 12, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0], list(range(12)))
    ac = ([0, 2, 2, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0], [0x00, 0x01, 0xF0, 0x23])
    luma, last, scan = [[3, -7], [20, 21]], {"y": 0, "b": 0, "r": 0}, []

    def block(channel, value, extra=()):
        size, bits = _amount(value - last[channel])
        last[channel] = value
        scan.append(_code(dc, size) + bits)
        for symbol, amount in extra:
            scan.append(_code(ac, symbol) + _amount(amount)[1])
        scan.append(_code(ac, 0x00))

    for pair in luma:
        block("y", pair[0], [(0x01, 1), (0x23, -5)])
        block("y", pair[1], [(0xF0, 0), (0x01, -1)])
        block("b", 5)
        block("r", -5, [(0x01, 1)])
    seg = md._segment
    body = b"\xff\xd8" + seg(0xFE, b"a comment") + seg(0xDB, bytes([0, 16] + [1] * 63) + bytes([1, 4] + [1] * 63))
    body += seg(0xC0, bytes([8, 0, 8, 0, 32, 3, 1, 0x21, 0, 2, 0x11, 1, 3, 0x11, 1]))
    body += seg(0xC4, b"".join(bytes([k, *t[0], *t[1]]) for k, t in ((0x00, dc), (0x10, ac), (0x01, dc), (0x11, ac))))
    body += seg(0xDA, bytes([3, 1, 0x00, 2, 0x11, 3, 0x11, 0, 63, 0]))
    image = body + _write_bits(scan) + b"\xff\xd9"
    (thumb,) = md.decode(image)
    assert thumb.tolist() == [[128 + 2 * v for pair in luma for v in pair]]
    assert [t.shape for t in md.decode(image + md.encode_all([bytes(576)])[0])] == [(1, 4), (24, 24)]


def test_broken_images_raise():
    good = md.encode_all([bytes(range(64)) * 18])[0]
    scan = good.index(b"\xff\xda")
    for bad in (b"", good[1:], good[:-2], good[: scan + 30], good.replace(b"\xff\xc0", b"\xff\xc2", 1), good[:2] + b"xx" + good[2:], good[: scan + 10] + good[scan + 20 :], good.replace(b"\xff\xd0", b"", 1)):
        with pytest.raises(ValueError):
            if not md.decode(bad):
                raise ValueError("nothing")


def test_columns(docs, odd_rows):
    out = md.media_columns(docs(odd_rows, CLASH))
    rows = out.collect()
    assert len(rows) == len(odd_rows)
    by_text = {}
    for r, (i, text) in zip(sorted(rows, key=lambda r: (str(r["doc_id"]), r["n_bytes"])), sorted(odd_rows, key=lambda x: (str(x[0]), len((x[1] or "").encode())))):
        data = (text or "").encode()
        padded = data + b"\xff" * (-len(data) % 576 if data else 576)
        assert r["doc_id"] == i and r["n_bytes"] == len(data) and r["payload_bytes"] == len(padded)
        assert r["payload_sha256"] == hashlib.sha256(padded).hexdigest() and r["tail_crc32"] == zlib.crc32(padded[-32:])
        assert r["media_bytes"] == len(r["media"]) and r["media_sha256"] == hashlib.sha256(bytes(r["media"])).hexdigest()
        assert b"".join(t.tobytes() for t in md.decode(bytes(r["media"]))) == padded
        assert by_text.setdefault(text or "", r["feature"]) == r["feature"]
    assert md.media_columns(docs([]), keep_media=False).count() == 0
    assert "media" not in md.media_columns(docs([]), keep_media=False).columns


def test_difference_hash():
    rising = np.tile(np.arange(24, dtype=np.uint8), (24, 1))
    assert md.difference_hash(rising) == 2**64 - 1 and md.difference_hash(rising[:, ::-1]) == 0
