"""Substring dedup: words covered by a window of words that also starts in a document with a smaller id go.

Method: Rabin-Karp hashes of every window of `window` consecutive words. Documents are dealt into blocks by a hash of
the whole row. Windows are counted in two rounds of Spark groups, each over ranges of the hash:

1. A block sends the distinct PREFIX first bits of its windows' hashes, so a passage that a third of all documents share
   sends one value a block, not one a document. Each range finds the prefixes that several blocks hold.
2. A block sends, for its windows with such a prefix only, both 64-bit hashes and the smallest id. Each range finds
   the windows (128 bits) that another block holds under a smaller id, and their blocks hear of them.

A block then marks these windows and those that repeat inside it, merges them into maximal intervals of words and removes
these. What a block sends is sorted, so it travels as differences, four to sixteen bytes a window; a row of Spark's
own for each window would take two to three times the disk. The numbers of blocks, ranges and partitions grow with the input, so
a task reads about BLOCKS blocks however large the input is; beyond PARTITIONS partitions (about 0.16 TB of text) tasks grow instead, as
more would burden the driver. At tens of TB ranges outnumber the windows of a block, and a record holds few of them.

Windows of different blocks count as equal if 128 bits of hashes are, windows of one block (some MB) if 64 are.

Defined cases: null, empty or blank texts have no words and nothing removed; texts of fewer words than the window are
kept whole; a very long text is a block of its own; a null id is neither smaller nor larger than any id, so such a row
keeps all words, removes none elsewhere and is never shuffled; rows with the same id don't remove each other's words; an
empty table gives an empty result; other columns of the input are ignored, or carried along as they are if named.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from layerloom.llm._spark import BLOCK_BYTES, batched, packed_row, text_bytes
from layerloom.llm._stats import slices
from layerloom.llm._words import U, buffers, owners, window_hashes, windows_inside, word_hashes, word_spans

WINDOW = 13
#: Bits of a hash that the first round compares.
PREFIX = 48
#: Hashes of a range that one task sorts at a time, about, and bytes of text that make one window.
RANGE, BYTES_A_WINDOW = 2 << 20, 6
#: Blocks of a partition, and partitions of a shuffle at most.
BLOCKS, PARTITIONS = 2, 20_000
_PACKED = pa.schema([("blk", pa.int64()), ("n", pa.int64()), ("packed", pa.binary())])


def _pack(hashes: np.ndarray, *others: np.ndarray) -> bytes:
    """Ascending hashes as differences, then other 64-bit columns, byte plane by byte plane; compressed unless it is little."""
    columns = [np.diff(hashes, prepend=U(0)), *others]
    planes = b"".join(c.view(np.uint8).reshape(-1, 8).T.tobytes() for c in columns)
    return b"\0" + planes if len(planes) < 128 else b"\1" + pa.Codec("zstd", compression_level=1).compress(planes, asbytes=True)


def _unpack(packed: bytes, n: int, others: int = 0) -> list[np.ndarray]:
    raw = packed[1:] if packed[0] == 0 else pa.Codec("zstd").decompress(packed[1:], n * 8 * (1 + others), asbytes=True)
    planes = np.frombuffer(raw, np.uint8).reshape(1 + others, 8, n)
    columns = [np.ascontiguousarray(p.T).reshape(-1).view(U) for p in planes]
    return [np.cumsum(columns[0], dtype=U), *columns[1:]]


class _Block:
    """The windows of one block's documents; second: with an independent hash of each."""

    def __init__(self, table: pa.Table, window: int, second: bool = False):
        self.ids = table.column("id").combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64)
        self.data, self.offsets = buffers(table.column("text"))
        self.starts, self.ends, self.bounds = word_spans(self.data, self.offsets)
        self.at = np.flatnonzero(windows_inside(self.bounds, window))
        hashed = lambda seed: window_hashes(word_hashes(self.data, self.starts, self.ends, seed=seed), window, seed)[self.at]
        self.hashes = hashed(0)
        self.others = hashed(1) if second else None
        self.owner_ids = self.ids[owners(self.bounds)[self.at]]

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct hashes in ascending order, the smallest id of each, the place of a window with each, and for each window the index of its hash."""
        none = np.zeros(0, np.int64)
        if not len(self.hashes):
            return self.hashes, none, none, none
        order = np.argsort(self.hashes, kind="stable")
        ordered = self.hashes[order]
        new = np.ones(len(ordered), bool)
        new[1:] = ordered[1:] != ordered[:-1]
        heads = np.flatnonzero(new)
        index = np.empty(len(ordered), np.int64)
        index[order] = np.cumsum(new) - 1
        return ordered[heads], np.minimum.reduceat(self.owner_ids[order], heads), order[heads], index


def _to_ranges(blk: int, n: int, bits: int, hashes: np.ndarray, *others: np.ndarray) -> pa.Table:
    """Ascending hashes of so many bits, with other columns, cut at the bounds of n even ranges."""
    bounds = np.array([-(-(i << bits) // n) for i in range(1, n)], U) if n <= len(hashes) else None
    if bounds is not None:
        cuts = np.concatenate([[0], np.searchsorted(hashes, bounds), [len(hashes)]])
        full = np.flatnonzero(np.diff(cuts))
        buckets, cuts = full, np.append(cuts[full], len(hashes)) if len(full) else np.zeros(1, np.int64)
    else:  # more ranges than hashes
        own = np.array([(int(h) * n) >> bits for h in hashes], np.int64)
        first = np.flatnonzero(np.diff(own, prepend=-1))
        buckets, cuts = own[first], np.append(first, len(hashes))
    spans = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
    return pa.table(
        {
            "bucket": pa.array(buckets, pa.int64()),
            "blk": pa.array([blk] * len(spans), pa.int64()),
            "n": pa.array([b - a for a, b in spans], pa.int64()),
            "packed": pa.array([_pack(hashes[a:b], *[c[a:b] for c in others]) for a, b in spans], pa.binary()),
        }
    )


def _prefixes(window: int, n: int) -> Callable:
    def prefixes(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return _to_ranges(key[0].as_py(), n, PREFIX, np.unique(_Block(table, window).hashes >> U(64 - PREFIX)))

    return prefixes


def _parts(table: pa.Table, others: int = 0) -> tuple[list[int], list[np.ndarray], np.ndarray]:
    """The block of each record of a range, all records' columns one after another, and the record of each hash."""
    ns = table.column("n").to_pylist()
    unpacked = [_unpack(p.as_py(), n, others) for p, n in zip(table.column("packed"), ns, strict=True)]
    columns = [np.concatenate([u[k] for u in unpacked]) for k in range(1 + others)]
    return table.column("blk").to_pylist(), columns, np.repeat(np.arange(len(ns)), ns)


def _answers(blks: list[int], hashes: np.ndarray, part: np.ndarray, wanted: np.ndarray) -> pa.Table:
    """For each block its wanted hashes."""
    hashes, part = hashes[wanted], part[wanted]
    cuts = np.searchsorted(part, np.arange(len(blks) + 1)).tolist()
    rows = [(blks[k], b - a, _pack(hashes[a:b])) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
    return pa.table([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_PACKED)], schema=_PACKED)


def _shared(table: pa.Table) -> pa.Table:
    """Of one range: for each block the prefixes that another block holds too."""
    blks, (hashes,), part = _parts(table)
    order = np.argsort(hashes, kind="stable")
    ordered = hashes[order]
    same = ordered[1:] == ordered[:-1]
    wanted = np.zeros(len(hashes), bool)
    wanted[order[1:][same]] = wanted[order[:-1][same]] = True
    return _answers(blks, hashes, part, wanted)


def _suspects(window: int, n: int) -> Callable:
    def suspects(key: tuple[pa.Scalar, ...], table: pa.Table, heard: pa.Table) -> pa.Table:
        if not table.num_rows or not heard.num_rows:
            return _to_ranges(0, n, 64, np.zeros(0, U))
        block = _Block(table, window, second=True)
        hashes, smallest, place, _ = block.distinct()
        _, (prefixes,), _ = _parts(heard)
        prefixes = np.sort(prefixes)
        own = hashes >> U(64 - PREFIX)
        at = np.searchsorted(prefixes, own)
        shared = prefixes[np.minimum(at, len(prefixes) - 1)] == own
        return _to_ranges(key[0].as_py(), n, 64, hashes[shared], block.others[place[shared]], smallest[shared].view(U))

    return suspects


def _late(table: pa.Table) -> pa.Table:
    """Of one range: for each block the windows that another block holds under a smaller id."""
    blks, (hashes, others, ids), part = _parts(table, 2)
    ids = ids.view(np.int64)
    order = np.lexsort((others, hashes))
    new = np.ones(len(order), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (others[order][1:] != others[order][:-1])
    least = np.minimum.reduceat(ids[order], np.flatnonzero(new))[np.cumsum(new) - 1] if len(order) else ids
    late = np.empty(len(order), bool)
    late[order] = ids[order] > least
    return _answers(blks, hashes, part, late)


def _results(table: pa.Table, block: _Block, covered: np.ndarray, keep_text: bool) -> pa.Table:
    raw = block.data.tobytes()
    out: dict[str, list] = {"n_words": [], "n_removed": [], "kept_text": [], "removed": []}
    for i in range(table.num_rows):
        a, b = int(block.bounds[i]), int(block.bounds[i + 1])
        words = raw[block.offsets[i] : block.offsets[i + 1]].split()
        mask = covered[a:b]
        spans: list[dict] = []
        if mask.any():
            edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))).reshape(-1, 2)
            spans = [{"start": int(s), "end": int(e)} for s, e in edges]
            keep, at = [], 0
            for s, e in edges:
                keep += words[at:s]
                at = e
            words = keep + words[at:]
        out["n_words"].append(b - a)
        out["n_removed"].append(int(mask.sum()))
        out["kept_text"].append(b" ".join(words).decode())
        out["removed"].append(spans)
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    before = {"id": table.column("id"), "row": table.column("row")} | ({"text": table.column("text")} if keep_text else {})
    return pa.table(
        before | {"n_words": pa.array(out["n_words"], pa.int64()), "n_removed": pa.array(out["n_removed"], pa.int64()),
         "kept_text": pa.array(out["kept_text"], pa.string()), "removed": pa.array(out["removed"], span)}
    )


def _remove(window: int, keep_text: bool) -> Callable:
    def remove(key: tuple[pa.Scalar, ...], table: pa.Table, heard: pa.Table) -> pa.Table:
        block = _Block(table, window)
        hashes, smallest, _, index = block.distinct()
        gone = np.zeros(len(block.starts) + 1, np.int64)
        if len(hashes):
            repeated = np.zeros(len(hashes), bool)
            if heard.num_rows:
                repeated[np.searchsorted(hashes, _parts(heard)[1][0])] = True
            marked = block.at[repeated[index] | (block.owner_ids > smallest[index])]
            np.add.at(gone, marked, 1)
            np.add.at(gone, marked + window, -1)
        return _results(table, block, np.cumsum(gone)[:-1] > 0, keep_text)

    return remove


def _whole(keep_text: bool) -> Callable:
    """Results of rows that lose nothing."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                table = pa.Table.from_batches([part])
                block = _Block(table.set_column(0, "id", pa.array(np.zeros(len(part), np.int64))), 1)
                found = _results(table, block, np.zeros(len(block.starts), bool), keep_text)
                yield from found.combine_chunks().to_batches()

    return whole


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, carry: list[str] | None = None, n_blocks: int | None = None, n_ranges: int | None = None) -> DataFrame:
    """One row for each row of docs: id, n_words, n_removed, kept_text (kept words joined by one space) and removed.

    removed holds the maximal removed intervals as word positions, end exclusive. Columns named in carry come along as
    the struct `row`, and the whole text as `text`. n_blocks and n_ranges (default: by size) only deal out work; they never
    change the result.
    """
    if window < 1:
        raise ValueError("window must be at least 1")
    size = 0 if n_blocks and n_ranges else text_bytes(docs, text_col)
    n, ranges = n_blocks or max(1, -(-size // BLOCK_BYTES)), n_ranges or max(1, -(-size // (RANGE * BYTES_A_WINDOW)))
    parts = min(PARTITIONS, -(-n // BLOCKS))
    row = packed_row(docs, carry) if carry else F.lit(None).cast("int").alias("row")
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"), row)
    told_apart = [F.col(f"row.`{f.name}`") for f in rows.schema["row"].dataType.fields if isinstance(f.dataType, AtomicType)] if carry else []
    dealt = rows.filter("id is not null").withColumn("blk", F.pmod(F.xxhash64("id", "text", *told_apart), F.lit(n))).repartition(parts, "blk")
    sent, answer = "bucket long, blk long, n long, packed binary", "blk long, n long, packed binary"
    prefixes = dealt.groupBy("blk").applyInArrow(_prefixes(window, ranges), sent).repartition(parts, "bucket")
    shared = prefixes.groupBy("bucket").applyInArrow(_shared, answer).repartition(parts, "blk")
    suspects = dealt.groupBy("blk").cogroup(shared.groupBy("blk")).applyInArrow(_suspects(window, ranges), sent).repartition(parts, "bucket")
    heard = suspects.groupBy("bucket").applyInArrow(_late, answer).repartition(parts, "blk")
    kind = dealt.schema["row"].dataType.simpleString()
    schema = f"id bigint, row {kind}, {'text string, ' * bool(carry)}n_words bigint, n_removed bigint, kept_text string, removed array<struct<start:bigint,end:bigint>>"
    out = dealt.groupBy("blk").cogroup(heard.groupBy("blk")).applyInArrow(_remove(window, bool(carry)), schema)
    out = out.unionAll(batched(rows.filter("id is null"), _whole(bool(carry)), schema))
    return (out if carry else out.drop("row")).withColumnRenamed("id", id_col)


def reference(rows: list[tuple], window: int = WINDOW) -> dict:
    """Brute force over (id, text) rows, for tests: {id: (n_words, n_removed, sha256)} by comparing word sequences."""
    split = [(i, (t or "").encode().split()) for i, t in rows]
    first: dict[tuple, int] = {}
    for i, words in split:
        for k in range(len(words) - window + 1):
            if i is not None:
                seq = tuple(words[k : k + window])
                first[seq] = min(i, first.get(seq, i))
    out = {}
    for i, words in split:
        gone = [False] * len(words)
        for k in range(len(words) - window + 1):
            if i is not None and first[tuple(words[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out[i] = (len(words), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


__all__ = ["WINDOW", "reference", "substring_dedup"]
