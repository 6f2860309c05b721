"""Counts over whole texts, vectorised over Arrow batches, and ratios of them as Spark columns.

A null text counts as empty. Every count is exact over the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from layerloom.llm._spark import batched, held_out
from layerloom.llm._words import SEPARATORS, U, buffers, mix, owners, window_hashes, windows_inside, word_hashes, word_spans

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_digits", "n_bangs", "n_bars", "n_stops", "n_same", "n_lines")
#: Bytes of text that are counted in one go.
SLICE_BYTES = 4 << 20


def _set(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SYMBOLS, _UPPER, _DIGITS = _set(b"#*$%&|<>"), _set(bytes(range(65, 91))), _set(b"0123456789")
_BANGS, _BARS, _STOPS, _BREAKS = _set(b"!"), _set(b"|"), _set(b"."), _set(b"\n")
_HEADS = _set(bytes(range(0x80))) | _set(bytes(range(0xC0, 0x100)))


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about limit bytes of text; a longer text makes a run of its own."""
    sizes = np.cumsum(pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


def _repeats(keys: np.ndarray) -> np.ndarray:
    """For each key: 0 if it occurs once, 1 at its first occurrence of several, 2 at later ones."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    same = ordered[1:] == ordered[:-1]
    kind = np.zeros(len(keys), np.int8)
    kind[1:][same] = 2
    kind[:-1][same & (kind[:-1] == 0)] = 1
    out = np.empty_like(kind)
    out[order] = kind
    return out


def _within(hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    return mix(hashes + mix(owner.astype(U) + U(1)))


def count_texts(column: pa.Array) -> dict[str, np.ndarray]:
    data, offsets = buffers(column)
    starts, ends, bounds = word_spans(data, offsets)
    n = len(offsets) - 1
    per_text = lambda at: np.diff(np.searchsorted(at, offsets))
    count = lambda table: per_text(np.flatnonzero(table[data]))
    out = {"n_words": np.diff(bounds), "word_chars": count(_HEADS) - count(SEPARATORS), "n_symbols": count(_SYMBOLS)}

    breaks = np.flatnonzero(data == 10)
    cut = np.searchsorted(breaks, offsets)  # the breaks before each text
    line_owner = np.repeat(np.arange(n), np.diff(cut) + 1)
    first = cut[:-1] + np.arange(n)  # each text's first line
    line_starts = np.empty(len(breaks) + n, np.int64)
    line_starts[first] = offsets[:-1]
    inner = np.ones(len(line_starts), bool)
    inner[first] = False
    line_starts[inner] = breaks + 1
    line_ends = np.empty_like(line_starts)
    line_ends[first[1:] - 1] = offsets[1:-1]
    line_ends[-1:] = len(data)
    inner = np.ones(len(line_starts), bool)
    inner[first[1:] - 1] = inner[-1:] = False
    line_ends[inner] = breaks
    full = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    keys = _within(word_hashes(data, line_starts[full], line_ends[full]), line_owner[full])
    out["n_dup_lines"] = np.bincount(line_owner[full][_repeats(keys) == 2], minlength=n)

    words, owner = word_hashes(data, starts, ends), owners(bounds)
    covered = np.zeros(len(words), bool)
    at = np.flatnonzero(windows_inside(bounds, 3))
    if len(at):
        again = at[_repeats(_within(window_hashes(words, 3)[at], owner[at])) > 0]
        for k in range(3):
            covered[again + k] = True
    out["n_repeat_words"] = np.bincount(owner[covered], minlength=n)
    same = np.flatnonzero((words[1:] == words[:-1]) & (owner[1:] == owner[:-1])) + 1
    latin = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E))
    out |= {"n_upper": count(_UPPER) + per_text(latin), "n_digits": count(_DIGITS), "n_bangs": count(_BANGS), "n_bars": count(_BARS), "n_stops": count(_STOPS)}
    return out | {"n_same": np.bincount(owner[same], minlength=n), "n_lines": count(_BREAKS) + 1}


def with_counts(df: DataFrame, text: str, keep_text: bool = False) -> DataFrame:
    """df's other columns, its text column (if keep_text) and COUNTS of it, as bigint."""
    keep = [c for c in df.columns if keep_text or c != text]
    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep] + [f"{c} bigint" for c in COUNTS])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                found = count_texts(part.column(text))
                yield pa.RecordBatch.from_arrays([part.column(c) for c in keep] + [pa.array(found[c].astype(np.int64)) for c in COUNTS], [*keep, *COUNTS])

    return batched(df.select(*[c for c in keep if c != text], text), count, schema)


def ratios() -> dict[str, Column]:
    """What the learned quality operators look at, as columns over COUNTS; 0 for texts without words."""
    words, chars, lines = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1)), F.greatest(F.col("n_lines"), F.lit(1))
    return {
        "words": F.col("n_words").cast("double"),
        "word_length": F.col("word_chars") / words,
        "symbols": F.col("n_symbols") / words,
        "bars": F.col("n_bars") / words,
        "bangs": F.col("n_bangs") / words,
        "stops": F.col("n_stops") / words,
        "upper": F.col("n_upper") / chars,
        "digits": F.col("n_digits") / chars,
        "repeats": F.col("n_repeat_words") / words,
        "same_again": F.col("n_same") / words,
        "dup_lines": F.col("n_dup_lines") / lines,
    }


RATIOS = ("words", "word_length", "symbols", "bars", "bangs", "stops", "upper", "digits", "repeats", "same_again", "dup_lines")


def labelled_ratios(docs: DataFrame, labels: DataFrame, label: str, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Ratios and 0/1 labels of at most limit labelled documents outside the held-out fold.

    The bound is the sample's size and concerns learning only: of more labelled rows, those with the smallest hashes
    of their ids are taken. Rows without id, label or document are left out.
    """
    ids = labels.select(F.col("doc_id").cast("bigint").alias("label_id"), F.col(label).cast("int").alias("label"))
    ids = ids.filter(F.col("label_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out("label_id"))
    sample = ids.orderBy(F.xxhash64("label_id"), "label").limit(limit)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("label_id"), "text").join(F.broadcast(sample), "label_id")  # limit rows of 12 bytes
    rows = with_counts(texts, "text").select("label", "label_id", *[c.alias(k) for k, c in ratios().items()]).toPandas()
    rows = rows.sort_values(["label_id", "label", *RATIOS])
    return rows[list(RATIOS)].to_numpy(float), rows["label"].to_numpy(int)
