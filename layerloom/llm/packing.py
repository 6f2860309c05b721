"""Best-fit packing of tokenised documents into sequences of at most `size` tokens.

Method. A document is its token ids and then id 0. One longer than a sequence is cut into pieces of `size` tokens, of
which the first may be shorter; full pieces fill a sequence each and stay out of the packing. All other pieces, one a
document at most, are packed by best-fit decreasing: a segment tree over remaining capacities finds the tightest open
sequence that takes a piece in as many steps as the capacity has bits. Pieces are dealt by hashes into groups of at most
about GROUP; each group is packed by one task, and the sequences that it leaves less than full are at most one more than
needed for its share of lengths, so the total is that of packing everything at once up to about one sequence a group.
The number of groups follows from the documents and their bytes (a token has one at least), so a corpus of long documents
makes no larger groups.

Tokens are those that the tokenizers library's own model makes of each pre-token. As pre-tokens repeat, bounded tables keep
what the model has made of them (bpe.py cuts texts into them; tests compare the ids with the library's on all code points, odd
texts and long runs), which takes half of the library's time.

Defined cases: a null or empty text is the single id 0; repeated rows stay separate documents and are spread over the groups;
a very long text is cut like any other; a null id is packed like any other; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from layerloom.llm._spark import batched
from layerloom.llm._stats import slices
from layerloom.llm.bpe import Encoder, Vocabulary, byte_letters

SIZE = 2048
#: Pieces that one task packs, at most about.
GROUP = 20_000
END = 0


class LibraryEncoder(Encoder):
    """An encoder whose pre-tokens are merged by the tokenizers library."""

    def __init__(self, path: str):
        super().__init__(Vocabulary(path))
        self.library = Tokenizer.from_file(path)
        self.merge = self.library.model.tokenize
        self.letters = "".join(sorted(byte_letters(), key=byte_letters().__getitem__))

    def make(self, text: str) -> bytes:
        plain = text.isascii() and text.isprintable()
        letters = text.replace(" ", self.letters[32]) if plain else text.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.merge(letters)]).tobytes()


@lru_cache(2)
def library_encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


class OpenBins:
    """A segment tree over remaining capacities 1..size: a node counts the open bins below it."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.bins: list[list[int]] = [[] for _ in range(size + 1)]

    def put(self, capacity: int, number: int) -> None:
        self.bins[capacity].append(number)
        self._add(capacity, 1)

    def _add(self, capacity: int, n: int) -> None:
        node = self.leaves + capacity
        while node:
            self.count[node] += n
            node >>= 1

    def tightest(self, least: int) -> int:
        """The smallest capacity of an open bin that is at least `least`; 0 if there is none."""
        node = self.leaves + least
        if self.count[node]:
            return least
        while node > 1:  # up to the first right sibling that holds a bin, then down its left side
            if not node & 1 and self.count[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.count[2 * node] else 2 * node + 1
                return node - self.leaves
            node >>= 1
        return 0

    def take(self, capacity: int) -> int:
        self._add(capacity, -1)
        return self.bins[capacity].pop()


def best_fit_decreasing(lengths: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """The bin of each length (0, 1, ...) and its offset there. Lengths are 1 to size; ties go in order."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree, opened = OpenBins(size), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        capacity = tree.tightest(n)
        if capacity:
            number = tree.take(capacity)
        else:
            number, capacity = opened, size
            opened += 1
        bins[i], offsets[i] = number, size - capacity
        if capacity > n:
            tree.put(capacity - n, number)
    return bins, offsets


def _pieces(path: str, size: int, keep_ids: bool):
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = library_encoder(path).encode, np.array([END], "<u4")
        for batch in batches:
            for part in slices(batch, "text"):
                ids, rows, kept = part.column("id").to_pylist(), [], []
                met: Counter = Counter()
                for doc, text in zip(ids, part.column("text").to_pylist(), strict=True):
                    tokens = np.concatenate([encode(text or "").astype("<u4", copy=False), end])
                    cuts = [0, *range(len(tokens) % size or size, len(tokens) + 1, size)] if len(tokens) > size else [0, len(tokens)]
                    whole = doc, len(tokens), zlib.crc32(tokens[: cuts[1]].tobytes())
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        rows.append((doc, k, a, b - a, zlib.crc32(tokens[a:b].tobytes()), met[whole]))
                        if keep_ids:
                            kept.append(tokens[a:b].astype(np.int32))
                    met[whole] += 1
                kinds = [part.schema.field("id").type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
                columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
                names = ["id", "piece", "start", "length", "ids_crc32", "again"]
                if keep_ids:
                    columns.append(pa.array(kept, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return pieces


def _pack(size: int):
    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("id", "ascending"), ("piece", "ascending")])
        lengths = table.column("length").to_numpy()
        full = int((lengths == size).sum())
        bins, offsets = best_fit_decreasing(lengths[full:], size)
        bins, offsets = np.concatenate([np.arange(full), bins + full]), np.concatenate([np.zeros(full, np.int64), offsets])
        group = table.column("salt").to_numpy()
        out = table.drop_columns(["again", "salt"])
        return out.append_column("sequence_id", pa.array((group << 32) + bins)).append_column("offset", pa.array(offsets))

    return pack


def best_fit_packing(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, group: int = GROUP, keep_ids: bool = True) -> DataFrame:
    """One row for each piece: id, piece, start, length, ids_crc32, sequence_id, offset and (if keep_ids) ids."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    columns = f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, again int" + ", ids array<int>" * keep_ids
    cut = batched(rows, _pieces(path, size, keep_ids), columns)
    n, n_bytes = docs.agg(F.count("*"), F.sum(F.octet_length(text_col))).first()
    n_groups = max(1, -(-(n + (n_bytes or 0) // size) // group))  # of at most so many pieces
    dealt = cut.withColumn("salt", F.pmod(F.xxhash64("id", "piece", "ids_crc32", "again"), F.lit(n_groups)))
    packed = dealt.groupBy("salt").applyInArrow(_pack(size), f"{columns.replace(', again int', '')}, sequence_id bigint, offset bigint")
    return packed.withColumnRenamed("id", id_col)
