"""BPE encoding and decoding with a public byte-level vocabulary.

Method. Text is cut at special tokens, then into pre-tokens by the vocabulary's pattern. Within a pre-token an
Aho-Corasick automaton over all tokens gives the longest token at a position; a token is taken if a table says that it
can follow the last one, else the next shorter token is tried, and if none is left the last token is taken back. A pair
of tokens is compatible if merging would never join them: no merge of a token on the right edge of the first with one
on the left edge of the second comes before the merges that hide these edges. A sequence whose neighbours are all
compatible is the one that merging by rank gives, so the result is exact; positions from which nothing could follow
are marked and never tried again, and the automaton only ever sees as many bytes as the longest token has, so the time
is linear in a pre-token's length too. A pre-token surely starts where white space does, so a text is first cut there,
mostly at single spaces; such pieces and pre-tokens repeat, so bounded tables keep their tokens. A long text is cut a part
at a time.

Decoding looks up each id's bytes in one array by an offset table; bytes that are no UTF-8 become U+FFFD.

Defined cases: a null or empty text has no tokens and decodes to an empty text; very long texts, also of one pre-token, are
worked on whole; repeated rows give repeated results, an empty table none; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from layerloom.llm._spark import batched
from layerloom.llm._stats import slices

#: Byte-level pre-tokens: contractions, words, numbers and signs with a space before, white space.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space, as the pattern's; runs of more than one are kept with the word that follows.
RUNS = re.compile("([ \t-\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{2,})")
#: Signs that often end a word.
MARKS = frozenset(".,;:!?)")
#: Pre-tokens, and pieces, whose tokens are kept, and their length at most.
KEPT, KEPT_LENGTH = 300_000, 64
PAIRS = 1_000_000
#: Characters whose pre-tokens are held at a time, about.
PART = 1 << 20


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes for themselves, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens, merges and special tokens of a tokenizers file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters, vocab = byte_letters(), spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens: dict[int, bytes] = {i: bytes(letters[c] for c in t) for t, i in vocab.items() if t not in self.special}
        self.ids = {b: i for i, b in self.tokens.items()}
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}  # pair -> rank, token
        self.parts: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            self.merge.setdefault((x, y), (rank, z))
            self.parts.setdefault(z, (x, y))
        self.rank = {z: self.merge[p][0] for z, p in self.parts.items()}
        size = max([*self.tokens, *self.special.values()]) + 1
        everything = [self.tokens.get(i, b"") for i in range(size)]
        for text, i in self.special.items():
            everything[i] = text.encode()
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for t in everything])])
        self.bytes = np.frombuffer(b"".join(everything), np.uint8)


class Kept(dict):
    """A bounded table of tokens, as 32-bit integers, by text: when it is full, what was not met since it was last full goes."""

    def __init__(self):
        super().__init__()
        self.old: dict[str, bytes] = {}

    def make(self, text: str) -> bytes:
        raise NotImplementedError

    def __missing__(self, text: str) -> bytes:
        ids = self.old.get(text)
        if ids is None:
            ids = self.make(text)
        if len(text) <= KEPT_LENGTH:
            if len(self) >= KEPT:
                self.old = self.copy()
                self.clear()
            self[text] = ids
        return ids


class Pieces(Kept):
    """The tokens of pieces of text that start with white space or at the start of a text; before: what stands before each."""

    def __init__(self, encoder: Encoder, before: str = ""):
        super().__init__()
        self.encoder, self.before = encoder, before

    def make(self, text: str) -> bytes:
        encoder = self.encoder
        if text.isalpha():  # one pre-token
            return encoder.make(self.before + text)
        if text[-1:] in MARKS and text[:-1].isalpha():  # two
            return self[text[:-1]] + encoder[text[-1]]
        return b"".join(map(encoder.__getitem__, encoder.find(self.before + text)))


class Encoder(Kept):
    """An encoder, and the table of pre-tokens that it has met."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.v = vocabulary
        self.longest = ahocorasick.Automaton()
        for token, i in vocabulary.ids.items():
            self.longest.add_word(token.decode("latin-1"), i)
        self.longest.make_automaton()
        self.size = {i: len(t) for i, t in vocabulary.tokens.items()}
        self.find = regex.compile(PATTERN).findall
        self.start = regex.compile(r"(?<=\S) (?=\S)").search  # a pre-token starts with such a space
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(vocabulary.special, key=len, reverse=True)) + ")") if vocabulary.special else None
        self.most = max(self.size.values())
        self.pairs: dict[tuple[int, int], bool] = {}
        self.shorter: dict[int, int] = {}
        self.edges: dict[tuple[int, int], list[tuple[int, float]]] = {}
        self.pieces, self.spaced = Pieces(self), Pieces(self, " ")
        self.end = array("I", [vocabulary.ids[b"\n"]]).tobytes()

    def edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """The tokens on one edge (0: left, 1: right) of a token, from whole to byte, with the rank of the merge that hides each."""
        if (token, side) not in self.edges:
            out: list[tuple[int, float]] = [(token, float("inf"))]
            while (now := out[-1][0]) in self.v.parts:
                out.append((self.v.parts[now][side], self.v.rank[now]))
            self.edges[token, side] = out
        return self.edges[token, side]

    def compatible(self, a: int, b: int) -> bool:
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            merge, right = self.v.merge, self.edge(b, 0)
            # Of two merges of one rank the one further left comes first: the first token's own, then the joint one.
            known = not any((m := merge.get((x, y))) and m[0] < hides_x and m[0] <= hides_y for x, hides_x in self.edge(a, 1) for y, hides_y in right)
            self.pairs[a, b] = known
        return known

    def next_shorter(self, token: int) -> int:
        """The longest token that is a proper prefix of a token; -1 if there is none."""
        found = self.shorter.get(token)
        if found is None:
            text = self.v.tokens[token]
            found = next((self.v.ids[text[:k]] for k in range(len(text) - 1, 0, -1) if text[:k] in self.v.ids), -1)
            self.shorter[token] = found
        return found

    def word(self, word: bytes) -> tuple[int, ...]:
        """The tokens of one pre-token."""
        whole = self.v.ids.get(word)
        if whole is not None:
            return (whole,)
        text, n, size, pairs = word.decode("latin-1"), len(word), self.size, self.pairs
        # Taking the longest token again and again is mostly right: all neighbours are compatible.
        out: list[int] = []
        at, last, token = 0, -1, -1
        for _, token in self.longest.iter_long(text):
            if last >= 0 and not pairs.get((last, token), False) and not self.compatible(last, token):
                break
            out.append(token)
            at += size[token]
            last = token
        if at == n:
            return tuple(out)
        longest = lambda at: next(self.longest.iter_long(text[at : at + self.most]))[1]
        dead: set[int] = set()
        while True:
            last = out[-1] if out else -1
            while token >= 0 and (at + size[token] in dead or (last >= 0 and not self.compatible(last, token))):
                token = self.next_shorter(token)
            if token >= 0:
                out.append(token)
                at += size[token]
                if at == n:
                    return tuple(out)
                token = longest(at)
            else:
                dead.add(at)
                token = out.pop()
                at -= size[token]

    def make(self, text: str) -> bytes:
        return array("I", self.word(text.encode())).tobytes()

    def _plain(self, text: str) -> bytes:
        if len(text) <= 2 * PART:
            return self._known(text)
        out, at = [], 0
        while at < len(text):
            gap = self.start(text, at + PART) if len(text) - at > 2 * PART else None
            to = gap.start() if gap else len(text)
            out.append(self._known(text[at:to]))
            at = to
        return b"".join(out)

    def _known(self, text: str) -> bytes:
        """The tokens of a text: its white space stands alone within a part, so that each word takes the space before it."""
        pieces, spaced, out = self.pieces, self.spaced.__getitem__, []
        parts = RUNS.split(text)
        for k in range(0, len(parts), 2):
            before = parts[k - 1] if k else ""
            for line in parts[k].split("\n"):
                first, *others = line.split(" ")
                out.append(pieces[before + first])
                out += map(spaced, others)
                out.append(self.end)
                before = ""
            out.pop()
        return b"".join(out)

    def encode(self, text: str) -> np.ndarray:
        if self.cut is None or not self.cut.search(text):
            return np.frombuffer(self._plain(text), np.uint32)
        special = self.v.special
        parts = [array("I", [special[p]]).tobytes() if p in special else self._plain(p) for p in self.cut.split(text)]
        return np.frombuffer(b"".join(parts), np.uint32)

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        if not len(ids):
            return b""
        starts, sizes = self.v.offsets[ids], np.diff(self.v.offsets)[ids]
        ends = np.cumsum(sizes)
        return self.v.bytes[np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1])].tobytes()


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(Vocabulary(path))


def _round_trip(path: str, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for batch in batches:
            for part in slices(batch, "text"):
                n, ids_hash, texts, all_ids = [], [], [], []
                for text in part.column("text").to_pylist():
                    ids = e.encode(text or "")
                    n.append(len(ids))
                    ids_hash.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                    texts.append(e.decode_bytes(ids).decode("utf-8", "replace"))
                    if keep_ids:
                        all_ids.append(ids.astype(np.int32))
                columns = [part.column("id"), pa.array(n, pa.int64()), pa.array(ids_hash), pa.array(texts, pa.string())]
                names = ["id", "n_tokens", "ids_sha256", "decoded"]
                if keep_ids:
                    columns.append(pa.array(all_ids, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def bpe_round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """One row for each row of docs: id, n_tokens, ids_sha256, decoded and (if keep_ids) ids. path must be readable on all executors."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_tokens bigint, ids_sha256 string, decoded string" + ", ids array<int>" * keep_ids
    return batched(rows, _round_trip(path, keep_ids), schema).withColumnRenamed("id", id_col)
