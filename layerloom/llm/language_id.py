"""Language identification of words in code-switched text by a linear-chain conditional random field.

Method. Each word's features are its character n-grams of 1 to 4 bytes, those that touch a word's edges (affixes) among
them, and the word itself (lexicon), hashed into one table of weights for each language. A chain runs over all words of a
text; its transitions are learned. Forward-backward gives each word's distribution over languages; a document's
language is the one with the largest mean over its words with letters, and its score is that mean.

Learning takes texts with a known language. As these rarely mix, spans of texts of different languages are spliced into
training chains, so that transitions are learned too; the likelihood of the chains is maximised by AdaGrad steps.

Words are trimmed to their letters (bytes from 0x80 on count as letters) and lower-cased (A-Z and the Latin letters of
U+00C0 to U+00DE) before features are taken; a word without letters has none and only carries its neighbours' labels.
Chains of a batch advance side by side: each step is one small matrix product over all texts that are still that long.

Defined cases: a null text, or one without any letter, is `und` with score 0; so is every text if nothing could be
learned; with one learned language all else is that language. Ties go to the language that sorts first. Very long texts
are labelled whole; repeated rows get repeated results, an empty table none; other columns are carried along whatever
their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from layerloom.llm._spark import batched, packed_row
from layerloom.llm._stats import slices
from layerloom.llm._words import U, buffers, mix, word_hashes, word_spans

#: Documents to learn from in each language, about, and the characters taken from each, from a place that its hash picks.
SAMPLE, SAMPLE_CHARS = 300, 1 << 15
BUCKETS, GRAMS = 1 << 16, (1, 2, 3, 4)
CHAINS, CHAIN, SPAN = 2500, 40, 12
ROUNDS, STEP, SHRINK = 30, 0.4, 1e-6
#: Bytes of text whose chains advance together.
SLICE_BYTES = 4 << 20
#: Kinds of words whose features are held at a time.
KINDS = 1 << 13
EDGE = 0x00
_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_HAS_LETTER = regex.compile(r"\p{L}")


@dataclass
class Words:
    """The words of some texts: bounds as word_spans gives them, the kind of each word, and the letters of each kind.

    buffer holds the kinds one after another, each with an edge on both sides; begin is where each starts.
    """

    bounds: np.ndarray
    kinds: np.ndarray
    lettered: np.ndarray
    buffer: np.ndarray = field(repr=False)
    begin: np.ndarray = field(repr=False)

    def features(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """The features of kinds low to high (exclusive), kind by kind, and where each kind's begin."""
        begin = self.begin[low : high + 1] - self.begin[low]
        buffer = self.buffer[self.begin[low] : self.begin[high]]
        owner = np.repeat(np.arange(high - low, dtype=np.int32), np.diff(begin))
        full = np.flatnonzero(self.lettered[low:high])
        whole = word_hashes(buffer, begin[full], begin[full + 1])
        columns, owners = [(mix(whole) % U(BUCKETS)).astype(np.int32)], [full.astype(np.int32)]
        wide = buffer.astype(U)
        rolling = wide
        for n in range(1, max(GRAMS) + 1):
            if n > 1:
                rolling = rolling[:-1] * U(256) + wide[n - 1 :]
            if n in GRAMS and len(rolling):
                at = np.flatnonzero(owner[: len(rolling)] == owner[n - 1 :])
                if n == 1:
                    at = at[buffer[at] != EDGE]
                columns.append((mix(rolling[at] + (U(n) << U(40))) % U(BUCKETS)).astype(np.int32))
                owners.append(owner[at])
        of, found = np.concatenate(owners), np.concatenate(columns)
        order = np.argsort(of, kind="stable")
        return found[order], np.searchsorted(of[order], np.arange(high - low + 1))

    def scores(self, weights: np.ndarray) -> np.ndarray:
        """Each kind's score in each language."""
        out = np.zeros((len(self.lettered), weights.shape[1]), np.float32)
        for low in range(0, len(out), KINDS):
            found, first = self.features(low, min(len(out), low + KINDS))
            full = np.flatnonzero(np.diff(first))
            if len(full):
                out[low + full] = np.add.reduceat(weights[found], first[full], axis=0)
        return out


def words_of(column: pa.Array) -> Words:
    data, offsets = buffers(column)
    starts, ends, bounds = word_spans(data, offsets)
    _, first, kinds = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
    starts, ends = starts[first], ends[first]
    letters = np.flatnonzero(_LETTERS[data])
    low, high = np.searchsorted(letters, starts), np.searchsorted(letters, ends)
    lettered = high > low
    starts, ends = starts.copy(), ends.copy()
    starts[lettered], ends[lettered] = letters[low[lettered]], letters[high[lettered] - 1] + 1
    ends[~lettered] = starts[~lettered]
    # All kinds in one buffer, an edge on both sides of each.
    sizes = np.where(lettered, ends - starts + 2, 0)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    total = int(begin[-1])
    buffer = np.zeros(total, np.uint8)
    inner = np.ones(total, bool)
    inner[begin[:-1][lettered]] = inner[begin[1:][lettered] - 1] = False
    spans = (ends - starts)[lettered]
    source = np.repeat(starts[lettered] - np.cumsum(spans) + spans, spans) + np.arange(int(spans.sum()))
    buffer[inner] = _LOWER[data[source]]
    latin = np.flatnonzero((buffer[:-1] == 0xC3) & (buffer[1:] >= 0x80) & (buffer[1:] <= 0x9E)) + 1
    buffer[latin] += 0x20
    return Words(bounds, kinds, lettered, buffer, begin)


def forward_backward(emissions: np.ndarray, bounds: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Each word's distribution over languages, exact over whole chains; emissions and transitions are logarithms."""
    lengths = np.diff(bounds)
    order = np.argsort(-lengths, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    longest = int(lengths.max(initial=0))
    alive = np.searchsorted(-lengths[order], -np.arange(longest), "left")  # chains longer than t
    at = np.concatenate([[0], np.cumsum(alive)])
    place = at[np.arange(bounds[-1]) - np.repeat(bounds[:-1], lengths)] + np.repeat(rank, lengths)
    e = np.empty((int(bounds[-1]), emissions.shape[1]), np.float32)
    e[place] = np.exp(np.maximum(emissions - emissions.max(axis=1, keepdims=True), -60))
    a = np.exp(transitions - transitions.max()).astype(np.float32)
    tiny = np.float32(1e-30)
    alpha = e.copy()
    for t in range(longest):
        now = alpha[at[t] : at[t + 1]]
        if t:
            now *= alpha[at[t - 1] : at[t - 1] + len(now)] @ a
        now /= now.sum(axis=1, keepdims=True) + tiny
    back = np.ones((int(alive[0]) if longest else 0, e.shape[1]), np.float32)
    for t in range(longest - 1, 0, -1):
        k = int(alive[t])
        message = (e[at[t] : at[t + 1]] * back[:k]) @ a.T
        alpha[at[t] : at[t + 1]] *= back[:k]
        message /= message.sum(axis=1, keepdims=True) + tiny
        back[:k] = message
    if longest:
        alpha[: at[1]] *= back
    alpha /= alpha.sum(axis=1, keepdims=True) + tiny
    return alpha[place]


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    weights: np.ndarray
    transitions: np.ndarray

    def posteriors(self, words: Words) -> np.ndarray:
        return forward_backward(self.scores_of(words), words.bounds, self.transitions)

    def scores_of(self, words: Words) -> np.ndarray:
        return words.scores(self.weights)[words.kinds]


def learn(texts: list[str], languages: list[str]) -> LanguageModel:
    """The field for texts of known languages."""
    names = sorted(set(languages))
    if len(names) < 2:
        return LanguageModel(tuple(names), np.zeros((BUCKETS, len(names)), np.float32), np.zeros((len(names), len(names))))
    words, random = words_of(pa.array(texts, pa.string())), np.random.default_rng(11)
    label = np.array([names.index(x) for x in languages])
    lengths = np.diff(words.bounds)
    pools = [np.flatnonzero((label == k) & (lengths > 0)) for k in range(len(names))]
    full = [k for k, p in enumerate(pools) if len(p)]
    kinds, truth = np.zeros((CHAINS, CHAIN), np.int64), np.zeros((CHAINS, CHAIN), np.int64)
    if not full:
        return LanguageModel((), np.zeros((BUCKETS, 0), np.float32), np.zeros((0, 0)))
    for c in range(CHAINS):
        t = 0
        while t < CHAIN:
            k = full[random.integers(len(full))]
            text = pools[k][random.integers(len(pools[k]))]
            start = int(words.bounds[text] + random.integers(lengths[text]))
            n = min(int(random.geometric(1 / SPAN)), int(words.bounds[text + 1]) - start, CHAIN - t)
            kinds[c, t : t + n], truth[c, t : t + n] = words.kinds[start : start + n], k
            t += n
    size, n = len(names), CHAINS * CHAIN
    used, index = np.unique(kinds.ravel(), return_inverse=True)
    parts, sizes = [], []
    for low in range(0, len(words.lettered), KINDS):  # only the features of the kinds that the chains use are kept
        found, first = words.features(low, min(len(words.lettered), low + KINDS))
        for k in used[(used >= low) & (used < low + KINDS)] - low:
            parts.append(found[first[k] : first[k + 1]].copy())
            sizes.append(len(parts[-1]))
    flat, of = np.concatenate(parts), np.repeat(np.arange(len(used)), sizes)
    weights, transitions = np.zeros((BUCKETS, size)), np.zeros((size, size))
    seen_w, seen_t = np.full((BUCKETS, size), 1e-8), np.full((size, size), 1e-8)
    bounds, onehot = np.arange(CHAINS + 1) * CHAIN, np.eye(size)[truth.ravel()]
    moves = np.zeros((size, size))
    np.add.at(moves, (truth[:, :-1].ravel(), truth[:, 1:].ravel()), 1)
    for _ in range(ROUNDS):
        of_kind = np.stack([np.bincount(of, weights[flat, k], len(used)) for k in range(size)], axis=1)
        emissions = of_kind[index]
        post = forward_backward(emissions.astype(np.float32), bounds, transitions)
        miss = post - onehot
        by_kind = np.stack([np.bincount(index, miss[:, k], len(used)) for k in range(size)], axis=1)
        gradient = np.stack([np.bincount(flat, by_kind[of, k], BUCKETS) for k in range(size)], axis=1) / n + SHRINK * weights
        expected = _expected_moves(emissions, post, transitions)
        gradient_t = (expected - moves) / n
        seen_w += gradient**2
        seen_t += gradient_t**2
        weights -= STEP * gradient / np.sqrt(seen_w)
        transitions -= STEP / 2 * gradient_t / np.sqrt(seen_t)
    return LanguageModel(tuple(names), weights.astype(np.float32), transitions)


def _expected_moves(emissions: np.ndarray, post: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Expected counts of neighbouring labels over the training chains."""
    size = len(transitions)
    e = np.exp(emissions - emissions.max(axis=1, keepdims=True)).reshape(CHAINS, CHAIN, size)
    a = np.exp(transitions - transitions.max())
    alpha = np.empty_like(e)
    alpha[:, 0] = e[:, 0] / e[:, 0].sum(axis=1, keepdims=True)
    for t in range(1, CHAIN):
        now = (alpha[:, t - 1] @ a) * e[:, t]
        alpha[:, t] = now / now.sum(axis=1, keepdims=True)
    out = np.zeros((size, size))
    post = post.reshape(CHAINS, CHAIN, size)
    for t in range(CHAIN - 1):  # p(i, j) = p(j at t + 1) * p(i at t given j), by the forward messages
        joint = alpha[:, t][:, :, None] * a
        joint /= joint.sum(axis=1, keepdims=True) + 1e-30
        out += (joint * post[:, t + 1][:, None, :]).sum(axis=0)
    return out


def predict(model: LanguageModel, column: pa.Array) -> tuple[list[str], np.ndarray, Words, np.ndarray]:
    """Each text's language and score, its words and their distributions."""
    words = words_of(column)
    n, size = len(words.bounds) - 1, len(model.languages)
    languages, scores = ["und"] * n, np.zeros(n)
    if not size:
        return languages, scores, words, np.zeros((0, 0))
    post = model.posteriors(words)
    counted = words.lettered[words.kinds]
    total = np.zeros((len(counted) + 1, size))
    np.cumsum(post * counted[:, None], axis=0, dtype=float, out=total[1:])
    count = np.concatenate([[0], np.cumsum(counted)])
    share = (total[words.bounds[1:]] - total[words.bounds[:-1]]) / np.maximum(1, count[words.bounds[1:]] - count[words.bounds[:-1]])[:, None]
    best = share.argmax(axis=1)
    for i, text in enumerate(column.to_pylist()):
        if text and count[words.bounds[i + 1]] > count[words.bounds[i]] and _HAS_LETTER.search(text):
            languages[i], scores[i] = model.languages[best[i]], min(1.0, float(share[i, best[i]]))
    return languages, scores, words, post


def _spans(model: LanguageModel, words: Words, post: np.ndarray) -> list[list[dict]]:
    """Of each text: runs of words (end exclusive) with one most likely language."""
    best, out = post.argmax(axis=1) if len(post) else np.zeros(0, int), []
    for a, b in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist(), strict=True):
        cuts = [0, *(np.flatnonzero(np.diff(best[a:b])) + 1).tolist(), b - a] if b > a and len(best) else [0]
        out.append([{"start": s, "end": e, "lang": model.languages[best[a + s]]} for s, e in zip(cuts, cuts[1:], strict=False)])
    return out


def _certainty(words: Words, post: np.ndarray) -> np.ndarray:
    """Of each text: the mean probability of its words' own most likely languages, whichever they are; 0 without words."""
    counted = words.lettered[words.kinds]
    total = np.concatenate([[0.0], np.cumsum(post.max(axis=1) * counted, dtype=float)]) if post.size else np.zeros(len(counted) + 1)
    count = np.concatenate([[0], np.cumsum(counted)])
    return (total[words.bounds[1:]] - total[words.bounds[:-1]]) / np.maximum(1, count[words.bounds[1:]] - count[words.bounds[:-1]])


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text", keep_spans: bool = True, keep_text: bool = False, keep_certainty: bool = False) -> DataFrame:
    """docs' other columns as `row`, lang_pred, score, and what is kept: spans of words by language, text, certainty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                languages, scores, words, post = predict(model, part.column("text"))
                columns, names = [part.column("row"), pa.array(languages, pa.string()), pa.array(scores)], ["row", "lang_pred", "score"]
                if keep_spans:
                    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))
                    columns.append(pa.array(_spans(model, words, post), kind))
                    names.append("spans")
                if keep_text:
                    columns.append(part.column("text"))
                    names.append("text")
                if keep_certainty:
                    columns.append(pa.array(_certainty(words, post)))
                    names.append("certainty")
                yield pa.RecordBatch.from_arrays(columns, names)

    others = [c for c in docs.columns if c != text_col]
    rows = docs.select(packed_row(docs, others), F.col(f"`{text_col}`").alias("text"))
    schema = f"row {rows.schema['row'].dataType.simpleString()}, lang_pred string, score double"
    schema += ", spans array<struct<start:bigint,end:bigint,lang:string>>" * keep_spans + ", text string" * keep_text + ", certainty double" * keep_certainty
    return batched(rows, run, schema)


def learn_from(docs: DataFrame, usable: Column, sample: int = SAMPLE) -> LanguageModel:
    """A model of the languages that usable rows of docs (lang, text) name, from about `sample` of them in each.

    The bound is the sample's size and concerns learning only: of each language the rows with the smallest hashes of
    their ids and texts are taken, and of a text longer than SAMPLE_CHARS so many characters from a place picked by its hash.
    """
    rows = docs.filter(usable & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row a language
    if not counts:
        return learn([], [])
    cuts = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, math.ceil(min(1.0, sample / n) * 2**31))])
    chosen = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(2**31)) < cuts[F.col("lang")])
    h = F.xxhash64("doc_id", "text")
    start = F.pmod(h, F.greatest(F.lit(1), F.char_length("text") - SAMPLE_CHARS + 1)).cast("int") + 1
    spans = chosen.select("lang", F.col("text").substr(start, F.lit(SAMPLE_CHARS)).alias("text"), h.alias("h"))
    found = spans.orderBy("h", "lang").limit(2 * sample * len(counts) + 100).toPandas()  # one id may have many rows
    return learn(found["text"].tolist(), found["lang"].tolist())
