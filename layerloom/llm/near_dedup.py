"""Near-duplicate groups: MinHash bands find candidates, odd sketches sift them, full shingle sets confirm them.

Method. A-Z is lower-cased; a document's set holds its distinct shingles of `ngram` words (the whole sequence as one
if there are fewer). 160 MinHash samples make 32 bands of 5; the same samples, folded into a parity bitmap of 512 bits
(an odd sketch), estimate a pair's similarity from the population count of the XOR of two bitmaps. Only pairs whose
estimate lies within five standard errors of the threshold have their full sets compared, and only these exact
comparisons make links: 100 * intersection >= percent * union.

Groups of copies. Equal sets form one class with one representative, so copies never meet pairwise. In each band's
bucket every representative is first compared with two leaders (the smallest and an arbitrary one): as many pairs as
members. Confirmed links are contracted to components. A bucket whose members are all connected by then needs nothing
more. In the others, odd sketches of members from different components are compared inside tasks; these pass on no
pairs but a spanning forest of the candidate links, whose components are clusters. Within a cluster the full sets of all
members are compared, again inside tasks that pass on a spanning forest, now of confirmed links. A bucket or cluster
larger than a task may hold is cut into a grid of cells, each a pair of parts: every two members meet in some cell, so
no link between different texts that share a band is lost, and what is passed on grows with members, not with pairs.
Of several buckets with the same members one is looked at.

What is quadratic: a bucket of m members that its leaders leave unconnected sends m * ceil(m / SKETCHES) rows of about 100
bytes and compares m * m / 2 bitmaps, about 5 ns each; a cluster of m likely links sends m * ceil(m / PART) texts. Such
buckets hold texts that share five minima without being similar; 100,000 of them cost 2.5 million rows and half a minute
of one core, spread over 325 tasks.

Words and shingles are compared as 64-bit hashes; links are confirmed on hashes of another seed than those that made
bands, sketches and classes. Rows of a class meet the class's component in one join, which adaptive execution splits
where a class is large; rows without id or words are kept out of it.

At a similarity of 0.85 two texts share no band with probability 7e-9, at 0.8 with probability 3e-6.

Defined cases: a null or blank text has an empty set, is linked with nothing and is its own component; a null id takes
no part in links: component_id is null and kept is true. Rows that repeat an id with equal texts share a component;
with unequal texts each row takes that of its own text. If several texts have the same smallest id they count as one,
and links to other texts are judged on the one with the smallest hash. Very long texts are sets like any other; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from layerloom.llm._spark import TASK_BYTES, batched, cut, hash_joins
from layerloom.llm._words import U, buffers, mix, window_hashes, word_hashes, word_spans
from layerloom.llm.components import components

BANDS, ROWS = 32, 5
SAMPLES = BANDS * ROWS
BITS = 512
#: Members of a part of a bucket; members and shingles of a part of a cluster. A cell holds two parts.
SKETCHES, PART, PART_SHINGLES = 4096, 512, 300_000
#: Bytes of text for each shingle, about; only deals out work.
BYTES_A_WORD = 7
#: Shingles that are compared in one go.
COLUMNS = 8192
_SEEDS = mix(np.arange(1, 2 * SAMPLES + 1, dtype=U))
_A, _B = (_SEEDS[:SAMPLES] >> U(32)).astype(np.uint32) | np.uint32(1), (_SEEDS[SAMPLES:] >> U(32)).astype(np.uint32)


def shingle_sets(column: pa.Array, ngram: int, seed: int = 0) -> list[np.ndarray]:
    """For each text its distinct shingles as ascending 64-bit hashes; another seed gives independent ones."""
    data, offsets = buffers(column)
    starts, ends, bounds = word_spans(data, offsets)
    words = word_hashes(data, starts, ends, lower=True, seed=seed)
    windows = window_hashes(words, ngram, seed)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        n = b - a
        if n >= ngram:
            out.append(np.unique(windows[a : b - ngram + 1]))
        else:
            out.append(window_hashes(words[a:b], n, seed) if n else np.zeros(0, U))
    return out


def minhash(shingles: np.ndarray) -> np.ndarray:
    """SAMPLES minima of pairwise independent 32-bit hashes."""
    x = (shingles >> U(32)).astype(np.uint32)[:, None]
    least = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 2048):
        np.minimum(least, (x[at : at + 2048] * _A + _B).min(axis=0), out=least)
    return least


def band_keys(samples: np.ndarray) -> np.ndarray:
    rows = samples.reshape(BANDS, ROWS).astype(U)
    key = np.arange(1, BANDS + 1, dtype=U) * U(0x9E3779B97F4A7C15)
    for i in range(ROWS):
        key = mix(key ^ (rows[:, i] + U(i + 1)))
    return key


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """A bitmap in which each sample flips the bit that it hashes to."""
    at = mix(samples.astype(U) + (np.arange(1, SAMPLES + 1, dtype=U) << U(32))) % U(BITS)
    return np.packbits((np.bincount(at.astype(np.int64), minlength=BITS) & 1).astype(np.uint8), bitorder="little").view(np.int64)


def most_different_bits(percent: int) -> int:
    """The largest population count of an XOR of two odd sketches that a pair at the threshold may still have."""
    j = percent / 100
    low = max(0.0, j - 5 * (j * (1 - j) / SAMPLES) ** 0.5)
    expected = BITS / 2 * (1 - (1 - 2 / BITS) ** (2 * SAMPLES * (1 - low)))
    return int(expected + 3 * (BITS / 4) ** 0.5 * 0.75) + 1


FEATURES = "id bigint, text_key bigint, n_shingles bigint, set_key binary, bands array<bigint>, sketch array<bigint>"


def _features(ngram: int):
    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, keys, bands, sketches = [], [], [], []
            for shingles in shingle_sets(batch.column("text"), ngram):
                n.append(len(shingles))
                if not len(shingles):
                    keys.append(None)
                    bands.append([])
                    sketches.append([])
                    continue
                samples = minhash(shingles)
                spread = mix(shingles ^ U(0x5851F42D4C957F2D))
                keys.append(np.array([np.bitwise_xor.reduce(spread), spread.sum(dtype=U)]).tobytes())
                bands.append(band_keys(samples).view(np.int64))
                sketches.append(odd_sketch(samples))
            long = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("text_key"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, long), pa.array(sketches, long)],
                ["id", "text_key", "n_shingles", "set_key", "bands", "sketch"],
            )

    return features


def _confirm(ngram: int, percent: int):
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for i, (a, b) in enumerate(zip(shingle_sets(part.column("text_a"), ngram, 1), shingle_sets(part.column("text_b"), ngram, 1), strict=True)):
                    shared = len(np.intersect1d(a, b, assume_unique=True))
                    if shared and 100 * shared >= percent * (len(a) + len(b) - shared):
                        kept.append(at + i)
            yield batch.select(["a", "b"]).take(pa.array(kept, pa.int64()))

    return confirm


def _forest(near: np.ndarray, tied: np.ndarray | None = None) -> np.ndarray:
    """Pairs of a spanning forest of a symmetric matrix of links; members tied to each other need no link."""
    left, out = np.ones(len(near), bool), []
    for root in range(len(near)):
        if not left[root]:
            continue
        left[root] = False
        todo = [root]
        while todo:
            i = todo.pop()
            if tied is not None:
                same = np.flatnonzero(left & (tied == tied[i]))
                left[same] = False
                todo += same.tolist()
            found = np.flatnonzero(near[i] & left)
            if tied is not None and len(found):  # one link to each group of tied members
                found = found[np.unique(tied[found], return_index=True)[1]]
            left[found] = False
            out += [(i, j) for j in found.tolist()]
            todo += found.tolist()
    return np.array(out, np.int64).reshape(-1, 2)


def _pairs(ids: np.ndarray, found: np.ndarray) -> pa.Table:
    return pa.table({"a": pa.array(ids[found].min(axis=1, initial=np.iinfo(np.int64).max)), "b": pa.array(ids[found].max(axis=1, initial=np.iinfo(np.int64).min))})


def _cross(limit: int):
    """Of one cell: a forest of the pairs from different components whose sketches differ in at most limit bits."""

    def cross(table: pa.Table) -> pa.Table:
        ids, comps = table.column("id").to_numpy(), table.column("comp").to_numpy()
        sketch = np.frombuffer(b"".join(table.column("packed").to_pylist()), np.uint64).reshape(len(ids), -1)
        near = np.empty((len(ids), len(ids)), bool)
        for i, own in enumerate(sketch):
            near[i] = (np.bitwise_count(sketch ^ own).sum(axis=1, dtype=np.int16) <= limit) & (comps != comps[i])
        return _pairs(ids, _forest(near))

    return cross


def _resolve(ngram: int, percent: int):
    """Of one cell: a forest, across components, of the pairs whose full sets are similar enough."""

    def resolve(table: pa.Table) -> pa.Table:
        ids, comps = table.column("id").to_numpy(), table.column("comp").to_numpy()
        sets = shingle_sets(table.column("text"), ngram, 1)
        sizes = np.array([len(s) for s in sets], np.int64)
        owner, flat = np.repeat(np.arange(len(sets)), sizes), np.concatenate(sets)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        new = np.ones(len(flat), bool)
        new[1:] = flat[1:] != flat[:-1]
        number, heads = np.cumsum(new) - 1, np.flatnonzero(new)
        shared = np.diff(np.append(heads, len(flat))) > 1
        column = np.cumsum(shared) - 1
        keep = shared[number]
        owner, number = owner[keep], column[number[keep]]
        both = np.zeros((len(ids), len(ids)), np.int64)
        for at in range(0, int(shared.sum()), COLUMNS):
            here = slice(*np.searchsorted(number, [at, at + COLUMNS]))
            has = np.zeros((len(ids), min(COLUMNS, int(shared.sum()) - at)), np.float32)
            has[owner[here], number[here] - at] = 1
            both += (has @ has.T).astype(np.int64)
        near = (both > 0) & (100 * both >= percent * (sizes + sizes[:, None] - both)) & (comps != comps[:, None])
        return _pairs(ids, _forest(near, comps))

    return resolve


def _grid(members: DataFrame, group: str, parts: Column) -> DataFrame:
    """members, each in all cells (x, y) of its group's grid that hold its part."""
    dealt = members.withColumn("parts", parts).withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts")))
    spread = dealt.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
    return spread.select(group, F.least("own", "part").alias("x"), F.greatest("own", "part").alias("y"), "id", "comp")


def _xor_bits(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def _representatives(feats: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """(set_key, rep): the smallest id of each distinct set; and (rep, text_key, bands, sketch, n) of one text of that id and set."""
    usable = feats.filter("id is not null and set_key is not null")
    classes = usable.groupBy("set_key").agg(F.min("id").alias("rep"))
    own = usable.join(classes.withColumnRenamed("set_key", "class_key"), (F.col("id") == F.col("rep")) & (F.col("set_key") == F.col("class_key")))
    one = own.groupBy("rep").agg(F.min_by(F.struct("text_key", "bands", "sketch", F.col("n_shingles").alias("n")), "text_key").alias("one"))
    return classes, cut(one.select("rep", "one.*"), n * (BANDS * 8 + BITS // 8 + 64))


def _bucket_members(reps: DataFrame, n: int) -> DataFrame:
    """(key, rep, lead, other): the members of each bucket of several, with two leaders of it."""
    spread = reps.select("rep", F.explode("bands").alias("key"))
    leaders = spread.groupBy("key").agg(F.min("rep").alias("lead"), F.max_by("rep", F.xxhash64("rep")).alias("other"), F.count("*").alias("size"))
    return cut(spread.join(leaders.filter("size > 1").drop("size"), "key"), n * BANDS * 24)


def _texts(rows: DataFrame, members: DataFrame, reps: DataFrame, n_bytes: int) -> DataFrame:
    """(id, text) of the representatives that share a bucket: the text that bands and sketch were made of."""
    needed = reps.join(members.select("rep").distinct(), "rep", "left_semi").select(F.col("rep").alias("id"), "text_key")
    found = rows.filter("id is not null and text is not null").join(needed, ["id", "text_key"], "left_semi")
    return cut(found.groupBy("id", "text_key").agg(F.first("text").alias("text")).drop("text_key"), n_bytes)


def _links_to_leaders(members: DataFrame, reps: DataFrame, texts: DataFrame, n_bytes: int, ngram: int, percent: int) -> DataFrame:
    """Confirmed links (a, b) between members and their buckets' leaders: no more candidates than members."""
    sketches = reps.select("rep", "sketch")
    pairs = members.select("rep", F.explode(F.array("lead", "other")).alias("to")).filter("rep <> to")
    pairs = pairs.select(F.least("rep", "to").alias("a"), F.greatest("rep", "to").alias("b")).distinct()
    pairs = pairs.join(sketches.toDF("a", "sketch_a"), "a").join(sketches.toDF("b", "sketch_b"), "b")
    pairs = pairs.filter(_xor_bits("sketch_a", "sketch_b") <= most_different_bits(percent)).select("a", "b")
    full = pairs.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b").select("a", "b", "text_a", "text_b")
    return cut(batched(full, _confirm(ngram, percent), "a bigint, b bigint"), n_bytes, TASK_BYTES // 2)  # of the texts that are read


def _labelled(ids: DataFrame, comps: DataFrame) -> DataFrame:
    """ids with the component `comp` of each; a node without links is its own."""
    found = ids.join(comps.withColumnRenamed("node", "id"), "id", "left")
    return found.withColumn("comp", F.coalesce("component", "id")).drop("component")


def _candidates(members: DataFrame, reps: DataFrame, comps: DataFrame, n: int, percent: int) -> DataFrame:
    """A forest (a, b) of likely links across components, from the buckets that aren't connected yet; of equal buckets one is looked at."""
    labelled = _labelled(members.select("key", F.col("rep").alias("id")), comps)
    same = F.struct(F.count("*").alias("size"), F.bit_xor(F.xxhash64("id")).alias("a"), F.sum(F.xxhash64("id", F.lit(1)).cast("decimal(38,0)")).alias("b"))
    split = labelled.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), same.alias("same")).filter("low < high")
    split = split.groupBy("same").agg(F.min("key").alias("key")).select("key", "same.size")
    left = labelled.join(split, "key")
    word = lambda i: F.unhex(F.lpad(F.hex(F.element_at("sketch", i)), 16, "0"))
    packed = reps.select(F.col("rep").alias("id"), F.concat(*[word(i) for i in range(1, BITS // 64 + 1)]).alias("packed"))
    cells = _grid(left, "key", F.ceil(F.col("size") / SKETCHES)).join(packed, "id")
    found = cells.groupBy("key", "x", "y").applyInArrow(_cross(most_different_bits(percent)), "a bigint, b bigint")
    return cut(found.distinct(), n * 16)


def _links_in_clusters(candidates: DataFrame, reps: DataFrame, texts: DataFrame, comps: DataFrame, n: int, ngram: int, percent: int) -> DataFrame:
    """A forest (a, b) of confirmed links across components, from comparing all members of each cluster."""
    members = _labelled(components(candidates, n * 16).toDF("id", "cluster"), comps).join(reps.select(F.col("rep").alias("id"), "n"), "id")
    sizes = members.groupBy("cluster").agg(F.count("*").alias("size"), F.sum("n").alias("shingles"))
    parts = F.greatest(F.ceil(F.col("size") / PART), F.ceil(F.col("shingles") / PART_SHINGLES))
    cells = _grid(members.join(sizes, "cluster"), "cluster", parts).join(texts, "id")
    return cells.groupBy("cluster", "x", "y").applyInArrow(_resolve(ngram, percent), "a bigint, b bigint")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = 5, percent: int = 80, keep_key: bool = False) -> DataFrame:
    """One row for each row of docs: id, n_shingles, component_id (smallest linked id), kept (id = component_id) and (if keep_key) text_key.

    text_key is xxhash64 of the text: rows of one id with different texts can be told apart by it.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("text_key", F.xxhash64("text"))
    with hash_joins(docs.sparkSession):
        feats = cut(batched(rows, _features(ngram), FEATURES))
        n, n_shingles = feats.agg(F.count("*"), F.coalesce(F.sum("n_shingles"), F.lit(0))).first()
        n_bytes = n_shingles * BYTES_A_WORD
        classes, reps = _representatives(feats, n)
        members = _bucket_members(reps, n)
        texts = _texts(rows, members, reps, n_bytes)
        links = _links_to_leaders(members, reps, texts, n_bytes, ngram, percent)
        comps = components(links, n * 16)
        candidates = _candidates(members, reps, comps, n, percent)
        if not candidates.isEmpty():
            comps = components(links.unionAll(_links_in_clusters(candidates, reps, texts, comps, n, ngram, percent)), n * 16)

    in_class = _labelled(classes.withColumnRenamed("rep", "id"), comps).select("set_key", F.col("comp").alias("component_id"))
    alone = "id is null or set_key is null"  # never joined: all of them would meet in one partition
    out = feats.filter(f"not ({alone})").join(in_class, "set_key").select("id", "n_shingles", "component_id", "text_key")
    out = out.unionAll(feats.filter(alone).select("id", "n_shingles", F.col("id").alias("component_id"), "text_key"))
    out = out.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True))).withColumnRenamed("id", id_col)
    return out.select(id_col, "n_shingles", "component_id", "kept", *["text_key"] * keep_key)


def reference(rows: list[tuple], ngram: int, percent: int) -> dict:
    """Brute force over (id, text) rows, for tests: {id: (n_shingles, component)}."""
    sets, parent = {}, {}
    for i, text in rows:
        words = [bytes(w).lower() for w in (text or "").encode().split()]
        sets[i] = {tuple(words[k : k + ngram]) for k in range(len(words) - ngram + 1)} if len(words) >= ngram else {tuple(words)} if words else set()
        parent[i] = i

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    where: dict = {}
    for i, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(i)
    seen = set()
    for ids in where.values():
        for k, a in enumerate(ids):
            for b in ids[k + 1 :]:
                if (a, b) not in seen:
                    seen.add((a, b))
                    both = len(sets[a] & sets[b])
                    if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                        x, y = sorted((root(a), root(b)))
                        parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in sets}
