"""Similarity join on word n-grams by vertical partitioning.

The n-grams of all texts have one global order, that of their 64-bit hashes. It is cut into fragments, and each set of n-grams
into its part of each fragment. Two sets of at most S elements together with Jaccard similarity t differ in at most
d = S (1 - t) / (1 + t) elements, so of d + 1 fragments they agree in one at least: sets that agree in a fragment are the
candidates. How many fragments there are depends on the size: sizes fall in groups in which a set's partners are in its own group
or the next, and a set is cut once for its own group and once for the group below. Fragments in which a set has nothing, or too few
n-grams to tell, are no evidence; more fragments than d + 1 make up for them. A set that still lacks fragments is keyed by its small and empty
ones as well. Of two sets that link, one has enough fragments, or both have all, so they meet.

Passages that many unlike texts share make equal fragments too. So all sets are counted that have a fragment, and no set meets others in its
most frequent ones: a set with f full fragments agrees with each it links with in f - d, so the f - d - 1 most frequent of its cut can go (all
sets follow one order, so of what two share the rarest stays in both). Nothing is sampled.

Equal sets are one class before any of this. Pairs are not listed: each fragment links its sets to one of them, and what these links
connect is a group of candidates. A group is dealt out in pairs of blocks of about BLOCK sets, so that a large one is the work of
many tasks. There the overlaps are counted for one fragment of the global order after another and summed for each pair, and the
sums decide exactly. A task returns the edges of a forest, fewer than it has sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import U64, arrow, chunks, components, cut, hashed_words, joined, mix, mix1, partitions, small_batches, stored, text_of

#: Sets in a block, and n-grams in a fragment when overlaps are counted.
BLOCK, COLUMNS = 128, 16384
#: Sets with one key that are held until they are counted; keys of so many or more are equally frequent, and pass through.
CROWD = 1 << 16
#: Bits of a list's number that say how many of its keys can go (a list that could spare more keeps the rest), and those of its scheme.
SPARE_BITS, SCHEME_BITS = 20, 12


class Cuts:
    """The size groups of a threshold num / den, and the fragments of each group's scheme."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.first = [1]
        while self.first[-1] < 1 << 40:
            self.first.append(self.first[-1] * den // num + 1)
        self.edges = np.array(self.first)
        self.differ, self.parts, self.spare, self.least = [], [], [], []
        for low, high in zip(self.first, self.first[1:], strict=False):
            largest = high - 1
            d = (largest + largest * den // num) * (den - num) // (den + num)
            for least in (4, 3, 2, 1):
                parts, spare = d + 1, 0
                for _ in range(40):
                    few = parts * sum(math.exp(-low / parts) * (low / parts) ** k / math.factorial(k) for k in range(least))
                    spare = math.ceil(few + 3 * math.sqrt(few))
                    parts = d + 1 + spare
                    if parts > 1.35 * (d + 1) + 4:
                        break
                if parts <= 1.35 * (d + 1) + 4:
                    break
            self.differ.append(d)
            self.spare.append(spare)
            self.parts.append(parts)
            self.least.append(least)

    def schemes(self, n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Twice: the sets that have the scheme (of their own group, of the one below), and its number for each."""
        group = np.searchsorted(self.edges, n, "right") - 1
        for below in (0, 1):
            scheme = group - below
            good = scheme >= 0
            good[good] = np.array(self.differ)[scheme[good]] > 0
            yield np.flatnonzero(good & (n > 0)), scheme


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct n-gram hashes of some texts one after the other, and where each text's begin (one more at the end)."""
    h, _, first = hashed_words(data, offsets)
    count = np.diff(first)
    if not len(h):
        return np.zeros(0, U64), np.zeros(len(count) + 1, np.int64)
    grams = np.zeros(len(h), U64)
    for k in range(n):
        if k < len(h):
            grams[: len(h) - k] += h[k:] * U64(mix1(k + 1) | 1)
    grams = mix(grams)
    owner = np.repeat(np.arange(len(count)), count)
    keep = np.arange(len(h)) - first[owner] <= (count - n)[owner]
    for i in np.flatnonzero((count > 0) & (count < n)):  # the whole sequence is the only element
        own = h[first[i] : first[i + 1]]
        seed = np.array([sum(int(x) * (mix1(k + 101) | 1) for k, x in enumerate(own)) + len(own) & 0xFFFFFFFFFFFFFFFF], U64)
        grams[first[i]] = mix(seed)[0]
        keep[first[i]] = True
    grams, owner = grams[keep], owner[keep]
    at = np.searchsorted(owner, np.arange(len(count) + 1))
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        grams[a:b].sort()
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    grams, owner = grams[new], owner[new]
    return grams, np.searchsorted(owner, np.arange(len(count) + 1))


def _sum_by(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, U64)
    np.cumsum(values, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def _fragments(grams: np.ndarray, at: np.ndarray, own: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the sets `own`, cut into so many fragments each: slot of the set, number of the fragment, sum of its hashes, its size; none that are empty."""
    reps = np.diff(at)[own]
    index = np.repeat(at[own] - np.concatenate(([0], np.cumsum(reps)[:-1])), reps) + np.arange(reps.sum())
    slot = np.repeat(np.arange(len(own)), reps)
    part = ((grams[index] >> U64(32)) * parts[slot].astype(U64)) >> U64(32)
    new = np.ones(len(index), bool)
    new[1:] = (part[1:] != part[:-1]) | (slot[1:] != slot[:-1])
    begin = np.flatnonzero(new)
    if not len(begin):
        return slot, part, np.zeros(0, U64), np.zeros(0, np.int64)
    sums = np.add.reduceat(mix(grams[index] ^ U64(0xA5A5A5A5A5A5A5A5)), begin)
    return slot[begin], part[begin], sums, np.diff(np.append(begin, len(index)))


def fragment_keys(grams: np.ndarray, at: np.ndarray, cuts: Cuts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The keys of all sets' fragments, for each key the number of its set, and the list that it is of.

    A list is a set's cut by one scheme: its number has 24 bits of the set's hash (rows can share a doc_id), the scheme, and how many of its keys can go."""
    size = np.diff(at)
    whole = _sum_by(mix(grams + U64(3)), at)
    keys, owners, lists = [], [], []
    for own, scheme in cuts.schemes(size):
        if not len(own):
            continue
        parts, spare, least, differ = (np.array(x)[scheme[own]] for x in (cuts.parts, cuts.spare, cuts.least, cuts.differ))
        slot, part, sums, count = _fragments(grams, at, own, parts)
        named = lambda sl, pt, o=own: mix(pt * U64(0x9E3779B97F4A7C15) + scheme[o][sl].astype(U64) * U64(0xC2B2AE3D27D4EB4F))  # noqa: B023, E731
        full = count >= least[slot]
        enough = np.bincount(slot[full], minlength=len(own))
        lacking = parts - enough > spare
        can_go = np.clip(enough - differ - 1, 0, (1 << SPARE_BITS) - 1).astype(U64)
        listed = ((whole[own] >> U64(40)) << U64(SCHEME_BITS) | scheme[own].astype(U64)) << U64(SPARE_BITS) | can_go
        take = full | lacking[slot]
        keys.append(mix(sums[take] + named(slot[take], part[take])))
        owners.append(own[slot[take]])
        lists.append(listed[slot[take]])
        for k in np.flatnonzero(lacking):
            void = np.setdiff1d(np.arange(parts[k], dtype=U64), part[slot == k])
            keys.append(mix(named(np.full(len(void), k), void) ^ U64(0x5555555555555555)))
            owners.append(np.full(len(void), own[k]))
            lists.append(np.full(len(void), listed[k]))
    if not keys:
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, U64)
    return np.concatenate(keys), np.concatenate(owners), np.concatenate(lists)


def _names(n: int):
    """The size of each text's set, and 128 bits that name the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_of(batch.column(1))
            for a, b in chunks(offsets):
                grams, at = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], n)
                sums = [_sum_by(mix(grams + U64(seed)), at).view(np.int64) for seed in (1, 2)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(at)), *map(pa.array, sums)], names=["doc_id", "n", "hi", "lo"])

    return run


def _keys(n: int, num: int, den: int):
    """The keys of all sets' fragments, with their lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = Cuts(num, den)
        for batch in batches:
            data, offsets = text_of(batch.column(1))
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for a, b in chunks(offsets):
                grams, at = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], n)
                keys, owners, lists = fragment_keys(grams, at, cuts)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(ids[a:b][owners]), pa.array(lists.view(np.int64))], names=["key", "rep", "list"])

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key: those of keys that two lists or more have, with how many have it, CROWD at most."""

    def counted(rows: list[np.ndarray], many: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*map(pa.array, rows), pa.array(many.astype(np.int64))], names=["key", "rep", "list", "many"])

    held, crowded = [np.zeros(0, np.int64)] * 3, None
    for batch in batches:
        rows = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)]
        if crowded is not None and len(rows[0]):
            n = int(np.searchsorted(rows[0], crowded, "right"))
            if n:
                yield counted([x[:n] for x in rows], np.full(n, CROWD))
            rows = [x[n:] for x in rows]
        if not len(rows[0]):
            continue
        crowded = None
        rows = [np.concatenate([h, x]) for h, x in zip(held, rows, strict=True)]
        begin = np.flatnonzero(np.concatenate(([True], rows[0][1:] != rows[0][:-1])))
        many = np.minimum(np.repeat(np.diff(np.append(begin, len(rows[0]))), np.diff(np.append(begin, len(rows[0])))), CROWD)
        last = len(rows[0])
        if many[-1] < CROWD:  # more may follow
            last = int(begin[-1])
        else:
            crowded = rows[0][-1]
        held = [x[last:] for x in rows]
        some = np.flatnonzero(many[:last] > 1)
        yield counted([x[some] for x in rows], many[some])
    if len(held[0]) > 1:
        yield counted(held, np.full(len(held[0]), len(held[0])))


def _rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (rep, list), the most frequent keys first: without as many of each list as can go."""
    now, gone = None, 0
    for batch in batches:
        key, rep, of = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
        if not len(key):
            continue
        new = np.concatenate(([now != (rep[0], of[0])], (rep[1:] != rep[:-1]) | (of[1:] != of[:-1])))
        at = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
        rank = np.arange(len(key)) - at + np.where(at < 0, gone - 1, 0)  # before the first new list at is -1
        now, gone = (rep[-1], of[-1]), int(rank[-1]) + 1
        stay = rank >= (of.view(U64) & U64((1 << SPARE_BITS) - 1)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(key[stay]), pa.array(rep[stay])], names=["key", "rep"])


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, rep): edges from the first set of each key to the others. Nothing of a key is held but its first set."""
    last_key, lead = None, 0
    for batch in batches:
        key, rep = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        if not len(key):
            continue
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        new[0] = last_key is None or key[0] != last_key
        at = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
        first = np.where(at < 0, lead, rep[at])
        last_key, lead = key[-1], first[-1]
        some = np.unique(np.stack([first, rep], 1)[first != rep], axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(some[:, k])) for k in (0, 1)], names=["a", "b"])


def _blocks(n: int):
    """Whole sets with their candidate component, each once for every pair of blocks that it is compared in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_of(batch.column(1))
            group, size = (batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 3))
            for a, b in chunks(offsets):
                grams, at = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], n)
                rep = batch.column(0).slice(a, b - a)
                blocks = -(-size[a:b] // BLOCK)
                own = mix(rep.to_numpy(zero_copy_only=False).astype(np.int64).view(U64)) % blocks.astype(U64)
                rows = np.repeat(np.arange(b - a), blocks)
                other = np.arange(len(rows)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
                own = own.astype(np.int64)[rows]
                sets = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer((at * 8).astype(np.int32).tobytes()), pa.py_buffer(grams.tobytes())])
                for lo, hi in chunks(np.concatenate(([0], np.cumsum(np.diff(at)[rows] * 8 + 64)))):
                    r, o, i = rows[lo:hi], own[lo:hi], other[lo:hi]
                    yield pa.RecordBatch.from_arrays([pa.array(group[a:b][r]), pa.array(np.minimum(o, i)), pa.array(np.maximum(o, i)), rep.take(pa.array(r)), pa.array(o > i), sets.take(pa.array(r))], names=["group", "low", "high", "id", "upper", "set"])

    return run


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two sets share: counted for one fragment of the global order after another, and summed."""
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    _, element, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    rank = np.cumsum(shared) - 1
    keep = shared[element]
    element, owner = rank[element[keep]], owner[keep]
    order = np.argsort(element, kind="stable")
    element, owner = element[order], owner[order]
    total = np.zeros((len(sets), len(sets)), np.int64)
    for low in range(0, int(shared.sum()), COLUMNS):
        a, b = np.searchsorted(element, (low, low + COLUMNS))
        part = np.zeros((len(sets), min(COLUMNS, int(shared.sum()) - low)), np.float32)
        part[owner[a:b], element[a:b] - low] = 1
        total += (part @ part.T).astype(np.int64)
    return total


def forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what the links of a small symmetric matrix connect, and no more."""
    out, seen = [], np.zeros(len(linked), bool)
    for root in range(len(linked)):
        if seen[root]:
            continue
        seen[root], todo = True, [root]
        while todo:
            k = todo.pop()
            new = np.flatnonzero(linked[k] & ~seen)
            seen[new] = True
            out += [(k, int(x)) for x in new]
            todo += new.tolist()
    return out


def _compared(num: int, den: int):
    """Exact links between the sets of two blocks, as the edges of a forest."""

    def finish(ids: list, sets: list, upper: list, across: bool) -> list[tuple[int, int]]:
        if len(ids) < 2:
            return []
        size = np.array([len(s) for s in sets])
        linked = overlaps(sets) * (den + num) >= (size[:, None] + size[None, :]) * num
        np.fill_diagonal(linked, False)
        if across:  # within a block they are compared elsewhere
            side = np.array(upper)
            linked &= side[:, None] != side[None, :]
        return [(ids[x], ids[y]) for x, y in forest(linked)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, sets, upper = None, [], [], []
        for batch in batches:
            found = []
            keys = list(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True))
            for k, (key, id_, side) in enumerate(zip(keys, batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)):
                if key != now:
                    found += finish(ids, sets, upper, now is not None and now[1] != now[2])
                    now, ids, sets, upper = key, [], [], []
                ids.append(id_)
                sets.append(np.frombuffer(batch.column(5)[k].as_buffer(), U64).copy())
                upper.append(side)
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])
        found = finish(ids, sets, upper, now is not None and now[1] != now[2])
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])

    return run


def jaccard_links(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> tuple[DataFrame, DataFrame]:
    """(classes, labels) of the documents (doc_id, text).

    classes has each row's doc_id, n_shingles and rep, the smallest doc_id with the same set; labels has (id, component) of
    the representatives that link with others. Sets link when their Jaccard similarity is num / den at least.
    """
    spark = docs.sparkSession
    parts = partitions(spark)
    small_batches(spark)
    docs = docs.select("doc_id", "text")
    rows = stored(docs.transform(arrow, _names(n), "doc_id long, n long, hi long, lo long"), "sets")
    same = ["n", "hi", "lo"]
    reps = cut(rows.where("n > 0").groupBy(*same).agg(F.min("doc_id").alias("rep")))  # written, so that joins with it can split a hot set
    # all but later copies: these are few, as a rule, and leave the texts where they are
    copies = rows.join(reps, same).where("doc_id != rep").select("doc_id").distinct().join(reps.select(F.col("rep").alias("doc_id")), "doc_id", "left_anti")
    keys = joined(docs.where("doc_id is not null"), copies, "doc_id", "left_anti").transform(arrow, _keys(n, num, den), "key long, rep long, list long")
    shared = keys.repartition(parts, "key").sortWithinPartitions("key").transform(arrow, _shared, "key long, rep long, list long, many long")
    rare = shared.repartition(parts, "rep", "list").sortWithinPartitions("rep", "list", F.desc("many"), "key").transform(arrow, _rarest, "key long, rep long")
    edges = rare.repartition(parts, "key").sortWithinPartitions("key", "rep").transform(arrow, _stars, "a long, b long")
    near = components(edges)
    sized = near.join(near.groupBy("component").agg(F.count(F.lit(1)).alias("size")), "component").select(F.col("id").alias("doc_id"), "component", "size")
    blocks = joined(docs, sized, "doc_id", "inner").select("doc_id", "text", "component", "size").transform(arrow, _blocks(n), "group long, low long, high long, id long, upper boolean, set binary")
    links = blocks.repartition(parts, "group", "low", "high").sortWithinPartitions("group", "low", "high").transform(arrow, _compared(num, den), "a long, b long")
    classes = rows.select("doc_id", *same).join(reps.select(*same, "rep"), same, "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("rep", "doc_id").alias("rep"))
    return classes, components(links)


def jaccard_components(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs (doc_id, text; other columns are not looked at).

    Words are runs of anything but ASCII white space, A-Z lower-cased; a set holds the distinct runs of n words, or the whole
    sequence where there are fewer. component_id is the smallest doc_id reachable over links, the row's own included. Null and
    empty texts, and texts of white space, have 0 shingles and are alone. Rows with equal texts are one class; repeated rows each give a
    row; rows that share a doc_id but not the text each get their own text's component, and classes that one doc_id represents are one. A null doc_id is linked with nothing of its own: such a row gets its
    class's component, or null. An empty table gives an empty result.
    """
    classes, labels = jaccard_links(docs, n, num, den)
    return classes.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
