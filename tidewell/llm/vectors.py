"""Near-duplicates among embeddings: spherical k-means cells, blocked cosine products in them.

Only vectors of one label (and one length) are compared. Equal vectors are one class from the start. Each class is at home in the
cell of its nearest centroid, and a guest in every other cell whose border it is near to: two unit vectors with cosine t or more are at
most sqrt(2 - 2 t) apart, so if both are further than half of that from the border between their cells, they are no pair. Each pair is
thus met in the home cell of one of them, and none is missed. A cell is dealt out in pairs of blocks of about BLOCK vectors.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import U64, arrow, components, cut, mix, partitions, stored
from tidewell.llm.ngram_join import forest

#: Vectors in a cell that are aimed at, the most centroids in all and bytes of them (they are broadcast), bytes of vectors to fit them on (these come
#: to the driver), rounds of k-means. Beyond the most centroids cells grow; that costs time, never links.
CELL, CENTROIDS, CENTROID_BYTES, FIT_BYTES, ROUNDS = 2048, 4096, 8 << 20, 48 << 20, 8
BLOCK = 1024


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, units, dims = [], [], []
        lists = batch.column(2)
        flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # null is not a number here
        to = np.concatenate(([0], np.cumsum([len(x) if x.is_valid else 0 for x in lists])))
        for a, b in zip(to[:-1].tolist(), to[1:].tolist(), strict=True):
            v = flat[a:b]
            top = np.abs(v).max() if len(v) else 0.0
            good = np.isfinite(top) and top > 0
            if good:
                v = v / top
                unit = v / np.sqrt(v @ v)
            keys.append(hashlib.md5((v + 0.0).tobytes() + top.tobytes()).digest() if good else None)
            units.append(unit.tobytes() if good else None)
            dims.append(len(v) if good else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(dims, pa.int32()), pa.array(units, pa.binary())], names=["vec_id", "label", "key", "dim", "unit"])


def spherical_kmeans(x: np.ndarray, k: int, seed: int = 5) -> np.ndarray:
    """k unit centroids of unit vectors."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(ROUNDS):
        near = (x @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        size = np.sqrt((total * total).sum(1, keepdims=True))
        c = np.where(size > 0, total / np.where(size > 0, size, 1), c)
    return c


def _matrix(column: pa.Array) -> np.ndarray:
    return np.stack([np.frombuffer(x.as_buffer(), np.float64) for x in column])


def _cells(given, margin: float):
    """The cells of each class: at home in one, guest in others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, cells, homes = [], [], []
            labels, dims = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            by: dict[tuple, list[int]] = {}
            for k, key in enumerate(zip(labels, dims, strict=True)):
                by.setdefault(key, []).append(k)
            for key, own in by.items():
                c = given.value.get(key)
                if c is None:
                    rows += own
                    cells += [0] * len(own)
                    homes += [0] * len(own)
                    continue
                x = _matrix(batch.column(4).take(pa.array(own)))
                home, guest = places(x, c, margin)
                guest[np.arange(len(own)), home] = True
                r, cell = np.nonzero(guest)
                rows += [own[k] for k in r]
                cells += cell.tolist()
                homes += home[r].tolist()
            yield pa.RecordBatch.from_arrays([*(x.take(pa.array(rows, pa.int32())) for x in batch.columns), pa.array(cells, pa.int32()), pa.array(homes, pa.int32())], names=["id", "label", "dim", "n", "unit", "cell", "home"])

    return run


def places(x: np.ndarray, c: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray]:
    """The home cell of each vector, and which cells it is near to."""
    s = x @ c.T
    home = s.argmax(1)
    apart = np.sqrt(np.maximum(0, 2 - 2 * c @ c.T))
    return home, s[np.arange(len(x)), home][:, None] - s <= margin * apart[home] + 1e-9


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A class once for each pair of blocks; two blocks of guests are no pair."""
    for batch in batches:
        id_, cell, home, size = (batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in ("id", "cell", "home", "homes"))
        guests = batch.column(batch.schema.get_field_index("guests")).to_numpy(zero_copy_only=False)
        nh, ng = -(-size // BLOCK), -(-guests // BLOCK)
        at_home = cell == home
        h = mix(id_.astype(np.int64).view(U64))
        own = np.where(at_home, (h % np.maximum(nh, 1).astype(U64)).astype(np.int64), nh + (h % np.maximum(ng, 1).astype(U64)).astype(np.int64))
        times = np.where(at_home, nh + ng, nh)
        rows = np.repeat(np.arange(len(id_)), times)
        other = np.arange(len(rows)) - np.repeat(np.cumsum(times) - times, times)
        own = own[rows]
        for lo in range(0, len(rows), 4096):
            r, o, i = rows[lo : lo + 4096], own[lo : lo + 4096], other[lo : lo + 4096]
            some = batch.take(pa.array(r))
            keep = [some.column(some.schema.get_field_index(k)) for k in ("label", "dim", "cell")]
            rest = [some.column(some.schema.get_field_index(k)) for k in ("id", "n", "home", "unit")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(np.minimum(o, i)), pa.array(np.maximum(o, i)), pa.array(o > i), *rest], names=["label", "dim", "cell", "low", "high", "upper", "id", "n", "home", "unit"])


def _compared(given, threshold: float, margin: float):
    """Kind 0: edges of a forest. Kind 1: how many vectors a class links with, as far as this pair of blocks goes."""

    def finish(key: tuple, rows: list[tuple]) -> list[tuple[int, int, int]]:
        label, dim, cell, low, high = key
        upper, ids, n, home, unit = (list(x) for x in zip(*rows, strict=True))
        side = np.array(upper)
        x = np.stack([np.frombuffer(u, np.float64) for u in unit])
        home, n = np.array(home), np.array(n)
        a, b = (np.flatnonzero(~side), np.flatnonzero(side)) if low != high else (np.arange(len(x)),) * 2
        if not len(a) or not len(b) or len(x) < 2:
            return []
        linked = x[a] @ x[b].T >= threshold
        if low == high:
            np.fill_diagonal(linked, False)
        guest = home != cell
        linked &= ~(guest[a][:, None] & guest[b][None, :])
        c = given.value.get((label, dim))
        if c is not None and guest.any() and linked.any():  # a pair that both home cells meet counts in the first of them
            _, near = places(x, c, margin)
            for some, others, found in ((a, b, linked), (b, a, linked.T)):
                found &= ~(near[np.ix_(some, home[others])] & (home[others] < cell)[None, :] & ~guest[some][:, None] & guest[others][None, :])
        counts = np.zeros(len(x), np.int64)
        counts[a] += linked @ n[b]
        if low != high:
            counts[b] += linked.T @ n[a]
        met = np.flatnonzero(counts)
        place = np.full(len(x), -1)
        place[met] = np.arange(len(met))
        square = np.zeros((len(met), len(met)), bool)
        i, j = np.nonzero(linked)
        square[place[a[i]], place[b[j]]] = square[place[b[j]], place[a[i]]] = True
        return [(0, ids[met[p]], ids[met[q]]) for p, q in forest(square)] + [(1, ids[k], int(counts[k])) for k in met]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(found: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in range(3)], names=["kind", "a", "b"])

        now, rows = None, []
        for batch in batches:
            found = []
            columns = [batch.column(k).to_pylist() for k in range(10)]
            for row in zip(*columns, strict=True):
                if row[:5] != now:
                    if now:
                        found += finish(now, rows)
                    now, rows = row[:5], []
                rows.append(row[5:])
            yield out(found)
        yield out(finish(now, rows) if now else [])

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, margin: float | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors (vec_id, embedding, label; other columns are not looked at).

    Rows link when their labels are equal and not null, their vectors equally long and their cosine, in double precision, is at least the
    threshold. Null, empty and zero vectors and those with null or non-finite components link with nothing. n_links counts rows, so repeated
    rows link with each other; component_id is the smallest vec_id reachable (rows of one vec_id are one node of the graph). A row without
    vec_id is its class's, which has the component of the others' smallest vec_id, or null, and is not kept. margin is
    how near to a border a vector is a guest beyond it: the default finds all pairs, less is faster. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    parts = partitions(spark)
    margin = math.sqrt(max(0.0, 1 - threshold) / 2) if margin is None else margin
    label_type = vectors.schema["label"].dataType.simpleString()
    rows = stored(vectors.select("vec_id", "label", F.col("embedding").cast("array<double>")).transform(arrow, _classes, f"vec_id long, label {label_type}, key binary, dim int, unit binary"), "vectors")
    same = ["label", "dim", "key"]
    reps = cut(rows.where("key is not null and label is not null").groupBy(*same).agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("n"), F.first("unit").alias("unit")).where("id is not null"))
    sizes = reps.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("size"))
    total, longest = sizes.agg(F.sum("size"), F.max("dim")).first()
    most = max(2, min(CENTROIDS, CENTROID_BYTES // (8 * (longest or 1))))
    target = max(CELL, -(-(total or 0) // (most // 2)))
    # at most total / target <= most / 2 of them have more than target vectors
    cells = {(r["label"], r["dim"]): -(-r["size"] // target) for r in sizes.where(F.col("size") > target).collect()}
    given = {}
    if cells:
        share = min(1.0, FIT_BYTES / (8 * longest * total))
        wanted = spark.createDataFrame(list(cells), f"label {label_type}, dim int")
        seen: dict[tuple, list] = {}
        for r in reps.join(F.broadcast(wanted), ["label", "dim"]).sample(share, 3).select("label", "dim", "unit").toLocalIterator():
            seen.setdefault((r["label"], r["dim"]), []).append(np.frombuffer(r["unit"], np.float64))
        given = {k: spherical_kmeans(np.stack(x), cells[k]) for k, x in seen.items() if len(x) > cells[k]}
    given = spark.sparkContext.broadcast(given)
    placed = cut(reps.select("id", "label", "dim", "n", "unit").transform(arrow, _cells(given, margin), f"id long, label {label_type}, dim int, n long, unit binary, cell int, home int"))
    counts = placed.groupBy("label", "dim", "cell").agg(F.sum((F.col("cell") == F.col("home")).cast("long")).alias("homes"), F.sum((F.col("cell") != F.col("home")).cast("long")).alias("guests"))
    blocks = placed.join(counts, ["label", "dim", "cell"]).transform(arrow, _blocks, f"label {label_type}, dim int, cell int, low long, high long, upper boolean, id long, n long, home int, unit binary")
    key = ["label", "dim", "cell", "low", "high"]
    found = stored(blocks.repartition(parts, *key).sortWithinPartitions(*key).transform(arrow, _compared(given, threshold, margin), "kind long, a long, b long"), "links")
    joined = components(found.where("kind = 0").select("a", "b"))
    links = found.where("kind = 1").groupBy(F.col("a").alias("id")).agg(F.sum("b").alias("linked"))
    classes = reps.select(*same, "id", "n").join(links, "id", "left").join(joined, "id", "left")
    out = rows.select("vec_id", *same).join(classes, same, "left")
    return out.select("vec_id", F.coalesce(F.col("n") - 1 + F.coalesce("linked", F.lit(0)), F.lit(0)).alias("n_links"), F.coalesce("component", "id", "vec_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
