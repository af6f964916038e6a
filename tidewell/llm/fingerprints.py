"""SimHash fingerprints of texts, their likeness, and a search for all fingerprints within a Hamming radius.

A text's terms are its runs of two and of three lower-cased words (the word, where there is one alone), weighted by their length. The
128 bits of each term's hash vote, plus or minus the weight, and a fingerprint has the bits with a positive sum. The angle between two texts' term
vectors is about pi times the share of bits that differ, and likeness is its cosine, 0 at least.
"""

from __future__ import annotations

import hashlib
import itertools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import U64, arrow, chunks, hashed_words, mix, mix1, partitions, shared_dir, small_batches, stored, text_of

BITS = 128
#: A term of so many bytes or more has the full weight.
FULL = 16
#: Blocks of 16 bits that the tables are keyed by, the bits of a block that may differ, and the radius they find all of: of RADIUS bits
#: that differ, spread over TABLES blocks, one block has FLIPS at most. At a Jaccard similarity of 0.8 of five-word runs texts are 12 to 18 bits apart
#: on average: the more, the closer together the words that differ.
TABLES, FLIPS = 8, 2
RADIUS = TABLES * (FLIPS + 1) - 1
#: Lookups or candidates that are held at once.
PAIRS = 1 << 20
#: Queries in a block, and rows that meet a block at a time (16 bytes each).
BLOCK, HELD = 1 << 17, 1 << 18
#: Ranges of documents for each shuffle partition.
RANGES = 4

_FLIPPED = np.array([sum(1 << x for x in some) for n in range(FLIPS + 1) for some in itertools.combinations(range(16), n)], np.uint16)
_SIGNS = (np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float32) * 2 - 1).copy()


def votes(hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Sums of the signed bits of rows of bytes."""
    total = np.zeros((hashes.shape[1], 8), np.float32)
    for lo in range(0, len(hashes), 2048):
        part = _SIGNS[hashes[lo : lo + 2048]]
        total += (weights[lo : lo + 2048] @ part.reshape(len(part), -1)).reshape(total.shape)
    return total.ravel()


def simhash(texts: pa.Array) -> np.ndarray:
    """A row of BITS / 8 bytes for each text; equal texts have equal rows, and texts without a word have zeros."""
    data, offsets = text_of(texts)
    out = np.zeros((len(texts), BITS // 8), np.uint8)
    for a, b in chunks(offsets):
        word, size, first = hashed_words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        n = len(word)
        if not n:
            continue
        left = np.repeat(first[1:], np.diff(first)) - np.arange(n)  # words from here to the end of the text
        terms, weights = np.zeros((n, 2), U64), np.zeros((n, 2), np.float32)
        for column, run in enumerate((2, 3)):
            m = n - run + 1
            if m > 0:
                terms[:m, column] = mix(sum((word[j : j + m] * U64(mix1(8 * run + j) | 1) for j in range(run)), np.zeros(m, U64)))
                weights[:m, column] = sum((size[j : j + m] for j in range(run)), np.full(m, run - 1))  # with a blank between words
            weights[left < run, column] = 0
        alone = first[:-1][np.diff(first) == 1]
        terms[alone, 0] = mix(word[alone] * U64(mix1(8) | 1))
        weights[alone, 0] = size[alone]
        np.minimum(weights, FULL, out=weights)
        flat = terms.ravel()
        bits = np.stack([flat, mix(flat ^ U64(0x6A09E667F3BCC909))], 1).view(np.uint8)
        weights = weights.ravel() / np.float32(FULL)
        for k, (lo, hi) in enumerate(zip((2 * first[:-1]).tolist(), (2 * first[1:]).tolist(), strict=True)):
            if hi > lo:
                out[a + k] = np.packbits(votes(bits[lo:hi], weights[lo:hi]) > 0)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """0 to 1, for rows of fingerprints."""
    apart = np.bitwise_count(a ^ b).sum(1)
    return np.where(apart == 0, 1.0, np.maximum(0.0, np.cos(np.pi * apart / BITS)))


def edited(text: str, after: str) -> str:
    """The text with its last floor(n / 2) characters replaced by the first as many, or all, of another."""
    n = len(text) // 2
    return text[: len(text) - n] + after[:n]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (range, ahead, order): each row with the next one of its range, the last with the first of those sent ahead."""
    waiting: tuple | None = None
    for batch in batches:
        where, ahead, ids = (batch.column(k).to_pylist() for k in range(3))
        texts = batch.column(3).to_pylist()
        done: list[tuple] = []
        for row in zip(where, ahead, ids, texts, strict=True):
            if waiting is not None and waiting[0] == row[0]:
                done.append((waiting[2], waiting[3], row[3]))
                waiting = None
            if not row[1]:
                waiting = row
        if done:
            yield _finished(done)


def _finished(done: list[tuple]) -> pa.RecordBatch:
    ids, texts, after = zip(*done, strict=True)
    changed = [edited(t, x) for t, x in zip(texts, after, strict=True)]
    other = simhash(pa.array(changed, pa.string()))
    # as a rule the next text is that of the next row, and is not hashed again
    place, every = {}, []
    for t in (*texts, *after):
        if id(t) not in place:
            place[id(t)] = len(every)
            every.append(t)
    hashed = simhash(pa.array(every, pa.string()))
    own, following = (hashed[[place[id(t)] for t in x]] for x in (texts, after))
    hexes = [bytes(x).hex() for x in own], [bytes(x).hex() for x in other]
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]), pa.array(hexes[0]), pa.array(hexes[1]), pa.array(likeness(own, other)), pa.array(likeness(own, following))], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def _range_of(key: Column, splitters: list[int]) -> Column:
    """How many splitters are above the key: coarse steps first, then the step's own."""
    step = max(1, int(len(splitters) ** 0.5))
    groups = [splitters[k : k + step] for k in range(0, len(splitters), step)]
    if not groups:
        return F.lit(0)
    coarse = F.size(F.filter(F.array(*[F.lit(g[-1]) for g in groups]), lambda x: x > key))
    fine = F.element_at(F.array(*[F.array(*map(F.lit, g)) for g in groups]), F.least(coarse + 1, F.lit(len(groups))))
    return coarse * step + F.when(coarse < len(groups), F.size(F.filter(fine, lambda x: x > key))).otherwise(len(splitters) - len(groups) * step)


def with_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of each row of docs (doc_id, text; other columns are not looked at) and of its edited text; see fingerprinted()."""
    spark = docs.sparkSession
    parts = partitions(spark)
    small_batches(spark)
    docs = docs.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("key"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = RANGES * parts
    splitters = sorted({int(x) for x in docs.approxQuantile("key", [k / n for k in range(1, n)], 0.2 / n)} if n > 1 else set(), reverse=True)
    docs = docs.withColumn("range", _range_of(F.col("key"), splitters))
    # a row for each range: the document that the range before it ends with
    first = {r["range"]: r["first"] for r in docs.groupBy("range").agg(F.max("key").alias("first")).collect()}
    filled = sorted(first)
    before = dict(zip(filled, [filled[-1], *filled[:-1]], strict=True)) if filled else {}
    if not filled:
        first, before = {0: 0}, {0: 0}
    top = max(first) + 1
    first_of = F.element_at(F.array(*[F.lit(first.get(k)).cast("long") for k in range(top)]), F.col("range") + 1)
    before_of = F.element_at(F.array(*[F.lit(before.get(k)).cast("int") for k in range(top)]), F.col("range") + 1)
    here = F.struct(F.col("range").alias("to"), F.lit(False).alias("ahead"))
    sent = F.struct(before_of.alias("to"), F.lit(True).alias("ahead"))
    rows = docs.withColumn("at", F.explode(F.when(F.col("key") == first_of, F.array(here, sent)).otherwise(F.array(here)))).select("at.to", "at.ahead", "doc_id", "text", "key")
    rows = rows.repartition(parts, "to").sortWithinPartitions("to", "ahead", F.desc("key"), "text").select("to", "ahead", "doc_id", "text")
    return rows.transform(arrow, _compare, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _bytes_of(column: pa.Array) -> np.ndarray:
    """A row of BITS / 8 bytes for each hexadecimal fingerprint."""
    return np.frombuffer(bytes.fromhex(text_of(column)[0].tobytes().decode()), np.uint8).reshape(-1, BITS // 8)


def _asked(folder: str):
    """Writes the distinct fingerprints of a task, BLOCK at most to a file; (path) of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pyarrow.fs.FileSystem.from_uri(folder)
        held: list[np.ndarray] = []

        def written(rows: np.ndarray) -> pa.RecordBatch:
            name = uuid.uuid4().hex
            with store.open_output_stream(f"{base}/{name}", compression=None) as out:
                out.write(rows.tobytes())
            return pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"]})

        for batch in batches:
            held.append(_bytes_of(batch.column(0)))
            while sum(map(len, held)) >= BLOCK:
                rows = np.concatenate(held)
                held = [rows[BLOCK:]]
                yield written(rows[:BLOCK])
        rows = np.concatenate([np.zeros((0, BITS // 8), np.uint8), *held])
        if len(rows):
            yield written(rows)

    return run


class _Block:
    """A block of queries in tables, one for each block of their bits, and how many rows are near to each."""

    def __init__(self, own: np.ndarray):
        self.own, self.total = own, np.zeros(len(own), np.int64)
        self.words, self.blocks = own.view(np.uint64), own.view(np.uint16)
        self.order = [np.argsort(self.blocks[:, k], kind="stable") for k in range(TABLES)]
        self.begin = [np.searchsorted(self.blocks[o, k], np.arange((1 << 16) + 1)) for k, o in enumerate(self.order)]

    def meet(self, rows: np.ndarray) -> None:
        step = max(1, PAIRS // (len(self.own) + len(_FLIPPED)))
        for lo in range(0, len(rows), step):
            here = rows[lo : lo + step]
            w, b = here.view(np.uint64), here.view(np.uint16)
            for k in range(TABLES):
                keys = (b[:, k, None] ^ _FLIPPED).astype(np.int64)
                first = self.begin[k][keys]
                count = self.begin[k][keys + 1] - first
                at, which = np.nonzero(count)
                count = count[at, which]
                row, nth = np.repeat(at, count), np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                query = self.order[k][np.repeat(first[at, which], count) + nth]
                near = np.bitwise_count(w[row] ^ self.words[query]).sum(1) <= RADIUS
                row, query = row[near], query[near]
                # a pair counts in the first table that has it
                new = (np.bitwise_count(b[row, :k] ^ self.blocks[query, :k]) > FLIPS).all(1)
                self.total += np.bincount(query[new], minlength=len(self.own))


def _counted(paths: DataFrame):
    """How many rows are within RADIUS bits of each fingerprint that is asked for, in a task's share of the rows; none that nothing is near.

    Rows are held HELD at a time, and meet one block of queries after another; blocks are read from the shared folder."""
    names = [r["path"] for r in paths.collect()]  # a path for BLOCK queries, or for a task with fewer

    def out(block: _Block) -> pa.RecordBatch:
        some = np.flatnonzero(block.total)
        return pa.RecordBatch.from_arrays([pa.array([bytes(x).hex() for x in block.own[some]], pa.string()), pa.array(block.total[some])], names=["fingerprint", "n"])

    def passed(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        todo = list(names)
        while todo:
            own: list[np.ndarray] = []
            while todo and sum(map(len, own)) < BLOCK:  # small files together
                store, at = pyarrow.fs.FileSystem.from_uri(todo.pop())
                with store.open_input_stream(at, compression=None) as stream:
                    own.append(np.frombuffer(stream.read(), np.uint8).reshape(-1, BITS // 8))
            block = _Block(np.unique(np.concatenate(own), axis=0))
            block.meet(rows)
            yield out(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches if names else ():
            held.append(_bytes_of(batch.column(0)))
            if sum(map(len, held)) >= HELD:
                yield from passed(np.concatenate(held))
                held = []
        if held:
            yield from passed(np.concatenate(held))

    return run


def within_radius(queries: DataFrame, index: DataFrame) -> DataFrame:
    """(fingerprint, n_near): for each distinct fingerprint of queries, the rows of index at most RADIUS bits from it.

    Fingerprints are hexadecimal. Those of queries are written in blocks to the shared folder; a task builds tables of one block after another, one for each
    block of bits. A row of index looks up its own bits there and all that differ from them in FLIPS bits at most, which finds all within the radius;
    whole fingerprints decide. A task holds one block and HELD rows, whatever the number of queries.
    """
    spark = queries.sparkSession
    folder = f"{shared_dir(spark)}/queries-{uuid.uuid4().hex}"
    store, base = pyarrow.fs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    paths = stored(queries.select("fingerprint").distinct().transform(arrow, _asked(folder), "path string"), "blocks")
    return index.select("fingerprint").transform(arrow, _counted(paths), "fingerprint string, n long").groupBy("fingerprint").agg(F.sum("n").alias("n_near"))


def fingerprinted(docs: DataFrame, every: int = 100) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_near) for each row of docs.

    The next document is that of the next smaller doc_id, and after the smallest the largest; rows of one doc_id follow each other by text, and rows
    without doc_id come last. A null text is empty. The edited text has its last floor(n_chars / 2) characters replaced by the first as many, or all, of
    the next text. near_edited and near_next are the likeness of the text's fingerprint to those of the edited and of the next text. n_near is, for
    documents whose id is divisible by `every`, the number of other rows whose fingerprint is at most RADIUS bits away; else null. A single row is
    its own next; an empty table gives an empty result.
    """
    rows = stored(with_next(docs), "fingerprints")
    asked = F.col("doc_id") % every == 0
    near = within_radius(rows.where(asked).select("fingerprint"), rows.select("fingerprint"))
    found = rows.where(asked).select("doc_id", "fingerprint").distinct().join(near, "fingerprint").select("doc_id", "fingerprint", (F.col("n_near") - 1).alias("n_near"))
    return rows.join(found, ["doc_id", "fingerprint"], "left").select(*rows.columns, "n_near")
