"""Quality by importance resampling: how much likelier a text is under the target's model than under that of all texts.

Both models are bags of hashed word unigrams and bigrams, SLOTS shares each with add-one smoothing: one over the target, good texts, the
other over all documents. A text's importance weight is the ratio of its likelihoods, its logarithm the sum of its terms' log ratios: long texts
weigh more, for and against, as the method has it. A Gumbel variate drawn from its doc_id is added, and the texts with the largest sums are a sample
without replacement by these weights. per_terms instead compares all texts at one length: the mean log ratio times so many terms.

The k-th largest sum is found by counting its bits, 16 at a time, on the cluster: at most 65,536 counts come to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import U64, arrow, chunks, hashed_words, mix, mix1, small_batches, stored, text_of

SLOTS = 1 << 14
#: The most target texts that the target's model is fitted on, and the share of documents that is sampled.
TARGETS, SHARE = 20_000, 0.8
_SHIFT = U64(64 - SLOTS.bit_length() + 1)


def term_slots(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slots of all texts' terms, and where each text's begin (one more at the end)."""
    word, _, first = hashed_words(data, offsets)
    pair = mix(word * U64(mix1(21) | 1) + np.append(word[1:], U64(0)) * U64(mix1(22) | 1))
    both = np.stack([word, pair], 1)
    lasts = first[1:][np.diff(first) > 0] - 1
    keep = np.ones(both.shape, bool)
    keep[lasts, 1] = False  # no pair goes beyond its text
    count = np.maximum(2 * np.diff(first) - 1, 0)
    return (both[keep] >> _SHIFT).astype(np.int64), np.concatenate(([0], np.cumsum(count)))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    every, target = np.zeros(SLOTS, np.int64), np.zeros(SLOTS, np.int64)
    for batch in batches:
        data, offsets = text_of(batch.column(0))
        chosen = batch.column(1).to_numpy(zero_copy_only=False)
        for a, b in chunks(offsets):
            slots, at = term_slots(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            every += np.bincount(slots, minlength=SLOTS)
            target += np.bincount(slots[np.repeat(chosen[a:b], np.diff(at))], minlength=SLOTS)
    some = np.flatnonzero(every)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(every[some]), pa.array(target[some])], names=["slot", "n_all", "n_target"])


def log_ratios(docs: DataFrame, target: DataFrame) -> np.ndarray:
    """The log ratio of each slot's shares; target is (doc_id), at most TARGETS rows of which count."""
    ids = target.where("doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(TARGETS)
    rows = docs.select("doc_id", "text").join(F.broadcast(ids.withColumn("chosen", F.lit(True))), "doc_id", "left").select("text", F.coalesce("chosen", F.lit(False)).alias("chosen"))
    found = rows.transform(arrow, _counts, "slot long, n_all long, n_target long").groupBy("slot").agg(F.sum("n_all").alias("a"), F.sum("n_target").alias("t")).collect()
    every, wanted = np.ones(SLOTS), np.ones(SLOTS)
    for r in found:
        every[r["slot"]] += r["a"]
        wanted[r["slot"]] += r["t"]
    return np.log(wanted / wanted.sum()) - np.log(every / every.sum())


def gumbel(ids: np.ndarray, seed: int) -> np.ndarray:
    u = ((mix(ids.astype(np.int64).view(U64) + U64(mix1(seed))) >> U64(11)).astype(np.float64) + 0.5) / 2**53
    return -np.log(-np.log(u))


def ordered_bits(x: np.ndarray) -> np.ndarray:
    """Longs in the order of the doubles."""
    bits = (x + 0.0).view(np.int64)
    return np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits)


def _scored(given, seed: int, per_terms: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratios = given.value
        for batch in batches:
            data, offsets = text_of(batch.column(1))
            weight, terms = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for a, b in chunks(offsets):
                slots, at = term_slots(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                n = np.diff(at)
                some = np.flatnonzero(n)
                if len(some):
                    weight[a + some] = np.add.reduceat(ratios[slots], at[some]) * (1 if per_terms is None else per_terms / n[some])
                terms[a:b] = n
            ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            key = np.where(terms > 0, weight + gumbel(ids, seed), -np.inf)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(terms), pa.array(np.round(weight, 9)), pa.array(ordered_bits(key))], names=["doc_id", "n_terms", "log_weight", "key"])

    return run


def kth_largest(rows: DataFrame, column: str, k: int) -> int | None:
    """The k-th largest of a column of longs, or None if there are fewer; each round counts 16 bits of those still in question."""
    if k < 1:
        return None
    low, width, rest = 0, 64, k
    unsigned = F.col(column).bitwiseXOR(F.lit(-(1 << 63)))  # in the order of unsigned numbers
    while width:
        width -= 16
        part: Column = F.shiftrightunsigned(unsigned, width).bitwiseAND(0xFFFF)
        near = rows if width == 48 else rows.where(F.shiftrightunsigned(unsigned, width + 16) == low)
        for slot, n in sorted(((r[0], r[1]) for r in near.groupBy(part.alias("slot")).agg(F.count(F.lit(1))).collect()), reverse=True):
            if n >= rest:
                low = low << 16 | slot
                break
            rest -= n
        else:
            return None
    low ^= 1 << 63
    return low - (1 << 64) if low >> 63 else low


def resampled(docs: DataFrame, target: DataFrame, share: float = SHARE, seed: int = 1, per_terms: int | None = None) -> DataFrame:
    """(doc_id, n_terms, log_weight, selected) for each row of docs (doc_id, text; other columns are not looked at).

    target (doc_id) names good documents; if none is in docs, all weights come from smoothing alone. selected holds for the floor(share * rows)
    rows with the largest log_weight plus Gumbel noise, and rows tied with the last of them; noise follows doc_id, so repeated rows tie. per_terms, if given, is the
    length at which texts are compared. Texts
    without words, null ones too, have weight 0 and come after all others. A row without doc_id has the noise of doc_id 0. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    given = spark.sparkContext.broadcast(log_ratios(docs, target))
    rows = stored(docs.select("doc_id", "text").transform(arrow, _scored(given, seed, per_terms), "doc_id long, n_terms long, log_weight double, key long"), "weights")
    least = kth_largest(rows, "key", int(share * rows.count()))
    return rows.select("doc_id", "n_terms", "log_weight", (F.lit(False) if least is None else F.col("key") >= F.lit(least)).alias("selected"))
