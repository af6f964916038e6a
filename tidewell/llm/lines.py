"""Removal of line runs that occur earlier, by a suffix array over line ids.

A text is a sequence of units: a line has one, and one more for every further UNIT_WORDS words, MIN_UNITS at most; blank lines have none.
A run of lines is long enough when it has MIN_UNITS units: a few lines, or a single long one. Distributed prefix doubling ranks the
suffixes of all sequences by their first 1, 2, 4, ... units: a suffix's rank and that of the suffix so many units on give its next
rank. Only suffixes whose prefix occurs again go into the next round, until no prefix does; all others are settled: their longest common prefix
with any other is shorter. Ranks come from a range partitioning of the distinct pairs, so they keep the suffixes' order, and suffixes of one rank
are an interval of the suffix array whose longest common prefix is the round's units or more. Of each interval at MIN_UNITS units or more the first suffix
is the original, and the others begin later copies, as long as the last round that has them in an interval says. Their union is the maximal repeated runs.

No rank's suffixes are gathered: groups are counted before the shuffle, and suffixes get their rank by an equi-join.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.common import arrow, cut, partitions, small_batches, stored

MIN_UNITS, UNIT_WORDS = 4, 16
#: Units that a task holds at once.
UNITS = 1 << 16


def _units(min_units: int, unit_words: int):
    """A row for each unit: its document and text, its place, its line's hash, its line. UNITS at most are held at once."""
    names, types = ["doc_id", "row", "at", "hi", "lo", "line", "last"], (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[] for _ in names]

        def taken() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], names=names)
            for column in out:
                column.clear()
            return batch

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if doc is None or not text.is_valid:
                    continue
                raw = text.as_buffer().to_pybytes()
                row, at, start, line = int.from_bytes(hashlib.md5(raw).digest()[:8], "little", signed=True), 0, 0, 0
                while start <= len(raw):
                    end = raw.find(b"\n", start)
                    own = raw[start : len(raw) if end < 0 else end]
                    words = len(own.split())
                    if words:
                        digest = hashlib.md5(own).digest()
                        hi, lo = int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)
                        for unit in range(min(min_units, -(-words // unit_words))):
                            for column, x in zip(out, (doc, row, at, hi, lo ^ unit, line, line), strict=True):
                                column.append(x)
                            at += 1
                    start, line = (len(raw) + 1 if end < 0 else end + 1), line + 1
                    if len(out[0]) >= UNITS:
                        yield taken()
        yield taken()

    return run


def _ranked(rows: DataFrame, *key: str) -> DataFrame:
    """Rows whose key occurs again, with its rank (in the order of the keys) instead, and the first place that has it."""
    groups = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "at")).alias("first")).where("n > 1").drop("n")
    ordered = groups.repartitionByRange(partitions(rows.sparkSession), *key).sortWithinPartitions(*key)
    ranks = cut(ordered.withColumn("rank", F.monotonically_increasing_id()))  # written once: a lost task must not rank anew
    return rows.join(ranks, list(key)).drop(*key)


def intervals(docs: DataFrame, min_units: int = MIN_UNITS, unit_words: int = UNIT_WORDS) -> list[DataFrame]:
    """The rounds of prefix doubling, from min_units units on: (doc_id, row, at, line, last, first, rank) of each suffix in an interval of the suffix array.

    row tells the texts of one doc_id apart, at is the suffix's first unit and line its line, last the line of its last unit in this round, first the (doc_id, at) that comes
    first in the interval. The last round has no rows: no prefix of so many units occurs twice.
    """
    units = stored(docs.select("doc_id", "text").transform(arrow, _units(min_units, unit_words), "doc_id long, row long, at int, hi long, lo long, line int, last int"), "units")
    suffixes, span, rounds = _ranked(units, "hi", "lo"), 1, []
    while True:
        suffixes = stored(suffixes, "suffixes")
        if span >= min_units:
            rounds.append(suffixes)
        if suffixes.isEmpty():
            return rounds or [suffixes]
        ahead = Window.partitionBy("doc_id", "row").orderBy("at").rangeBetween(span, span)
        pairs = suffixes.select("doc_id", "row", "at", "line", F.col("rank").alias("own"), F.max("rank").over(ahead).alias("next"), F.max("last").over(ahead).alias("last")).where("next is not null")
        suffixes, span = _ranked(pairs, "own", "next"), span * 2


def repeated_runs(docs: DataFrame, min_units: int = MIN_UNITS, unit_words: int = UNIT_WORDS) -> DataFrame:
    """(doc_id, line, last): windows of lines, both ends included, that are a later copy of a run of min_units units (a power of two) or more."""
    if min_units < 1 or min_units & (min_units - 1):
        raise ValueError("min_units has to be a power of two")
    found = [r.where("(doc_id, at) != (first.doc_id, first.at)").select("doc_id", "line", "last") for r in intervals(docs, min_units, unit_words)]
    return reduce(DataFrame.union, found).groupBy("doc_id", "line").agg(F.max("last").alias("last"))


def _cut_texts(keep: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n_lines, removed, runs = [], [], [], []
            for text, spans in zip(batch.column(keep).to_pylist(), batch.column(keep + 1).to_pylist(), strict=True):
                lines = text.split("\n") if text is not None else []
                gone = np.zeros(len(lines) + 1, np.int32)
                for span in spans or ():
                    if span["last"] < len(lines):
                        gone[span["line"]] += 1
                        gone[span["last"] + 1] -= 1
                gone = np.cumsum(gone[:-1]) > 0
                n_lines.append(len(lines))
                removed.append(int(gone.sum()))
                runs.append(int((np.diff(np.concatenate(([0], gone.astype(np.int8)))) == 1).sum()))
                texts.append(text if not gone.any() else "\n".join(x for x, g in zip(lines, gone.tolist(), strict=True) if not g))
            yield pa.RecordBatch.from_arrays([*batch.columns[:keep], pa.array(texts, pa.string()), pa.array(n_lines, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64())], names=[*batch.schema.names[:keep], "text", "n_lines", "n_removed", "n_runs"])

    return run


def without_repeated_lines(docs: DataFrame, *keep: str, min_units: int = MIN_UNITS, unit_words: int = UNIT_WORDS) -> DataFrame:
    """The columns keep (doc_id is one), text, n_lines, n_removed, n_runs for each row of docs (doc_id, text; other columns are not looked at).

    Lines end with a line feed and are equal byte for byte. A run is removed where it also begins earlier: in a smaller doc_id, or earlier in the
    same text; copies may overlap, and runs are judged on the input, not on what is left. Blank lines count for nothing, but go with a run they
    are inside of. text holds the other lines; a text may be left empty. Null stays null, with no lines. Rows of one doc_id are taken for one
    document, met twice: that is no repeat. A row without doc_id has no place in the order: it loses nothing and takes nothing. An empty
    table gives an empty result.
    """
    small_batches(docs.sparkSession)
    spans = repeated_runs(docs, min_units, unit_words).groupBy("doc_id").agg(F.collect_list(F.struct("line", "last")).alias("__spans")).withColumnRenamed("doc_id", "__doc")
    rows = docs.select(*keep, F.col("text").alias("__text"), F.col("doc_id").alias("__id"))
    rows = rows.join(spans, F.col("__id") == F.col("__doc"), "left").select(*keep, "__text", "__spans")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(keep)]), "text string, n_lines long, n_removed long, n_runs long"])
    return rows.transform(arrow, _cut_texts(len(keep)), schema)
