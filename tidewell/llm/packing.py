"""Best-fit-decreasing packing of token sequences.

Which bin a document gets depends on lengths alone, and there are only `capacity` different lengths. The driver therefore
plans with the number of pieces of each length: lengths descending, a segment tree over remaining capacities finds the tightest
open bin in logarithmic time, and bins that are alike are filled together, as one document after another would have filled them. The plan
is a list of runs (so many pieces of one length into consecutive bins at one place); its size depends on the capacity, not on
the input. Pieces are numbered within their length by two levels of counts and take their place from the plan's runs.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewell.llm.common import U64, arrow, blank_parts, chunks, cut, joined, prefix_hash, slice_hash, small_batches, stored, text_of

#: Pieces of one length and part, on average: common lengths are dealt out in as many parts as that takes.
PER_SALT = 256
#: Words whose ids a worker remembers.
REMEMBERED = 400_000
#: Bytes of text that are split at once, and new words that are encoded in one call.
SPLIT, ENCODED = 1 << 20, 8192


class FreeSpace:
    """A segment tree over remaining capacities 0..capacity: which of them some open bin has."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.open = bytearray(2 * self.leaves)

    def set(self, free: int, is_open: bool) -> None:
        at = free + self.leaves
        self.open[at] = is_open
        while at > 1:
            at >>= 1
            self.open[at] = self.open[2 * at] | self.open[2 * at + 1]

    def tightest(self, least: int) -> int:
        """The smallest open capacity of at least so much, or -1."""
        at = least + self.leaves
        while not self.open[at]:
            while at & 1:
                at >>= 1
                if at <= 1:
                    return -1
            at += 1
        while at < self.leaves:
            at = 2 * at if self.open[2 * at] else 2 * at + 1
        return at - self.leaves


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first piece, pieces, first bin, pieces a bin, offset): best-fit decreasing of so many pieces of each length."""
    tree, bins, runs, opened = FreeSpace(capacity), {}, [], 0

    def put(free: int, first: int, n: int) -> None:
        if free and n:
            bins.setdefault(free, []).append((first, n))
            tree.set(free, True)

    for length in sorted((x for x in counts if x > 0), reverse=True):
        done, left = 0, counts[length]
        while left:
            free = tree.tightest(length)
            if free < 0:
                free, first = capacity, opened
                n = -(-left // (capacity // length))
                opened += n
            else:
                first, n = bins[free].pop()
                if not bins[free]:
                    del bins[free]
                    tree.set(free, False)
            each = free // length
            full = min(n, left // each)
            if full:
                runs.append((length, done, full * each, first, each, capacity - free))
                put(free - each * length, first, full)
                done, left = done + full * each, left - full * each
            rest = 1 if left and full < n else 0
            if rest:  # one more bin takes what is left, fewer than a whole bin's worth
                runs.append((length, done, left, first + full, left, capacity - free))
                put(free - left * length, first + full, 1)
                done, left = done + left, 0
            put(free, first + full + rest, n - full - rest)
    return runs


#: What the tokenizer's own pattern does with the bytes of plain text, by fixed classes: white space ends words, a word is a run of letters, one
#: digit, or a run of other signs. Letters are a-z and those of C3 80 to C3 BF but for two signs. Texts with any other byte, with an
#: apostrophe (contractions) or the beginning of a special token go through the tokenizer whole.
#: This holds for a tokenizer whose normalizer and pre-tokenizer are these (fixed values, from its file); any other gets all texts whole.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
WORDS = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_BLANK, _ALPHA, _DIGIT, _SIGN, _ODD = range(5)
_CLASS = np.full(256, _ODD, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = _BLANK
_CLASS[33:127] = _SIGN
_CLASS[48:58] = _DIGIT
_CLASS[[*range(65, 91), *range(97, 123), 0xC3]] = _ALPHA
_CLASS[39] = _ODD


def _split(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, starts and ends of words, and which texts are not plain; those have no words here."""
    kind = _CLASS[data]
    after = np.zeros(len(data), bool)  # the second byte of a letter
    after[1:] = data[:-1] == 0xC3
    kind[after & (data >= 0x80) & (data <= 0xBF)] = _ALPHA
    lower = data.copy()
    lower[(data >= 65) & (data <= 90)] += 32
    lower[after & (data >= 0x80) & (data <= 0x9E)] += 32
    bad = kind == _ODD
    bad |= after & ((data == 0x97) | (data == 0xB7))
    bad[:-1] |= (data[:-1] == 60) & (data[1:] == 124)
    odd = np.diff(np.concatenate(([0], np.cumsum(bad)))[offsets]) > 0
    edge = np.ones(len(data) + 1, bool)
    edge[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
    edge[offsets] = True
    words = kind != _BLANK
    if odd.any():
        words &= ~np.repeat(odd, np.diff(offsets))
    return lower, np.flatnonzero(words & edge[:-1]), np.flatnonzero(words & edge[1:]) + 1, odd


class Ids:
    """Ids of texts, by the tokenizer, which sees each word of plain texts once; words are known by their 64-bit hash."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that a word ends with
        self.ends[[k for token, k in vocabulary.items() if token.endswith("</w>")]] = True
        spec = json.loads(self.tokenizer.to_str())
        first = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0]
        same = spec["normalizer"] == NORMALIZER and (first.get("type"), first.get("pattern"), first.get("invert")) == ("Split", {"Regex": WORDS}, True)
        self.by_words = same and spec["model"].get("end_of_word_suffix") == "</w>" and not any(c.isspace() for t in spec["added_tokens"] for c in t["content"])
        self.forget()

    def forget(self) -> None:
        self.known, self.row = np.zeros(0, U64), np.zeros(0, np.int64)
        self.ids, self.at = np.zeros(0, "<u4"), np.zeros(1, np.int64)

    def raw(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def learn(self, hashes: np.ndarray, words: list[str]) -> None:
        """Encodes words in one call; if the ids do not fall into as many words, each alone."""
        ids = self.raw(" ".join(words))
        to = np.flatnonzero(self.ends[ids]) + 1
        if len(to) != len(words):
            each = [self.raw(word) for word in words]
            ids, to = np.concatenate(each), np.cumsum([len(x) for x in each])
        place = np.searchsorted(self.known, hashes)  # both are ascending
        self.known, self.row = np.insert(self.known, place, hashes), np.insert(self.row, place, len(self.at) - 1 + np.arange(len(words)))
        self.ids, self.at = np.concatenate([self.ids, ids]), np.concatenate([self.at, self.at[-1] + to])

    def unknown(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.arange(len(hashes))
        place = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        return np.flatnonzero(self.known[place] != hashes)

    def of(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text; null counts as empty."""
        if not self.by_words:
            return [self.raw(t.as_py() or "") for t in texts]
        data, offsets = text_of(texts)
        out: list[np.ndarray] = []
        for a, b in chunks(offsets, SPLIT):
            if offsets[b] - offsets[a] > 2 * SPLIT:  # one long text; no word, and no token, goes across a blank
                own = data[offsets[a] : offsets[b]]
                parts = [own[x:y].tobytes().decode() for x, y in blank_parts(own, SPLIT)]
                out.append(np.concatenate([self.of(pa.array([p]))[0] if len(p) <= SPLIT else self.raw(p) for p in parts]))
                continue
            lower, start, end, odd = _split(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            each, first, which = np.unique(slice_hash(prefix_hash(lower), start, end), return_index=True, return_inverse=True)
            new = self.unknown(each)
            if len(self.known) + len(new) > REMEMBERED:
                self.forget()
                new = np.arange(len(each))
            raw = lower.tobytes()
            for lo in range(0, len(new), ENCODED):
                part = new[lo : lo + ENCODED]
                self.learn(each[part], [raw[s:e].decode() for s, e in zip(start[first[part]].tolist(), end[first[part]].tolist(), strict=True)])
            row = self.row[np.searchsorted(self.known, each)][which] if len(each) else np.zeros(0, np.int64)
            size = self.at[row + 1] - self.at[row]
            to = np.concatenate(([0], np.cumsum(size)))
            ids = self.ids[np.repeat(self.at[row] - to[:-1], size) + np.arange(to[-1])]
            edge = to[np.searchsorted(start, offsets[a : b + 1] - offsets[a])]
            for k, (x, y) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)):
                out.append(self.raw(texts[a + k].as_py()) if odd[k] else ids[x:y])
        return out


_IDS: dict[str, Ids] = {}


def _pieces(path: str, capacity: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _IDS.get(path) or _IDS.setdefault(path, Ids(path))
        tail = np.array([end], "<u4")
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for lo in range(0, batch.num_rows, 512):
                for k, found in enumerate(known.of(batch.column(1).slice(lo, 512))):
                    whole = np.concatenate([found, tail])
                    for piece, at in enumerate(range(0, len(whole), capacity)):
                        part = whole[at : at + capacity]
                        for column, x in zip(rows, (lo + k, piece, at, len(part), zlib.crc32(part.data)), strict=True):
                            column.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows[0], pa.int32())), pa.array(rows[1], pa.int32()), *(pa.array(x, pa.int64()) for x in rows[2:])], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 4096, end: int = 1) -> DataFrame:
    """The documents' token sequences, each closed by the id `end` and cut into pieces of capacity ids; the last may be shorter."""
    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").transform(arrow, _pieces(tokenizer, capacity, end), "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(found: DataFrame, capacity: int = 4096) -> DataFrame:
    """Adds sequence_id and offset to rows with a length of 1..capacity, by best-fit decreasing over all of them."""
    spark = found.sparkSession
    rows = stored(found, "pieces")
    # at most `capacity` rows come to the driver, however large the input is
    sizes = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    salts = spark.createDataFrame([(k, -(-n // PER_SALT)) for k, n in sizes.items()] or [(0, 1)], "length long, salts long")
    salted = rows.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), "salts")).drop("salts")
    counts = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    runs = spark.createDataFrame(plan(sizes, capacity) or [(0, 0, 0, 0, 1, 0)], "length long, first long, n long, bin long, each long, free long")
    # a run's first piece is at most the piece's number: the last such run of its length has it
    by_length = runs.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("first", "bin", "each", "free"))).alias("runs"))
    at = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    numbered = joined(salted, before, ["length", "salt"], "inner").withColumn("rank", F.col("before") + F.row_number().over(at) - 1)
    placed = numbered.join(F.broadcast(by_length), "length").withColumn("run", F.element_at(F.filter("runs", lambda r: r["first"] <= F.col("rank")), -1))
    into = F.col("rank") - F.col("run.first")
    sequence = F.col("run.bin") + F.floor(into / F.col("run.each"))
    offset = F.col("run.free") + into % F.col("run.each") * F.col("length")
    return placed.select(*found.columns, sequence.cast("long").alias("sequence_id"), offset.alias("offset"))


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 4096, end: int = 1) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for each piece of docs (doc_id, text; other columns are not looked at).

    A null or empty text is the id `end` alone. Pieces of one length rank by (doc_id, piece, start, crc), nulls first; rows that are
    equal in all of these each have a place of their own, and which of them has which is open. No other ties arise. An empty table gives
    an empty result.
    """
    return pack(pieces(docs, tokenizer, capacity, end), capacity)
