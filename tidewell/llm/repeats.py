"""Removal of byte strings that occur earlier, by a sparse suffix array.

Of every window of `length` bytes one inner position is picked by its content alone: the one whose next GRAM bytes have the smallest
hash. The suffixes at the picked positions (about one in thirty) are sorted, not those at all positions, and equal windows still
meet, since both are picked at the same place. The windows that share a picked position are a run; together they are its region.

1. Splitters, sampled, cut the order of the suffixes into ranges: by their first LEAD bytes, and then by a hash of their leading GRAM bytes. There are
   as many ranges as the input's size asks for, and a task works through its ranges one by one. No two suffixes with equal leading GRAM bytes are
   in different ranges, so that nothing has to be compared across a boundary. In a range, suffixes are sorted by these, then region. A region that occurs earlier as a whole is removed as a whole; of equal regions only the first one goes on.
   Tasks do the same before the shuffle, so copies of one text, however many, put one record a batch into a range.
2. Only where different regions share leading bytes are the windows themselves compared. Each goes with the bytes right and left of the
   leading ones that all its windows have, which again sets most apart; what is left is sorted by multikey quicksort over machine words.

Every comparison that removes a byte is of regions (by 64-bit hash next to equal 64-bit hashes of their leading bytes) or of the bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import CHUNK, U64, arrow, chunks, mix, partitions, prefix_hash, slice_hash, small_batches, stored, text_of

#: Documents from which splitters are sampled, and suffixes of each.
SAMPLED, OF_EACH = 4096, 16
#: Ranges for each shuffle partition: these are dealt out by hash, and many small ones even out. Bytes of text for a range at most, on average.
RANGES, RANGE_BYTES = 4, 64 << 20
#: Bytes of a suffix that the order begins with; a hash of its leading GRAM bytes has the other 8 - LEAD bytes of the key.
LEAD = 5
#: Windows that a task sorts at once.
AT_ONCE = 1 << 19

SUFFIX = np.dtype([("gram", "<u8"), ("region", "<u8"), ("doc", "<i8"), ("start", "<u4"), ("left", "<u2"), ("more", "<u2")])
SPAN = np.dtype([("doc", "<i8"), ("start", "<u4"), ("end", "<u4")])
WINDOW = np.dtype([("key", "<u8"), ("doc", "<i8"), ("start", "<u4"), ("left", "<u2"), ("more", "<u2")])


def gram_of(length: int) -> int:
    return max(LEAD, length * 2 // 5)


def in_parts(data: np.ndarray, offsets: np.ndarray, doc: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """(data, offsets, doc, base) of about CHUNK bytes; a text beyond two chunks comes in parts, from base on, that overlap by all windows but one byte."""
    for a, b in chunks(offsets):
        size = int(offsets[b] - offsets[a])
        if size <= 2 * CHUNK:
            yield data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], doc[a:b], 0
            continue
        for base in range(0, size - length + 1, CHUNK):
            part = data[offsets[a] + base : min(offsets[b], offsets[a] + base + CHUNK + length - 1)]
            yield part, np.array([0, len(part)]), doc[a:b], base


def picked_in(data: np.ndarray, offsets: np.ndarray, doc: np.ndarray, length: int) -> np.ndarray:
    """The suffixes picked in some texts of any length."""
    found = [np.zeros(0, SUFFIX)]
    for part, at, own, base in in_parts(data, offsets, doc, length):
        some = picked(part, at, own, length)[0]
        some["start"] += base
        found.append(some)
    return np.concatenate(found)


def picked(data: np.ndarray, offsets: np.ndarray, doc: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes picked in some texts, and the sums that their hashes came from."""
    gram = gram_of(length)
    sums = prefix_hash(data)
    size = np.diff(offsets)
    long_ = np.flatnonzero(size >= length)
    if not len(long_):
        return np.zeros(0, SUFFIX), sums
    at = np.arange(len(data) - gram + 1)
    h = slice_hash(sums, at, at + gram)
    bits = U64(max(20, int(len(data)).bit_length()))
    least = (h >> bits << bits) | at.astype(U64)
    span, width = 1, length - gram + 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if width > span:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    windows = size[long_] - length + 1
    owner = np.repeat(long_, windows)
    start = np.repeat(offsets[long_] - np.concatenate(([0], np.cumsum(windows)[:-1])), windows) + np.arange(windows.sum())
    chosen = (least[start] & ((U64(1) << bits) - U64(1))).astype(np.int64)
    new = np.ones(len(start), bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    out = np.zeros(len(first), SUFFIX)
    begin, position = start[first], chosen[first]
    lead = np.zeros(len(first), U64)
    for k in range(LEAD):
        lead = lead << U64(8) | data[position + k].astype(U64)
    out["gram"] = lead << U64(64 - 8 * LEAD) | mix(h[position]) >> U64(8 * LEAD)
    out["left"], out["more"] = position - begin, start[last] - begin
    out["region"] = mix(slice_hash(sums, begin, start[last] + length) + (position - begin).astype(U64))
    out["doc"], out["start"] = doc[owner[first]], begin - offsets[owner[first]]
    return out, sums


def first_ones(found: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Of equal regions the earliest, sorted by (gram, region); the spans of the others. One place met twice is no repeat."""
    found = found[np.lexsort((found["start"], found["doc"], found["region"], found["gram"]))]
    new = np.ones(len(found), bool)
    new[1:] = (found["gram"][1:] != found["gram"][:-1]) | (found["region"][1:] != found["region"][:-1])
    lead = found[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(found) else found
    later = ~new & ((found["doc"] != lead["doc"]) | (found["start"] != lead["start"]))
    return found[new], merged(spans_of(found[later], length))


def spans_of(found: np.ndarray, length: int) -> np.ndarray:
    out = np.zeros(len(found), SPAN)
    out["doc"], out["start"], out["end"] = found["doc"], found["start"], found["start"] + found["more"] + length
    return out


def merged(spans: np.ndarray) -> np.ndarray:
    """The union of spans, as disjoint spans that do not touch."""
    if not len(spans):
        return spans
    spans = spans[np.lexsort((spans["start"], spans["doc"]))]
    shift = np.concatenate(([0], np.cumsum(spans["doc"][1:] != spans["doc"][:-1]))) << 33
    reach = np.maximum.accumulate(spans["end"] + shift)
    new = np.ones(len(spans), bool)
    new[1:] = spans["start"][1:] + shift[1:] > reach[:-1]
    out = spans[new]
    out["end"] = (reach - shift)[np.append(np.flatnonzero(new)[1:], len(spans)) - 1]
    return out


def multikey_groups(group: np.ndarray, column, columns: int) -> np.ndarray:
    """Numbers of the groups of rows that are equal in group and in all columns of words, -1 for a row alone: multikey quicksort.

    column(j, rows) gives the j-th word of some rows. Each round sorts by one word what is still tied, and drops what is not.
    """
    rows, now = np.arange(len(group)), np.unique(group, return_inverse=True)[1]
    for j in range(-1, columns):
        if j >= 0 and len(rows):
            word = column(j, rows)
            order = np.lexsort((word, now))
            rows, now, word = rows[order], now[order], word[order]
            new = np.ones(len(rows), bool)
            new[1:] = (now[1:] != now[:-1]) | (word[1:] != word[:-1])
            now = np.cumsum(new) - 1
        tied = np.bincount(now)[now] > 1 if len(now) else np.zeros(0, bool)
        rows, now = rows[tied], now[tied]
    out = np.full(len(group), -1, np.int64)
    out[rows] = now
    return out


def _blob(records: np.ndarray) -> bytes:
    return records.tobytes()


def _by_range(records: np.ndarray, key: str, splitters: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    if not len(records):
        return
    part = np.searchsorted(splitters, records[key], "right")
    order = np.argsort(part, kind="stable")
    records, part = records[order], part[order]
    edge = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
    for a, b in zip(edge, np.append(edge[1:], len(part)), strict=True):
        yield int(part[a]), records[a:b]


def _rows(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], names=["range", "kind", "records"])


def _sample(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_of(batch.column(1))
            for a, b in chunks(offsets):
                found = picked_in(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], np.arange(b - a), length)
                yield pa.RecordBatch.from_arrays([pa.array(found["gram"][:: max(1, len(found) // (OF_EACH * (b - a)))].view(np.int64))], names=["gram"])

    return run


def _suffixes(length: int, splitters: np.ndarray):
    """Kind 0: records of a range; kind 1: spans that are known already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = 0
        for batch in batches:
            data, offsets = text_of(batch.column(1))
            doc = batch.column(0).to_numpy(zero_copy_only=False)
            kept, spans = first_ones(picked_in(data, offsets, doc, length), length)
            rows = [(part, 0, _blob(own)) for part, own in _by_range(kept, "gram", splitters)]
            if len(spans):
                turn += 7919
                rows.append(((int(spans["doc"][0]) + turn) % (len(splitters) + 1), 1, _blob(spans)))
            if rows:
                yield _rows(rows)

    return run


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[list[list[np.ndarray]]]:
    """Of rows sorted by range: all columns behind the range, as buffers, one range after another."""
    now, held = None, []
    for batch in batches:
        for k, to in enumerate(batch.column(0).to_pylist()):
            if to != now and held:
                yield held
                held = []
            now = to
            held.append([batch.column(c)[k] for c in range(1, batch.num_columns)])
    if held:
        yield held


def _marks(kind: int, doc, start, left, more) -> pa.RecordBatch:
    n = len(doc)
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), pa.array(np.ascontiguousarray(doc)), *(pa.array(np.asarray(x).astype(np.int32)) for x in (start, left, more))], names=["kind", "doc_id", "start", "left", "more"])


def _spans_out(spans: np.ndarray) -> pa.RecordBatch:
    return _marks(1, spans["doc"], spans["start"], spans["end"], np.zeros(len(spans)))


def _sorted(length: int):
    """Kind 1: spans to remove (start, end in left). Kind 0: regions whose windows are still to be compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _ranges(batches):
            known = [np.frombuffer(blob.as_buffer(), SPAN) for kind, blob in rows if kind.as_py()]
            if known:
                yield _spans_out(np.concatenate(known))
            kept, spans = first_ones(np.concatenate([np.zeros(0, SUFFIX), *(np.frombuffer(blob.as_buffer(), SUFFIX) for kind, blob in rows if not kind.as_py())]), length)
            yield _spans_out(spans)
            same = np.zeros(len(kept), bool)
            if len(kept):
                twin = kept["gram"][1:] == kept["gram"][:-1]
                same[1:] |= twin
                same[:-1] |= twin
            kept = kept[same]
            yield _marks(0, kept["doc"], kept["start"], kept["left"], kept["more"])

    return run


def _regions(data: np.ndarray, offsets: np.ndarray, doc: np.ndarray, per_row: pa.Array, length: int) -> Iterator[tuple]:
    """Texts of about CHUNK bytes with the regions in them: where each one's document begins in the text, its doc, (start, left, more)."""
    for a, b in chunks(offsets):
        part = per_row.slice(a, b - a)
        flat = part.flatten()
        if not len(flat):
            continue
        owner = np.repeat(np.arange(b - a), np.diff(part.offsets.to_numpy()))
        own = [flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3)]
        inside = own[0] + own[2] + length <= (offsets[a + 1 : b + 1] - offsets[a:b])[owner]
        own, owner = [x[inside] for x in own], owner[inside]
        if offsets[b] - offsets[a] <= 2 * CHUNK:
            yield data[offsets[a] : offsets[b]], (offsets[a:b] - offsets[a])[owner], doc[a:b][owner], own
            continue
        for k in np.unique(own[0] // CHUNK):  # one long text
            some = own[0] // CHUNK == k
            start, left, more = (x[some] for x in own)
            lo = int(start.min())
            yield data[offsets[a] + lo : offsets[a] + int((start + more).max()) + length], np.full(len(start), -lo), doc[a:b][owner[some]], (start, left, more)


def _windows(length: int, splitters: int):
    """From texts and their undecided regions, halves of regions under keys of all bytes that their windows surely have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = gram_of(length)
        half = (length - gram) // 2
        for batch in batches:
            data, offsets = text_of(batch.column(1))
            doc = batch.column(0).to_numpy(zero_copy_only=False)
            per_row = batch.column(2)
            for text, base, ids, (start, left, more) in _regions(data, offsets, doc, per_row, length):
                sums = prefix_hash(text)
                place = base + start + left
                rows = []
                for side in (0, 1):
                    # windows with so many bytes left of the place, or else so many right of the leading bytes
                    cut_at = np.maximum(left - half + 1, 0)  # windows 0..cut_at - 1 have them on the left
                    lo, hi = (np.zeros(len(left), np.int64), np.minimum(more, cut_at - 1)) if side == 0 else (cut_at, more)
                    ok = np.flatnonzero(lo <= hi)
                    if not len(ok):
                        continue
                    f, t = (place - half, place + gram) if side == 0 else (place, place + gram + half)
                    rec = np.zeros(len(ok), WINDOW)
                    rec["key"] = mix(slice_hash(sums, f[ok], t[ok]) + U64(side + 1))
                    rec["doc"], rec["start"] = ids[ok], (start + lo)[ok]
                    rec["left"], rec["more"] = (left - lo)[ok], (hi - lo)[ok]
                    begin = (base + start + lo)[ok]
                    rows.append((rec, begin, (hi - lo)[ok] + length))
                if not rows:
                    continue
                rec, begin, size = (np.concatenate(x) for x in zip(*rows, strict=True))
                into = rec["key"] % U64(splitters)
                order = np.argsort(into, kind="stable")
                rec, begin, size, into = rec[order], begin[order], size[order], into[order]
                edge = np.flatnonzero(np.append(True, into[1:] != into[:-1]))
                heads, bodies = [], []
                for x, y in zip(edge, np.append(edge[1:], len(into)), strict=True):
                    heads.append(rec[x:y].tobytes())
                    bodies.append(text[np.repeat(begin[x:y] - np.concatenate(([0], np.cumsum(size[x:y])[:-1])), size[x:y]) + np.arange(size[x:y].sum())].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(into[edge].astype(np.int32)), pa.array(heads, pa.binary()), pa.array(bodies, pa.binary())], names=["range", "records", "bytes"])

    return run


def _compared(length: int):
    """Spans of windows that occur earlier, among windows under one key."""
    steps = [0, length - 8, *range(8, length - 8, 8)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _ranges(batches):
            yield from compared(np.concatenate([np.frombuffer(x.as_buffer(), WINDOW) for x, _ in rows]), [np.frombuffer(x.as_buffer(), np.uint8) for _, x in rows])

    def compared(rec: np.ndarray, bodies: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        text = np.concatenate([*bodies, np.zeros(8, np.uint8)])
        size = rec["more"].astype(np.int64) + length
        at = np.cumsum(size) - size
        order = np.argsort(rec["key"], kind="stable")
        key = rec["key"][order]
        new = np.append(True, key[1:] != key[:-1])
        group = np.cumsum(new) - 1
        order = order[np.bincount(group)[group] > 1]
        if not len(order):
            return
        key = rec["key"][order]
        edge = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        total = np.append(0, np.cumsum(rec["more"][order].astype(np.int64) + 1))
        words = np.lib.stride_tricks.as_strided(text, (len(text) - 7, 8), (1, 1))
        first = 0
        while first < len(edge):
            after = max(first + 1, int(np.searchsorted(total[edge], total[edge[first]] + AT_ONCE)))
            own = order[edge[first] : edge[after] if after < len(edge) else len(order)]
            yield _spans_out(_later(rec[own], at[own], words, steps, length))
            first = after

    return run


def _later(rec: np.ndarray, at: np.ndarray, words: np.ndarray, steps: list[int], length: int) -> np.ndarray:
    count = rec["more"].astype(np.int64) + 1
    owner = np.repeat(np.arange(len(rec)), count)
    j = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    begin, left = at[owner] + j, rec["left"][owner].astype(np.int64) - j
    key = np.unique(rec["key"], return_inverse=True)[1]
    group = multikey_groups(key[owner] * (length + 1) + left, lambda s, rows: np.ascontiguousarray(words[begin[rows] + steps[s]]).view(">u8").ravel().astype(U64), len(steps))
    some = np.flatnonzero(group >= 0)
    doc, start = rec["doc"][owner], rec["start"][owner].astype(np.int64) + j
    some = some[np.lexsort((start[some], doc[some], group[some]))]
    new = np.append(True, group[some][1:] != group[some][:-1]) if len(some) else np.zeros(0, bool)
    lead = some[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(some) else some
    later = some[(doc[some] != doc[lead]) | (start[some] != start[lead])]
    out = np.zeros(len(later), SPAN)
    out["doc"], out["start"], out["end"] = doc[later], start[later], start[later] + length
    return merged(out)


def _cut_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, spans = batch.column(1), batch.column(2)
        kept, size, removed, runs = [], [], [], []
        for k in range(len(texts)):
            raw, out, at, n, gone = texts[k].as_buffer().to_pybytes() if texts[k].is_valid else b"", [], 0, 0, 0
            own = spans[k]
            if own.is_valid:
                for start, end in sorted(zip(own.values.field(0).to_pylist(), own.values.field(1).to_pylist(), strict=True)):
                    end = min(end, len(raw))
                    if end <= at and n or end <= start:
                        continue
                    if start > at or not n:
                        out.append(raw[at:start])
                        n += 1
                    gone += end - max(start, at)
                    at = end
            out.append(raw[at:])
            kept.append(b"".join(out))
            size.append(len(raw))
            removed.append(gone)
            runs.append(n)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (size, removed, runs)), pa.array([hashlib.sha256(x).hexdigest() for x in kept]), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def repeated_spans(docs: DataFrame, length: int = 100) -> DataFrame:
    """(doc_id, start, end): spans of bytes whose every byte is in a string of `length` bytes that starts earlier too; they may overlap."""
    if length < 8:
        raise ValueError("strings have to be of 8 bytes or more")
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where("doc_id is not null")
    parts = partitions(spark)
    n, size = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    ranges = max(RANGES * parts, -(-size // RANGE_BYTES))
    sampled = max(SAMPLED, ranges)  # documents; a few suffixes of each, so that every range has some
    some = docs.sample(min(1.0, sampled / max(n, 1)), 17).transform(arrow, _sample(length), "gram long")
    grams = np.sort(np.array([r[0] for r in some.collect()], np.int64).view(U64))
    splitters = np.unique(grams[np.arange(1, ranges) * len(grams) // ranges]) if len(grams) else np.zeros(0, U64)
    found = docs.transform(arrow, _suffixes(length, splitters), "range int, kind int, records binary").repartition(parts, "range").sortWithinPartitions("range")
    marks = stored(found.transform(arrow, _sorted(length), "kind int, doc_id long, start int, left int, more int"), "suffixes")
    open_ = marks.where("kind = 0").groupBy("doc_id").agg(F.collect_list(F.struct("start", "left", "more")).alias("regions"))
    windows = docs.join(open_, "doc_id").select("doc_id", "text", "regions").transform(arrow, _windows(length, ranges), "range int, records binary, bytes binary")
    later = windows.repartition(parts, "range").sortWithinPartitions("range").transform(arrow, _compared(length), "kind int, doc_id long, start int, left int, more int")
    return marks.where("kind = 1").union(stored(later, "windows")).select("doc_id", "start", F.col("left").alias("end"))


def without_repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) for each row of docs (doc_id, text; other columns are not looked at).

    Texts are UTF-8 bytes; null counts as empty; texts shorter than `length` lose nothing. Removed is each byte in a string of `length`
    bytes that also starts earlier: in a smaller doc_id, or earlier in the same text. n_spans counts maximal removed runs; kept holds what is left.
    Rows of one doc_id are taken for one document, met twice: that is no repeat, and each row gives a row. A row without doc_id has no place in
    the order: it loses nothing and takes nothing from others. An empty table gives an empty result.
    """
    spans = repeated_spans(docs, length).groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    return docs.select("doc_id", "text").join(spans, "doc_id", "left").select("doc_id", "text", "spans").transform(arrow, _cut_texts, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
