"""Language of texts, word by word, with a linear-chain conditional random field.

Each word has features: its affixes, its byte n-grams with the word's edges, and itself (the lexicon), all hashed into one table of
weights per language. Transitions between the languages of neighbouring words are learned with them, from sequences that join pieces of
different documents, as code-switched text does. Forward-backward gives each word's distribution; a text's language is the one with
the largest sum over its words, its score that sum's share.

The model is fitted on the driver from a bounded sample of rows: of each language the PER_LANG documents with the smallest hashes among those of
LONGEST bytes or less, whole, in pieces of WORDS words. The sample follows doc_id and text, not the layout of files. The model's size is the number of
languages times 2**BITS weights. Prediction reads every whole text, once, without a shuffle; long texts go through in parts, with messages carried on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import arrow, prefix_hash, slice_hash, small_batches

BITS = 17
PER_LANG, LONGEST, WORDS, EPOCHS, RATE, DECAY = 250, 1 << 16, 24, 3, 0.3, 1e-5
#: Words that forward-backward takes at once.
AT_ONCE = 1 << 19
#: Characters of text whose features are made at once; a longer text comes in parts that end at white space, or inside a word that is longer still.
FEATURED = 1 << 19
#: A text of more words is a sequence of its own, whose messages are carried from block to block.
BLOCKED = 1 << 13
UNKNOWN = "und"

_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[128:] = True


def words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes with a blank for all but letters; starts and ends of words; the first word of each text (one more at the end)."""
    raw = [(t or "").lower().encode("utf-8", "replace") for t in texts]
    data = np.frombuffer(b"    " + b"    ".join(raw) + b"    ", np.uint8)
    data = np.where(_LETTER[data], data, np.uint8(32))
    letter = data != 32
    start = np.flatnonzero(letter[1:] & ~letter[:-1]) + 1
    end = np.flatnonzero(letter[:-1] & ~letter[1:]) + 1
    at = np.cumsum([4, *(len(r) + 4 for r in raw)])
    return data, start, end, np.searchsorted(start, at)


def features(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the weight table: of each n-gram, with the first n-gram of each word, and six of each word itself. Row 0 has no weight."""
    shift, one = np.uint32(32 - BITS), np.uint32(1)
    b = data.astype(np.uint32) + one
    two = b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA77)
    three = two + b[2:] * np.uint32(0xC2B2AE3D) + np.uint32(0x27D4EB2F)

    def slot(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        x = (x ^ (x >> np.uint32(12))) * np.uint32(0x297A2D39)
        return (x >> shift) | one

    grams = np.stack([slot(two), slot(three)], 1).astype(np.int32)
    outside = np.ones(len(grams), bool)  # a word's n-grams begin at the blank before it
    letter = data != 32
    outside[: len(grams)] = ~(letter[: len(grams)] | letter[1 : len(grams) + 1])
    grams[outside] = 0
    sums = prefix_hash(data)
    own = []
    for kind, (s, e) in enumerate(((start, end), (start, np.minimum(start + 3, end)), (start, np.minimum(start + 5, end)), (np.maximum(end - 2, start), end), (np.maximum(end - 3, start), end), (np.maximum(end - 5, start), end))):
        h = slice_hash(sums, s, e) + np.uint64(kind * 0x9E3779B9)
        own.append((((h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - BITS)).astype(np.int32)) | 1)
    return grams, start - 1, np.stack(own, 1)


def emissions(weights: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Scores of each word for each language."""
    if not len(start):
        return np.zeros((0, weights.shape[1]), np.float32)
    grams, first, own = features(data, start, end)
    each = weights[grams[:, 0]]
    each += weights[grams[:, 1]]
    out = np.add.reduceat(each, first, axis=0)
    for k in range(own.shape[1]):
        out += weights[own[:, k]]
    return out


def by_time(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequences side by side, the longest first: where each word goes, where each time step begins, and the order of sequences."""
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    longest = int(size.max()) if len(size) else 0
    step = np.concatenate(([0], np.cumsum(np.searchsorted(-size[order], -np.arange(longest), "left"))))
    rank = np.empty(len(size), np.int64)
    rank[order] = np.arange(len(size))
    owner = np.repeat(np.arange(len(size)), size)
    return step[np.arange(first[-1] - first[0]) - (first[:-1] - first[0])[owner]] + rank[owner], step, order


def forward_backward(scores: np.ndarray, step: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distributions of all words (by time), and the expected number of each move between languages."""
    e = np.exp(scores - scores.max(1, keepdims=True))
    a, b, t = np.empty_like(e), np.ones_like(e), np.exp(moves).astype(e.dtype)
    back, pairs = np.ascontiguousarray(t.T), np.zeros_like(t, dtype=np.float64)
    n = len(step) - 1
    for k in range(n):
        now = e[step[k] : step[k + 1]]
        if k:
            now = now * (a[step[k - 1] : step[k - 1] + len(now)] @ t)
        a[step[k] : step[k + 1]] = now / now.sum(1, keepdims=True)
    for k in range(n - 2, -1, -1):
        m = step[k + 2] - step[k + 1]
        ahead = e[step[k + 1] : step[k + 2]] * b[step[k + 1] : step[k + 2]]
        now = ahead @ back
        total = now.sum(1, keepdims=True)
        b[step[k] : step[k] + m] = now / total
    p = a * b
    p /= p.sum(1, keepdims=True)
    if n > 1:
        for k in range(n - 1):
            m = step[k + 2] - step[k + 1]
            ahead = e[step[k + 1] : step[k + 2]] * b[step[k + 1] : step[k + 2]]
            own = a[step[k] : step[k] + m]
            z = ((own @ t) * ahead).sum(1, keepdims=True)
            pairs += t * (own.T @ (ahead / z))
    return p, pairs


def _posterior(scores: np.ndarray, step: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """The distributions alone."""
    e = np.exp(scores - scores.max(1, keepdims=True))
    a, t = np.empty_like(e), np.exp(moves).astype(e.dtype)
    back = np.ascontiguousarray(t.T)
    edges = step.tolist()
    n = len(edges) - 1
    last = None
    for k in range(n):
        lo, hi = edges[k], edges[k + 1]
        now = e[lo:hi]
        if k:
            now = now * (last[: hi - lo] @ t)
        last = now / now.sum(1, keepdims=True)
        a[lo:hi] = last
    b = None
    for k in range(n - 1, -1, -1):
        lo, hi = edges[k], edges[k + 1]
        if b is not None:
            m = len(b)
            b = (e[edges[k + 1] : edges[k + 1] + m] * b) @ back
            b /= b.sum(1, keepdims=True)
            a[lo : lo + m] *= b
        if b is None or len(b) < hi - lo:
            b = np.concatenate([b if b is not None else np.ones((0, e.shape[1]), e.dtype), np.ones((hi - lo - (0 if b is None else len(b)), e.shape[1]), e.dtype)])
    a /= a.sum(1, keepdims=True)
    return a


def posterior_of_long(scores: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """The distributions of one long sequence: blocks of equal length side by side, each first as the matrix that carries messages over it."""
    e = np.exp(scores - scores.max(1, keepdims=True)).astype(np.float64)
    n, langs = e.shape
    t = np.exp(moves)
    size = max(1, int(n**0.5))
    blocks = n // size
    main, tail = e[: blocks * size].reshape(blocks, size, langs).transpose(1, 0, 2), e[blocks * size :]
    carry = np.broadcast_to(np.eye(langs), (blocks, langs, langs)).copy()
    for s in range(size):
        ahead = carry @ t
        if s == 0:
            ahead[0] = carry[0]  # nothing precedes the first word
        carry = ahead * main[s][:, None, :]
        carry /= carry.sum((1, 2), keepdims=True)
    into, ones = np.empty((blocks, langs)), np.ones(langs)
    message = ones
    for k in range(blocks):
        into[k] = message
        message = message @ carry[k]
        message = message / message.sum()
    out, behind = np.empty((n, langs)), []
    for now in tail:
        message = (message @ t) * now
        message = message / message.sum()
        behind.append(message)
    back = ones
    for k in range(len(tail) - 1, -1, -1):
        out[blocks * size + k] = behind[k] * back
        back = t @ (tail[k] * back)
        back = back / back.sum()
    beyond = np.empty((blocks, langs))
    for k in range(blocks - 1, -1, -1):
        beyond[k] = back
        back = carry[k] @ back
        back = back / back.sum()
    held = np.empty_like(main)
    for s in range(size):
        ahead = into @ t
        if s == 0:
            ahead[0] = into[0]
        into = ahead * main[s]
        into /= into.sum(1, keepdims=True)
        held[s] = into
    for s in range(size - 1, -1, -1):
        held[s] *= beyond
        beyond = (main[s] * beyond) @ t.T
        beyond /= beyond.sum(1, keepdims=True)
    out[: blocks * size] = held.transpose(1, 0, 2).reshape(-1, langs)
    return out / out.sum(1, keepdims=True)


def parts_of(text: str) -> Iterator[str]:
    """A text in parts of FEATURED characters at most, cut behind white space where there is any."""
    at = 0
    while len(text) - at > FEATURED:
        end = max(text.rfind(" ", at, at + FEATURED), text.rfind("\n", at, at + FEATURED)) + 1
        end = end if end > at else at + FEATURED
        yield text[at:end]
        at = end
    yield text[at:] if at else text


class Model:
    """Languages, weights per feature and language, and scores of the moves between languages."""

    def __init__(self, langs: list[str], weights: np.ndarray, moves: np.ndarray):
        self.langs, self.weights, self.moves = langs, weights, moves

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if not self.langs:
            return names, scores
        parts = [(k, part) for k, t in enumerate(texts) for part in parts_of(t or "")]
        size = np.cumsum([0, *(len(part) for _, part in parts)])
        pending: list[np.ndarray] = []
        a = done = held = 0
        count = np.zeros(len(texts), np.int64)
        while a < len(parts):
            b = max(a + 1, int(np.searchsorted(size, size[a] + FEATURED, "right")) - 1)
            data, start, end, first = words([part for _, part in parts[a:b]])
            pending.append(emissions(self.weights, data, start, end))
            np.add.at(count, [k for k, _ in parts[a:b]], np.diff(first))
            held += len(start)
            a = b
            if a == len(parts) or held >= AT_ONCE and parts[a][0] != parts[a - 1][0]:
                to = parts[a][0] if a < len(parts) else len(texts)
                self._finish(np.concatenate(pending), count[done:to], texts, done, names, scores)
                pending, held, done = [], 0, to
        return names, scores

    def _finish(self, scores: np.ndarray, count: np.ndarray, texts: list, base: int, names: list, out: np.ndarray) -> None:
        first = np.concatenate(([0], np.cumsum(count)))
        total = np.zeros((len(count), len(self.langs)))
        long_ = count > BLOCKED
        for k in np.flatnonzero(long_):
            total[k] = posterior_of_long(scores[first[k] : first[k + 1]], self.moves).sum(0)
        if long_.any():
            scores = scores[np.repeat(~long_, count)]
            first = np.concatenate(([0], np.cumsum(np.where(long_, 0, count))))
        if first[-1]:
            place, step, _ = by_time(first)
            laid = np.empty_like(scores)
            laid[place] = scores
            some = np.flatnonzero(np.diff(first))
            total[some] = np.add.reduceat(_posterior(laid, step, self.moves)[place], first[some], axis=0, dtype=np.float64)
        some = np.flatnonzero(count)
        best = total.argmax(1)
        for k, lang, share in zip(some.tolist(), best[some].tolist(), (total[some, best[some]] / count[some]).tolist(), strict=True):
            text = texts[base + k]
            if text.isascii() or any(map(str.isalpha, text)):
                names[base + k], out[base + k] = self.langs[lang], min(1.0, share)


def fit(samples: list[tuple[str, str]], seed: int = 7) -> Model:
    """A model of (text, lang) samples, by stochastic gradient ascent of the conditional likelihood (AdaGrad)."""
    langs = sorted({lang for _, lang in samples})
    n, rng = len(langs), np.random.default_rng(seed)
    weights = np.zeros((1 << BITS, n), np.float32)
    moves = np.zeros((n, n))
    if not langs:
        return Model(langs, weights, moves)
    pieces: list[tuple[str, int]] = []
    for text, lang in samples:
        own = text.split()
        for at in range(0, len(own), WORDS):
            pieces.append((" ".join(own[at : at + WORDS]), langs.index(lang)))
    square, square_moves = np.full_like(weights, 1e-4), np.full_like(moves, 1e-2)
    for _ in range(EPOCHS):
        order = rng.permutation(len(pieces))
        for lo in range(0, len(order), 1024):
            part = order[lo : lo + 1024]
            texts, labels = [pieces[k][0] for k in part], np.array([pieces[k][1] for k in part])
            data, start, end, first = words(texts)
            if not len(start):
                continue
            word_label = np.repeat(labels, np.diff(first))
            joined = np.append(first[0:-1:2], first[-1])  # two pieces make a sequence
            place, step, _ = by_time(joined)
            scores = np.empty((len(start), n), np.float32)
            scores[place] = emissions(weights, data, start, end)
            p, pairs = forward_backward(scores, step, moves)
            slope = -p[place]
            slope[np.arange(len(start)), word_label] += 1
            same = np.ones(len(start), bool)
            same[joined[:-1][joined[:-1] < len(start)]] = False
            at = np.flatnonzero(same)
            seen = np.bincount(word_label[at - 1] * n + word_label[at], minlength=n * n).reshape(n, n)
            grams, begin, own = features(data, start, end)
            spread = np.zeros(len(grams), np.int64)
            spread[begin] = 1
            word = np.maximum(np.cumsum(spread) - 1, 0)
            rows = np.concatenate([grams[:, 0], grams[:, 1], *own.T])
            words_ = np.concatenate([word, word, *[np.arange(len(start))] * own.shape[1]])
            used, rows = np.unique(rows, return_inverse=True)
            g = np.stack([np.bincount(rows, slope[words_, k], len(used)) for k in range(n)], 1) / len(part)
            g[used == 0] = 0
            g -= DECAY * weights[used]
            square[used] += g * g
            weights[used] += RATE * g / np.sqrt(square[used])
            g = (seen - pairs) / len(part)
            square_moves += g * g
            moves += RATE * g / np.sqrt(square_moves)
    return Model(langs, weights, moves)


def learn(docs: DataFrame) -> Model:
    """A model of the documents' text and non-null lang; all of docs (doc_id, text, lang) may be sampled. An empty sample gives a model without languages."""
    known = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (F.octet_length("text") <= LONGEST)).select("text", "lang", F.xxhash64("doc_id", "text").alias("key"))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return fit([])
    # the rows with the smallest hashes, and some more than are wanted: about 2 * PER_LANG for each language
    least = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, int(-(1 << 63) + min(1.0, (2 * PER_LANG + 20) / n) * ((1 << 64) - 2049)))])
    rows = known.where(F.col("key") <= least[F.col("lang")]).collect()
    taken: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r["key"], r["text"])):
        taken.setdefault(r["lang"], []).append((r["text"], r["lang"]))
    return fit([x for lang in sorted(taken) for x in taken[lang][:PER_LANG]])


def predicted(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """The columns keep, lang_pred and score for each row of docs, from its text alone."""
    small_batches(docs.sparkSession)
    given = docs.sparkSession.sparkContext.broadcast(model)
    columns = docs.select(*keep, F.col("text").alias("__text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in columns.schema.fields[:-1]), "lang_pred string, score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = given.value.predict(batch.column(len(keep)).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(names, pa.string()), pa.array(scores)], names=[*keep, "lang_pred", "score"])

    return columns.transform(arrow, run, schema)


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def identified(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row of docs (doc_id, text, lang; other columns are not looked at).

    Learned from are rows with a non-null doc_id, text and lang that are not held out. lang_pred is a learned lang, or und (score 0)
    where the text is null or has no letter or nothing was learned. Equal texts have equal results, whatever their doc_id or lang. Repeated
    rows each give a row; an empty table gives an empty result.
    """
    model = learn(docs.where(F.col("doc_id").isNotNull() & ~held_out()))
    return predicted(docs.withColumn("held_out", held_out()), model, "doc_id", "held_out")
