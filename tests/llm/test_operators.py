"""Each operator against brute force on small random corpora, and on a table of hard cases."""

import collections
import gzip
import hashlib
import io
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewell.llm import common, fingerprints, langid, lines, mixing, ngram_join, packing, repeats, resampling, vectors, warc
from tidewell.llm.entry import tokenizer_file

#: Columns that operators use inside, as extra columns of the input.
CLASH = ["rank", "salt", "key", "rep", "n", "hi", "lo", "start", "end", "range", "epoch", "block", "spans", "component", "score", "lang_pred", "length", "size"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASH)


def table(spark, rows):
    """(doc_id, text[, lang, source]) rows as documents with the clashing columns."""
    full = [(r[0], r[1], *(list(r[2:]) + [None] * 2)[:2], len(r[1] or ""), *["x"] * len(CLASH)) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def corpus(seed, n=120, words=60):
    """Texts with exact and near copies, repeated lines and passages."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgé") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(70))
    common_line = " ".join(rng.choice(vocabulary) for _ in range(9))
    out = []
    for k in range(n):
        kind = rng.random()
        if out and kind < 0.12:
            text = rng.choice(out)[1]
        elif out and kind < 0.35:
            own = (rng.choice(out)[1] or "a b").split(" ")
            for _ in range(rng.randint(1, 3)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            text = " ".join(own)
        else:
            text = "\n".join(" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, words // 3))).capitalize() for _ in range(rng.randint(1, 6)))
            if kind > 0.8:
                text = common_line + "\n" + text
            if kind > 0.9:
                text += "\n" + passage + "\n" + rng.choice(vocabulary)
        out.append((k, text, rng.choice(["xx", "yy"]), rng.choice(["a", "a", "a", "b", "c"])))
    return out


HARD = [(1, None), (2, ""), (3, " \n\t "), (4, "word"), (5, "two words"), (6, "é" * 250), (7, "a" * 40_000), (8, "lorem ipsum dolor sit amet " * 8000), (9, "!!! ... 123"), (9, "!!! ... 123"), (None, "lonely text without an id, long enough to be cut " * 4), (10, "lonely text without an id, long enough to be cut " * 4), (11, "\x00 odd   signs <|endoftext|> 'tis don't"), (12, "word")]


@pytest.fixture(scope="module")
def hard(spark):
    return table(spark, HARD).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return table(spark, [])


def rows_of(df):
    return [r.asDict() for r in df.collect()]


@pytest.fixture(scope="module")
def long_texts():
    """Texts of more than two chunks, two of which share most of their words, and a short one with a passage of them."""
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdefgé") for _ in range(rng.randint(2, 9))) for _ in range(5000)]
    lines_ = [" ".join(rng.choice(vocabulary) for _ in range(12)) for _ in range(16_000)]
    one = "\n".join(lines_[:4000] + lines_[:40] + lines_[4000:])
    two = "\n".join(lines_[:2000] + ["Something ELSE <|endoftext|> don't"] + lines_[2001:])
    assert len(one.encode()) > 2 * common.CHUNK
    return [(1, one, "aa"), (2, two, "bb"), (3, "\n".join(lines_[100:130]), "aa"), (4, "x" * (2 * common.CHUNK + 9) + " y", "aa")]


def test_long_texts_lines_and_repeats(spark, long_texts):
    df = table(spark, long_texts)
    want = lines_brute([(d, t) for d, t, *_ in long_texts])
    assert {r["doc_id"]: r["n_removed"] for r in rows_of(lines.without_repeated_lines(df, "doc_id"))} == {d: len(x) for d, x in want.items()}
    want = repeats_brute([(d, t) for d, t, *_ in long_texts], 100)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows_of(repeats.without_repeats(df))}
    assert got == want


def test_long_texts_words(spark, long_texts, monkeypatch):
    """Kernels give the same for texts in parts as for texts in one piece."""
    texts = pa.array([t for _, t, _ in long_texts])
    data, offsets = common.text_of(texts)
    parts = [common.hashed_words(data, offsets), fingerprints.simhash(texts), ngram_join.shingle_sets(data[: offsets[1]], offsets[:2], 3), resampling.term_slots(data, offsets)]
    assert np.diff(parts[0][2]).tolist() == [len(t.split()) for _, t, _ in long_texts]
    monkeypatch.setattr(common, "CHUNK", 1 << 22)
    whole = [common.hashed_words(data, offsets), fingerprints.simhash(texts), ngram_join.shingle_sets(data[: offsets[1]], offsets[:2], 3), resampling.term_slots(data, offsets)]
    same = np.arange(len(parts[0][0])) != len(parts[0][0]) - 2  # the word of more than a chunk has another hash, the same wherever it is
    assert np.array_equal(parts[0][0][same], whole[0][0][same]) and np.array_equal(parts[1][:3], whole[1][:3])
    assert all(np.array_equal(x, y) for x, y in zip(parts[2], whole[2], strict=True)) and np.array_equal(parts[3][1], whole[3][1])
    df = table(spark, long_texts)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows_of(ngram_join.jaccard_components(df, 3, 90, 100))}
    sets = {d: {tuple(w[k : k + 3]) for k in range(len(w) - 2)} or {tuple(w)} for d, t, _ in long_texts for w in ["".join(c.lower() if c.isascii() else c for c in t).split()]}
    assert got == {d: (len(sets[d]), {2: 1}.get(d, d)) for d in sets} and len(sets[1] & sets[2]) >= 0.9 * len(sets[1] | sets[2])


def test_long_texts_language_and_packing(spark, long_texts, monkeypatch):
    rng = np.random.default_rng(3)
    for n, langs in ((1, 3), (2, 2), (50, 3), (997, 4)):
        scores, moves = rng.normal(size=(n, langs)).astype(np.float32) * 3, rng.normal(size=(langs, langs))
        _, step, _ = langid.by_time(np.array([0, n]))
        assert np.allclose(langid.posterior_of_long(scores, moves), langid._posterior(scores, step, moves), atol=1e-3)
    model = langid.fit([(t, lang) for _, t, lang in language_docs()])
    texts = ["kalo mitu", *(t for _, t, _ in long_texts), None, "shrent " * 9]
    names, scores = model.predict(texts)
    monkeypatch.setattr(langid, "FEATURED", 1 << 23)
    monkeypatch.setattr(langid, "BLOCKED", 1 << 40)
    whole = model.predict(texts)
    rest = [0, 1, 2, 3, 5, 6]  # the word longer than a part counts as several
    assert [names[k] for k in rest] == [whole[0][k] for k in rest] and np.allclose(scores[rest], whole[1][rest], atol=1e-3) and names[-2:] == ["und", "bb"]
    ids = packing.Ids(tokenizer_file())
    some = [t for _, t, _ in long_texts]
    for got, text in zip(ids.of(pa.array(some)), some, strict=True):
        assert np.array_equal(got, ids.raw(text))
    assert ids.by_words


# ------------------------------------------------------------------ common


def test_components_against_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(k, k + 1) for k in range(300, 340)] + [(5, 5), (None, 4)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            low, high = sorted((find(a), find(b)))
            parent[high] = low
    got = {r["id"]: r["component"] for r in rows_of(common.components(spark.createDataFrame(edges, "a long, b long")))}
    assert got == {x: find(x) for x in parent}


# ------------------------------------------------------------------ 1 line dedup


def lines_brute(docs):
    sequences, first, out = {}, {}, {}
    for d, text in docs:
        units = []
        for k, line in enumerate((text or "").split("\n")):
            n = len(line.encode().split())
            units += [(line, j, k) for j in range(min(4, -(-n // 16)))]
        sequences[d] = units
    for d in sorted(sequences):
        units, gone = sequences[d], set()
        for at in range(len(units) - 3):
            key = tuple(u[:2] for u in units[at : at + 4])
            if first.setdefault(key, (d, at)) != (d, at):
                gone |= set(range(units[at][2], units[at + 3][2] + 1))
        out[d] = gone
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_lines(spark, seed):
    docs = corpus(seed)
    want = lines_brute([(d, t) for d, t, *_ in docs])
    assert any(want.values())
    for r in rows_of(lines.without_repeated_lines(table(spark, docs), "doc_id", "source")):
        text = docs[r["doc_id"]][1]
        assert r["text"] == "\n".join(x for k, x in enumerate(text.split("\n")) if k not in want[r["doc_id"]])
        assert (r["n_lines"], r["n_removed"]) == (text.count("\n") + 1, len(want[r["doc_id"]]))


def test_lines_rounds(spark):
    """Ranks of all rounds keep the order of suffixes, an interval's suffixes have its rank, and the last round has none."""
    docs = corpus(3, 40)
    units = {}
    for d, text, *_ in docs:
        own = []
        for line in text.split("\n"):
            n = len(line.encode().split())
            raw = hashlib.md5(line.encode()).digest()
            hi, lo = int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)
            own += [(hi, lo ^ j) for j in range(min(4, -(-n // 16)))]
        units[d] = own
    rounds = lines.intervals(table(spark, docs))
    assert len(rounds) > 1 and rounds[-1].isEmpty()
    for k, found in enumerate(rounds):
        span = 4 << k
        groups = collections.defaultdict(list)
        for d, own in units.items():
            for at in range(len(own) - span + 1):
                groups[tuple(own[at : at + span])].append((d, at))
        tied = {x: sorted(v) for x, v in groups.items() if len(v) > 1}
        got = rows_of(found)
        assert sorted((r["doc_id"], r["at"]) for r in got) == sorted(x for v in tied.values() for x in v)
        key = {(d, at): x for x, v in tied.items() for d, at in v}
        ranks = {}
        for r in got:
            assert tuple(r["first"]) == tied[key[r["doc_id"], r["at"]]][0]
            assert ranks.setdefault(key[r["doc_id"], r["at"]], r["rank"]) == r["rank"]
        ordered = [ranks[x] for x in sorted(ranks)]
        assert ordered == sorted(ordered) and len(set(ordered)) == len(ordered)


def test_lines_hard(spark, hard, empty):
    got = rows_of(lines.without_repeated_lines(hard, "doc_id", "key"))
    assert len(got) == len(HARD) and all(r["n_removed"] == 0 for r in got if r["doc_id"] not in (10,))
    assert next(r for r in got if r["doc_id"] == 1)["text"] is None
    assert lines.without_repeated_lines(empty, "doc_id").count() == 0
    long_line = "w " * 60
    pair = rows_of(lines.without_repeated_lines(table(spark, [(2, long_line), (1, long_line), (2, long_line)]), "doc_id"))
    assert sorted((r["doc_id"], r["n_removed"]) for r in pair) == [(1, 0), (2, 1), (2, 1)]
    with pytest.raises(ValueError):
        lines.repeated_runs(empty, min_units=3)


# ------------------------------------------------------------------ 2 WARC


def test_warc_round_trip(spark, tmp_path):
    big = "<p>" + "x" * 300_000
    pages = [(1, "http://a/\n<b>", big), (2, None, big), (3, "u", "é" * 60), (4, "u", "é" * 60), (5, "u", "short"), (6, "u", "short"), (7, "u", None), (7, "u", None), (None, "u", "é" * 60), (3, "u", "é" * 60)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("sha256", F.lit("clash")).withColumn("first", F.lit(0))
    got = collections.Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows_of(warc.round_trip(df)))
    low = {big: 1, "é" * 60: 3}
    want = collections.Counter()
    for page, _, html in pages:
        raw = (html or "").encode()
        again = html in low and page != low[html]
        want[(page, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", low[html] if again else None)] += 1
    assert got == want
    assert warc.round_trip(df.limit(0)).count() == 0
    archives = warc.write_archives(df, f"file://{tmp_path}/w").collect()
    assert sum(r["records"] for r in archives) == len(pages)
    raw = b"".join(open(r["path"].removeprefix("file://"), "rb").read() for r in archives)
    assert gzip.decompress(raw).count(b"WARC/1.1\r\n") == len(pages) + len(archives)


def test_warc_reader_frames_and_checks():
    good = warc.page_member(1, "http://x", b"payload \r\n\r\n inside", hashlib.sha256(b"payload \r\n\r\n inside").hexdigest(), None)
    for size in (1, 7, 10_000):
        found = list(warc.records(io.BytesIO(good + good).read()[k : k + size] for k in range(0, 2 * len(good), size)))
        assert [r.payload for r in found] == [b"payload \r\n\r\n inside"] * 2
    raw = zlib.decompress(good, 31)
    for bad in (raw.replace(b"payload ", b"Payload "), raw.replace(b"Content-Length: 1", b"Content-Length: 2"), raw[:-2], b"junk" + raw, raw.replace(b"WARC-Payload-Digest: sha256:", b"WARC-Payload-Digest: sha256:0")):
        with pytest.raises(warc.WarcError):
            list(warc.records([gzip.compress(bad)]))
    for stream in ([good[:-5]], [b"not gzip at all"]):
        with pytest.raises(warc.WarcError):
            list(warc.records(stream))


# ------------------------------------------------------------------ 3 mixing


def test_mixing(spark):
    docs = [(k, "w " * (1 + k % 7), None, "big" if k < 300 else "mid" if k < 360 else "small" if k < 380 else None) for k in range(390)]
    df = table(spark, docs)
    uses = rows_of(mixing.schedule(df, entropy=0.97, repeats=3.0, block=200))
    tokens, spent = collections.Counter(), collections.Counter()
    for d, text, _, source in docs:
        tokens[source] += len(text.split())
    for r in uses:
        spent[r["source"]] += r["n_tokens"]
    p = {s: t / sum(tokens.values()) for s, t in tokens.items()}

    def spread(a):
        w = np.array([x**a for x in p.values()])
        w /= w.sum()
        return -(w * np.log(w)).sum()

    alpha = max([a / 1e4 for a in range(10001) if spread(a / 1e4) >= 0.97 * math.log(len(p))], default=0)
    limit = 1 - math.log(3.0) / math.log(max(p.values()) / min(p.values()))
    alpha = max(alpha, limit)
    for s, t in tokens.items():
        want = t * (max(p.values()) / p[s]) ** (1 - alpha)
        assert want - 1 <= spent[s] <= want + 8, s
        assert spent[s] <= 3 * t + 8
    times = collections.Counter(r["doc_id"] for r in uses)
    assert set(times) == {d for d, *_ in docs}
    for s in tokens:  # whole epochs, and a part of the next
        own = {times[d] for d, _, _, x in docs if x == s}
        assert max(own) - min(own) <= 1
    per_block = collections.Counter()
    for r in uses:
        per_block[r["block"]] += r["n_tokens"]
    assert max(per_block.values()) < 200 + 4 * 8 and set(per_block) == set(range(len(per_block)))
    again = mixing.mixed(df, entropy=0.97, repeats=3.0, block=200)
    assert again.columns == df.columns
    assert collections.Counter(r["doc_id"] for r in rows_of(again)) == times


def test_mixing_hard(spark, hard, empty):
    got = collections.Counter(r["doc_id"] for r in rows_of(mixing.schedule(hard)))
    assert set(got) == {d for d, *_ in HARD} and got[9] == 2
    assert mixing.mixed(hard).count() == len(HARD)
    assert mixing.schedule(empty).count() == 0 and mixing.mixed(empty).count() == 0
    assert {r["epoch"] for r in rows_of(mixing.schedule(table(spark, [(1, "a b", None, "s")])))} == {0}


# ------------------------------------------------------------------ 4 language id


def language_docs(n=400, seed=5):
    rng = random.Random(seed)
    parts = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["shr", "ent", "ing", "oll"], "cc": ["éu", "çà", "ñor", "ß"]}
    return [(k, " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(3, 60))), lang) for k in range(n) for lang in [rng.choice(sorted(parts))]]


def test_language_held_out(spark):
    docs = language_docs()
    df = table(spark, docs + [(1000, None, "aa"), (1001, "12 !!", "aa"), (1002, docs[0][1], "cc"), (None, "kalo mitu", "bb")])
    got = {r["doc_id"]: r for r in rows_of(langid.identified(df))}
    out = [d for d, *_ in docs if zlib.crc32(str(d).encode()) % 5 == 0]
    assert all(got[d]["held_out"] for d in out) and sum(r["held_out"] for r in got.values()) - len(out) <= 3
    assert sum(got[d]["lang_pred"] == docs[d][2] for d in out) / len(out) > 0.97
    assert (got[1000]["lang_pred"], got[1000]["score"], got[1001]["lang_pred"]) == ("und", 0.0, "und")
    assert (got[1002]["lang_pred"], got[1002]["score"]) == (got[0]["lang_pred"], got[0]["score"])
    assert got[None]["lang_pred"] == "aa" and all(0 <= r["score"] <= 1 for r in got.values())


def test_language_words_switch():
    docs = language_docs()
    model = langid.fit([(t, lang) for _, t, lang in docs])
    text = " ".join(docs[k][1] for k in (next(k for k, d in enumerate(docs) if d[2] == "aa"), next(k for k, d in enumerate(docs) if d[2] == "bb")))
    data, start, end, first = langid.words([text])
    place, step, _ = langid.by_time(first)
    scores = np.empty((len(start), 3), np.float32)
    scores[place] = langid.emissions(model.weights, data, start, end)
    best = langid._posterior(scores, step, model.moves)[place].argmax(1)
    assert list(dict.fromkeys(best.tolist())) == [0, 1]
    assert (np.diff(best) != 0).sum() == 1
    assert np.allclose(langid._posterior(scores, step, model.moves), langid.forward_backward(scores, step, model.moves)[0], atol=1e-4)


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(1)
    scores, moves, first = rng.normal(size=(9, 2)).astype(np.float32), rng.normal(size=(2, 2)), np.array([0, 4, 4, 9])
    place, step, _ = langid.by_time(first)
    laid = np.empty_like(scores)
    laid[place] = scores
    got = langid._posterior(laid, step, moves)[place]
    for a, b in ((0, 4), (4, 9)):
        total, n = np.zeros((b - a, 2)), b - a
        for code in range(2**n):
            y = [code >> k & 1 for k in range(n)]
            p = math.exp(sum(scores[a + k, y[k]] for k in range(n)) + sum(moves[y[k], y[k + 1]] for k in range(n - 1)))
            for k in range(n):
                total[k, y[k]] += p
        assert np.allclose(got[a:b], total / total.sum(1, keepdims=True), atol=1e-4)


def test_language_hard(hard, empty):
    got = rows_of(langid.identified(hard))  # nothing has a lang, so nothing is learned
    assert len(got) == len(HARD) and {r["lang_pred"] for r in got} == {"und"}
    assert langid.identified(empty).count() == 0


# ------------------------------------------------------------------ 5 packing


def test_plan_is_best_fit_decreasing():
    rng = random.Random(1)
    for _ in range(200):
        capacity = rng.choice([5, 10, 17, 64])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 60))]
        free = []
        for length in sorted(lengths, reverse=True):
            fits = [k for k, f in enumerate(free) if f >= length]
            if fits:
                free[min(fits, key=lambda k: (free[k], k))] -= length
            else:
                free.append(capacity - length)
        bins, counts = collections.defaultdict(list), collections.Counter()
        for length, _, n, first, each, offset in packing.plan(collections.Counter(lengths), capacity):
            counts[length] += n
            for k in range(n):
                bins[first + k // each].append((offset + k % each * length, length))
        assert counts == collections.Counter(lengths)
        for own in bins.values():
            own.sort()
            assert [o for o, _ in own] == list(np.cumsum([0] + [x for _, x in own[:-1]]))
        assert sorted(capacity - sum(x for _, x in own) for own in bins.values()) == sorted(free)


def test_packing_is_the_tokenizers(spark, hard, empty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_file())
    docs = corpus(4, n=40) + [(500 + k, t) for k, (_, t) in enumerate(HARD)] + [(900, "It's I'M we'LL 12,3½ ª × ÷ ß ÀÉÞ a1b22c!!??d ÿĀŁ ú <|x|>")]
    got = rows_of(packing.pack_documents(table(spark, docs), tokenizer_file(), 64))
    by = collections.defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    for d, text, *_ in docs:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        want = [(k, a, len(ids[a : a + 64]), zlib.crc32(np.array(ids[a : a + 64], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), 64))]
        assert [(r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in sorted(by[d], key=lambda r: r["piece"])] == want
    sequences = collections.defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in sequences.values():
        own.sort()
        assert [o for o, _ in own] == list(np.cumsum([0] + [x for _, x in own[:-1]])) and sum(x for _, x in own) <= 64
    assert packing.pack_documents(hard, tokenizer_file()).where("piece = 0").count() == len(HARD)
    assert packing.pack_documents(empty, tokenizer_file()).count() == 0


# ------------------------------------------------------------------ 6 repeats


def repeats_brute(docs, length):
    first, out = {}, {}
    for d, text in sorted(docs):
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for s in range(len(raw) - length + 1):
            if first.setdefault(raw[s : s + length], (d, s)) != (d, s):
                gone[s : s + length] = True
        out[d] = (len(raw), int(gone.sum()), int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum()), hashlib.sha256(bytes(np.frombuffer(raw, np.uint8)[~gone])).hexdigest())
    return out


@pytest.mark.parametrize(("seed", "length"), [(1, 100), (2, 40), (3, 21), (4, 9)])
def test_repeats(spark, seed, length):
    docs = [(d, t) for d, t, *_ in corpus(seed, n=80)] + [(200, "ab" * 300), (201, "x" + "ab" * 100), (202, "aé" * 90)]
    want = repeats_brute(docs, length)
    assert sum(w[1] for w in want.values()) > 0
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows_of(repeats.without_repeats(table(spark, docs), length))}
    assert got == want


def test_repeats_hard(spark, hard, empty):
    got = {r["doc_id"]: r for r in rows_of(repeats.without_repeats(hard))}
    want = repeats_brute([(d, t) for d, t in dict((x for x in HARD if x[0] is not None)).items()], 100)
    assert {d: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for d, r in got.items() if d is not None} == want
    assert got[None]["n_removed"] == 0
    assert repeats.without_repeats(empty).count() == 0


# ------------------------------------------------------------------ 7 similarity join


def join_brute(docs, n, num, den):
    sets = {}
    for d, text in docs:
        words = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
        sets[d] = {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} - {()}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {d: (len(s), find(d)) for d, s in sets.items()}


@pytest.mark.parametrize(("n", "num", "den"), [(3, 90, 100), (5, 80, 100), (1, 50, 100), (2, 2, 3)])
def test_join(spark, monkeypatch, n, num, den):
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    docs = [(d, t) for d, t, *_ in corpus(11, n=150)] + [(300 + k, " ".join(["same"] * 30 + [f"w{k % 5}"])) for k in range(10)]
    want = join_brute(docs, n, num, den)
    assert len({c for _, c in want.values()}) < len(docs)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows_of(ngram_join.jaccard_components(table(spark, docs), n, num, den))}
    assert got == want


def test_join_passages_connect_no_candidates(spark, monkeypatch):
    """A chain of unlike texts, each with a passage of the one before: they share fragments, but too few to link."""
    rng = np.random.default_rng(5)
    own = [" ".join(f"o{x}" for x in rng.integers(0, 1 << 40, 20)) for _ in range(200)]
    passage = [" ".join(f"p{x}" for x in rng.integers(0, 1 << 40, 70)) for _ in range(201)]
    docs = [(k, f"{passage[k]} {own[k]} {passage[k + 1]}") for k in range(200)] + [(200, f"{passage[7]} {own[7]} {passage[8]} more")]
    seen, real = [], ngram_join.components
    monkeypatch.setattr(ngram_join, "components", lambda edges: seen.append(edges.distinct().count()) or real(edges))
    got = {r["doc_id"]: r["component_id"] for r in rows_of(ngram_join.jaccard_components(table(spark, docs)))}
    assert got == {d: 7 if d == 200 else d for d, _ in docs}
    assert 1 <= seen[0] < 20


@pytest.mark.parametrize("crowd", [2, 3, 1 << 16])
def test_join_counts_keys_over_batches(monkeypatch, crowd):
    """Keys are counted and the most frequent of a list go, wherever batches end."""
    monkeypatch.setattr(ngram_join, "CROWD", crowd)
    rng = np.random.default_rng(6)
    rows = sorted((int(k), r, 8 << 20 | 2) for r in range(40) for k in rng.permutation(60)[:12] ** 2)
    many = {k: sum(x == k for x, *_ in rows) for k, *_ in rows}
    cut = lambda x, names, step: [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*x[i : i + step], strict=True)], names=names) for i in range(0, len(x), step)]
    for step in (1, 7, 1000):
        got = sorted(tuple(r.values()) for b in ngram_join._shared(iter(cut(rows, ["key", "rep", "list"], step))) for r in b.to_pylist())
        assert got == [(k, r, t, min(many[k], crowd)) for k, r, t in rows if many[k] > 1]
        got.sort(key=lambda x: (x[1], x[2], -x[3], x[0]))
        want = [x[:2] for n, x in enumerate(got) if sum(y[1] == x[1] for y in got[:n]) >= 2]
        assert [tuple(r.values()) for b in ngram_join._rarest(iter(cut([x[:3] for x in got], ["key", "rep", "list"], step))) for r in b.to_pylist()] == want


def test_join_hard(hard, empty):
    got = collections.defaultdict(set)
    for r in rows_of(ngram_join.jaccard_components(hard)):
        got[r["doc_id"]].add((r["n_shingles"], r["component_id"]))
    assert got[1] == got[1] and got[1] == {(0, 1)} and got[2] == {(0, 2)} and got[3] == {(0, 3)}
    assert got[12] == {(1, 4)} and got[None] == got[10] == {(next(iter(got[10]))[0], 10)}
    assert ngram_join.jaccard_components(empty).count() == 0


def test_join_with_a_repeated_id(spark):
    a, b = " ".join(f"a{k}" for k in range(60)), " ".join(f"b{k}" for k in range(60))
    rows = [(2, a), (5, a), (5, b), (7, b + " more"), (9, "other words here")]
    got = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in rows_of(ngram_join.jaccard_components(table(spark, rows)))}
    assert got[5, 56] == got[7, 57] == got[2, 56] == 2 and got[9, 1] == 9


# ------------------------------------------------------------------ 8 resampling


def mix_plain(x):
    x &= 2**64 - 1
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> shift)) * factor & 2**64 - 1
    return x ^ (x >> 31)


def term_slots_plain(text):
    """The slots of words and pairs, from the definition of the hashes."""
    def word(w):
        raw = w.lower().encode()
        return mix_plain(sum(mix_plain((c + 1) * 0x9E3779B97F4A7C15) * pow(common.BASE, k, 2**64) for k, c in enumerate(raw)) + len(raw))

    own = [word(w) for w in text.split()]
    pairs = [mix_plain(a * (mix_plain(21) | 1) + b * (mix_plain(22) | 1)) for a, b in zip(own, own[1:])]
    return [h >> 50 for h in own + pairs]


def test_resampling(spark, hard, empty):
    rng = random.Random(2)
    good, bad = [f"g{k}" for k in range(30)], [f"b{k}" for k in range(30)]
    docs = [(k, " ".join(rng.choice(good if k % 3 else bad) for _ in range(40))) for k in range(300)]
    df = table(spark, docs)
    target = spark.createDataFrame([(k,) for k in range(0, 300) if k % 3 and k % 2], "doc_id long")
    got = rows_of(resampling.resampled(df, target, share=0.5))
    assert sum(r["selected"] for r in got) == 150
    assert sum(r["selected"] for r in got if r["doc_id"] % 3 == 0) <= 3
    # models, weights, noise and choice once more, one word at a time
    slots = {k: term_slots_plain(t) for k, t in docs}
    every = collections.Counter(x for t in slots.values() for x in t)
    chosen = collections.Counter(x for k, t in slots.items() if k % 3 and k % 2 for x in t)
    size, wanted = resampling.SLOTS + sum(every.values()), resampling.SLOTS + sum(chosen.values())
    weight = {k: sum(math.log((1 + chosen[x]) / wanted) - math.log((1 + every[x]) / size) for x in t) for k, t in slots.items()}
    noise = {k: -math.log(-math.log(((mix_plain(k + mix_plain(1)) >> 11) + 0.5) / 2**53)) for k in weight}
    best = set(sorted(weight, key=lambda k: -(weight[k] + noise[k]))[:150])
    for r in got:
        assert abs(r["log_weight"] - weight[r["doc_id"]]) < 1e-6 and r["n_terms"] == 79
        assert r["selected"] == (r["doc_id"] in best)
    at_one_length = {r["doc_id"]: r["log_weight"] for r in rows_of(resampling.resampled(df, target, per_terms=64))}
    assert all(abs(at_one_length[k] - weight[k] / 79 * 64) < 1e-6 for k in weight)
    assert len(rows_of(resampling.resampled(hard, target))) == len(HARD)
    assert resampling.resampled(empty, target).count() == 0
    longs = [rng.randrange(-(1 << 63), 1 << 63) for _ in range(50)] + [5, 5, 5]
    frame = spark.createDataFrame([(x,) for x in longs], "x long")
    for k in (1, 2, 25, 53):
        assert resampling.kth_largest(frame, "x", k) == sorted(longs, reverse=True)[k - 1]
    x = np.array([-np.inf, -2.5, -0.0, 0.0, 1e-300, 3.0])
    assert (np.diff(resampling.ordered_bits(x)) >= 0).all()


# ------------------------------------------------------------------ 9 fingerprints


def test_fingerprints(spark, hard, empty):
    docs = [(d, t) for d, t, *_ in corpus(7, n=90)] + [(100, None), (200, "x")]
    got = {r["doc_id"]: r for r in rows_of(fingerprints.fingerprinted(table(spark, docs), every=10))}
    order = sorted(docs, key=lambda r: -r[0])
    for k, (d, text) in enumerate(order):
        changed = fingerprints.edited(text or "", order[(k + 1) % len(order)][1] or "")
        assert (got[d]["n_chars"], got[d]["edited_sha256"]) == (len(text or ""), hashlib.sha256(changed.encode()).hexdigest())
        assert got[d]["edited_fingerprint"] == bytes(fingerprints.simhash(pa.array([changed]))[0]).hex()
    bits = {d: np.unpackbits(np.frombuffer(bytes.fromhex(r["fingerprint"]), np.uint8)) for d, r in got.items()}
    for d, r in got.items():
        near = sum((bits[d] != b).sum() <= fingerprints.RADIUS for b in bits.values()) - 1
        assert r["n_near"] == (near if d % 10 == 0 else None)
    texts = collections.defaultdict(set)
    for d, t in docs:
        texts[t or ""].add(got[d]["fingerprint"])
    assert all(len(x) == 1 for x in texts.values())
    assert np.mean([r["near_edited"] > r["near_next"] for r in got.values()]) > 0.8
    assert fingerprints.fingerprinted(hard).count() == len(HARD)
    assert fingerprints.fingerprinted(empty).count() == 0
    assert rows_of(fingerprints.fingerprinted(table(spark, [(1, "abcdef")])))[0]["edited_sha256"] == hashlib.sha256(b"abcabc").hexdigest()


@pytest.mark.parametrize("words", [60, 300])
def test_fingerprints_find_near_copies(spark, words):
    """Planted copies with a five-word Jaccard similarity of 0.8 to 0.95: scattered words, a block of words, or an end that is new."""
    rng = random.Random(words)
    vocabulary = ["".join(rng.choice("abcdefghijklmno") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    new = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    runs = lambda own: {tuple(own[i : i + 5]) for i in range(len(own) - 4)}
    docs = []
    while len(docs) < 300:
        own, kind, n = new(words), len(docs) // 2 % 3, rng.randint(1, words // 6)
        other, at = list(own), rng.randrange(words - n)
        if kind == 0:
            for _ in range(max(1, n // 8)):
                other[rng.randrange(words)] = rng.choice(vocabulary)
        elif kind == 1:
            other[at : at + n] = new(n)
        else:
            other += new(n)
        a, b = runs(own), runs(other)
        if 0.8 <= len(a & b) / len(a | b) <= 0.95:
            docs += [(len(docs), " ".join(own)), (len(docs) + 1, " ".join(other))]
    got = [r["n_near"] for r in rows_of(fingerprints.fingerprinted(table(spark, docs), every=1))]
    assert max(got) == 1 and np.mean(got) > 0.93


def test_fingerprints_radius_is_exact(spark):
    """Pairs RADIUS bits apart are found however the bits lie, those one bit further are not, and rows of one fingerprint all count."""
    rng = np.random.default_rng(9)
    asked, stock, want = [], [], []
    for k in range(200):
        own = rng.integers(0, 2, 128)
        first = np.array([rng.permutation(16) for _ in range(8)]) + 16 * np.arange(8)[:, None]
        flip = first[:, :3].ravel()[1:] if k % 2 else rng.permutation(128)[: fingerprints.RADIUS]
        rest = np.setdiff1d(np.arange(128), flip)[0]
        far = own.copy()
        far[flip] ^= 1
        beyond = far.copy()
        beyond[rest] ^= 1
        name = lambda x: np.packbits(x).tobytes().hex()
        asked.append((name(own),))
        stock += [(name(far),)] * (1 + k % 3) + [(name(beyond),)]
        want.append((name(own), 1 + k % 3))
    got = fingerprints.within_radius(spark.createDataFrame(asked, "fingerprint string"), spark.createDataFrame(stock, "fingerprint string"))
    assert sorted(map(tuple, got.collect())) == sorted(want)
    none = spark.createDataFrame([], "fingerprint string")
    assert fingerprints.within_radius(none, none).count() == 0 and fingerprints.within_radius(spark.createDataFrame(asked, "fingerprint string"), none).count() == 0


# ------------------------------------------------------------------ 10 vectors


def vectors_brute(rows, threshold):
    unit = {}
    for k, (_, v, label) in enumerate(rows):
        if label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            x = np.array(v, float)
            unit[k] = x / np.sqrt(x @ x)
    root = {r[0]: r[0] for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    count = collections.Counter()
    for a in unit:
        for b in unit:
            if a < b and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= threshold:
                count[a] += 1
                count[b] += 1
                low, high = sorted((find(rows[a][0]), find(rows[b][0])))
                root[high] = low
    return sorted((r[0], count[k], find(r[0]), find(r[0]) == r[0]) for k, r in enumerate(rows))


@pytest.mark.parametrize("cell", [10_000, 40])
def test_vectors_find_all(spark, monkeypatch, cell):
    monkeypatch.setattr(vectors, "CELL", cell)
    monkeypatch.setattr(vectors, "BLOCK", 16)
    rng = np.random.default_rng(4)
    rows = []
    for k in range(260):
        v = rng.normal(size=8)
        if k and rng.random() < 0.5:
            near = rows[rng.integers(len(rows))][1]
            v = np.array(near) + rng.normal(size=8) * rng.choice([0, 0.2, 0.5])
        rows.append((k, [float(x) for x in v], int(rng.integers(2))))
    rows += [(300, None, 0), (301, [0.0] * 8, 0), (302, [1.0, None] + [0.0] * 6, 0), (303, [math.nan] * 8, 0), (304, rows[0][1], None), (305, rows[0][1][:4], rows[0][2]), (306, [2 * x for x in rows[0][1]], rows[0][2]), (307, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("cell", F.lit("x")).withColumn("unit", F.lit("x"))
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in rows_of(vectors.near_duplicates(df)))
    assert got == vectors_brute(rows, 0.93)
    assert vectors.near_duplicates(df.limit(0)).count() == 0
