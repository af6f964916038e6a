"""The pipeline's stages one after the other on a small corpus, each against what it should keep."""

import collections

import corpus_pipeline
from test_operators import HARD, corpus, join_brute, language_docs, lines_brute, table


def test_stages(spark, tmp_path):
    docs = [(d, t, lang, "a") for d, t, lang in language_docs(150)] + [(1000 + d, t, "zz", s) for d, t, _, s in corpus(21, n=80)] + [(5000, None, "aa", "b"), (5001, "12 34 !!", "aa", "b")]
    table(spark, docs).select(*corpus_pipeline.COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    now, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == corpus_pipeline.COLUMNS
        out.write.parquet(f"{tmp_path}/{name}")
        seen[name] = (now, now := spark.read.parquet(f"{tmp_path}/{name}"))
    texts = {k: {r["doc_id"]: r["text"] for r in after.collect()} for k, (_, after) in seen.items() if "text" in after.columns}
    assert {5000, 5001}.isdisjoint(texts["language"]) and len(texts["language"]) >= len(docs) - 6
    gone = lines_brute(texts["language"].items())
    want = {d: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[d]) for d, t in texts["language"].items()}
    assert texts["lines"] == {d: t for d, t in want.items() if not gone[d] or t.strip(" ")}
    joined = join_brute(list(texts["lines"].items()), 5, 80, 100)
    assert set(texts["near"]) == {d for d, (_, c) in joined.items() if c == d}
    assert set(texts["mixture"]) == set(texts["near"])
    assert {r["doc_id"] for r in seen["packing"][1].collect()} == set(texts["near"])


def test_run_on_hard_cases_and_nothing(spark, tmp_path):
    for name, rows in (("hard", HARD), ("none", [])):
        table(spark, rows).select(*corpus_pipeline.COLUMNS).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        corpus_pipeline.run(spark, f"{tmp_path}/{name}").count()
    docs = [(k, t, lang, "s") for k, t, lang in language_docs(60)]
    table(spark, docs).select(*corpus_pipeline.COLUMNS).write.parquet(f"{tmp_path}/some/documents.parquet")
    got = collections.Counter(r["doc_id"] for r in corpus_pipeline.run(spark, f"{tmp_path}/some").collect())
    assert got and set(got) <= {d for d, *_ in docs}


def test_near_decides_by_row(spark, tmp_path):
    """Rows without an id and unlike texts under one id stay unless they are copies; which row of a group stays does not depend on the order of the rows."""
    a, b, c, d, e = (" ".join(f"{x}{k}" for k in range(40)) for x in "abcde")
    docs = [(1, a), (2, b), (2, a), (3, c), (3, d), (3, d), (4, d + " x"), (None, e), (None, e), (None, b + " y"), (None, "f g h"), (5, ""), (5, ""), (None, "")]
    want = collections.Counter([(1, a), (2, b), (3, c), (3, d), (None, e), (None, "f g h"), (5, ""), (None, "")])
    for rows in (docs, docs[::-1]):
        got = corpus_pipeline.near_copies(spark, table(spark, rows).select(*corpus_pipeline.COLUMNS), str(tmp_path)).collect()
        assert collections.Counter((r["doc_id"], r["text"]) for r in got) == want


def test_rows_without_id_reach_the_end(spark, tmp_path):
    docs = [(k if k % 10 else None, t, lang, "s") for k, t, lang in language_docs(60)]
    now, number = table(spark, docs).select(*corpus_pipeline.COLUMNS), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        number[name] = now.where("doc_id is null").count()
    assert number["near"] and number["mixture"] >= number["near"] and number["packing"] >= number["mixture"]
