"""The corpus pipeline stage by stage against plain computations, and odd input."""

from __future__ import annotations

import collections

import corpus_pipeline
from test_operators import brute_components, brute_contamination, corpus, docs_table


def test_stages(spark, tmp_path):
    rows = corpus() + [(400, "fresh text " + " ".join(f"n{i}" for i in range(30)), "en")]
    items = [(1, corpus()[5][1])]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = docs_table(spark, rows)
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 4
    first, second, third, last = (f for _, f in corpus_pipeline.STAGES)

    kept = first(spark, docs, str(tmp_path))
    want = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    key = lambda df: collections.Counter((r["doc_id"], r["text"]) for r in df.collect())
    assert kept.columns == columns and key(kept) == collections.Counter((d, t) for d, t, _ in want)

    groups = brute_components(want)
    unique = second(spark, docs_table(spark, want), str(tmp_path))
    alone = {(d, c) for d, _, c in groups}
    left = {d for d, c in alone if d == c}
    assert unique.columns == columns
    got = key(unique)
    assert {d for d, _ in got} == left and set(got.values()) == {1}

    clean = third(spark, docs_table(spark, want), str(tmp_path))
    bad = {k[0] for k in brute_contamination(want, items) if k[5]}
    assert bad and key(clean) == collections.Counter((d, t) for d, t, _ in want if d not in bad)
    assert last(spark, docs_table(spark, want), str(tmp_path)).where("NOT round_trip").count() == 1  # the text with a literal mark


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs_table(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_rows_of_null_and_repeated_ids(spark, tmp_path):
    """Texts that differ stay though their ids are null or equal; near copies and contaminated rows go one by one."""
    words = lambda x, n=40: " ".join(f"{x}{i}" for i in range(n))
    rows = [(None, words("a"), "en"), (None, words("b"), "en"), (None, words("c"), "en"), (None, words("a"), "en"), (7, words("d"), "en"), (7, words("e"), "en"),
            (None, words("d"), "en"), (3, words("e"), "en")]
    got = collections.Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_duplicates(spark, docs_table(spark, rows), str(tmp_path)).collect())
    assert got == collections.Counter([(None, words("a")), (None, words("b")), (None, words("c")), (7, words("d")), (3, words("e"))])

    spark.createDataFrame([(1, words("b"))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(None, words("a"), "en"), (None, words("b"), "en"), (5, words("b"), "en"), (5, words("c"), "en")]
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.drop_contaminated(spark, docs_table(spark, rows), str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted([(None, words("a")), (5, words("c"))], key=str)


def test_language_stage_without_labels(spark, tmp_path):
    rows = [(d, t, None) for d, t, _ in corpus()]
    got = corpus_pipeline.identify_language(spark, docs_table(spark, rows), str(tmp_path)).collect()
    want = [(d, t) for d, t, _ in rows if t and any(c.isalpha() for c in t)]
    assert collections.Counter((r["doc_id"], r["text"]) for r in got) == collections.Counter(want)
