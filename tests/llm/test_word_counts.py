"""Word counts of whole texts against a pattern."""

import re

from auditlake.llm.packing import word_counts


def test_word_counts_equal_the_pattern(spark):
    texts = [None, "", " ", "a", " a\tb\n\nc ", "é è \x0bz\x0c", "x " * 5000, "y" * 100_000, "a", "a"]
    rows = [(i // 2, t, "s") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, N_Words string").repartition(3)
    got = word_counts(docs)
    assert got.dtypes == [("doc_id", "bigint"), ("n_words", "bigint")]
    want = sorted((i, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t, _ in rows)
    assert sorted((r.doc_id, r.n_words) for r in got.collect()) == want
    assert word_counts(docs.limit(0)).collect() == []
