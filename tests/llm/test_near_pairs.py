"""The Jaccard join's pairs of few and of many rows, and the columns that it hands on."""

import itertools
import random
import re

import pytest

from auditlake.llm import jaccard_join as J


@pytest.mark.parametrize(("few", "told"), [(2, 1), (3, 1 << 21), (64, 1 << 21)])
def test_pairs_of_few_and_of_many_rows(spark, monkeypatch, few, told):
    """Weak first links leave most of the work to the prefixes, whichever way their rows meet."""
    for name, value in (("FEW_ROWS", few), ("TOLD_NODES", told), ("MIN_HASHES", 1), ("PICKS", 1)):
        monkeypatch.setattr(J, name, value)
    rng = random.Random(12)
    texts = []
    for base in range(12):
        core = [f"c{base}-{i}" for i in range(50)]
        for _ in range(rng.choice([2, 3, 9])):
            words = list(core)
            for _ in range(rng.randrange(3)):
                words[rng.randrange(len(words))] = f"w{rng.randrange(9)}"
            texts.append(" ".join(words + [f"t{rng.randrange(1000)}" for _ in range(rng.randrange(6))]))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    comp = list(range(len(sets)))
    for a, b in itertools.combinations(range(len(sets)), 2):
        if comp[a] != comp[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            lo, hi = sorted((comp[a], comp[b]))
            comp = [lo if c == hi else c for c in comp]
    got = {r.doc_id: r.component_id for r in J.jaccard_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(texts))] == comp
    assert 1 < len(set(comp)) < len(comp)


def test_columns_and_words_are_handed_on(spark):
    rows = [(1, "a b c d e f", "x", 4), (1, None, None, 5), (None, " \t", "y", None), (2, "A b c d e f", "x", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, `k y` long").repartition(3)
    out = J.jaccard_groups(docs, keep=("source", "k y"), words="n")
    assert out.dtypes == [("doc_id", "bigint"), ("n_shingles", "bigint"), ("component_id", "bigint"), ("source", "string"), ("k y", "bigint"), ("n", "bigint")]
    want = {(i, 2 if t and t.strip() else 0, i and 1 if t and t.strip() else i, s, k, len(re.findall(r"\S+", t or ""))) for i, t, s, k in rows}
    assert {tuple(r) for r in out.collect()} == want
    assert J.jaccard_groups(docs.limit(0), keep=("source", "k y"), words="n").collect() == []
