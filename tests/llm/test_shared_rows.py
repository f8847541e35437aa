"""Suffix-array dedup and language-model scores where rows share ids or texts."""

import collections
import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from auditlake.llm.lm_scoring import lm_score
from auditlake.llm.suffix_dedup import repeated_starts, suffix_dedup


def windows(texts, length):
    """Each text's removed bytes, runs and rest, window by window over all rows."""
    seen = collections.Counter(t[a : a + length] for t in texts for a in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = [False] * len(t)
        for a in range(len(t) - length + 1):
            if seen[t[a : a + length]] > 1:
                gone[a : a + length] = [True] * length
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        out.append((sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), kept))
    return out


def words(rng, n):
    return " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(500)}" for _ in range(n))


def test_suffix_dedup_of_rows_that_share_ids_and_texts(spark):
    rng = random.Random(9)
    passage, copied = words(rng, 60), words(rng, 150)
    rows = [(None, copied)] * 200 + [(1, words(rng, 120)), (1, words(rng, 90) + passage), (None, words(rng, 40) + passage + words(rng, 30)), (None, words(rng, 200)), (1, None), (None, "")]
    rows += [(None, words(rng, 20) + copied[100:500] + words(rng, 20))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id or 0, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup(docs, 200).collect())
    texts = [(t or "").encode() for _, t in rows]
    assert got == sorted((i or 0, *w) for (i, _), w in zip(rows, windows(texts, 200), strict=True))


def test_suffix_dedup_leaves_texts_alone_that_only_share_an_id(spark):
    rng = random.Random(10)
    rows = [(None, words(rng, 30)) for _ in range(5000)]
    out = suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string"), 60)
    assert sorted(bytes(r.kept).decode() for r in out.collect()) == sorted(t for _, t in rows)


def test_equal_rows_do_not_multiply(spark):
    rng = random.Random(11)
    text = words(rng, 400)
    rows = spark.createDataFrame([(1, 2, text)] * 40, "_id long, _tag long, _text string")
    found = repeated_starts(rows, 100).collect()
    assert len(found) == len({(r.lo, r.hi) for r in found}) < len(text)
    assert sum(r.hi - r.lo + 1 for r in found) == len(text) - 99


def test_lm_scores_of_texts_that_share_an_id(spark):
    rng = random.Random(12)
    rows = [(None, words(rng, n % 7)) for n in range(300)] + [(3, "a b c")] * 50 + [(3, "d e"), (4, "a b c"), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    held = F.coalesce(F.col("doc_id") == 4, F.lit(False))
    got = [(r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, r.base_score) for r in lm_score(docs, held).collect()]
    tokens = [(i, (t or "").split() + [None]) for i, t in rows]
    counts = collections.Counter(itertools.chain.from_iterable(w for i, w in tokens if i != 4))
    mass = sum(counts.values()) + len(counts) + 1
    want = [(i or 0, i == 4, len(w), sum(counts[x] > 0 for x in w), sum(math.log10((counts[x] + 1) / mass) for x in w)) for i, w in tokens]
    for a, b in zip(sorted(got), sorted(want), strict=True):
        assert a[:4] == b[:4] and a[4] == pytest.approx(b[4], rel=1e-9)
    scores = {(r.doc_id, r.n_tokens): r.score for r in lm_score(docs.where("doc_id = 3 OR doc_id = 4"), held).collect()}
    assert scores[3, 4] == scores[4, 4] != scores[3, 3]
