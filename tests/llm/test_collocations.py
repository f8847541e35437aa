"""Collocations against counting every phrase, and the automata against plain dictionaries."""

import collections
import random
import re

import numpy as np

from auditlake.llm import collocations as C


def brute(rows, least, widest=5, top=2000):
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    counts, totals = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", lower(text or "")):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            for k in range(1, widest + 1):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = {p[i:j] for p, a in candidates.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and a >= f[p[i:j]]}
        scored = []
        for p, a in candidates.items():
            if p not in inside:
                score, k = min((1000 * a * totals[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, x, y, totals[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(scored)[:top])]
    return sorted(out)


def corpus(seed, n):
    rng = random.Random(seed)
    words = ["the", "The", "of", "é", "it's", "a", "-", "b c", "x9"] + [f"w{i}" for i in range(30)]
    fixed = ["new york city hall", "of the of the of", "one two three four five six", "a a a a a a"]
    out = []
    for _ in range(n):
        parts = [rng.choice(fixed) if rng.random() < 0.2 else words[min(int(rng.expovariate(0.2)), len(words) - 1)] for _ in range(rng.randrange(40))]
        out.append((rng.choice(["en", "de", None, "und"]), "".join(p + rng.choice([" ", " ", " ", "  \t", ". ", ",", "\n", "!?"]) for p in parts)))
    return out


def rows_of(frame):
    return sorted(tuple(r) for r in frame.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def test_phrases_equal_counting_them_all(spark):
    rows = [*corpus(1, 300), ("en", None), ("en", ""), (None, " \t"), ("fr", "one"), ("long", "q r " * 5000)]
    docs = spark.createDataFrame([(t, lang, 1) for lang, t in rows], "text string, lang string, rank int")
    for least in (100, 12, 3):
        want = brute(rows, least)
        assert want and rows_of(C.collocations(docs, least=least)) == want
    want = brute(rows, 5, widest=3, top=4)
    assert rows_of(C.collocations(docs, least=5, widest=3, top=4)) == want


def test_small_blocks_ranges_and_filters(spark, monkeypatch):
    rows = corpus(2, 200)
    docs = spark.createDataFrame([(t, lang) for lang, t in rows], "text string, lang string").repartition(3)
    monkeypatch.setattr(C, "RANGES", 40)
    monkeypatch.setattr(C, "FILTER_BITS", (6, 8))
    for name, value in (("COUNT_BYTES", 300), ("HELD", 200)):
        monkeypatch.setattr(C, name, value)
    assert rows_of(C.collocations(docs, least=4)) == brute(rows, 4)


def test_empty_tables_and_no_phrases(spark):
    docs = spark.createDataFrame([("a b", "en"), (None, None)], "text string, lang string")
    assert C.collocations(docs).count() == 0 and C.collocations(docs.limit(0)).count() == 0
    assert rows_of(C.collocations(docs, least=1)) == [("en", 1, "a b", 1, 1, 1, 2, 2000)]


def test_large_counts_stay_exact(spark):
    words = spark.createDataFrame([(1, True, "en", b"a", 0), (2, True, "en", b"b", 0), (0, False, "en", b"", 10**16)], "symbol long, real boolean, lang string, word binary, n long")
    found = spark.createDataFrame([([1, 2], 10**15 - 7, [10**15 + 3], [10**15 + 1])], "symbols array<long>, a long, l array<long>, r array<long>")
    kept = C.phrase_counts
    try:
        C.phrase_counts = lambda *a: (found, words)
        row = C.collocations(found).first()
    finally:
        C.phrase_counts = kept
    assert row["score"] == 1000 * (10**15 - 7) * 10**16 // ((10**15 + 3) * (10**15 + 1))


def test_automata_equal_dictionaries():
    rng = random.Random(4)
    for symbols in (2, 5, 300):
        parts = []
        for _ in range(4):
            grams = {tuple(rng.randrange(1, symbols + 1) for _ in range(rng.randrange(1, 6))): rng.randrange(1, 400) for _ in range(200)}
            orders = {}
            for n in range(1, 6):
                own = sorted(g for g in grams if len(g) == n)
                if own:
                    orders[n] = [np.array(c, np.uint64) for c in zip(*own, strict=True)], np.array([grams[g] for g in own], np.uint64)
            parts.append((grams, C.Transducer.from_bytes(C.Transducer.of(orders).to_bytes())))
        total = collections.Counter()
        for grams, _ in parts:
            total.update(grams)
        whole = C.united([t for _, t in parts])
        for n in range(1, 6):
            asked = [tuple(rng.randrange(1, symbols + 2) for _ in range(n)) for _ in range(300)] + [g for g in total if len(g) == n]
            got = whole.composed([np.array(c, np.uint64) for c in zip(*asked, strict=True)])
            assert got.tolist() == [total[g] for g in asked]
        listed = {tuple(map(int, g)): int(w) for c, ws in whole.paths().values() for *g, w in zip(*c, ws, strict=True) if w}
        assert listed == dict(total)


def test_equal_states_are_one():
    pairs = [(a, b) for a in range(50) for b in (7, 8, 9)]
    t = C.Transducer.of({2: ([np.array(c, np.uint64) for c in zip(*pairs, strict=True)], np.ones(len(pairs), np.uint64))})
    assert len(t.symbols[0]) == 50 and len(t.symbols[1]) == 3
