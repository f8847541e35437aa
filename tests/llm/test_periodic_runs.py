"""Periodic runs against a search of every period."""

import hashlib
import random
import zlib

from auditlake.llm.periodic_runs import periodic_runs, run_digests, runs_of


def brute(words, least=12):
    """Every period, every stretch of it; of the periods of one stretch the smallest."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q), q)
            i = j
    return sorted(((a, b - a, q) for (a, b), q in found.items()), key=lambda r: (r[0], r[2]))


def digest(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute(words)
    gone = {i for a, length, q in runs for i in range(a + q, a + length)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (
        doc_id, len(runs), best[0], best[1], best[2], best[1] and 1000 * best[1] // best[2],
        sha("".join(f"{a},{length},{q}\n" for a, length, q in runs).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


def test_runs_equal_a_search_of_every_period():
    rng = random.Random(5)
    for _ in range(400):
        texts = []
        for _ in range(rng.randrange(1, 5)):
            symbols = rng.choice([1, 2, 3, 40])
            words = [b"%d" % rng.randrange(symbols) for _ in range(rng.randrange(0, 70))]
            if words and rng.random() < 0.5:
                a = rng.randrange(len(words))
                p = 1 + (len(words) - a) // rng.randrange(3, 11)
                words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
            texts.append(words)
        for least in (12, 3):
            assert runs_of(texts, least) == [brute(w, least) for w in texts]


def test_many_runs_of_one_word_take_few_steps():
    words = ([b"a"] * 400 + [b"x"]) * 40
    runs = runs_of([words])[0]
    assert len(runs) == 41 and (0, len(words), 401) in runs
    assert runs_of([[b"a"] * 60000])[0] == [(0, 60000, 1)]


def test_digests_of_nulls_empties_repeats_and_ties(spark):
    rng = random.Random(6)
    texts = [None, "", " \t\n ", "one", "a " * 11, "a " * 12, "a b\x0b" * 9, "É é " * 7 + "x " * 14, "x y z " * 4 + "q " + "x y z " * 4]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "b c " * 8), (None, "b c " * 8), (3, "one"), (3, "t u " * 9)]
    rows += [(i, " ".join(rng.choice("abcdef") for _ in range(rng.randrange(200)))) for i in range(100, 220)]
    docs = spark.createDataFrame([(t, i, "x", 1) for i, t in rows], "text string, doc_id long, Runs string, start int")
    got = sorted(map(tuple, run_digests(docs).collect()), key=str)
    assert got == sorted((digest(i, t) for i, t in rows), key=str)
    assert run_digests(docs.limit(0)).count() == 0


def test_own_columns_stay_and_clashing_ones_give_way(spark):
    docs = spark.createDataFrame([(1, "k " * 13, "old", 7)], "doc_id long, text string, RUNS string, kept int")
    row = periodic_runs(docs).first()
    assert row.asDict(recursive=True) == {"doc_id": 1, "text": "k " * 13, "kept": 7, "runs": [{"start": 0, "length": 13, "period": 1}], "collapsed": "k"}
