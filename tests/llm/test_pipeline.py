"""Every stage of the corpus pipeline on small tables with nulls, empties, repeats, ties and clashing names."""

import collections
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P

RNG = random.Random(5)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, n_lines string, _drop int, `a b` string, starts long, part int"


def words(n, tag=""):
    return " ".join(f"{RNG.choice('bcdfgh')}{RNG.randrange(900)}{tag}" for _ in range(n))


def table(spark, rows):
    full = [(i, t, "en", s, len(t or ""), "x", 1, "y", 2, 3) for i, t, s in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


PASSAGE = words(60)
SHARED = "This line is in several documents"
BASE = words(80)
ROWS = [
    (1, BASE, "s1"), (2, BASE + " tail", "s1"), (3, BASE, "s2"), (3, BASE, "s2"), (3, words(30), "s2"),
    (5, words(40) + " " + PASSAGE + " " + words(35), "s1"), (6, words(50) + " " + PASSAGE + " " + words(30), None),
    (7, f"own first\n{SHARED}\n{words(9)}", "s1"), (8, f"{words(12)}\n  {SHARED.upper()}  ", "s3"), (9, None, "s1"), (10, "", None),
    (11, " \n\n ", "s1"), (12, words(2600), "s4"), (None, words(20), "s1"), (None, BASE, "s1"), (13, words(25), "s1"), (14, words(25), "s1"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, ROWS)


def pairs(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def test_stages_are_those_of_the_job():
    assert [name for name, _ in P.STAGES] == ["toxicity", "line_dedup", "jaccard_join", "suffix_array_dedup", "best_fit_packing"]


@pytest.mark.parametrize("stage", [f for _, f in P.STAGES[1:]])
def test_empty_table(spark, docs, stage):
    assert stage(spark, docs.limit(0), "").count() == 0


def test_toxicity_drops_what_the_tagger_rejects(spark, tmp_path):
    common = lambda n: " ".join(f"w{RNG.randrange(60)}" for _ in range(n))
    rows = [(i, common(20) + (" scoundrelly " if i % 3 == 0 else " ") + common(20), "s1") for i in range(240)] + [(None, "scoundrelly", "s1"), (900, None, "s1"), (901, "", None), (241, common(9), "s1")]
    own = table(spark, rows)
    own.select("doc_id", F.lit(1).alias("quality"), F.when(F.col("doc_id") % 3 == 0, 1).otherwise(0).alias("toxic")).where("doc_id < 240").dropDuplicates(["doc_id"]).write.parquet(f"{tmp_path}/labels.parquet")
    out = P.toxicity(spark, own, str(tmp_path))
    assert out.columns == own.columns
    assert pairs(out) == sorted(((i, t) for i, t, _ in rows if not t or "scoundrelly" not in t), key=str)
    assert P.toxicity(spark, own.limit(0), str(tmp_path)).count() == 0


def test_lines(spark, docs):
    out = P.lines(spark, docs, "")
    text = collections.defaultdict(list)
    for i, t in pairs(out):
        text[i].append(t)
    assert out.columns == docs.columns and out.count() == len(ROWS)
    assert SHARED in text[7][0] and SHARED.lower() not in text[8][0].lower() and text[8][0].count("\n") == 0
    assert text[1] == [BASE] and sorted(text[3], key=len)[0] == "" and text[9] == [""]
    assert all(r["n_chars"] == len(r["text"]) for r in out.collect())


def test_near_duplicates(spark, docs):
    out = P.near_duplicates(spark, docs, "")
    assert out.columns == docs.columns
    gone = {2, 3}
    assert pairs(out) == sorted(((i, t) for i, t, _ in ROWS if i not in gone), key=str)


def test_near_duplicates_loses_no_text_of_a_repeated_id(spark):
    rows = [(4, "one text", "s"), (4, "another text", "s"), (4, "one text", "s"), (6, "third", "s")]
    assert pairs(P.near_duplicates(spark, table(spark, rows), "")) == [(4, "another text"), (4, "one text"), (6, "third")]


def test_repeated_passages(spark, docs):
    length = P.PASSAGE_BYTES
    seen = collections.Counter(t[a : a + length] for _, t, _ in ROWS if t for a in range(len(t) - length + 1))
    want = []
    for i, t, _ in ROWS:
        gone = [False] * len(t or "")
        for a in range(len(t or "") - length + 1):
            if seen[t[a : a + length]] > 1:
                gone[a : a + length] = [True] * length
        want.append((i, "".join(c for c, g in zip(t or "", gone) if not g)))
    out = P.repeated_passages(spark, docs, "")
    assert out.columns == docs.columns and pairs(out) == sorted(want, key=str)
    left = dict(want)
    assert 50 * 4 <= len(PASSAGE) and PASSAGE[20:60] not in left[5] and len(left[5]) > 150


def test_packing(spark, docs):
    out = P.packing(spark, docs, "").collect()
    units, fill, sources = collections.Counter(), collections.Counter(), collections.defaultdict(list)
    source = {i: s for i, _, s in ROWS}
    for r in out:
        units[r["doc_id"]] += r["n_tokens"]
        fill[r["bin"]] += r["n_tokens"]
        sources[r["bin"]].append(source[r["doc_id"]])
    want = collections.Counter()
    for i, t, _ in ROWS:
        want[i] += len((t or "").split()) + 1
    assert units == want and max(fill.values()) <= 2048
    assert all(len([s for s in own if s]) == len({s for s in own if s}) for own in sources.values())
    for b in fill:
        places = sorted((r["bin_start"], r["n_tokens"]) for r in out if r["bin"] == b)
        assert all(a + n == c for (a, n), (c, _) in zip(places, places[1:])) and places[0][0] == 0
