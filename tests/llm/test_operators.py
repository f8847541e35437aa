"""The corpus operators against brute force on small tables with nulls, empties, repeats and ties."""

import collections
import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from auditlake.llm.bpe import Bpe, bpe_round_trip, slice_coder
from auditlake.llm.components import connected_components
from auditlake.llm.elias_fano import EliasFano
from auditlake.llm.exact_dedup import exact_dedup
from auditlake.llm.exact_topk import exact_topk
from auditlake.llm.jaccard_join import jaccard_groups
from auditlake.llm.line_dedup import line_dedup
from auditlake.llm.lm_scoring import lm_score
from auditlake.llm.packing import best_fit, pack_documents
from auditlake.llm.queries import op2_best_fit_packing
from auditlake.llm.suffix_dedup import suffix_dedup
from auditlake.llm.token_store import Huffman, code_lengths, library_coder, token_store
from auditlake.llm.toxicity import Tagger, _chain_fit, tag_toxicity, train

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
RNG = random.Random(3)
WORDS = ["ab", "Cde", "fé", "ghi", "x", "long-word", "12", "z!"]


def prose(n):
    return " ".join(RNG.choice(WORDS) + str(RNG.randrange(40)) for _ in range(n))


BASE = prose(300)
TEXTS = [
    None, "", "  \t ", "one", BASE, BASE, BASE.upper(), BASE + " tail", prose(200) + BASE[200:900] + prose(50), BASE[:500] + prose(80), prose(40),
    "a shared line here\nx\n  A SHARED line here \nlast" + prose(3), "x\na shared line here\n" + prose(5), "q" * 1500, "q" * 450 + prose(9), prose(3000), "\n\n", "é" * 401 + "é" * 30, "tie", "tie",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, f"s{i % 3}" if i % 5 else None, i) for i, t in enumerate(TEXTS)] + [(None, "null id line is long\nx", None, 0), (4, BASE, "s1", 4)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_lines long")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def collected(df):
    return [r.asDict() for r in df.collect()]


def test_line_dedup(docs, empty):
    held = collections.defaultdict(set)
    rows = [(r.doc_id, (r.text or "").split("\n")) for r in docs.collect()]
    key = lambda x: lower(x.strip(" \t\x0b\x0c\r\n"))
    for i, parts in rows:
        for x in parts:
            held[key(x)].add(math.inf if i is None else i)
    want = []
    for i, parts in rows:
        own = math.inf if i is None else i
        kept = [x for x in parts if not (len(key(x)) >= 10 and len(held[key(x)]) > 1 and own != min(held[key(x)]))]
        want.append((i, len(parts), len(parts) - len(kept), "\n".join(kept)))
    got = [(r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in collected(line_dedup(docs))]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert line_dedup(empty).count() == 0
    assert {r["doc_id"]: r["n_dropped"] for r in collected(line_dedup(docs.where("doc_id IN (11, 12)"), min_docs=3))} == {11: 0, 12: 0}


def test_line_dedup_keeps_columns_of_any_name(spark):
    names = ["_drop", "_lines", "__drop", "__lines", "_id", "_row", "own_0", "n_dropped"]
    rows = [(1, "a shared line of text\nx", *names), (2, "y\nA shared line of text", *names)]
    out = line_dedup(spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} string" for n in names)))
    got = {r["doc_id"]: r for r in collected(out)}
    assert got[2]["text"] == "y" and got[2]["n_dropped"] == 1 and all(got[2][n] == n for n in names[:-1])


def test_exact_dedup_deals_large_groups_to_shares(spark, monkeypatch):
    monkeypatch.setattr("auditlake.llm.exact_dedup.SHARE_ROWS", 7)
    rows = [(i, "Same" if i % 2 else "sAME") for i in range(50)] + [(None, "same"), (3, "same"), (60, "other"), (60, "OTHER"), (61, None), (62, "")]
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[(t or "").lower()].append(i)
    want = []
    for t, ids in groups.items():
        best = max(i for i in ids if i is not None)
        want += [(i, best, len(ids), i == best, hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    got = [tuple(r) for r in exact_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), keep="largest").collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_exact_dedup(docs, empty):
    groups = collections.defaultdict(list)
    for r in docs.collect():
        groups[lower(r.text)].append(r.doc_id)
    for keep, pick in (("largest", max), ("smallest", min)):
        want = []
        for t, ids in groups.items():
            best = pick([i for i in ids if i is not None], default=None)
            want += [(i, best, len(ids), i == best, hashlib.sha256(t.encode()).hexdigest()) for i in ids]
        got = [tuple(r) for r in exact_dedup(docs, keep=keep).collect()]
        assert sorted(map(str, got)) == sorted(map(str, want))
    assert exact_dedup(empty).count() == 0


def test_topk(spark):
    rng = np.random.default_rng(1)
    vecs = rng.normal(size=(130, 6)) * rng.uniform(0.1, 3, size=(130, 1))
    vecs[40:90] = vecs[40]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vecs)] + [(200, None), (201, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (202, [float("nan")] * 6), (203, [0.0] * 6), (220, [1.0, 2.0]), (240, [2.0, 2.0]), (300, [1e300, 1.0, 0.0, 0.0, 0.0, 0.0]), (301, [-1e300, 0.5, 0.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = {i: [max(-(2**52), min(2**52, math.floor(64 * x))) for x in v] for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)}
    want = []
    for q in (i for i in whole if i % 20 == 0):
        best = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(whole[q], v, strict=True)))), i) for i, v in whole.items() if i != q and len(v) == len(whole[q]))[:20]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    got = [tuple(r) for r in exact_topk(df, F.col("vec_id") % 20 == 0).collect()]
    assert sorted(got) == sorted(want)
    assert exact_topk(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_topk_of_repeated_vectors_and_queries(spark):
    """A vector of many queries, ties in and across buckets, an extra column; repeated rows are one."""
    rows = [(i, [float(i % 3), 1.0], "x") for i in range(400)] + [(20, [2.0, 1.0], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string").repartition(3)
    whole = {i: [int(64 * x) for x in v] for i, v, _ in rows}
    want = []
    for q in range(0, 400, 20):
        best = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q)[:20]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert sorted(tuple(r) for r in exact_topk(df, F.col("vec_id") % 20 == 0).collect()) == sorted(want)


def brute_windows(rows, length):
    seen = collections.Counter(d[a : a + length] for _, d in rows for a in range(len(d) - length + 1))
    out = []
    for i, d in rows:
        gone = [False] * len(d)
        for a in range(len(d) - length + 1):
            if seen[d[a : a + length]] > 1:
                gone[a : a + length] = [True] * length
        kept = bytes(c for c, g in zip(d, gone, strict=True) if not g)
        out.append((i, len(d), sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), kept))
    return out


@pytest.mark.parametrize("length", [400, 60])
def test_suffix_dedup(docs, empty, length):
    want = brute_windows([(r.doc_id, (r.text or "").encode()) for r in docs.collect()], length)
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in collected(suffix_dedup(docs, length))]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert suffix_dedup(empty, length).count() == 0


def test_jaccard(docs, empty):
    shingles = {}
    for r in docs.collect():
        w = lower(r.text).encode().split()
        shingles[r.doc_id] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in shingles if i is not None}
    find = lambda i: i if parent[i] == i else find(parent[i])
    for a, b in itertools.combinations(parent, 2):
        x, y = shingles[a], shingles[b]
        if x and y and 100 * len(x & y) >= 80 * len(x | y):
            lo, hi = sorted((find(a), find(b)))
            parent[hi] = lo
    got = collected(jaccard_groups(docs))
    assert len(got) == docs.count()
    for r in got:
        i = r["doc_id"]
        assert (r["n_shingles"], r["component_id"]) == (len(shingles[i]), None if i is None else find(i))
    assert jaccard_groups(empty).count() == 0


def test_jaccard_links_the_texts_of_one_id(spark):
    rows = [(5, BASE), (5, "some other text of six words"), (9, "some other text of six words"), (2, BASE + " tail"), (7, None), (7, "alone")]
    got = {(r["doc_id"], r["component_id"]) for r in collected(jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string")))}
    assert got == {(5, 2), (9, 2), (2, 2), (7, 7)}


def test_jaccard_part_copies(spark):
    """Texts around a common passage, with own words before, inside and after it, near the threshold."""
    rng = random.Random(8)
    core = [f"core{i}" for i in range(60)]
    texts = []
    for i in range(220):
        words = list(core if i % 2 else core[:40])
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = f"w{rng.randrange(30)}"
        own = [f"own{i}-{j}" for j in range(rng.randrange(12))]
        texts.append(" ".join(own + words if i % 3 else words + own))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    comp = list(range(len(sets)))
    for a, b in itertools.combinations(range(len(sets)), 2):
        if comp[a] != comp[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            lo, hi = sorted((comp[a], comp[b]))
            comp = [lo if c == hi else c for c in comp]
    got = {r["doc_id"]: r["component_id"] for r in collected(jaccard_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))}
    assert [got[i] for i in range(len(texts))] == comp
    assert 1 < len(set(comp)) < len(comp)


@pytest.mark.parametrize("symbols", [1 << 19, 20])
def test_lm(docs, empty, symbols):
    held = F.col("doc_id") % 4 == 1
    rows = [(r.doc_id, lower(r.text).encode().split() + [None]) for r in docs.where("doc_id IS NOT NULL").distinct().collect()]
    counts = collections.Counter(itertools.chain.from_iterable(w for i, w in rows if i % 4 != 1))
    n, v = sum(counts.values()), len(counts)
    got = {r["doc_id"]: r for r in collected(lm_score(docs.where("doc_id IS NOT NULL").distinct(), held, symbols=symbols))}
    assert len(got) == len(rows)
    for i, w in rows:
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (i % 4 == 1, len(w), sum(counts[x] > 0 for x in w), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w))
        assert math.isfinite(r["score"]) and r["score"] < 0
    assert got[4]["score"] > got[4]["base_score"]
    assert lm_score(empty, held).count() == 0


def equals_trigram_model(spark, words, symbols, shard_tokens):
    """Scores of texts of words against a count of all trigrams; returns the most frequent words' counts and all counts."""
    rng = random.Random(11)
    rows = [(i, " ".join(words(rng, i, j) for j in range(rng.randrange(1, 60)))) for i in range(120)]
    rows += [(120, rows[0][1]), (121, ""), (122, "the"), (125, "new words the never of seen")]
    c1, c2, c3, n2, n3 = (collections.Counter() for _ in range(5))
    seq = {i: ["<1>", "<2>", *t.split(), "<end>"] for i, t in rows}
    for i, t in seq.items():
        for u, v, w in zip(t, t[1:], t[2:]) if i % 4 != 1 else ():
            for c, k in ((c1, w), (c2, (v, w)), (c3, (u, v, w)), (n2, v), (n3, (u, v))):
                c[k] += 1
    mass = sum(c1.values()) + len(c1) + 1

    def p(u, v, w):
        p2 = (c2[v, w] + 1000 * (c1[w] + 1) / mass) / (n2[v] + 1000)
        return (c3[u, v, w] + p2) / (n3[u, v] + 1)

    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r for r in collected(lm_score(docs, F.col("doc_id") % 4 == 1, symbols=symbols, shard_tokens=shard_tokens))}
    assert len(got) == len(rows)
    for i, t in seq.items():
        assert got[i]["score"] == pytest.approx(sum(math.log10(p(*x)) for x in zip(t, t[1:], t[2:])), abs=2e-4 * len(t))
        assert got[i]["n_known"] == sum(c1[x] > 0 for x in t[2:]) and got[i]["n_tokens"] == len(t) - 2
    return max(c1[w] for w in c1 if w != "<end>")


@pytest.mark.parametrize("symbols", [20, 0])
def test_lm_counts_ngrams_of_all_words(spark, symbols):
    assert equals_trigram_model(spark, lambda rng, i, j: rng.choice([f"w{rng.randrange(80)}"] * 3 + [f"once{i}x{j}"]), symbols, 5000) < 5000


@pytest.mark.parametrize(("symbols", "shard_tokens"), [(1 << 19, 100), (0, 100), (1 << 19, 4), (0, 4)])
def test_lm_deals_frequent_words_to_parts(spark, symbols, shard_tokens):
    """Words of several parts, and of more than 64, keep whole counts; shards have several blocks."""
    assert equals_trigram_model(spark, lambda rng, i, j: rng.choice(["the", "the", "of", f"w{rng.randrange(60)}", f"once{i}x{j}"]), symbols, shard_tokens) >= 2 * shard_tokens


def test_lm_repeats_and_null_ids(spark):
    rows = [(1, "a b c"), (1, "a b c"), (2, "a b"), (None, "a b c"), (2, None), (3, "x " * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("own")).repartition(3)
    got = collected(lm_score(docs, F.lit(False)))
    assert sorted((r["doc_id"] or 0, r["n_tokens"], r["n_known"]) for r in got) == [(0, 4, 4), (1, 4, 4), (1, 4, 4), (2, 1, 1), (2, 3, 3), (3, 3001, 3001)]
    assert len({round(r["score"], 6) for r in got if r["n_tokens"] == 4}) == 1


def test_elias_fano_successor():
    values = np.sort(np.random.default_rng(2).integers(0, 5000, 700).astype(np.uint64))
    code = EliasFano(*EliasFano.code(values, 5001))
    x = np.arange(5001, dtype=np.uint64)
    assert (code.successor(x) == np.searchsorted(values, x)).all()
    assert ((code.find(x) >= 0) == np.isin(x, values)).all()
    for n, bound in ((0, 9), (1, 1), (3, 1 << 40), (5000, 6000)):
        values = np.sort(np.random.default_rng(n).integers(0, bound, n).astype(np.uint64))
        code = EliasFano(*EliasFano.code(values, bound))
        x = np.unique(np.r_[values, values + np.uint64(1), np.uint64(0)])
        x = x[x < bound]
        assert (code.successor(x) == np.searchsorted(values, x)).all() and ((code.find(x) >= 0) == np.isin(x, values)).all()


def test_toxicity(spark, empty):
    rows = [(i, prose(20) + (" scoundrelly " if i % 3 == 0 else " ") + prose(20), int(i % 3 == 0)) for i in range(240)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = df.select("doc_id", "toxic")
    model = train(df.select("doc_id", "text"), labels, F.col("doc_id") % 5 != 0)
    out = collected(tag_toxicity(df.select("doc_id", "text"), model))
    text = {i: t for i, t, _ in rows}
    for r in out:
        assert r["predicted"] == int(r["doc_id"] % 3 == 0) and 0 <= r["score"] <= 1
        assert [text[r["doc_id"]][s["start"] : s["end"]] for s in r["spans"]] == ["scoundrelly"] * r["predicted"]
    assert tag_toxicity(empty, model).count() == 0
    none = train(df.select("doc_id", "text"), labels.limit(0), F.lit(True))
    assert {r["predicted"] for r in collected(tag_toxicity(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"), none))} == {0}


def test_chain_marginals_are_those_of_all_taggings():
    rng = np.random.default_rng(4)
    model = Tagger(np.zeros(0, np.uint64), np.zeros(0), -0.7, np.array([[0.3, -0.9], [-0.2, 0.6]]), np.zeros(3), 0.1)
    for words, places in ((1, [0]), (6, [1, 2, 5]), (7, [0, 6]), (5, [3])):
        pulls = rng.normal(size=len(places)) * 3
        pull = np.full(words, model.bias)
        pull[places] = pulls
        mass, toxic = 0.0, np.zeros(words)
        for tags in itertools.product((0, 1), repeat=words):
            p = math.exp(sum(model.turn[a, b] + b * pull[i] for i, (a, b) in enumerate(zip((0, *tags), tags))))
            mass += p
            toxic += p * np.array(tags)
        (got,) = model.marginals([words], [np.array(places)], [pulls])
        assert got == pytest.approx((toxic / mass)[places], abs=1e-9)


def test_chain_fit_climbs_the_likelihood_of_the_labels():
    """Weights that fit a planted feature, and a likelihood, counted over all taggings, above that of the start."""
    rng = np.random.default_rng(6)
    at = rng.integers(0, 4, (60, 5, 1))
    label = (at[:, :, 0] == 2).astype(np.int64)
    at[:10, 3:], label[:10, 3:] = 4, -1
    w, bias, turn = _chain_fit(at, label, 4)

    def likelihood(w, bias, turn):
        total = 0.0
        for row, y in zip(at[:, :, 0], label):
            n = int((y >= 0).sum())
            score = lambda tags: sum(turn[a, b] + b * (np.r_[w, 0.0][row[i]] + bias) for i, (a, b) in enumerate(zip((0, *tags), tags)))  # noqa: B023, E731
            total += score(tuple(y[:n])) - math.log(sum(math.exp(score(t)) for t in itertools.product((0, 1), repeat=n)))
        return total

    assert w[2] > max(w[[0, 1, 3]]) + 2
    assert likelihood(w, bias, turn) > likelihood(np.zeros(4), -3.0, np.array([[0.0, -1.0], [0.0, 0.5]])) + 10


def test_components_of_long_chains(spark):
    n = 300
    order = RNG.sample(range(1000), n)
    links = spark.createDataFrame([*zip(order, order[1:]), (5000, 5001), (6000, 6000)], "a long, b long")
    got = {r.node: r.comp for r in connected_components(links).collect()}
    assert {got[i] for i in order} == {min(order)} and got[5001] == 5000 and len(got) == n + 2


def test_packing_ties_and_repeats(spark):
    rows = [(7, 4, "a"), (7, 4, "a"), (None, 4, None), (None, None, None), (1, -3, "b"), (2, 25, "b"), (3, 10, "c"), (4, 6, "c")]
    out = collected(pack_documents(spark.createDataFrame(rows, "doc_id long, n int, bin string"), F.col("n"), F.col("bin"), F.lit(None), capacity=10))
    units, fill = collections.Counter(), collections.Counter()
    for r in out:
        units[r["doc_id"]] += r["n_tokens"]
        fill[r["bin"]] += r["n_tokens"]
        assert r["start"] == 10 * r["piece"]
    assert units == {7: 8, None: 5, 1: 1, 2: 25, 3: 10, 4: 6} and max(fill.values()) == 10
    assert len({r["bin"] for r in out if r["doc_id"] == 7}) == 2
    assert len(out) == len(rows) + 2


def test_bpe(docs, empty):
    library = Tokenizer.from_file(VOCABULARY)
    own = Bpe(VOCABULARY)
    odd = ["a  b\n\n c\t\td 's<|endoftext|> x", "\x1c a\x1d \x85 \xa0\xa0 x　z", "日本語 🙂🙂  ", "x" * 3000 + " " * 50, "\r\n\r\nfoo\x0b\x0c é"]
    for t in odd:
        assert own.encode(t) == library.encode(t, add_special_tokens=False).ids
    mixed = [*odd, None, "", " ", "\n", "foo", "\nfoo \n bar  ", "a ", "b", " c", "x  <|endoftext|>", "  <|endoftext|>  ", "\n<|endoftext|>", *filter(None, TEXTS)]
    for coder in (slice_coder(VOCABULARY), library_coder(VOCABULARY)):
        for _ in range(2):  # the second time from what is remembered
            ids, at = coder(pa.array(mixed, pa.string()))
            assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [library.encode(t or "", add_special_tokens=False).ids for t in mixed]
        assert [x.tolist() for x in coder(pa.array([], pa.string()))] == [[], [0]]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = []
    for r in docs.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id, len(ids), sha(",".join(map(str, ids))), sha(r.text or "")))
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in bpe_round_trip(docs, VOCABULARY).collect())
    assert bpe_round_trip(empty, VOCABULARY).count() == 0


def test_huffman_lengths_and_round_trip():
    counts = np.array([2**i for i in range(24)] + [0, 1, 1])
    lengths = code_lengths(counts, 10)
    assert lengths.max() <= 10 and lengths[24] == 0 and sum(2.0 ** -int(x) for x in lengths if x) <= 1
    ids = np.random.default_rng(5).choice(np.flatnonzero(counts), 5000)
    coder = Huffman(lengths)
    assert (coder.decode(coder.encode(ids)) == ids).all()


def test_token_store(docs, empty):
    library = Tokenizer.from_file(VOCABULARY)
    unique = docs.distinct()
    at, want = 0, []
    for r in sorted(unique.select("doc_id", "text").distinct().collect(), key=lambda r: math.inf if r.doc_id is None else r.doc_id):
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 0]
        want.append((r.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = [tuple(r) for r in token_store(unique.select("doc_id", "text").distinct(), VOCABULARY).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert token_store(empty, VOCABULARY).count() == 0


def test_token_store_of_many_blocks(spark):
    """Several partitions and blocks, repeated rows, null texts and a null id."""
    library = Tokenizer.from_file(VOCABULARY)
    rows = [(i * 3, prose(i % 40) if i % 9 else None, i) for i in range(150)] + [(6, "same id", 0), (6, "same id", 1), (None, "no id", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start long").repartition(7)
    got = sorted((tuple(r) for r in token_store(df, VOCABULARY, block_ids=200).collect()), key=lambda r: r[1])
    at, texts = 0, collections.defaultdict(list)
    for i, t, _ in rows:
        texts[i].append([*library.encode(t or "", add_special_tokens=False).ids, 0])
    assert [r[0] for r in got] == sorted((r[0] for r in rows), key=lambda i: math.inf if i is None else i)
    for i, start, n, crc in got:
        assert start == at and (n, crc) in [(len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for x in texts[i]]
        at += n
    assert at == sum(len(x) for own in texts.values() for x in own)


def naive_best_fit(sizes, sources, clusters, capacity):
    bins, out = [], []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        fit = [b for b in range(len(bins)) if bins[b][0] >= sizes[i] and sources[i] not in bins[b][1] and clusters[i] not in bins[b][2]]
        if fit:
            b = min(fit, key=lambda b: (bins[b][0], b))
        else:
            b = len(bins)
            bins.append([capacity, set(), set()])
        out.append((i, b))
        bins[b][0] -= sizes[i]
        bins[b][1].add(sources[i]) if sources[i] >= 0 else None
        bins[b][2].add(clusters[i]) if clusters[i] >= 0 else None
    return out


def test_packing(docs, empty):
    rng = random.Random(4)
    sizes = [rng.randrange(1, 90) for _ in range(300)]
    sources, clusters = [rng.randrange(-1, 12) for _ in sizes], [rng.randrange(-1, 60) for _ in sizes]
    assert [(i, b) for i, _, _, b, _ in best_fit(sizes, sources, clusters, 100)] == naive_best_fit(sizes, sources, clusters, 100)
    out = collected(pack_documents(docs, F.length("text"), F.col("source"), F.xxhash64("text"), capacity=1000))
    fill, who, units = collections.Counter(), collections.defaultdict(list), collections.Counter()
    source = {r.doc_id: r.source for r in docs.collect()}
    for r in out:
        fill[r["bin"]] += r["n_tokens"]
        units[r["doc_id"]] += r["n_tokens"]
        who[r["bin"]].append(source[r["doc_id"]])
    assert max(fill.values()) <= 1000
    assert all(len([s for s in v if s]) == len({s for s in v if s}) for v in who.values())
    assert units[15] == len(TEXTS[15]) and units[1] == 1
    assert pack_documents(empty, F.length("text"), F.col("source"), F.xxhash64("text")).count() == 0


def test_packing_deals_null_ids_of_one_text_to_groups(spark):
    rows = spark.createDataFrame([(None, "same", i) for i in range(400)], "doc_id long, text string, i int").repartition(4)
    out = collected(pack_documents(rows, F.lit(5), F.lit(None), F.lit("c"), group_rows=20))
    held = collections.Counter(r["bin"] >> 32 for r in out)
    assert len(out) == 400 and len(held) > 10 and max(held.values()) < 60


def test_packing_query_keeps_near_copies_apart(spark, tmp_path):
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*words, f"tail{i}"]), f"s{i}") for i in range(4)] + [(9, "other text of its own kind", "s9")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    bins = {r["doc_id"]: r["bin"] for r in collected(op2_best_fit_packing(spark, str(tmp_path)))}
    assert len({bins[i] for i in range(4)}) == 4 and len(bins) == 5


def test_packing_query_keeps_texts_without_id_or_words_apart(spark, tmp_path):
    rows = [(None, "one two three", "s0"), (None, "One Two three", "s1"), (1, " \n", "s2"), (2, " \n", "s3"), (3, None, "s4"), (4, "", "s5")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    out = collected(op2_best_fit_packing(spark, str(tmp_path)))
    bins = {r["doc_id"]: r["bin"] for r in out}
    assert len(out) == 6 and len({r["bin"] for r in out if r["doc_id"] is None}) == 2 and bins[1] != bins[2] and bins[3] != bins[4]
