"""Toxicity by a linear-chain conditional random field over words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import binaries, mix, shingle_set, slices, span_hashes, without, word_bounds

#: The fit reads at most so many labelled documents of each class, of at most so many bytes each.
SAMPLE_DOCS, SAMPLE_BYTES = 3000, 30_000
#: A feature needs so many toxic sample documents and so much log-odds to mark a word.
SUPPORT, LOG_ODDS = 10, 2.3
PREFIXES = (4, 5, 6)
WINDOW, WINDOWS, STEPS, MIN_HASHES = 24, 16_000, 60, 6
#: Texts whose features are held at a time in the fit.
BLOCK_DOCS = 128


def _features(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and per word the hashes of the whole and of its prefixes."""
    raw, starts, ends = word_bounds(data)
    found = [mix(span_hashes(raw, starts, ends), 1)]
    found += [mix(span_hashes(raw, starts, np.minimum(ends, starts + p)), 10 + p) for p in PREFIXES]
    return starts, ends, np.stack(found, 1) if len(starts) else np.zeros((0, 1 + len(PREFIXES)), np.uint64)


@dataclass
class Tagger:
    """keys: sorted feature hashes; weights: their pull to the toxic state; bias of any word; turn[i, j]:
    weight of state j after state i (0 clean, 1 toxic); calibration of the document score."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float
    turn: np.ndarray
    calibration: np.ndarray
    prior: float

    def __post_init__(self):
        self.mask = np.zeros(1 << 20, bool)
        self.mask[(self.keys >> np.uint64(44)).astype(np.int64)] = True

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        """Index of each hash in keys, or -1."""
        flat = hashes.reshape(-1)
        out = np.full(len(flat), -1, np.int64)
        if len(self.keys):
            at = np.flatnonzero(self.mask[(flat >> np.uint64(44)).astype(np.int64)])
            place = np.minimum(np.searchsorted(self.keys, flat[at]), len(self.keys) - 1)
            hit = self.keys[place] == flat[at]
            out[at[hit]] = place[hit]
        return out.reshape(hashes.shape)

    def marginals(self, words: list[int], places: list[np.ndarray], pulls: list[np.ndarray]) -> list[np.ndarray]:
        """P(toxic) of the marked words of each text, by forward-backward over the whole text.

        Words without features all pull alike, so a run of g of them is the g-th power of one 2 x 2
        matrix. Texts run side by side, the ones with most marked words first.
        """
        order = sorted(range(len(words)), key=lambda i: -len(places[i]))
        counts = np.array([len(places[i]) for i in order])
        d, m = int((counts > 0).sum()), int(counts.max(initial=0))
        out = [np.zeros(len(p)) for p in places]
        if not m:
            return out
        gap, pull, tail = np.zeros((d, m), np.int64), np.zeros((d, m)), np.zeros(d, np.int64)
        for r in range(d):
            p = places[order[r]]
            gap[r, : len(p)] = np.diff(np.r_[-1, p]) - 1
            pull[r, : len(p)] = pulls[order[r]]
            tail[r] = words[order[r]] - 1 - p[-1]
        turn = np.exp(self.turn)
        plain = turn * np.array([1.0, np.exp(self.bias)])
        value, vector = np.linalg.eig(plain)
        value, vector = np.real(value), np.real(vector)
        value, back = value / np.abs(value).max(), np.linalg.inv(vector)

        def power(g: np.ndarray) -> np.ndarray:
            return np.einsum("ij,...j,jk->...ik", vector, value ** g[..., None], back)

        ahead = np.zeros((d, m, 2))
        state = np.tile([1.0, 0.0], (d, 1))
        lift = np.exp(np.clip(pull, -30, 30))
        for t in range(m):
            n = int((counts > t).sum())
            s = np.einsum("ni,nij,jk->nk", state[:n], power(gap[:n, t]), turn)
            s[:, 1] *= lift[:n, t]
            state[:n] = s / s.sum(1, keepdims=True)
            ahead[:n, t] = state[:n]
        state = power(tail).sum(2)
        for t in range(m - 1, -1, -1):
            n = int((counts > t).sum())
            both = ahead[:n, t] * state[:n]
            share = both[:, 1] / both.sum(1)
            for r in range(n):
                out[order[r]][t] = share[r]
            s = state[:n] * np.stack([np.ones(n), lift[:n, t]], 1)
            s = np.einsum("nij,jk,nk->ni", power(gap[:n, t]), turn, s)
            state[:n] = s / s.sum(1, keepdims=True)
        return out

    def read(self, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of each text the starts, ends and toxic marginals of its marked words."""
        words, places, pulls, spans = [], [], [], []
        padded = np.r_[self.weights, 0.0]
        for data in texts:
            starts, ends, hashes = _features(data)
            at = self.lookup(hashes)
            marked = np.flatnonzero((at >= 0).any(1))
            words.append(len(starts))
            places.append(marked)
            pulls.append(padded[at[marked]].sum(1) + self.bias)
            spans.append((starts[marked], ends[marked]))
        return [(s, e, p) for (s, e), p in zip(spans, self.marginals(words, places, pulls), strict=True)]

    def score(self, marginals: list[np.ndarray]) -> np.ndarray:
        x = _aggregates(marginals)
        return 1 / (1 + np.exp(-np.clip(x @ self.calibration, -30, 30)))


def _aggregates(marginals: list[np.ndarray]) -> np.ndarray:
    """A text's marginals as: 1, the chance that any word is toxic, log of 1 + expected toxic words."""
    some = np.array([1 - np.prod(1 - np.minimum(p, 1 - 1e-9)) for p in marginals])
    many = np.array([np.log1p(p.sum()) for p in marginals])
    return np.stack([np.ones(len(marginals)), some, many], 1)


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(x.shape[1])
        w += np.linalg.solve(h, x.T @ (y - p) - 1e-2 * w)
    return w


def _chain_fit(at: np.ndarray, label: np.ndarray, size: int) -> tuple[np.ndarray, float, np.ndarray]:
    """Weights by gradient ascent on the conditional likelihood of word labels in windows of words.

    at: (windows, words, features) indexes, size where none; label: 0, 1, or -1 past a window's end.
    """
    w, bias, turn = np.zeros(size + 1), -3.0, np.array([[0.0, -1.0], [0.0, 0.5]])
    real = label >= 0
    y = np.maximum(label, 0)
    grads = [np.zeros(size + 1), 0.0, np.zeros((2, 2))]
    for _ in range(STEPS):
        pull = w[at].sum(2) + bias
        e, t = np.exp(np.clip(pull, -30, 30)), np.exp(turn)
        n, length = y.shape
        ahead, behind = np.zeros((n, length, 2)), np.ones((n, length, 2))
        state = np.tile([1.0, 0.0], (n, 1))
        for i in range(length):
            s = state @ t
            s[:, 1] *= e[:, i]
            ahead[:, i] = state = s / s.sum(1, keepdims=True)
        for i in range(length - 2, -1, -1):
            s = behind[:, i + 1] * real[:, i + 1, None] + 1.0 * ~real[:, i + 1, None]
            s = (s * np.stack([np.ones(n), e[:, i + 1]], 1)) @ t.T
            s = np.where(real[:, i + 1, None], s, 1.0)
            behind[:, i] = s / s.sum(1, keepdims=True)
        both = ahead * behind
        p = both[:, :, 1] / both.sum(2)
        gap = np.where(real, y - p, 0.0)
        g_w = np.zeros(size + 1)
        np.add.at(g_w, at, np.repeat(gap[:, :, None], at.shape[2], 2))
        g_turn = np.zeros((2, 2))
        before = np.concatenate([np.tile([1.0, 0.0], (n, 1, 1)).reshape(n, 1, 2), ahead[:, :-1]], 1)
        after = behind * np.stack([np.ones_like(e), e], 2)
        pair = before[:, :, :, None] * t * after[:, :, None, :]
        pair /= pair.sum((2, 3), keepdims=True)
        prior = np.concatenate([np.zeros((n, 1), np.int64), y[:, :-1]], 1)
        for i in range(2):
            for j in range(2):
                g_turn[i, j] = (((prior == i) & (y == j) & real) - np.where(real, pair[:, :, i, j], 0)).sum()
        g_w -= 0.05 * w
        g_w[size] = 0.0
        for k, g in enumerate((g_w, gap.sum(), g_turn)):
            grads[k] = grads[k] + g * g
        w = w + 0.5 * g_w / np.sqrt(grads[0] + 1e-6)
        bias += 0.3 * gap.sum() / np.sqrt(grads[1] + 1e-6)
        turn = turn + 0.2 * g_turn / np.sqrt(grads[2] + 1e-6)
    return w[:size], float(bias), turn


def _tally(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of the texts, and in how many of them each is; blocks of texts are added up in turn."""
    keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for i in range(0, len(texts), BLOCK_DOCS):
        own, n = np.unique(np.concatenate([np.unique(_features(x)[2]) for x in texts[i : i + BLOCK_DOCS]]), return_counts=True)
        keys, at = np.unique(np.r_[keys, own], return_inverse=True)
        counts = np.bincount(at, np.r_[counts, n], minlength=len(keys)).astype(np.int64)
    return keys, counts


def _unlike(texts: list[bytes]) -> list[int]:
    """Positions of texts that share no min-hash with an earlier one: words of a text that was copied
    often would else look typical of its label."""
    seen: set[tuple[int, int]] = set()
    kept = []
    for i, data in enumerate(texts):
        shingles = shingle_set(data)
        own = {(k, int(mix(shingles, 51 + k).min())) for k in range(MIN_HASHES)} if len(shingles) else {(-1, 0)}
        if not own & seen:
            kept.append(i)
        seen |= own
    return kept


def fit(texts: list[bytes], toxic: np.ndarray, seed: int = 7) -> Tagger:
    """Fit on a bounded sample of labelled documents.

    Words get labels from the documents': in a toxic document a word is toxic when one of its features
    is frequent in toxic documents and rare in clean ones; every other word is clean.
    """
    if not len(toxic) or toxic.min() == toxic.max():  # nothing to tell apart: the share of toxic examples
        prior = float(toxic.mean()) if len(toxic) else 0.0
        edge = np.log((prior + 1e-3) / (1 - prior + 1e-3))
        return Tagger(np.zeros(0, np.uint64), np.zeros(0), 0.0, np.zeros((2, 2)), np.array([edge, 0.0, 0.0]), prior)
    kept = _unlike(texts)
    texts, toxic = [texts[i] for i in kept], toxic[kept]
    n = [int((toxic == 0).sum()), int((toxic == 1).sum())]
    keys, bad = _tally([x for x, y in zip(texts, toxic, strict=True) if y])
    often = bad >= min(SUPPORT, max(2, n[1] // 20))
    keys, bad = keys[often], bad[often]
    good = np.zeros(len(keys), np.int64)
    for x, y in zip(texts, toxic, strict=True):
        if not y and len(keys):
            own = np.unique(_features(x)[2])
            at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
            good[at[keys[at] == own]] += 1
    odds = np.log((bad + 0.5) / (n[1] + 1)) - np.log((good + 0.5) / (n[0] + 1))
    keys = keys[odds >= LOG_ODDS]
    model = Tagger(keys, np.zeros(len(keys)), 0.0, np.zeros((2, 2)), np.zeros(3), float(toxic.mean()))
    rng = np.random.default_rng(seed)
    width = 1 + len(PREFIXES)
    windows, labels = [], []
    for x, y in zip(texts, toxic, strict=True):
        h = _features(x)[2]
        if not len(h):
            continue
        place = model.lookup(h)
        seeds = np.flatnonzero((place >= 0).any(1))
        centres = [*rng.permutation(seeds)[:3].tolist(), int(rng.integers(len(h)))]
        for c in dict.fromkeys(max(0, min(int(c) - WINDOW // 2, len(h) - WINDOW)) for c in centres):
            some = place[c : c + WINDOW]
            label = ((some >= 0).any(1) & bool(y)).astype(np.int64)
            short = WINDOW - len(some)
            windows.append(np.pad(np.where(some < 0, len(keys), some), ((0, short), (0, 0)), constant_values=len(keys)))
            labels.append(np.pad(label, (0, short), constant_values=-1))
    pick = rng.permutation(len(windows))[:WINDOWS]
    stacked = np.stack([windows[i] for i in pick]) if len(pick) else np.zeros((0, WINDOW, width), np.int64)
    if len(pick):
        weights, bias, turn = _chain_fit(stacked, np.stack([labels[i] for i in pick]), len(keys))
        model = Tagger(keys, weights, bias, turn, np.zeros(3), model.prior)
    x = np.concatenate([_aggregates([m for _, _, m in model.read(texts[i : i + BLOCK_DOCS])]) for i in range(0, len(texts), BLOCK_DOCS)])
    model.calibration = _logistic(x, toxic.astype(float))
    return model


def train(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES) -> Tagger:
    """Fit on up to sample_docs labelled documents of each class, picked by a hash of the id among those
    that usable allows (a column over labels), texts over sample_bytes left out. Ids that carry both
    labels or a null label are no examples."""
    marked = labels.where(usable & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(label_col).alias("_y"), F.max(label_col).alias("_z")).where("_y = _z")
    order = [F.xxhash64(id_col), F.col(id_col)]
    picked = marked.where("_y = 1").orderBy(*order).limit(sample_docs).union(marked.where("_y = 0").orderBy(*order).limit(sample_docs))
    texts = docs.select(id_col, F.col(text_col).alias("_text")).where(F.octet_length("_text") <= sample_bytes)
    rows = texts.join(F.broadcast(picked.select(id_col, "_y")), id_col).select(F.col(id_col).alias("_id"), "_text", "_y").toArrow().sort_by([("_id", "ascending"), ("_text", "ascending")])
    return fit(binaries(rows.column("_text").combine_chunks()), rows.column("_y").to_numpy().astype(np.int64))


def tag_toxicity(docs: DataFrame, model: Tagger, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Adds score (0 to 1), predicted (1 from 0.5 on) and spans to every row, in place of columns so named;
    nothing is shuffled.

    spans: (start, end) in code points of the runs of words whose toxic marginal is 0.5 and more. Null,
    empty and blank texts score as texts without marked words. Repeats and null ids come back as given.
    """
    docs = without(docs, "score", "predicted", "spans")
    sent = docs.sparkSession.sparkContext.broadcast(model)
    extra = "score double, predicted int, spans array<struct<start:long,end:long>>"
    names = [*docs.columns, "score", "predicted", "spans"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in slices(batches, text_col):
            texts = binaries(batch.column(at))
            read = own.read(texts)
            score = own.score([m for _, _, m in read])
            spans = []
            for data, (starts, ends, p) in zip(texts, read, strict=True):
                hot = np.flatnonzero(p >= 0.5)
                if not len(hot):
                    spans.append([])
                    continue
                points = np.r_[0, np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)]
                spans.append([{"start": int(points[s]), "end": int(points[e])} for s, e in zip(starts[hot], ends[hot], strict=True)])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32)), pa.array(spans, kind)], names)

    return docs.mapInArrow(run, f"{kinds}, {extra}")
