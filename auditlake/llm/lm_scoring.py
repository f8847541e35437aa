"""Language-model scores of whole texts from a sharded trigram trie."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import flat_bytes, hashed_words, mix, slices, staged
from auditlake.llm.elias_fano import Level, mapped

#: Words that are symbols, whose counts go to every task (the broadcast's bound); tokens of a shard, and of a part
#: of a word that has more (of all tokens / SYMBOLS where that is more); blocks of a shard; prior weights of bigrams and trigrams.
SYMBOLS, SHARD_TOKENS, BLOCKS, PRIOR_2, PRIOR_3 = 1 << 19, 1 << 21, 4, 1000.0, 1.0
#: Steps of a sum of logarithms.
FIXED = float(1 << 32)
_END = mix(np.array([1], np.uint64), 900)
_BEFORE = mix(np.array([2, 3], np.uint64), 900)


@dataclass
class Symbols:
    """hashes: sorted word hashes of the symbols; counts: theirs in training; tokens and types: of all words there;
    most: tokens of one part of a word.

    Numbers: the symbols, two for the words before a text, then the other words of a block or shard, which
    names them itself. Hot words are always symbols.
    """

    hashes: np.ndarray
    counts: np.ndarray
    tokens: int
    types: int
    most: int

    @property
    def others(self) -> int:
        return len(self.hashes) + 2

    @property
    def parts(self) -> np.ndarray:
        """By number of the symbols and the words before a text: how many parts its contexts are dealt to, a power of two."""
        return np.r_[np.exp2(np.ceil(np.log2(np.maximum(self.counts, self.most) / self.most))).astype(np.int64), 1, 1]

    def number(self, words: np.ndarray, others: np.ndarray) -> np.ndarray:
        """A word's symbol, or its place in others (sorted) after the symbols; all that is not a symbol is in others."""
        out = self.others + np.searchsorted(others, words)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, words), len(self.hashes) - 1)
            out = np.where(self.hashes[at] == words, at, out)
        return out

    def split(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of words in which others are named by the second result; _BEFORE has its own two."""
        out = self.number(words, np.zeros(0, np.uint64))
        for k in range(2):
            out[(out == self.others) & (words == _BEFORE[k])] = len(self.hashes) + k
        other = out == self.others
        names, at = np.unique(words[other], return_inverse=True)
        out[other] += at
        return out, names

    def log_unigram(self, counts: np.ndarray) -> np.ndarray:
        """log10 p by number; counts: of the words after the symbols and the two before a text."""
        return np.log10(np.r_[self.counts + 1, 1, 1, counts + 1] / (self.tokens + self.types + 1))


def _vocabulary(rows: DataFrame) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            token, n = np.unique(np.r_[hashed_words(batch.column(0))[0], np.repeat(_END, batch.num_rows)], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n, pa.int64())], ["token", "c"])

    return staged(rows.select("_text").mapInArrow(count, "token long, c long").groupBy("token").agg(F.sum("c").alias("c")), "vocabulary")


def _symbols(vocabulary: DataFrame, limit: int, shard_tokens: int) -> Symbols:
    """The most frequent words, as many as fit the limit with all words as frequent as the last, and those of several parts."""
    step = F.floor(F.log2("c") * 32)
    bins = vocabulary.groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("types"), F.sum("c").alias("tokens")).orderBy(F.desc("s")).collect()
    types, floor = 0, None
    for b in bins:
        if types + b["types"] > limit:
            break
        types, floor = types + b["types"], b["s"]
    all_types, all_tokens = sum(b["types"] for b in bins), sum(b["tokens"] for b in bins)
    most = max(shard_tokens, all_tokens // SYMBOLS)
    hot = F.col("c") > most
    top = vocabulary.where(hot | (step >= floor) if floor is not None else hot).toPandas()
    hashes = top["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return Symbols(hashes[order], top["c"].to_numpy(np.int64)[order], all_tokens, all_types, most)


def _part(parts: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Part of a context: by the hash of u, of so many parts."""
    return (mix(u, 77) & (parts - 1).astype(np.uint64)).astype(np.int64)


def _shard(v: np.ndarray, part: np.ndarray, shards: int) -> np.ndarray:
    return (mix(mix(v, 76) + part.astype(np.uint64), 78) % np.uint64(shards)).astype(np.int64)


def _trigrams(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words and ends with two before each text; places of the words themselves; the text of each."""
    words, first = hashed_words(column)
    counts = np.diff(first)
    rows = np.arange(len(counts))
    heads = first[:-1] + 3 * rows
    padded = np.empty(len(words) + 3 * len(counts), np.uint64)
    padded[heads], padded[heads + 1], padded[heads + counts + 2] = *_BEFORE, _END[0]
    padded[np.arange(len(words)) + np.repeat(3 * rows + 2, counts)] = words
    keep = np.ones(len(padded), bool)
    keep[heads] = keep[heads + 1] = False
    return padded, np.flatnonzero(keep), np.repeat(rows, counts + 1)


class Trie:
    """Levels: context words v, a frequent one by parts; words after them; contexts (v, u); words after a context.

    Seen n-grams keep quantised log10 of their smoothed probability, contexts that of the weight that
    an unseen word's shorter n-gram gets. Counts c give p = (c + prior * shorter) / (total + prior).
    cls, u, w, c3: the distinct trigrams of the training texts, with their counts.
    Bigrams of a word of several parts are counted elsewhere: hot_cls has its parts here, hot_total all counts of
    their words, and hot_pairs (part, word, count) whole counts of all pairs that anyone here asks for.
    """

    def __init__(self, cls: np.ndarray, u: np.ndarray, w: np.ndarray, c3: np.ndarray, log_unigram: np.ndarray, hot_cls: np.ndarray, hot_total: np.ndarray, hot_pairs: tuple[np.ndarray, np.ndarray, np.ndarray], prior_2: float, prior_3: float):
        self.log_unigram = log_unigram
        width = np.uint64(len(log_unigram))
        classes = np.union1d(cls, hot_cls)
        of_class = np.searchsorted(classes, cls)
        total = np.bincount(of_class, c3, minlength=len(classes))
        hot_at = np.searchsorted(classes, hot_cls)
        hot = np.zeros(len(classes), bool)
        hot[hot_at] = True
        total[hot_at] = hot_total
        plain = ~hot[of_class]
        pair, at = np.unique(of_class[plain].astype(np.uint64) * width + w[plain].astype(np.uint64), return_inverse=True)
        c2 = np.bincount(at, c3[plain], minlength=len(pair))
        pair = np.r_[pair, np.searchsorted(classes, hot_pairs[0]).astype(np.uint64) * width + hot_pairs[1].astype(np.uint64)]
        order = np.argsort(pair)
        pair, c2 = pair[order], np.r_[c2, hot_pairs[2]][order]
        p_cls, p_w = (pair // width).astype(np.int64), (pair % width).astype(np.int64)
        p2 = (c2 + prior_2 * 10 ** log_unigram[p_w]) / (total[p_cls] + prior_2)
        ctx, of_ctx = np.unique(of_class.astype(np.uint64) * width + u.astype(np.uint64), return_inverse=True)
        c_ctx = np.bincount(of_ctx, c3, minlength=len(ctx))
        order = np.argsort(of_ctx.astype(np.uint64) * width + w.astype(np.uint64))
        t_ctx, t_w, c3 = of_ctx[order], w[order], c3[order]
        shorter = p2[np.searchsorted(pair, ctx[t_ctx] // width * width + t_w.astype(np.uint64))]
        p3 = (c3 + prior_3 * shorter) / (c_ctx[t_ctx] + prior_3)
        bound = int(classes[-1]) + 1 if len(classes) else 1
        self.classes, self.pairs, self.contexts, self.triples = mapped([
            Level.code(np.zeros(len(classes)), classes, 1, bound, [np.log10(prior_2 / (total + prior_2))]),
            Level.code(p_cls, p_w, len(classes), int(width), [np.log10(p2)]),
            Level.code(ctx // width, ctx % width, len(classes), int(width), [np.log10(prior_3 / (c_ctx + prior_3))]),
            Level.code(t_ctx, t_w, len(ctx), int(width), [np.log10(p3)]),
        ])
        self.bound = bound

    def log_p(self, cls: np.ndarray, u: np.ndarray, w: np.ndarray) -> np.ndarray:
        """log10 p of distinct trigrams in order of cls, u, w; each class, context and pair is looked up once."""
        first = lambda x: np.flatnonzero(np.r_[True, x[1:] != x[:-1]][: len(x)])
        heads = first(cls)
        own = cls[heads]
        at = np.where(own < self.bound, self.classes.find(np.zeros(len(own), np.int64), np.minimum(own, self.bound - 1)), -1)
        parent = np.repeat(at, np.diff(np.r_[heads, len(cls)]))
        some = np.flatnonzero(parent >= 0)
        out = self.log_unigram[w].copy()
        parent, u, w = parent[some], u[some], w[some]
        width = np.uint64(len(self.log_unigram))
        pairs, of = np.unique(parent.astype(np.uint64) * width + w.astype(np.uint64), return_inverse=True)
        above, below = (pairs // width).astype(np.int64), (pairs % width).astype(np.int64)
        pair = self.pairs.find(above, below)
        short = np.where(pair >= 0, self.pairs.value(0, np.maximum(pair, 0)) if self.pairs.keys.n else 0.0, self.log_unigram[below] + self.classes.value(0, above))
        heads = first(parent.astype(np.uint64) * width + u.astype(np.uint64))
        context = np.repeat(self.contexts.find(parent[heads], u[heads]), np.diff(np.r_[heads, len(u)]))
        part = short[of]
        known = np.flatnonzero(context >= 0)
        triple = self.triples.find(context[known], w[known])
        full = triple >= 0
        part[known[full]] = self.triples.value(0, triple[full])
        part[known[~full]] += self.contexts.value(0, context[known[~full]])
        out[some] = part
        return out


def _pack(columns: list[np.ndarray]) -> bytes:
    raw = b"".join(np.ascontiguousarray(c.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes() for c in columns)
    return pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(data: bytes, n: int, columns: int) -> list[np.ndarray]:
    raw = np.frombuffer(pa.decompress(data, decompressed_size=4 * n * columns, codec="zstd", asbytes=True), np.uint8)
    return [np.ascontiguousarray(raw[4 * n * i : 4 * n * (i + 1)].reshape(4, n).T).view("<u4").reshape(-1) for i in range(columns)]


def lm_score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", symbols: int = SYMBOLS, shard_tokens: int = SHARD_TOKENS, prior_2: float = PRIOR_2, prior_3: float = PRIOR_3) -> DataFrame:
    """log10 probability of every whole text under a trigram model of the texts that are not held out.

    Tokens: words [^\\x20\\x09-\\x0D]+ after lower-casing A-Z, then one end. Every word has n-grams of its own;
    symbols only bounds how many words' counts are broadcast, the other words go by their hash and their
    counts come by a join, with the same scores. Every trigram occurrence travels once, packed, to the shard
    of its middle word; shards follow the number of tokens. A word of more than shard_tokens is dealt to
    parts by the word before it, and each part is given the counts over all parts of the bigrams that it
    meets. A shard counts its training trigrams block by block, builds its part of the trie, and answers
    for all texts block by block: it holds its packed rows, its distinct trigrams and one block. Only sums
    come back, for the texts of a batch by their places in it, in whole steps of 2^-32, so no order of adding
    changes them; ids take no part but to be given back, so rows may share one. The driver sees totals and
    symbols. All the contexts of one pair of words are one shard's. docs is read several times and must give
    the same rows each time, as a table does.

    Returns id, held_out, n_tokens, n_known, train_tokens, base_score (add-one unigram) and score. Null and
    empty text is the end token alone. Repeated rows and null ids come back as given. Without training texts
    every token is unseen: base and score are 0. Other columns take no part. Empty in, empty out.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), text.alias("_text"), F.coalesce(held_out, F.lit(False)).alias("_held"))
    vocabulary = _vocabulary(rows.where("NOT _held"))
    table = _symbols(vocabulary, symbols, shard_tokens)
    sent = spark.sparkContext.broadcast(table)
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 5 * table.tokens // (4 * shard_tokens))
    all_counted = table.types == len(table.hashes)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs (v, w) of a v of several parts with their count in training and the parts that meet them, by
        groups of parts of which a word has 64 at most; other words w with their shard."""
        known = sent.value
        parts_of = np.r_[known.parts, 1]
        for batch in slices(batches, "_text"):
            padded, at, doc = _trigrams(batch.column(0))
            number = known.number(padded, np.zeros(0, np.uint64))
            number[np.isin(padded, _BEFORE)] = len(known.hashes)
            n_parts = parts_of[number[at - 1]]
            hot = n_parts > 1
            some = at[hot]
            learnt = ~np.asarray(batch.column(1).to_pylist(), bool)[doc[hot]]
            bit = np.int64(1) << (_part(n_parts[hot], padded[some - 2]) // np.maximum(1, n_parts[hot] // 64))
            order = np.lexsort((padded[some], number[some - 1]))
            v, w = padded[some - 1][order], padded[some][order]
            first = np.flatnonzero(np.r_[True, (v[1:] != v[:-1]) | (w[1:] != w[:-1])]) if len(some) else np.zeros(0, np.int64)
            if len(first):
                n, mask = np.add.reduceat(learnt[order].astype(np.int64), first), np.bitwise_or.reduceat(bit[order], first)
                yield pa.RecordBatch.from_arrays([pa.array(v[first].view(np.int64)), pa.array(w[first].view(np.int64)), pa.array(np.full(len(first), -1, np.int32)), pa.array(n), pa.array(mask)], ["v", "w", "shard", "c", "parts"])
            if all_counted:
                continue
            other = at[number[at] == known.others]
            if len(other):
                shard = _shard(padded[other - 1], _part(parts_of[number[other - 1]], padded[other - 2]), shards)
                order = np.lexsort((padded[other], shard))
                w, shard = padded[other][order], shard[order]
                first = np.flatnonzero(np.r_[True, (w[1:] != w[:-1]) | (shard[1:] != shard[:-1])])
                none = pa.nulls(len(first), pa.int64())
                yield pa.RecordBatch.from_arrays([none, pa.array(w[first].view(np.int64)), pa.array(shard[first].astype(np.int32)), none, none], ["v", "w", "shard", "c", "parts"])

    def to_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        parts_of = known.parts
        for batch in batches:
            v, w, c, mask = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            n_parts = parts_of[known.number(v.view(np.uint64), np.zeros(0, np.uint64))]
            for k in range(64):
                some = np.flatnonzero(mask >> k & 1)
                each = np.maximum(1, n_parts[some] // 64)  # the parts of a group
                part = np.repeat(k * each, each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
                some = np.repeat(some, each)
                if len(some):
                    shard = _shard(v[some].view(np.uint64), part, shards)
                    yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32)), pa.array(v[some]), pa.array(part.astype(np.int32)), pa.array(w[some]), pa.array(c[some])], ["shard", "v", "part", "w", "c"])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        parts_of = known.parts
        for batch in slices(batches, "_text", 8 << 20):
            data, offsets = flat_bytes(batch.column(1))
            # Batches of the same texts have one name, and the same sums.
            name = hashlib.blake2b(data, digest_size=16, key=hashlib.blake2b(offsets.tobytes()).digest()).digest()
            padded, at, doc = _trigrams(batch.column(1))
            number, names = known.split(padded)
            v = number[at - 1]
            n_parts = np.ones(len(v), np.int64)
            n_parts[v < known.others] = parts_of[v[v < known.others]]
            shard = _shard(padded[at - 1], _part(n_parts, padded[at - 2]), shards)
            order = np.argsort(shard.astype(np.uint16) if shards <= 1 << 16 else shard, kind="stable")
            cuts = np.searchsorted(shard[order], np.arange(shards + 1))
            held = batch.column(2).to_numpy(zero_copy_only=False)
            ids, none = batch.column(0).fill_null(0).to_numpy().view(np.uint64), batch.column(0).is_null().to_numpy(zero_copy_only=False)
            own = _pack([ids & np.uint64(0xFFFFFFFF), ids >> np.uint64(32), none + 2 * held])
            out: list[list] = [[int.from_bytes(name[:4], "little") % shards], [0], [None], [None], [name], [len(held)], [own]]
            for s in np.flatnonzero(np.diff(cuts)).tolist():
                some = order[cuts[s] : cuts[s + 1]]
                present, runs = np.unique(doc[some], return_counts=True)
                block = number[at[some] - np.array([[2], [1], [0]])]
                other = block >= known.others
                used, place = np.unique(block[other], return_inverse=True)
                block[other] = known.others + place
                rows_of = _pack([np.diff(present, prepend=0), runs, held[present]])
                for column, value in zip(out, (s, len(some), _pack(list(block)), names[used - known.others].view(np.int64), name, len(present), rows_of), strict=True):
                    column.append(value)
            kinds = [pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["shard", "n", "packed", "names", "batch", "n_rows", "rows"])

    def answer(key: tuple, part: pa.Table, given: pa.Table) -> pa.Table:
        known = sent.value
        passed = part.filter(pc.equal(part.column("n"), 0)).select(["batch", "n_rows", "rows"])
        passed = passed.append_column("sums", pa.array([False] * passed.num_rows, pa.bool_()))
        part = part.filter(pc.greater(part.column("n"), 0))
        if not part.num_rows:
            return passed
        first, parts_of = known.others, known.parts
        class_of = np.r_[0, np.cumsum(parts_of)]  # of the symbols; every other word has one class
        own = [x.values.to_numpy(zero_copy_only=False).view(np.uint64) for x in part.column("names")]
        names = np.unique(np.concatenate(own))
        hashes = np.r_[known.hashes, _BEFORE, names]
        width = np.uint64(len(hashes))
        all_docs, all_runs, all_held = zip(*(_unpack(x.as_py(), m.as_py(), 3) for x, m in zip(part.column("rows"), part.column("n_rows"), strict=True)), strict=True)
        all_runs, all_held = [x.astype(np.int64) for x in all_runs], [x > 0 for x in all_held]
        sizes = part.column("n").to_pylist()
        cuts = np.r_[0, np.flatnonzero(np.diff(np.cumsum(sizes) // max(1, shard_tokens // BLOCKS))) + 1, len(sizes)]

        def block(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
            """Distinct trigrams (class and u, w) of some packed rows, by columns, and the trigram of each occurrence."""
            columns = [[], [], []]
            for k in range(a, b):
                place = (first + np.searchsorted(names, own[k])).astype(np.int32)
                for to, column in zip(columns, _unpack(part.column("packed")[k].as_py(), sizes[k], 3), strict=True):
                    column = column.astype(np.int32)
                    other = column >= first
                    column[other] = place[column[other] - first]
                    to.append(column)
            u, v, w = (np.concatenate(c) for c in columns)
            cls = np.where(v < first, class_of[np.minimum(v, first)], class_of[-1] + v - first)
            hot = np.flatnonzero(np.r_[parts_of, np.ones(len(names), np.int64)][v] > 1)
            cls[hot] += _part(parts_of[v[hot]], hashes[u[hot]])
            context, of = np.unique(cls.astype(np.uint64) * width + u.astype(np.uint64), return_inverse=True)
            tri, at = np.unique(of.astype(np.uint64) * width + w.astype(np.uint64), return_inverse=True)
            context = context[(tri // width).astype(np.int64)]
            return np.stack([(context // width).astype(np.int32), (context % width).astype(np.int32), (tri % width).astype(np.int32)]), at

        g_part, g_w, g_c = (given.column(c).to_numpy() for c in ("part", "w", "c"))
        g_hash, g_w = g_w.view(np.uint64), known.number(g_w.view(np.uint64), names)
        counts = np.zeros(len(names), np.int64)
        single = g_part < 0
        counts[g_w[single] - first] = g_c[single]
        g_v = known.number(given.column("v").to_numpy().view(np.uint64)[~single], names)
        log_unigram = known.log_unigram(counts)
        found, kept, hot_cls = [], None, []
        split = np.flatnonzero(parts_of > 1)
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            tri, at = block(a, b)
            kept = (tri, at)  # a shard of one block is not read twice
            learnt = np.repeat(~np.concatenate(all_held[a:b]), np.concatenate(all_runs[a:b]))
            c3 = np.bincount(at[learnt], minlength=tri.shape[1])
            found.append(np.vstack([tri, c3.astype(np.int32)])[:, c3 > 0])
            present = np.unique(tri[0])
            near = split[np.maximum(np.searchsorted(class_of[split], present, side="right") - 1, 0)] if len(split) else np.zeros(0, np.int64)
            hot_cls.append(present[(class_of[near] <= present) & (present < class_of[near + 1])] if len(split) else present[:0])
        n_found, tri = len(found), np.concatenate(found, axis=1)
        del found
        if n_found > 1:
            order = np.lexsort((tri[2], tri[1], tri[0]))
            tri = tri[:, order]
            new = np.flatnonzero(np.r_[True, (tri[:3, 1:] != tri[:3, :-1]).any(0)]) if tri.shape[1] else np.zeros(0, np.int64)
            tri = np.vstack([tri[:3, new], np.add.reduceat(tri[3], new)[None] if len(new) else tri[3:]])
        hot = np.unique(np.concatenate(hot_cls))
        hot_total = known.counts[np.searchsorted(class_of, hot, side="right") - 1]
        g_cls, g_hash, g_w, g_c = class_of[g_v] + g_part[~single], g_hash[~single], g_w[~single], g_c[~single]
        met = np.isin(g_cls, hot) & (hashes[np.minimum(g_w, len(hashes) - 1)] == g_hash)  # others of a group of parts may ask for more
        trie = Trie(*tri, log_unigram, hot, hot_total, (g_cls[met], g_w[met], g_c[met]), prior_2, prior_3)
        del tri
        seen = np.r_[known.counts, 0, 0, counts] > 0
        totals = []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            tri, at = kept if len(cuts) == 2 else block(a, b)
            runs = np.concatenate(all_runs[a:b])
            doc = np.repeat(np.arange(len(runs)), runs)
            log_p = np.concatenate([trie.log_p(*tri[:, i : i + (1 << 18)]) for i in range(0, tri.shape[1], 1 << 18)])
            add_up = lambda x: np.bincount(doc, x[at], minlength=len(runs))  # noqa: B023, E731
            totals.append(np.stack([add_up(seen[tri[2]]), add_up(log_unigram[tri[2]]), add_up(log_p)]))
        n_known, base, score = np.concatenate(totals, axis=1)
        packed, seen_batches, a = [], {}, 0
        base, score = (np.round(x * FIXED).astype(np.int64).view(np.uint64) for x in (base, score))
        for k, (name, steps, runs) in enumerate(zip(part.column("batch").to_pylist(), all_docs, all_runs, strict=True)):
            b = a + len(steps)
            if name not in seen_batches:
                seen_batches[name] = k
                halves = [h for x in (base[a:b], score[a:b]) for h in (x & np.uint64(0xFFFFFFFF), x >> np.uint64(32))]
                packed.append(_pack([steps, runs, n_known[a:b], *halves]))
            a = b
        kept = part.take(pa.array(seen_batches.values(), pa.int64())).select(["batch", "n_rows"])
        told = kept.append_column("rows", pa.array(packed, pa.binary())).append_column("sums", pa.array([True] * len(packed), pa.bool_()))
        return pa.concat_tables([passed, told.cast(passed.schema)])

    def add(part: pa.Table) -> pa.Table:
        """The rows of the batches of one name, from the sums that every shard has of them."""
        told = [x for x in part.select(["n_rows", "rows", "sums"]).to_pylist() if x["sums"]]
        own = [_unpack(x["rows"], x["n_rows"], 3) for x in part.select(["n_rows", "rows", "sums"]).to_pylist() if not x["sums"]]
        sums = np.zeros((4, len(own[0][0])), np.int64)
        for x in told:
            steps, runs, known, *halves = _unpack(x["rows"], x["n_rows"], 7)
            whole = [(lo.astype(np.uint64) + (hi.astype(np.uint64) << np.uint64(32))).view(np.int64) for lo, hi in (halves[:2], halves[2:])]
            sums[:, np.cumsum(steps)] += np.stack([runs.astype(np.int64), known.astype(np.int64), *whole])
        n, known, base, score = (np.tile(x, len(own)) for x in sums)
        lo, hi, flags = (np.concatenate([o[i] for o in own]) for i in range(3))
        ids = (lo.astype(np.uint64) + (hi.astype(np.uint64) << np.uint64(32))).view(np.int64)
        return pa.table({"_id": pa.array(ids, mask=(flags & 1) > 0), "_held": pa.array((flags & 2) > 0), "n": n, "known": known, "base": base, "score": score})

    asked = rows.select("_text", "_held").mapInArrow(ask, "v long, w long, shard int, c long, parts long")
    asked = staged(asked.groupBy("v", "w", "shard").agg(F.sum("c").alias("c"), F.bit_or("parts").alias("parts")), "asked")
    given = asked.where("c > 0").select("v", "w", "c", "parts").mapInArrow(to_parts, "shard int, v long, part int, w long, c long")
    if not all_counted:
        single = asked.where("v IS NULL").select("shard", F.col("w").alias("token")).join(vocabulary, "token")
        given = given.unionByName(single.select("shard", F.lit(0).cast("long").alias("v"), F.lit(-1).alias("part"), F.col("token").alias("w"), "c"))
    shared = rows.mapInArrow(spread, "shard int, n long, packed binary, names array<long>, batch binary, n_rows int, rows binary")
    answers = shared.groupBy("shard").cogroup(given.groupBy("shard")).applyInArrow(answer, "batch binary, n_rows int, rows binary, sums boolean")
    whole = answers.groupBy("batch").applyInArrow(add, "_id long, _held boolean, n long, known long, base long, score long")
    return whole.select(
        F.col("_id").alias(id_col),
        F.col("_held").alias("held_out"),
        F.col("n").alias("n_tokens"),
        F.col("known").alias("n_known"),
        F.lit(table.tokens).cast("long").alias("train_tokens"),
        (F.col("base") / FIXED).alias("base_score"),
        (F.col("score") / FIXED).alias("score"),
    )
