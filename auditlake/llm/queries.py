"""The corpus operators as named queries with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm.bpe import bpe_round_trip
from auditlake.llm.collocations import collocations
from auditlake.llm.common import ascii_lower, in_fold, read_table, staged, text_of
from auditlake.llm.exact_dedup import exact_dedup
from auditlake.llm.exact_topk import exact_topk
from auditlake.llm.jaccard_join import jaccard_groups
from auditlake.llm.line_dedup import line_dedup
from auditlake.llm.lm_scoring import lm_score
from auditlake.llm.packing import pack_documents
from auditlake.llm.periodic_runs import run_digests
from auditlake.llm.sharding import shard_digests
from auditlake.llm.suffix_dedup import suffix_dedup
from auditlake.llm.token_store import token_store
from auditlake.llm.toxicity import tag_toxicity, train

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size: words and one end token. Cluster: near copies as op5 links them; one text, A-Z lower-cased, where op5 has no shingles or no id."""
    docs = read_table(spark, sf_dir, "documents")
    # Only rows without words or id are named by their text: lowering and hashing all texts is not needed.
    alone = F.col("doc_id").isNull() | ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    same = F.when(alone, F.xxhash64(ascii_lower(text_of("text"))))
    # Words are counted as the join reads the texts. Written, as the rows are read several times.
    rows = staged(jaccard_groups(docs.select("doc_id", "source", "text", same.alias("_same")), keep=("source", "_same"), words="_n"), "packing-rows")
    told = rows.where("n_shingles > 0").withColumn("_component", F.col("component_id"))
    linked = told.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("component_id").alias("_component"))
    sized = told.unionByName(rows.where("n_shingles = 0").join(linked, "doc_id", "left"))
    cluster = F.coalesce(F.concat(F.lit("near "), F.col("_component").cast("string")), F.concat(F.lit("same "), F.col("_same").cast("string")))
    return pack_documents(sized.select("doc_id", "source", "_n", cluster.alias("_cluster")), F.col("_n") + 1, F.col("source"), F.col("_cluster"), capacity=2048)


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup(read_table(spark, sf_dir, "documents").select("doc_id", "text"), length=400)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(read_table(spark, sf_dir, "documents"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score(read_table(spark, sf_dir, "documents").select("doc_id", "text"), in_fold(F.col("doc_id"), 7, 2))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, read_table(spark, sf_dir, "labels"), ~in_fold(F.col("doc_id"), 5, 0))
    tagged = tag_toxicity(docs, model)
    return tagged.select("doc_id", in_fold(F.col("doc_id"), 5, 0).alias("held_out"), "score", "predicted", F.size("spans").alias("n_spans"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(read_table(spark, sf_dir, "documents"), TOKENIZER)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read_table(spark, sf_dir, "documents"), keep="largest")


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store(read_table(spark, sf_dir, "documents"), TOKENIZER)


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_digests(read_table(spark, sf_dir, "documents"), shards=24)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read_table(spark, sf_dir, "documents"), least=100, top=2000)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_line_dedup, op2_best_fit_packing, op3_exact_topk, op4_suffix_array_dedup, op5_jaccard_join, op6_lm_scoring, op7_toxicity, op8_bpe, op9_exact_dedup, op10_token_store, op11_sharding, op12_collocations, op13_periodic_runs)
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

ORACLE: dict[str, str] = {
    "op1_line_dedup": f"""
        WITH cut AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
        l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM cut),
        k AS (SELECT *, {_LOWER.format(f"trim(line, {_BLANK})")} AS key FROM l),
        s AS (SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
        j AS (SELECT k.doc_id, k.pos, k.line, s.key IS NOT NULL AND k.doc_id <> s.owner AS gone FROM k LEFT JOIN s ON k.key = s.key)
        SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
        FROM j GROUP BY doc_id""",
    "op3_exact_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings),
        p AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
              FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
        SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20""",
    "op5_jaccard_join": f"""
        WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
        s AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
              ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END) AS g FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
        l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
        e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
        SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.b) AS component_id
        FROM documents d LEFT JOIN n USING (doc_id) JOIN r ON r.a = d.doc_id GROUP BY d.doc_id""",
    "op9_exact_dedup": f"""
        WITH n AS (SELECT doc_id, {_LOWER.format("coalesce(text, '')")} AS t FROM documents),
        g AS (SELECT t, max(doc_id) AS keep_id, count(*)::BIGINT AS group_size FROM n GROUP BY t)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM n JOIN g USING (t)""",
    "op12_collocations": f"""
        WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
        w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM p),
        t AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM w GROUP BY lang),
        g AS (SELECT lang, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM w, range(1, 6) AS s(k)),
        f AS (SELECT lang, phrase, count(*) AS f FROM g GROUP BY lang, phrase HAVING count(*) >= 100),
        c AS (SELECT lang, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE contains(phrase, ' ')),
        i AS (SELECT DISTINCT c.lang, array_to_string(c.w[x:x + y - 1], ' ') AS phrase, c.a FROM c, range(1, 5) AS s(x), range(2, 5) AS u(y) WHERE y < len(c.w) AND x + y - 1 <= len(c.w)),
        k AS (SELECT c.* FROM c WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.lang = c.lang AND i.phrase = c.phrase AND 100 * i.a >= 100 * c.a)),
        u AS (SELECT k.lang, k.phrase, k.a, t.n, x, l.f AS l, r.f AS r, (1000::HUGEINT * k.a * t.n) // (l.f::HUGEINT * r.f) AS score
              FROM k JOIN t ON t.lang = k.lang, range(1, 5) AS s(x) JOIN f l ON l.lang = k.lang AND l.phrase = array_to_string(k.w[1:x], ' ')
              JOIN f r ON r.lang = k.lang AND r.phrase = array_to_string(k.w[x + 1:], ' ') WHERE x < len(k.w)),
        b AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, x) = 1),
        o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b)
        SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM o WHERE rank <= 2000""",
}
