"""The operators as registered queries over the given tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrelwatch.llm import byte_gru, chat_snapshots, chosen_path, decontaminate, noise_lm, projection_forest, row_bpe, table_kmeans, tag_ratio, token_counts, token_shards, trie_bpe, variant_trie

BYTE_BPE = "byte_bpe_50k.json"
RANKS = "byte_bpe_multi_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return projection_forest.search(vectors, vectors.where(F.col("vec_id") % 100 == 0))


def op2_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return noise_lm.score_documents(table(spark, sf_dir, "documents"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_snapshots.maximal_chats(table(spark, sf_dir, "conversations"))


OP3_SQL = """
WITH t AS (SELECT DISTINCT conv_id, CASE WHEN conv_id IS NULL THEN md5(concat_ws('/', turn, role, text)) END AS alone, turn,
           coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
r AS (SELECT *, '<|im_start|>' || replace(replace(role, '<|im_start|>', '< |im_start|>'), '<|im_end|>', '< |im_end|>') || chr(10)
      || replace(replace(text, '<|im_start|>', '< |im_start|>'), '<|im_end|>', '< |im_end|>') || '<|im_end|>' || chr(10) AS line FROM t),
c AS (SELECT conv_id, alone, count(*) AS n_turns, string_agg(line, '' ORDER BY turn NULLS FIRST, role, text) AS chat FROM r GROUP BY conv_id, alone),
b AS (SELECT DISTINCT string_agg(line, '') OVER (PARTITION BY conv_id, alone ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING) AS chat,
      row_number() OVER (PARTITION BY conv_id, alone ORDER BY turn NULLS FIRST, role, text) AS place,
      count(*) OVER (PARTITION BY conv_id, alone) AS n FROM r)
SELECT min(conv_id) AS conv_id, n_turns, count(*) AS n_copies, chat FROM c
WHERE chat NOT IN (SELECT chat FROM b WHERE place < n) GROUP BY n_turns, chat
"""


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.similarity_join(table(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), decoded=True).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated"
    )


# What parts words, for the SQL of a regular expression.
SQL_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SQL_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP7_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({SQL_LOWER}, '{SQL_WORD}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({SQL_LOWER}, '{SQL_WORD}') AS w FROM benchmark),
bw AS (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS s FROM bw),
size AS (SELECT DISTINCT n FROM win),
dw AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, size WHERE len(w) >= n),
hit AS (SELECT DISTINCT r, i, dw.n, item_id FROM (SELECT r, i, n, array_to_string(w[i : i + n - 1], ' ') AS s FROM dw) dw JOIN win ON dw.s = win.s AND dw.n = win.n),
words AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + n)) AS k FROM hit) x GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
          FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item_id FROM hit WHERE item_id IS NOT NULL) y GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tag_ratio.extract(table(spark, sf_dir, "pages"))


def op9_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_shards.shard_digest(spark, table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = byte_gru.predict(docs, byte_gru.train(docs))
    return found.select("doc_id", byte_gru.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variant_trie.variants(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH RECURSIVE tab AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(CAST(i AS BIGINT), range(8)),
       lambda c, j: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
runs AS MATERIALIZED (SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS s, run, count(*) AS n FROM
       (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents) x
       WHERE length(run) >= 5 GROUP BY ALL),
bytes AS (SELECT s, run, n, hex(encode(s)) AS b FROM runs),
crc AS (SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(length(b) // 2), lambda i: CAST(('0x' || substr(b, 2 * i + 1, 2)) AS BIGINT))),
       lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8))) AS h FROM bytes, tab),
w AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM
       (SELECT n, CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM crc) y
       WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
cut AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w) z),
near AS (SELECT a.word, b.word AS other, b.n AS m FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
         UNION SELECT c.word, w.word, w.n FROM cut c JOIN w ON c.rest = w.word
         UNION SELECT w.word, c.word, c.n FROM cut c JOIN w ON c.rest = w.word),
best AS (SELECT word, count(*) AS n_near, arg_min(other, (-m, encode(other))) AS other, max(m) AS m FROM near GROUP BY word),
f AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * w.n THEN other END AS form, CASE WHEN m >= 2 * w.n THEN m END AS form_n FROM w LEFT JOIN best USING (word)),
step AS (SELECT word, word AS place, 0 AS k FROM f UNION ALL SELECT step.word, f.form, k + 1 FROM step JOIN f ON f.word = step.place WHERE f.form IS NOT NULL),
root AS (SELECT word, arg_max(place, k) AS root FROM step GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM f JOIN root USING (word)
"""


def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table_kmeans.cluster(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


_NEAREST = """AS MATERIALIZED (SELECT r, arg_min(c, (q, c)) AS c, min(q) AS q FROM
      (SELECT r, c, CAST(sum((v - m) * (v - m)) AS BIGINT) AS q FROM x JOIN c{i} USING (d) GROUP BY r, c) y GROUP BY r)"""
_ROUND = f""",
a{{i}} {_NEAREST},
t{{i}} AS (SELECT c, d, CAST(sum(v) AS BIGINT) AS s, count(*) AS n FROM x JOIN a{{i}} USING (r) GROUP BY c, d),
c{{j}} AS MATERIALIZED (SELECT c, d, CASE WHEN n IS NULL THEN m ELSE (s - ((s % n) + n) % n) // n END AS m FROM c{{i}} LEFT JOIN t{{i}} USING (c, d))"""

OP12_SQL = f"""
WITH e AS (SELECT row_number() OVER () AS r, vec_id, embedding FROM embeddings WHERE len(embedding) = 64 AND
           len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x) OR abs(floor(64 * CAST(x AS DOUBLE))) > 134217728)) = 0),
k AS (SELECT r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM e),
x AS MATERIALIZED (SELECT r, unnest(range(64)) AS d, unnest(v) AS v FROM k),
s AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, v) - 1 AS c, v FROM k
      QUALIFY row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, v) <= 16),
c0 AS MATERIALIZED (SELECT c, unnest(range(64)) AS d, unnest(v) AS m FROM s){"".join(_ROUND.format(i=i, j=i + 1) for i in range(3))},
a3 {_NEAREST.format(i=3)},
h AS (SELECT c, sha256(string_agg(m, ',' ORDER BY d)) AS centroid_sha256 FROM c3 GROUP BY c)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, q AS distance, CAST(sum(q) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
       CAST(sum(q) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a3 JOIN k USING (r) JOIN h USING (c)
"""


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return row_bpe.encode(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, decoded=True).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_nearest": op1_nearest,
    "op2_lm_scores": op2_lm_scores,
    "op3_chat": op3_chat,
    "op4_token_counts": op4_token_counts,
    "op5_ngram_join": op5_ngram_join,
    "op6_bpe": op6_bpe,
    "op7_decontamination": op7_decontamination,
    "op8_main_text": op8_main_text,
    "op9_token_shards": op9_token_shards,
    "op10_language_id": op10_language_id,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_clusters": op12_clusters,
    "op13_byte_bpe": op13_byte_bpe,
}
SQL: dict[str, str] = {"op3_chat": OP3_SQL, "op7_decontamination": OP7_SQL, "op11_spelling_variants": OP11_SQL, "op12_clusters": OP12_SQL}
