"""One query for each corpus operator, over the driver's whole tables, with SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    collocations, embedding_dedup, language, merkle, packing, piece_codec, quality, sharding, simhash, suffix_dedup, token_files, toxicity, url_filter,
)

#: The fixed rules of op6.
URL_RULES = [
    ("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"),
]


def tokenizer_file(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(_table(spark, sf_dir, "documents"), shingle=4, distance=4)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(_table(spark, sf_dir, "documents"), 8)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), 2048, 1)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"), 200)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judged.select(*names, "rule_number")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(_table(spark, sf_dir, "pages"), URL_RULES)


OP6_SQL = """
WITH cut AS (
  SELECT page_id, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS rest
  FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
), judged AS (
  SELECT page_id, host, path, CASE
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/7') THEN 'example.com/en/7'
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/de/8') THEN 'example.net/de/8'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/en/') THEN 'com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/de/') THEN 'net/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/es/') THEN 'org/es/' END AS rule
  FROM parts
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('com/en/', 'example.net/de/8', 'org/es/') THEN 'block' ELSE 'allow' END AS verdict
FROM judged
"""


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify_languages(_table(spark, sf_dir, "documents"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_file_rows(_table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), 2)


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.link_vectors(_table(spark, sf_dir, "embeddings"), 0.9)


#: All pairs, so for small tables; the operator's recall there is full, as no pair lies near the threshold.
OP9_SQL = """
WITH RECURSIVE given AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), fine AS (
  SELECT * FROM given WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), pairs AS (
  SELECT a.vec_id AS i, b.vec_id AS j FROM fine a JOIN fine b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.9
), reached(a, b) AS (
  SELECT vec_id, vec_id FROM given UNION SELECT r.a, p.j FROM reached r JOIN pairs p ON r.b = p.i
), components AS (
  SELECT a AS vec_id, min(b) AS component_id FROM reached GROUP BY a
)
SELECT vec_id, (SELECT count(*) FROM pairs WHERE i = components.vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM components
"""


def op10_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.encode_documents(_table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = toxicity.judge_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "held_out", "score", "predicted", "n_sentences", F.size("offending").cast("bigint").alias("n_offending"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine_collocations(_table(spark, sf_dir, "documents"), longest=5, least=100, cover=100, most=2000)


OP12_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents WHERE text IS NOT NULL
), words AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces
), windows AS (
  SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM words, (SELECT unnest([1, 2, 3, 4, 5]) AS m) WHERE len(w) >= m
), counts AS (
  SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase, count(*) AS f FROM windows GROUP BY ALL
), totals AS (
  SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE m = 1 GROUP BY lang
), candidates AS (
  SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE m > 1 AND f >= 100
), cuts AS (
  SELECT lang, phrase, a, w, m, unnest(range(1, m)) AS k FROM candidates
), scored AS (
  SELECT c.lang, c.phrase, c.a, c.k, x.f AS l, y.f AS r, t.n, (1000::HUGEINT * c.a * t.n) // (x.f::HUGEINT * y.f) AS score
  FROM cuts c
  JOIN counts x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.k], ' ')
  JOIN counts y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.k + 1:], ' ')
  JOIN totals t ON t.lang = c.lang
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), left_over AS (
  SELECT * FROM best b WHERE NOT EXISTS (
    SELECT 1 FROM candidates c WHERE c.lang = b.lang AND c.phrase <> b.phrase AND 100 * c.a >= 100 * b.a AND contains(' ' || c.phrase || ' ', ' ' || b.phrase || ' '))
)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM left_over)
WHERE rank <= 2000
"""


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 0
    return merkle.verified_documents(_table(spark, sf_dir, "documents"), tampered)


#: crc32 is worked out bit by bit, trees and proofs level by level.
OP13_SQL = """
WITH RECURSIVE given AS (
  SELECT doc_id, lang, n_chars,
         coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
         coalesce(strlen(text) || ':' || text, '-') AS tail,
         xor(4294967295, list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(CASE WHEN doc_id IS NULL THEN CAST([] AS VARCHAR[]) ELSE string_split(CAST(doc_id AS VARCHAR), '') END, lambda d: CAST(ascii(d) AS BIGINT))),
           lambda c, d: list_reduce(list_concat([xor(c, d)], CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])), lambda x, b: xor(x >> 1, (x & 1) * 3988292384)))) % 7 = 0 AND doc_id IS NOT NULL AS bad
  FROM documents
), leaves AS (
  SELECT doc_id, lang, sha256(head || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || tail) AS leaf,
         sha256(head || coalesce(strlen(CAST(n_chars + CAST(bad AS BIGINT) AS VARCHAR)) || ':' || (n_chars + CAST(bad AS BIGINT)), '-') || tail) AS shown
  FROM given
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS nth, count(*) OVER (PARTITION BY lang) AS n FROM leaves
), nodes(lang, level, nth, n, h) AS (
  SELECT lang, 0, nth, n, leaf FROM ranked
  UNION ALL
  SELECT lang, level + 1, nth // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY nth)) FROM nodes WHERE n > 1 GROUP BY lang, level, nth // 2, n
), subroots AS (
  SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS nth, count(*) OVER () AS n FROM nodes WHERE n = 1
), tops(level, nth, n, h) AS (
  SELECT 0, nth, n, h FROM subroots
  UNION ALL
  SELECT level + 1, nth // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY nth)) FROM tops WHERE n > 1 GROUP BY level, nth // 2, n
), lower(lang, nth, place, level, proof, node) AS (
  SELECT lang, nth, nth, 0, '', shown FROM ranked
  UNION ALL
  SELECT l.lang, l.nth, l.place // 2, l.level + 1, l.proof || coalesce(s.h, ''),
         sha256(CASE WHEN l.place % 2 = 0 THEN l.node || coalesce(s.h, '') ELSE s.h || l.node END)
  FROM lower l
  JOIN nodes o ON o.lang IS NOT DISTINCT FROM l.lang AND o.level = l.level AND o.nth = l.place AND o.n > 1
  LEFT JOIN nodes s ON s.lang IS NOT DISTINCT FROM l.lang AND s.level = l.level AND s.nth = xor(l.place, 1)
), upper(lang, nth, place, level, proof, node) AS (
  SELECT l.lang, l.nth, r.nth, 0, l.proof, l.node
  FROM lower l JOIN nodes o ON o.lang IS NOT DISTINCT FROM l.lang AND o.level = l.level AND o.n = 1
  JOIN subroots r ON r.lang IS NOT DISTINCT FROM l.lang
  UNION ALL
  SELECT u.lang, u.nth, u.place // 2, u.level + 1, u.proof || coalesce(s.h, ''),
         sha256(CASE WHEN u.place % 2 = 0 THEN u.node || coalesce(s.h, '') ELSE s.h || u.node END)
  FROM upper u
  JOIN tops o ON o.level = u.level AND o.nth = u.place AND o.n > 1
  LEFT JOIN tops s ON s.level = u.level AND s.nth = xor(u.place, 1)
), final AS (
  SELECT u.lang, u.nth, u.proof, u.node, o.h AS root FROM upper u JOIN tops o ON o.level = u.level AND o.n = 1
)
SELECT r.doc_id, r.leaf, s.h AS subroot, f.root, sha256(f.proof) AS proof_sha256, f.node AS folded_root, f.node = f.root AS verified
FROM ranked r JOIN final f ON f.lang IS NOT DISTINCT FROM r.lang AND f.nth = r.nth JOIN subroots s ON s.lang IS NOT DISTINCT FROM r.lang
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_simhash, op2_sharding, op3_packing, op4_suffix_dedup, op5_quality_rules, op6_url_filter, op7_language_id, op8_token_files,
        op9_embedding_dedup, op10_piece_codec, op11_toxicity, op12_collocations, op13_merkle,
    )}


def oracle_sql() -> dict[str, str]:
    return {"op6_url_filter": OP6_SQL, "op9_embedding_dedup": OP9_SQL, "op12_collocations": OP12_SQL, "op13_merkle": OP13_SQL}
