"""The registered queries of the training-data operators and the DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from modalens.llm import fingerprints, lang_id, licences, media, mixing, near_dup, packing, pii, prefix_trie, search, simhash, suffix_dedup, token_counts
from modalens.llm.common import documents


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(documents(spark, sf_dir), w=2)


def with_paths(docs: DataFrame) -> DataFrame:
    """Documents as files of a tree, three levels by id. Those with a line on a licence are their directory's LICENSE.

    Two fifths of these stand in the directory above, and one fifth at the top, so that files inherit from every level.
    """
    i = F.col("doc_id")
    top, mid, low = (F.concat(F.lit(name), F.floor(i / d).cast("string")) for name, d in (("t", 100_000), ("m", 1_000), ("l", 50)))
    name = F.when(F.col("text").rlike(licences.MARK), F.lit("LICENSE")).otherwise(F.concat(i.cast("string"), F.lit(".txt")))
    up = F.when(name == "LICENSE", F.pmod(i, F.lit(5))).otherwise(F.lit(4))
    folder = F.when(up == 0, F.concat_ws("/", F.lit(""), top)).when(up <= 2, F.concat_ws("/", F.lit(""), top, mid)).otherwise(F.concat_ws("/", F.lit(""), top, mid, low))
    return docs.select("doc_id", F.concat(folder, F.lit("/"), name).alias("path"), "text")


def op3_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.licences(with_paths(documents(spark, sf_dir)))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(documents(spark, sf_dir))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.language(documents(spark, sf_dir))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digest(documents(spark, sf_dir))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digest(documents(spark, sf_dir))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(documents(spark, sf_dir), digest=True)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).drop("source")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_duplicates(documents(spark, sf_dir))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(prefix_trie.rebuilt(prefix_trie.turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


#: Exact sets, a prefix join (rare shingles first, no link is lost), confirmed links and a recursive walk over them.
OP2_SQL = r"""WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS s FROM words
), sized AS (SELECT doc_id, s, len(s) AS n FROM sets),
grams AS (SELECT doc_id, n, hash(g) AS g FROM (SELECT doc_id, n, unnest(s) AS g FROM sized)),
uses AS (SELECT g, count(*) AS uses FROM grams GROUP BY g),
placed AS (
  SELECT doc_id, n, g, row_number() OVER (PARTITION BY doc_id ORDER BY uses, g) AS place FROM grams JOIN uses USING (g)
), prefix AS (SELECT * FROM placed WHERE place <= n - ceil(0.8 * n) + 1),
pairs AS (
  SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM prefix a JOIN prefix b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n
), links AS (
  SELECT a, b FROM (SELECT p.a, p.b, x.n AS na, y.n AS nb, len(list_intersect(x.s, y.s)) AS common FROM pairs p JOIN sized x ON x.doc_id = p.a JOIN sized y ON y.doc_id = p.b)
  WHERE 100 * common >= 80 * (na + nb - common)
), edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM sized UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON r.other = e.a),
label AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM sized JOIN label USING (doc_id)"""


#: Scores of all pairs that share a term.
OP11_SQL = r"""WITH terms AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
), tf AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY ALL),
sizes AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
whole AS (SELECT count(*) AS docs, sum(n)::BIGINT AS length FROM sizes),
uses AS (
  SELECT item_id, term, count(*) AS uses FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
  ) GROUP BY ALL
), weights AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, whole GROUP BY term, docs
), impacts AS (
  SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // length))) AS x
  FROM tf JOIN sizes USING (doc_id) JOIN weights USING (term), whole WHERE term IN (SELECT term FROM uses)
), scores AS (SELECT item_id, doc_id, sum(uses * x)::BIGINT AS score FROM uses JOIN impacts USING (term) GROUP BY ALL),
placed AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM placed WHERE rank <= 10"""

#: crc32 bit by bit, every conversation's prefixes as lists of digests, subtrees by joining nodes to the prefixes of their smallest members.
OP13_SQL = r"""WITH own AS (
  SELECT conv_id, list(x ORDER BY turn NULLS FIRST, r, x) AS t,
    list(n ORDER BY turn NULLS FIRST, r, x) AS w
  FROM (SELECT conv_id, turn, coalesce(role, '') AS r, sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS x, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n FROM conversations WHERE conv_id IS NOT NULL) GROUP BY conv_id
), codes AS (
  SELECT list(list_reduce([i::UBIGINT] || [0::UBIGINT FOR x IN range(8)], lambda c, x: xor(c // 2, (c % 2) * 3988292384)) ORDER BY i) AS code FROM range(256) r(i)
), heads AS (
  SELECT conv_id, t, w, (xor(4294967295::UBIGINT, list_reduce([4294967295::UBIGINT] || [ascii(x)::UBIGINT FOR x IN string_split(conv_id::VARCHAR, '')], lambda c, x: xor(c // 256, code[xor(c % 256, x)::INT + 1]))) % 4)::INT AS h FROM own, codes
), built AS (
  SELECT c.conv_id, coalesce(b.t, [])[1:h] || c.t[h + 1:] AS t, coalesce(b.w, [])[1:h] || c.w[h + 1:] AS w
  FROM heads c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 20
), steps AS (SELECT conv_id, d, sha256(array_to_string(t[1:d], ',')) AS node, sha256(array_to_string(t[1:d - 1], ',')) AS up, CASE WHEN d > 0 THEN w[d] ELSE 0 END AS words, d = len(t) AS ended FROM (SELECT *, unnest(range(len(t) + 1)) AS d FROM built)),
nodes AS (
  SELECT node, d, any_value(up) AS up, any_value(words) AS words, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ended), '')) AS ends_sha256
  FROM steps GROUP BY node, d
), kids AS (SELECT up, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY up),
known AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN kids k ON k.up = n.node),
sums AS (
  SELECT s.node, sum((v.n_convs - 1) * v.words)::BIGINT AS saved_tokens, count(*) FILTER (v.n_children = 0) AS n_leaves
  FROM known v JOIN steps s ON s.conv_id = v.conv_id AND s.d <= v.d GROUP BY s.node
)
SELECT v.conv_id, v.d::BIGINT AS depth, CASE WHEN v.d > 0 THEN p.conv_id END AS parent_conv_id, v.n_convs, v.n_children, n_leaves, saved_tokens, v.ends_sha256
FROM known v JOIN sums USING (node) LEFT JOIN nodes p ON p.node = v.up AND v.d > 0"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_counts, op2_near_duplicates, op3_licences, op4_fingerprints, op5_language, op6_media, op7_pii, op8_packing, op9_suffix_dedup, op10_mixing, op11_ranked_search, op12_simhash, op13_prefix_trie, pipeline)}


def oracle_sql() -> dict[str, str]:
    """Links and components need no sketch to be told in SQL; tokenizers, trained models and programmes do, tests hold these."""
    return {"op2_near_duplicates": OP2_SQL, "op11_ranked_search": OP11_SQL, "op13_prefix_trie": OP13_SQL, **({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})}
