"""One query per operator over the driver tables, with DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefuse.llm import (bpe, codes, graph, jaccard, language, manifest, mixing, packing, quality, secrets, topk,
                          toxicity, warc)
from tidefuse.llm.common import fold, table, vocabulary_path
from tidefuse.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.tokenize_pieces(table(spark, sf_dir, "documents"), vocabulary_path(), size=1024, end_id=2)
    return packing.pack(pieces, size=1024)


@query
def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard.components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id")


ORACLES["op2_ngram_jaccard_join"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
placed AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM words),
grams AS (
  SELECT doc_id, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o || ' ' || lead(word, 3) OVER o
    || ' ' || lead(word, 4) OVER o AS x FROM placed WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
shingles AS (
  SELECT doc_id, x FROM grams WHERE x IS NOT NULL UNION
  SELECT doc_id, array_to_string(w, ' ') FROM words WHERE len(w) BETWEEN 1 AND 4),
sets AS MATERIALIZED (
  SELECT d.doc_id, coalesce(list(x) FILTER (x IS NOT NULL), []) AS s
  FROM documents d LEFT JOIN shingles g ON g.doc_id = d.doc_id GROUP BY d.doc_id),
items AS MATERIALIZED (SELECT doc_id, unnest(s) AS x FROM sets),
links AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM items a JOIN items b ON a.x = b.x AND a.doc_id <> b.doc_id
  JOIN sets p ON p.doc_id = a.doc_id JOIN sets q ON q.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, len(p.s), len(q.s)
  HAVING 100 * count(*) >= 75 * (len(p.s) + len(q.s) - count(*))),
reached AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, min(r.b) AS component_id
FROM sets s JOIN reached r ON r.a = s.doc_id GROUP BY s.doc_id, len(s.s)
"""


@query
def op3_mixture_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 5) == 0
    return language.predict(documents, language.train(documents.where(~held_out)), held_out)


@query
def op4_forced_boundary_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), vocabulary_path())


@query
def op5_markov_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return secrets.scan(documents, secrets.train(documents)).drop("found")


@query
def op6_weak_label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return quality.classify(documents, quality.train(documents))


@query
def op7_multiple_instance_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(fold(F.col("doc_id"), 3) != 1)
    return toxicity.score(documents, toxicity.train(documents, labels), fold(F.col("doc_id"), 3) == 1)


@query
def op8_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "archives")
    warc.write(table(spark, sf_dir, "pages"), path)
    captures = warc.assemble(warc.read(spark, path))
    return captures.select(
        F.col("response.page_id").alias("page_id"),
        F.col("metadata.fields")["payloadBytes"].cast("long").alias("payload_bytes"),
        F.coalesce("response.payload_digest", "response.declared_digest").alias("payload_digest"),
        F.col("response.kind").alias("record_type"), F.col("response.refers_to").alias("refers_to"))


ORACLES["op8_warc_transactions"] = """
WITH payloads AS (
  SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages),
last AS (SELECT html, max(page_id) AS target FROM payloads WHERE n >= 1000 GROUP BY html)
SELECT page_id, n::BIGINT AS payload_bytes, sha1(p.html) AS payload_digest,
  CASE WHEN target <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN target <> page_id THEN target END AS refers_to
FROM payloads p LEFT JOIN last l ON p.html = l.html AND p.n >= 1000
"""


@query
def op9_norm_bucketed_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.whole(table(spark, sf_dir, "embeddings"), scale=256)
    return topk.search(vectors, F.col("vec_id") % 50 == 0, k=5, repeats=True)


ORACLES["op9_norm_bucketed_top_k"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""


@query
def op10_graph_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.near_duplicates(table(spark, sf_dir, "embeddings"))


@query
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    leaves = manifest.claims(documents, tampered, manifest.lower_cased(F.col("text")))
    return manifest.proofs(manifest.build(leaves))


ORACLES["op11_merkle_manifest"] = """
WITH RECURSIVE fields AS (
  SELECT doc_id, coalesce('=' || source, '') AS tree, text,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-')
      || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
    xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT), lambda a, x:
      list_reduce(range(8), lambda r, i: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END, xor(a, x)),
      4294967295::BIGINT), 4294967295) % 5 = 0 AS hit
  FROM documents),
leaves AS (
  SELECT doc_id, tree, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN hit THEN sha256(head || coalesce(strlen(text) || ':' || translate(
      text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS claimed
  FROM fields),
placed AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
    count(*) OVER (PARTITION BY tree) AS n FROM leaves),
nodes AS (
  SELECT 0 AS level, tree, pos, n, leaf AS digest FROM placed UNION ALL
  SELECT level + 1, tree, pos // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY pos))
  FROM nodes WHERE n > 1 GROUP BY level, tree, pos // 16, n),
subroots AS MATERIALIZED (
  SELECT tree, digest, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n
  FROM nodes WHERE n = 1),
upper AS (
  SELECT 100 AS level, pos, n, digest FROM subroots UNION ALL
  SELECT level + 1, pos // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY pos))
  FROM upper WHERE n > 1 GROUP BY level, pos // 16, n),
every AS MATERIALIZED (SELECT * FROM nodes UNION ALL SELECT level, NULL, pos, n, digest FROM upper),
beside AS MATERIALIZED (
  SELECT a.level, a.tree, a.pos, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l,
    coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
  FROM every a JOIN every b ON a.level = b.level AND a.tree IS NOT DISTINCT FROM b.tree AND a.pos // 16 = b.pos // 16
  WHERE a.n > 1 GROUP BY a.level, a.tree, a.pos),
ways AS (
  SELECT p.tree, p.pos, list({l: s.l, r: s.r, d: ''} ORDER BY s.level) AS way
  FROM placed p JOIN subroots t ON p.tree = t.tree JOIN beside s
    ON s.level < 100 AND s.tree = p.tree AND s.pos = p.pos // (16 ** s.level)::BIGINT
    OR s.level >= 100 AND s.pos = t.pos // (16 ** (s.level - 100))::BIGINT
  GROUP BY p.tree, p.pos),
folded AS (
  SELECT p.doc_id, p.leaf, t.digest AS subroot, (SELECT digest FROM upper WHERE n = 1) AS root,
    sha256(coalesce(list_aggregate(list_transform(way, lambda x: x.l || x.r), 'string_agg', ''), '')) AS proof_sha256,
    list_reduce(coalesce(way, []), lambda a, x: {l: '', r: '', d: sha256(x.l || a.d || x.r)},
      {l: '', r: '', d: coalesce(p.claimed, p.leaf)}).d AS folded_root
  FROM placed p JOIN subroots t ON p.tree = t.tree LEFT JOIN ways w ON w.tree = p.tree AND w.pos = p.pos)
SELECT *, folded_root = root AS verified FROM folded
"""


@query
def op12_trie_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(table(spark, sf_dir, "embeddings"), scale=4096, parts=8, entries=16, rounds=6)


def code_rounds(rounds: int) -> str:
    """SQL of the rounds of fitting: each assigns all parts and moves the entries to the means."""
    return "".join(f"""
near{r} AS MATERIALIZED (
  SELECT p.vec_id, p.k, p.p, min({{d: list_sum(list_transform(list_zip(p.p, b.p), lambda z: (z[1] - z[2]) ** 2)
    )::BIGINT, e: b.e}}) AS m FROM parts p JOIN books{r} b ON p.k = b.k GROUP BY p.vec_id, p.k, p.p),
sums{r} AS (
  SELECT k, e, j, sum(x)::BIGINT AS s, count(*) AS c FROM (
    SELECT k, m.e AS e, unnest(p) AS x, generate_subscripts(p, 1) AS j FROM near{r}) GROUP BY k, e, j),
means{r} AS (
  SELECT k, e, list((s - (s % c + c) % c) // c ORDER BY j) AS p FROM sums{r} GROUP BY k, e),
books{r + 1} AS MATERIALIZED (
  SELECT k, e, coalesce(m.p, b.p) AS p FROM books{r} b LEFT JOIN means{r} m USING (k, e)),""" for r in range(rounds))


ORACLES["op12_trie_vector_codes"] = f"""
WITH whole AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (
  SELECT vec_id, label, k, v[k * (len(v) // 8) + 1:(k + 1) * (len(v) // 8)] AS p FROM whole, range(8) t(k)),
seeds AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM whole QUALIFY e < 16),
books0 AS MATERIALIZED (SELECT k, e, p FROM parts JOIN seeds USING (vec_id)),{code_rounds(6)}
last AS MATERIALIZED (
  SELECT p.vec_id, p.label, p.k, min({{d: list_sum(list_transform(list_zip(p.p, b.p), lambda z: (z[1] - z[2]) ** 2)
    )::BIGINT, e: b.e}}) AS m FROM parts p JOIN books6 b ON p.k = b.k GROUP BY p.vec_id, p.label, p.k),
coded AS (
  SELECT vec_id, label, string_agg(format('{{:02x}}', m.e), '' ORDER BY k) AS code, sum(m.d)::BIGINT AS error
  FROM last GROUP BY vec_id, label),
numbers AS (SELECT k, e, unnest(p) AS x, generate_subscripts(p, 1) AS j FROM books6)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY k, e, j)) FROM numbers) AS codebooks_sha256
FROM coded
"""


@query
def op13_budget_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents fill a budget is the method's choice, so there is no SQL; tests hold it to the contract."""
    return mixing.mix(table(spark, sf_dir, "documents"))
