"""The registered queries of the subpackage: each takes (spark, tables_dir)."""

from __future__ import annotations

from pyspark.sql import functions as F

from kontor.llm import (fingerprints, hard_negatives, hosts, lattice, licenses, mixing, ngram_join, packing,
                        ranked_search, secrets, sharding, token_files, toxicity)
from kontor.sources.tables import read_table


def op1_secret_grammar(spark, d):
    """Secret spans of all documents: base patterns and inferred formats."""
    docs = read_table(spark, d, "documents").select("doc_id", "text")
    return secrets.scan_secrets(docs).select(
        "doc_id", "n_assign", "n_access", "n_hex",
        F.lower(F.sha2(F.col("base_spans"), 256)).alias("base_sha256"), "spans", "n_format",
        "best_score")


def op2_token_files(spark, d):
    """All documents as token files, read back."""
    import public_tokenizers
    docs = read_table(spark, d, "documents").select("doc_id", "text")
    return token_files.token_digest(docs, public_tokenizers.path("byte_bpe_50k.json"))


def op3_fair_mix(spark, d):
    """Words that the weighted mix takes from every document."""
    return mixing.taken_words(read_table(spark, d, "documents").select("doc_id", "text", "source"))


def op4_toxicity_cnn(spark, d):
    """Toxicity of all documents; learned outside the held-out fifth."""
    docs = read_table(spark, d, "documents").select("doc_id", "text", "lang")
    model = toxicity.fit(docs, read_table(spark, d, "labels"))
    scored = toxicity.score_toxicity(docs, model)
    return scored.select(
        "doc_id", toxicity.held_out("doc_id").alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        toxicity.threshold_of(model, "lang").alias("threshold"),
        (F.col("score") >= toxicity.threshold_of(model, "lang")).cast("int").alias("rejected"))


def op5_best_fit_packing(spark, d):
    """All documents in bins of 2,048 words."""
    return packing.pack_documents(
        read_table(spark, d, "documents").select("doc_id", "text", "source"))


def op6_license_automata(spark, d):
    """License phrases and accepted templates of all documents."""
    docs = read_table(spark, d, "documents").select("doc_id", "text")
    return licenses.scan_licenses(docs).drop("text")


def op7_ngram_jaccard(spark, d):
    """Components of documents whose 3-word shingle sets have Jaccard 0.9 or more."""
    return ngram_join.jaccard_components(
        read_table(spark, d, "documents").select("doc_id", "text"), k=3, num=90, den=100)


def op8_chunk_fingerprints(spark, d):
    """Fingerprints of all documents and their edited texts, and their likeness."""
    return fingerprints.compare_neighbours(
        read_table(spark, d, "documents").select("doc_id", "text"))


def op9_lattice_near_dups(spark, d):
    """Links of embeddings with equal labels and cosine of 0.98 or more."""
    return lattice.near_duplicates(read_table(spark, d, "embeddings"))


def op10_host_words(spark, d):
    """Rule or verdict for every page's URL."""
    pages = read_table(spark, d, "pages").select("page_id", "url", "html")
    return hosts.judge_urls(pages.select("page_id", "url"),
                            words=hosts.learn_words(pages)).drop("url")


def op11_minimax_shards(spark, d):
    """All documents in 24 shards of near equal bytes, equal texts together."""
    placed = sharding.assign_shards(read_table(spark, d, "documents").select("doc_id", "text"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                         "slot", F.lit(None).cast("int").alias("grown_shard"))


def op12_ranked_search(spark, d):
    """The 50 best documents of all for every benchmark item."""
    return ranked_search.search(read_table(spark, d, "documents").select("doc_id", "text"),
                                read_table(spark, d, "benchmark").select("item_id", "text"))


def op13_hard_negatives(spark, d):
    """Hard negatives for every fiftieth embedding, against all rows."""
    vectors = read_table(spark, d, "embeddings").select("vec_id", "embedding", "label")
    vectors = (vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0,
                                                  (F.col("label") + 1) % 10).otherwise(F.col("label")))
               .withColumn("is_anchor", F.col("vec_id") % 50 == 0))
    return hard_negatives.mine_hard_negatives(vectors, "is_anchor")


def pipeline(spark, d):
    """The stages of ``corpus_pipeline`` over all documents."""
    import corpus_pipeline
    return corpus_pipeline.run(spark, d)


QUERIES = {f.__name__: f for f in (
    op1_secret_grammar, op2_token_files, op3_fair_mix, op4_toxicity_cnn, op5_best_fit_packing,
    op6_license_automata, op7_ngram_jaccard, op8_chunk_fingerprints, op9_lattice_near_dups,
    op10_host_words, op11_minimax_shards, op12_ranked_search, op13_hard_negatives,
    pipeline)}

_COMPONENTS = """
reach(id, root) AS (
  SELECT id, id FROM nodes
  UNION
  SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.id),
least AS (SELECT id, min(root) AS root FROM reach GROUP BY id)"""

#: DuckDB SQL where SQL can express an operator.
SQL: dict[str, str] = {
    "op7_ngram_jaccard": """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1),
                                      lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s
  FROM words),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c, any_value(x.n) AS na, any_value(y.n) AS nb
  FROM items x JOIN items y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
linked AS (SELECT a, b FROM pairs WHERE 100 * c >= 90 * (na + nb - c)),
links AS (SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked),
nodes AS (SELECT doc_id AS id FROM documents),""" + _COMPONENTS + """
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, l.root AS component_id
FROM sets s JOIN least l ON l.id = s.doc_id""",
    "op12_ranked_search": """
WITH terms AS (
  SELECT doc_id, unnest(regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY ALL),
lengths AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY ALL),
whole AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM lengths),
factor AS (SELECT doc_id, 100 - 50 + ((50 * n * docs) // words) AS m FROM lengths, whole),
weight AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM tf, whole GROUP BY term, docs),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark),
scored AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
  FROM asked JOIN tf USING (term) JOIN weight USING (term) JOIN factor USING (doc_id)
  GROUP BY ALL HAVING score > 0)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER)
         AS rank, doc_id, score
FROM scored QUALIFY rank <= 50""",
    "op13_hard_negatives": """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT a.vec_id AS anchor, a.label = b.label AS same, b.vec_id AS id,
         CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
positive AS (
  SELECT * FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) <= 5)
SELECT p.anchor AS anchor_id, p.id AS positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor, p.id ORDER BY n.score DESC, n.id) AS INTEGER) AS rank,
       n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positive p JOIN pairs n ON n.anchor = p.anchor AND NOT n.same
 AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
QUALIFY rank <= 3""",
    "op9_lattice_near_dups": """
WITH RECURSIVE vectors AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE label IS NOT NULL),
linked AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM vectors x JOIN vectors y
  ON x.label = y.label AND x.vec_id < y.vec_id AND list_cosine_similarity(x.v, y.v) >= 0.98),
links AS (SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked),
degree AS (SELECT a, count(*) AS n FROM links GROUP BY a),
nodes AS (SELECT vec_id AS id FROM embeddings),""" + _COMPONENTS + """
SELECT e.vec_id, coalesce(d.n, 0) AS n_links, l.root AS component_id, e.vec_id = l.root AS kept
FROM embeddings e JOIN least l ON l.id = e.vec_id LEFT JOIN degree d ON d.a = e.vec_id""",
}
