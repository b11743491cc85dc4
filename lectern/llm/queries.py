"""The operators as named queries over the test tables, with production parameters."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.chat import digest_windows, format_conversations
from lectern.llm.columns import table
from lectern.llm.decontaminate import find_leaks
from lectern.llm.hard_negatives import hard_negatives
from lectern.llm.html import extract_main_text
from lectern.llm.language import fit_language, predict_language
from lectern.llm.language_model import score_documents
from lectern.llm.manifest import build_manifest, leaf
from lectern.llm.mixing import mix_sources
from lectern.llm.near_copies import near_copies
from lectern.llm.neighbours import nearest
from lectern.llm.pii import KINDS, find_pii
from lectern.llm.quality import fit_model, judge_quality
from lectern.llm.toxicity import fit_chain, predict_chain


def op9_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The documents taken, with copies, when sources are mixed at 0.999 of the largest entropy."""
    return mix_sources(table(spark, folder, "documents"), entropy_share=0.999)


def op10_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Predicted language of every document; every fourth document by checksum is not learned from."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang", held.alias("held_out"))
    filters = fit_language(docs.where("doc_id is not null and not held_out"))
    return predict_language(docs, filters, keep=("held_out",))


def op1_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The five nearest vectors of every fiftieth vector."""
    return nearest(table(spark, folder, "embeddings"), F.col("id") % 50 == 0)


def op2_near_copies(spark: SparkSession, folder: str) -> DataFrame:
    """Class and links of every document by shingles of five words and a similarity of 0.8."""
    return near_copies(table(spark, folder, "documents"))


def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Probabilities of low quality, then toxicity, for every document."""
    docs = table(spark, folder, "documents")
    chain = fit_chain(docs, table(spark, folder, "labels"), (("low_quality", "quality", 0), ("toxic", "toxic", 1)))
    found = predict_chain(docs, chain)
    return found.select("doc_id", "p_low_quality", "p_toxic", (F.col("p_toxic") >= 0.5).alias("toxic"))


def op4_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data in every document: counts and digest of the plain spans, and all spans."""
    found = find_pii(table(spark, folder, "documents"))
    written = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )
    plain = F.filter("spans", lambda s: s["plain"])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["plain"] & (s["kind"] == kind)))
    return found.select(
        "doc_id",
        *[count(kind).cast("long").alias(f"n_{kind}") for kind in KINDS],
        F.sha2(written(plain), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
        (F.size("spans") - F.size(plain)).cast("long").alias("n_disguised"),
    )


def op7_pseudo_likelihood(spark: SparkSession, folder: str) -> DataFrame:
    """Masked pseudo-likelihood of every document under a network trained on all of them."""
    return score_documents(table(spark, folder, "documents"))


def op8_chat_windows(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations, and one whose texts are control strings, formatted and read back."""
    text = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame(
        [(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id bigint, turn bigint, role string, text string"
    )
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    return digest_windows(format_conversations(rows.unionByName(extra)))


def op5_benchmark_leaks(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark items in documents, within 15 edits per hundred characters."""
    return find_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op6_main_text(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    found = extract_main_text(table(spark, folder, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_blocks")


def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Hard negatives of every fiftieth vector. Every seventh vector carries the next label instead of its own."""
    rows = table(spark, folder, "embeddings")
    other = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows, F.col("id") % 50 == 0, label=other)


def op12_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Leaf, subroot, root, proof and the root after tampering of every document.

    Tampering lower-cases the text's A to Z in each document whose id's checksum five divides.
    """
    fields = ("doc_id", "source", "lang", "n_chars", "text")
    docs = table(spark, folder, "documents").select(*fields)
    plain = leaf([F.col(c) for c in fields])
    lowered = leaf([*[F.col(c) for c in fields[:-1]], F.translate("text", ascii_uppercase, ascii_lowercase)])
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    leaves = docs.select("doc_id", "source", plain.alias("leaf"), F.when(tampered, lowered).alias("changed"))
    found = build_manifest(leaves).versions().withColumnRenamed("proof", "proof_sha256")
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Rule counts of every document, and whether it passes them and its language's perplexity band."""
    docs = table(spark, folder, "documents")
    found = judge_quality(docs, fit_model(docs))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "surprise"
    )


QUERIES = {
    "op1_neighbours": op1_neighbours,
    "op2_near_copies": op2_near_copies,
    "op3_toxicity": op3_toxicity,
    "op4_personal_data": op4_personal_data,
    "op5_benchmark_leaks": op5_benchmark_leaks,
    "op6_main_text": op6_main_text,
    "op7_pseudo_likelihood": op7_pseudo_likelihood,
    "op8_chat_windows": op8_chat_windows,
    "op9_source_mix": op9_source_mix,
    "op10_language_id": op10_language_id,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_manifest": op12_manifest,
    "op13_quality_rules": op13_quality_rules,
}

OP2_SQL = r"""
WITH RECURSIVE t AS (
    SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\s+'), lambda x: x <> '') AS w
    FROM documents WHERE doc_id IS NOT NULL
), g AS (
    SELECT DISTINCT doc_id, unnest(CASE
        WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS s
    FROM t
), size AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id
), pair AS (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y ON x.s = y.s AND x.doc_id <> y.doc_id
    GROUP BY 1, 2
), link AS (
    SELECT a, b, c FROM pair JOIN size p ON a = p.doc_id JOIN size q ON b = q.doc_id
    WHERE c >= 0.8 * (p.n + q.n - c)
), reach(a, b) AS (
    SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a
), class AS (SELECT a, min(b) AS low FROM reach GROUP BY a
), norm AS (SELECT doc_id, array_to_string(w, ' ') AS v FROM t
), deg AS (
    SELECT a, count(*) AS n, count(DISTINCT y.v) FILTER (y.v <> x.v) AS m
    FROM link JOIN norm x ON a = x.doc_id JOIN norm y ON b = y.doc_id GROUP BY a
)
SELECT t.doc_id, least(coalesce(low, t.doc_id), t.doc_id) AS class_id,
       coalesce(n, 0)::BIGINT AS n_links, coalesce(m, 0)::BIGINT AS n_text_links
FROM t LEFT JOIN class ON class.a = t.doc_id LEFT JOIN deg ON deg.a = t.doc_id
"""

OP9_SQL = r"""
WITH RECURSIVE d AS (
    SELECT doc_id, coalesce(source, '') AS source, len(regexp_extract_all(coalesce(text, ''), '\S+'))::BIGINT AS tokens
    FROM documents
), src AS (
    SELECT source, sum(tokens)::BIGINT AS whole, ceil(sqrt(count(*)))::BIGINT AS blocks FROM d GROUP BY source
), everything AS (SELECT sum(whole)::DOUBLE AS budget, count(*) FILTER (whole > 0) AS n FROM src
), mid(step, low, high) AS (
    SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
    UNION ALL
    SELECT step + 1, CASE WHEN ok THEN (low + high) / 2 ELSE low END, CASE WHEN ok THEN high ELSE (low + high) / 2 END
    FROM (SELECT step, low, high, (
              SELECT -sum(w * ln(w)) FROM (
                  SELECT pow(whole, (low + high) / 2) / sum(pow(whole, (low + high) / 2)) OVER () AS w
                  FROM src WHERE whole > 0)) >= 0.999 * ln((SELECT n FROM everything)) AS ok
          FROM mid WHERE step < 60)
), rep(step, low, high) AS (
    SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
    UNION ALL
    SELECT step + 1, CASE WHEN ok THEN (low + high) / 2 ELSE low END, CASE WHEN ok THEN high ELSE (low + high) / 2 END
    FROM (SELECT step, low, high, (
              SELECT max((SELECT budget FROM everything) * w / whole) FROM (
                  SELECT whole, pow(whole, (low + high) / 2) / sum(pow(whole, (low + high) / 2)) OVER () AS w
                  FROM src WHERE whole > 0)) > 4.0 AS ok
          FROM rep WHERE step < 60)
), unmixed AS (
    SELECT -sum(w * ln(w)) AS h FROM (SELECT whole / sum(whole) OVER () AS w FROM src WHERE whole > 0)
), even AS (SELECT max((SELECT budget / n FROM everything) / whole) AS r FROM src WHERE whole > 0
), a AS (
    SELECT greatest(
        CASE WHEN (SELECT h FROM unmixed) >= 0.999 * ln((SELECT n FROM everything)) THEN 1
             ELSE (SELECT low FROM mid WHERE step = 60) END,
        CASE WHEN (SELECT r FROM even) <= 4.0 THEN 0 ELSE (SELECT high FROM rep WHERE step = 60) END) AS a
), w AS (
    SELECT source, whole, blocks, CASE WHEN whole > 0 THEN pow(whole, (SELECT a FROM a)) ELSE 0 END AS x FROM src
), s AS (
    SELECT source, whole, blocks,
           floor(x / (SELECT sum(x) FROM w) * (SELECT budget FROM everything) + 1e-6)::BIGINT AS source_tokens
    FROM w
), p AS (
    SELECT d.*, s.whole, s.source_tokens,
           CASE WHEN whole > 0 THEN greatest(ceil(source_tokens / whole), 1) ELSE 1 END::BIGINT AS epochs,
           ('0x' || substr(md5('1:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT % blocks AS block
    FROM d JOIN s USING (source)
), b AS (
    SELECT source, block, epoch, sum(tokens) AS block_tokens, any_value(whole) AS whole, any_value(source_tokens) AS source_tokens
    FROM (SELECT *, unnest(range(epochs)) AS epoch FROM p) GROUP BY ALL
), starts AS (
    SELECT source, block, epoch, source_tokens, epoch * whole - block_tokens + sum(block_tokens) OVER (
        PARTITION BY source, epoch ORDER BY ('0x' || substr(md5('1:' || epoch || ':' || block), 1, 8))::BIGINT, block) AS before
    FROM b
), e AS (
    SELECT doc_id, source, epoch, block, tokens, p.source_tokens, before + sum(tokens) OVER (
        PARTITION BY source, epoch, block
        ORDER BY ('0x' || substr(md5('1:' || epoch || ':d:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT, doc_id, tokens
        ROWS UNBOUNDED PRECEDING) AS stop
    FROM p JOIN starts USING (source, block)
)
SELECT doc_id, source, epoch::BIGINT AS epoch, block, (stop - tokens)::BIGINT AS start_token, tokens, source_tokens
FROM e WHERE stop <= source_tokens
"""

OP11_SQL = r"""
WITH r AS (
    SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT a.id AS anchor_id, b.id, a.label = b.label AS alike, list_inner_product(a.v, b.v)::BIGINT AS score
    FROM r a JOIN r b ON a.id <> b.id AND len(a.v) = len(b.v) WHERE a.id % 50 = 0
), p AS (
    SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE alike
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT anchor_id, positive_id, positive_score, s.id AS negative_id, s.score AS negative_score,
       (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.id))::INTEGER AS rank
FROM p JOIN s USING (anchor_id)
WHERE NOT alike AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.id) <= 3
"""

OP12_SQL = r"""
WITH RECURSIVE d AS (
    SELECT doc_id, coalesce('=' || source, '') AS key, source, lang, n_chars, text,
           -- The checksum of the id's digits, bit by bit.
           list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(
               string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
               lambda c, b: xor(xor(c, b) >> 1, (xor(c, b) & 1) * 3988292384)) AS register
    FROM documents
), tampered AS (
    SELECT *, CASE WHEN xor(register, 4294967295) % 5 = 0
                   THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS after
    FROM d
), leaf AS (
    SELECT doc_id, key,
           sha256(a || coalesce(strlen(text)::VARCHAR || ':' || text, '-')) AS leaf,
           sha256(a || coalesce(strlen(after)::VARCHAR || ':' || after, '-')) AS changed
    FROM (SELECT *, coalesce(strlen(doc_id::VARCHAR)::VARCHAR || ':' || doc_id, '-')
                 || coalesce(strlen(source)::VARCHAR || ':' || source, '-')
                 || coalesce(strlen(lang)::VARCHAR || ':' || lang, '-')
                 || coalesce(strlen(n_chars::VARCHAR)::VARCHAR || ':' || n_chars, '-') AS a
          FROM tampered)
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaf
), node(level, key, pos, h) AS (
    SELECT 0, key, pos, leaf FROM placed
    UNION ALL
    SELECT level + 1, key, pos // 16, sha256(string_agg(h, '' ORDER BY pos))
    FROM (SELECT *, count(*) OVER (PARTITION BY key) AS n FROM node) WHERE n > 1 GROUP BY level, key, pos // 16
), sub AS (
    SELECT key, arg_max(h, level) AS subroot, row_number() OVER (ORDER BY encode(key)) - 1 AS place FROM node GROUP BY key
), upper_node(level, pos, h) AS (
    SELECT 0, place, subroot FROM sub
    UNION ALL
    SELECT level + 1, pos // 16, sha256(string_agg(h, '' ORDER BY pos))
    FROM (SELECT *, count(*) OVER () AS n FROM upper_node) WHERE n > 1 GROUP BY level, pos // 16
), run AS (
    SELECT level, key, pos // 16 AS run, list(h ORDER BY pos) AS hs FROM node
    WHERE level < (SELECT max(level) FROM node m WHERE m.key = node.key) GROUP BY ALL
), upper_run AS (
    SELECT level, pos // 16 AS run, list(h ORDER BY pos) AS hs FROM upper_node
    WHERE level < (SELECT max(level) FROM upper_node) GROUP BY ALL
), fold(doc_id, key, pos, level, spot, h, proof) AS (
    SELECT doc_id, key, pos, 0, pos, changed, '' FROM placed
    UNION ALL
    SELECT doc_id, key, pos, fold.level + 1, spot // 16,
           sha256(array_to_string(hs[:spot % 16] || [h] || hs[spot % 16 + 2:], '')),
           proof || array_to_string(hs[:spot % 16] || hs[spot % 16 + 2:], '')
    FROM fold JOIN run USING (level, key) WHERE run.run = spot // 16
), folded AS (
    SELECT doc_id, key, pos, arg_max(h, level) AS h, arg_max(proof, level) AS proof FROM fold GROUP BY doc_id, key, pos
), upper_fold(doc_id, key, pos, level, spot, h, proof) AS (
    SELECT doc_id, key, pos, 0, place, h, proof FROM folded JOIN sub USING (key)
    UNION ALL
    SELECT doc_id, key, pos, f.level + 1, spot // 16,
           sha256(array_to_string(hs[:spot % 16] || [h] || hs[spot % 16 + 2:], '')),
           proof || array_to_string(hs[:spot % 16] || hs[spot % 16 + 2:], '')
    FROM upper_fold f JOIN upper_run r ON r.level = f.level AND r.run = spot // 16
), ended AS (
    SELECT key, pos, arg_max(h, level) AS h, arg_max(proof, level) AS proof FROM upper_fold GROUP BY key, pos
), top AS (SELECT arg_max(h, level) AS root FROM upper_node)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, h AS folded_root, h = root AS verified
FROM placed JOIN sub USING (key) JOIN ended USING (key, pos) CROSS JOIN top
"""

# Per text: words, lines and symbols; then orders one to four of the model, whose counts are those of
# n-grams with each start; the mean of the logarithms; and the languages' bands.
OP13_SQL = r"""
WITH RECURSIVE d AS (
    SELECT row_number() OVER () AS r, doc_id, coalesce('=' || lang, '') AS lang, coalesce(text, '') AS t FROM documents
), w AS (
    SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d
), window3 AS (
    SELECT r, i, w[i:i+2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w)
), repeated AS (
    SELECT r, count(DISTINCT i + o) AS n_repeat_words
    FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM window3), range(3) o(o) WHERE n > 1 GROUP BY r
), dup AS (
    SELECT r, count(*) - count(DISTINCT l) AS n_dup_lines
    FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r
), rules AS (
    SELECT d.r, doc_id, lang, len(w)::BIGINT AS n_words, len(array_to_string(w, ''))::BIGINT AS word_chars,
           len(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
           coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
    FROM d JOIN w USING (r) LEFT JOIN repeated USING (r) LEFT JOIN dup USING (r)
), point AS (
    SELECT r, i, unicode(s) AS c
    FROM (SELECT r, unnest(range(len(s))) AS i, unnest(string_split(s, '')) AS s
          FROM (SELECT r, regexp_replace(t || ' ', '[\x20\x09-\x0D]+', ' ', 'g') AS s FROM d))
), sym AS (
    SELECT r, i, CASE WHEN c = 32 THEN 0 WHEN c BETWEEN 97 AND 122 THEN c - 96 WHEN c BETWEEN 65 AND 90 THEN c - 64
                      WHEN c BETWEEN 48 AND 57 THEN 27 WHEN c < 128 THEN 28 + c % 16 ELSE 44 + c % 20 END AS s
    FROM point
), solid AS (
    -- A text that begins with white space has its first gap among the three in front.
    SELECT r, i, s FROM sym WHERE NOT (i = 0 AND s = 0)
), gram AS (
    SELECT r, coalesce(lag(s, 3) OVER o, 0) * 262144 + coalesce(lag(s, 2) OVER o, 0) * 4096
              + coalesce(lag(s) OVER o, 0) * 64 + s AS g
    FROM solid WINDOW o AS (PARTITION BY r ORDER BY i)
), c4 AS (SELECT g, count(*)::DOUBLE AS n FROM gram GROUP BY g
), c3 AS (SELECT g % 262144 AS g, count(*)::DOUBLE AS n FROM c4 GROUP BY ALL
), c2 AS (SELECT g % 4096 AS g, count(*)::DOUBLE AS n FROM c3 GROUP BY ALL
), c1 AS (SELECT g % 64 AS g, count(*)::DOUBLE AS n FROM c2 GROUP BY ALL
), every AS (
    SELECT 1 AS k, * FROM c1 UNION ALL SELECT 2, * FROM c2 UNION ALL SELECT 3, * FROM c3 UNION ALL SELECT 4, * FROM c4
), few AS (
    SELECT k, (count(*) FILTER (n = 1))::DOUBLE AS n1, (count(*) FILTER (n = 2))::DOUBLE AS n2,
           (count(*) FILTER (n = 3))::DOUBLE AS n3, (count(*) FILTER (n = 4))::DOUBLE AS n4
    FROM every GROUP BY k
), raw_cut AS (
    SELECT k, 1 - 2 * y * n2 / nullif(n1, 0) AS a, 2 - 3 * y * n3 / nullif(n2, 0) AS b, 3 - 4 * y * n4 / nullif(n3, 0) AS c
    FROM (SELECT *, CASE WHEN n1 > 0 AND n2 > 0 THEN n1 / (n1 + 2 * n2) END AS y FROM few)
), cut AS (
    SELECT k, CASE WHEN a > 0 AND a < 1 THEN a ELSE 0.5 END AS a, CASE WHEN b > 0 AND b < 2 THEN b ELSE 0.75 END AS b,
           CASE WHEN c > 0 AND c < 3 THEN c ELSE 0.75 END AS c
    FROM raw_cut
), own AS (
    SELECT k, g, (n - x) / sum(n) OVER o AS own, sum(x) OVER o / sum(n) OVER o AS back
    FROM (SELECT k, g, n, CASE n WHEN 1 THEN a WHEN 2 THEN b ELSE c END AS x FROM every JOIN cut USING (k))
    WINDOW o AS (PARTITION BY k, g // 64)
), p1 AS (SELECT g, own + back / 64 AS p FROM own WHERE k = 1
), p2 AS (SELECT o.g, own + back * p AS p FROM own o JOIN p1 ON o.g % 64 = p1.g WHERE k = 2
), p3 AS (SELECT o.g, own + back * p AS p FROM own o JOIN p2 ON o.g % 4096 = p2.g WHERE k = 3
), p4 AS (SELECT o.g, own + back * p AS p FROM own o JOIN p3 ON o.g % 262144 = p3.g WHERE k = 4
), scored AS (
    SELECT rules.*, CASE WHEN n_words > 0 THEN m END AS surprise,
           n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed
    FROM rules LEFT JOIN (
        SELECT r, round(1000 * sum(-ln(p)) / count(*))::BIGINT AS m FROM gram JOIN p4 USING (g) GROUP BY r) USING (r)
), deciles AS (
    SELECT lang, quantile_disc(surprise, 0.1) AS d1, quantile_disc(surprise, 0.5) AS d5, quantile_disc(surprise, 0.9) AS d9
    FROM scored WHERE surprise IS NOT NULL GROUP BY lang
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, surprise,
       NOT base_failed AND coalesce(surprise BETWEEN d5 - greatest(3.0 * (d5 - d1), 120)
                                             AND d5 + greatest(3.0 * (d9 - d5), 120), false) AS kept
FROM scored LEFT JOIN deciles USING (lang)
"""

ORACLES: dict[str, str] = {
    "op2_near_copies": OP2_SQL,
    "op9_source_mix": OP9_SQL,
    "op11_hard_negatives": OP11_SQL,
    "op12_manifest": OP12_SQL,
    "op13_quality_rules": OP13_SQL,
}
