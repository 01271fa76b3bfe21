"""Jobs: text, JSON, URL and vector columns, tokens; summaries over labels, conversations, pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import scalar as sc
from tessera.operators import vectors
from tessera.plans.registry import register, tables


@register("document_text_features", sql=r"""
SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars,
       CAST(CASE WHEN trim(regexp_replace(text, '[\s\v]+', ' ', 'g')) = '' THEN 0
            ELSE len(string_split(trim(regexp_replace(text, '[\s\v]+', ' ', 'g')), ' ')) END AS BIGINT)
         AS n_words,
       CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS BIGINT) AS n_lines,
       CAST(length(regexp_replace(text, '[^\p{Lu}]', '', 'g')) AS BIGINT) AS n_upper,
       CAST(length(regexp_replace(text, '[^0-9]', '', 'g')) AS BIGINT) AS n_digits,
       CAST(length(regexp_replace(text, '[^.!?]', '', 'g')) AS BIGINT) AS n_sentence_ends
FROM documents
""")
def document_text_features(spark, sf_dir):
    """P47 text_features over whole documents."""
    t = tables(spark, sf_dir)
    return sc.text_features(t.documents.select("doc_id", "text"), "text").drop("text")


@register("event_props_k", sql="""
SELECT event_id, event_type, CAST(TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS BIGINT) AS k
FROM events
""")
def event_props_k(spark, sf_dir):
    """P49 json_field: the integer ``k`` out of ``events.props``."""
    t = tables(spark, sf_dir)
    e = t.events
    return e.select("event_id", "event_type", sc.json_field("props", "$.k", "int").cast("long").alias("k"))


@register("page_url_parts", sql=r"""
SELECT page_id,
       nullif(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1), '') AS scheme,
       nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^@/?#]*@)?([^:/?#]*)', 1), '') AS host,
       regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path,
       CASE WHEN regexp_matches(regexp_replace(url, '#.*$', ''), '\?')
            THEN regexp_extract(regexp_replace(url, '#.*$', ''), '\?(.*)$', 1) END AS query,
       CASE WHEN regexp_matches(url, '#') THEN regexp_extract(url, '#(.*)$', 1) END AS fragment
FROM pages
""")
def page_url_parts(spark, sf_dir):
    """P50 url_parts."""
    t = tables(spark, sf_dir)
    return sc.url_parts(t.pages.select("page_id", "url"), "url").drop("url")


@register("embedding_centroid_cosine", sql="""
WITH ex AS (SELECT label, unnest(range(1, len(embedding) + 1)) AS i,
                   CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
     m AS (SELECT label, i, avg(x) AS m FROM ex GROUP BY 1, 2),
     c AS (SELECT label, list(m ORDER BY i) AS centroid FROM m GROUP BY 1)
SELECT vec_id, label,
       round(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS norm,
       round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), centroid), 6) AS cos_centroid
FROM embeddings JOIN c USING (label)
""")
def embedding_centroid_cosine(spark, sf_dir):
    """P51 vector_similarity: norm and cosine to the label centroid."""
    t = tables(spark, sf_dir)
    out = vectors.centroid_similarity(t.embeddings, ["label"], "embedding")
    return out.select("vec_id", "label", F.round("norm", 6).alias("norm"),
                      F.round("cos_centroid", 6).alias("cos_centroid"))


@register("document_tokens", sql=r"""
WITH s AS (SELECT doc_id, lower(trim(regexp_replace(text, '[\s\v]+', ' ', 'g'))) AS s FROM documents),
     a AS (SELECT doc_id, string_split(s, ' ') AS arr FROM s WHERE s <> '')
SELECT doc_id, CAST(i - 1 AS BIGINT) AS pos, arr[i] AS token
FROM (SELECT doc_id, arr, unnest(range(1, len(arr) + 1)) AS i FROM a)
""")
def document_tokens(spark, sf_dir):
    """P77 tokens: every token of every whole document with its position."""
    t = tables(spark, sf_dir)
    return sc.tokens(t.documents.select("doc_id", "text"), "text", ["doc_id"])


@register("label_rates_by_lang", sql="""
SELECT lang, count(*) AS n_docs, count(quality) AS n_labeled,
       round(avg(quality), 8) AS quality_rate, round(avg(toxic), 8) AS toxic_rate
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang
""")
def label_rates_by_lang(spark, sf_dir):
    """P20 + P27: documents with their (optional) labels, rates per language."""
    from tessera.operators.joins import left_enrich
    t = tables(spark, sf_dir)
    j = left_enrich(t.documents.select("doc_id", "lang"), t.labels, ["doc_id"])
    return j.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n_docs"), F.count("quality").alias("n_labeled"),
        F.round(F.avg("quality"), 8).alias("quality_rate"), F.round(F.avg("toxic"), 8).alias("toxic_rate"))


@register("conversation_role_stats", sql=r"""
WITH w AS (SELECT conv_id, turn, role,
                  CASE WHEN trim(regexp_replace(text, '[\s\v]+', ' ', 'g')) = '' THEN 0
                       ELSE len(string_split(trim(regexp_replace(text, '[\s\v]+', ' ', 'g')), ' ')) END AS n_words
           FROM conversations)
SELECT role, count(*) AS n_turns, count(DISTINCT conv_id) AS n_conversations,
       round(avg(n_words), 6) AS avg_words, CAST(max(n_words) AS BIGINT) AS max_words,
       CAST(max(turn) AS BIGINT) AS max_turn
FROM w GROUP BY role
""")
def conversation_role_stats(spark, sf_dir):
    """P47 + P31: turns, conversations and words per speaker role."""
    t = tables(spark, sf_dir)
    c = t.conversations.select("conv_id", "turn", "role", sc.word_count("text").alias("n_words"))
    return c.groupBy("role").agg(
        F.count(F.lit(1)).alias("n_turns"), F.count_distinct("conv_id").alias("n_conversations"),
        F.round(F.avg("n_words"), 6).alias("avg_words"), F.max("n_words").alias("max_words"),
        F.max("turn").alias("max_turn"))


@register("page_host_summary", sql=r"""
WITH p AS (SELECT regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^@/?#]*@)?([^:/?#]*)', 1) AS host,
                  regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1) AS scheme,
                  length(html) AS n_chars FROM pages)
SELECT host, count(*) AS n_pages, count(*) FILTER (WHERE scheme = 'https') AS n_https,
       round(avg(n_chars), 6) AS avg_html_chars
FROM p GROUP BY host
""")
def page_host_summary(spark, sf_dir):
    """P50 + P27: pages per host, secure share and page size."""
    t = tables(spark, sf_dir)
    p = sc.url_parts(t.pages.select("url", F.length("html").alias("n_chars")), "url")
    return p.groupBy("host").agg(
        F.count(F.lit(1)).alias("n_pages"),
        F.count(F.when(F.col("scheme") == "https", 1)).alias("n_https"),
        F.round(F.avg("n_chars"), 6).alias("avg_html_chars"))
