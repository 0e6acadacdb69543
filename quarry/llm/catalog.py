"""Queries of the operators in this subpackage: ``opN_<name>`` applies operator
N to its whole table. ``ORACLE`` holds DuckDB SQL where SQL can express the
result."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.llm import ann, bpe, chat, discriminant, html_text, langid, minhash, packing, quality, repair, runs, token_counts, warc
from quarry.sources.tables import load

QUERIES: dict = {}
ORACLE: dict = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


@register("op1_quality_rules")
def op1(spark, sf_dir):
    return quality.quality_report(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


# All pairs that share a shingle, and the transitive closure of their links.
DEDUP_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
x AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) >= 5
  THEN list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))
  WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM x GROUP BY doc_id),
c AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS common FROM x a JOIN x b USING (shingle) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT u, v FROM c JOIN n nu ON nu.doc_id = u JOIN n nv ON nv.doc_id = v WHERE 100 * common >= 75 * (nu.n + nv.n - common)),
reach(id, r) AS (SELECT doc_id, doc_id FROM w UNION SELECT id, e.v FROM reach JOIN e ON r = e.u),
root AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, w.doc_id = component_id AS kept
FROM w JOIN root ON root.id = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id"""


@register("op2_minhash_dedup", DEDUP_SQL)
def op2(spark, sf_dir):
    return minhash.near_duplicates(load(spark, sf_dir, "documents"))


@register("op10_language_id")
def op10(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    return langid.predict_languages(docs, langid.fit(docs.where(~langid.held_out())))


@register("op5_best_fit_packing")
def op5(spark, sf_dir):
    return packing.pack_documents(load(spark, sf_dir, "documents"))


@register("op9_byte_bpe")
def op9(spark, sf_dir):
    import public_tokenizers
    return bpe.round_trip(load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
                          public_tokenizers.PATTERN)


@register("op4_chat_windows", chat.SQL)
def op4(spark, sf_dir):
    rows = chat.with_probe(load(spark, sf_dir, "conversations"))
    return chat.digests(chat.read_back(chat.format_conversations(rows)))


# On pages of this table the article is one element without boilerplate inside.
ARTICLE_SQL = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(</article>|$)', 1) AS h FROM pages),
t AS (SELECT page_id, url, regexp_replace(regexp_replace(h, '</?(b|i|em|strong|a|span)\b[^>]*>', '', 'g'), '<(/?[a-zA-Z!][^>]*)>', ' ', 'g') AS t FROM a),
d AS (SELECT page_id, url, replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&') AS t FROM t),
s AS (SELECT page_id, url, trim(regexp_replace(t, '\s+', ' ', 'g')) AS text FROM d)
SELECT page_id, url, text, length(text) AS n_chars FROM s"""


@register("op8_html_main_text", ARTICLE_SQL)
def op8(spark, sf_dir):
    return html_text.extract(load(spark, sf_dir, "pages"))


@register("op7_warc_chain", """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS n, sha256(html) AS digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first FROM d)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
  CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to, true AS intact
FROM f""")
def op7(spark, sf_dir):
    return warc.round_trip(load(spark, sf_dir, "pages"))


@register("op3_collision_ann")
def op3(spark, sf_dir):
    return ann.nearest(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@register("op6_token_counts")
def op6(spark, sf_dir):
    import public_tokenizers
    return token_counts.count_lines(load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
                                    public_tokenizers.PATTERN)


@register("op11_quality_discriminant")
def op11(spark, sf_dir):
    return discriminant.quality_scores(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


@register("op12_conversation_repair", repair.SQL)
def op12(spark, sf_dir):
    return repair.repair_report(load(spark, sf_dir, "conversations"))


@register("op13_periodic_runs")
def op13(spark, sf_dir):
    return runs.periodic_runs(load(spark, sf_dir, "documents"))
