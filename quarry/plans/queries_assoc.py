"""Registered queries for cleaning (A2, B) and association (D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions.exprs import slugify
from quarry.operators import assoc, prep
from quarry.plans.catalog import (LI_INPUTS, LI_TARGET, load, register, rounded,
                                  sql_lineitem_scores)


def _li_scores(spark, sf, metrics=("pearson", "spearman"), topk=None):
    long, _ = assoc.associate(load(spark, sf, "lineitem"), LI_TARGET, "regression",
                              list(metrics), inputs=LI_INPUTS, topk=topk)
    return long


def _docs_labels(spark, sf):
    """documents LEFT JOIN labels: the unlabeled documents give NULL targets."""
    d = load(spark, sf, "documents").select("doc_id", "n_chars", "lang")
    lab = load(spark, sf, "labels")
    return d.join(lab, "doc_id", "left").select(
        "doc_id", "n_chars", F.length("lang").alias("lang_len"), "quality", "toxic")


SQL_DOCS_LABELS = """(SELECT d.doc_id, d.n_chars, length(d.lang)::INTEGER AS lang_len, l.quality, l.toxic
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""

# ------------------------------------------------------------------ A2, B
register("A2_preview", """
SELECT event_id, user_id, event_type, round(value, 6) + 0.0 AS value
FROM events ORDER BY event_id LIMIT 10
""")(lambda spark, sf: rounded(prep.preview(
    load(spark, sf, "events").select("event_id", "user_id", "event_type", "value"), 10, "event_id")))

register("B1_select_existing", """
SELECT l_tax, l_quantity FROM lineitem
""")(lambda spark, sf: prep.select_existing(load(spark, sf, "lineitem"), ["l_tax", "no_such_col", "l_quantity"]))


def _coerce_src(df):
    k = F.regexp_extract("props", r": (.*)\}", 1)
    return df.select("event_id", k.alias("k"), F.concat(k, F.lit("d")).alias("k_bad"),
                     F.concat(F.lit(" "), k, F.lit("e1 ")).alias("k_exp"), "props")


register("B3_coerce_numeric", r"""
WITH s AS (SELECT event_id, regexp_extract(props, ': (.*)\}', 1) AS k, props FROM events),
t AS (SELECT event_id, k, k || 'd' AS k_bad, ' ' || k || 'e1 ' AS k_exp, props FROM s)
SELECT event_id,
  CASE WHEN regexp_matches(k, '^\s*[+-]?((\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?|[nN][aA][nN])\s*$') THEN TRY_CAST(trim(k) AS DOUBLE) END AS k,
  CASE WHEN regexp_matches(k_bad, '^\s*[+-]?((\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?|[nN][aA][nN])\s*$') THEN TRY_CAST(trim(k_bad) AS DOUBLE) END AS k_bad,
  CASE WHEN regexp_matches(k_exp, '^\s*[+-]?((\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?|[nN][aA][nN])\s*$') THEN TRY_CAST(trim(k_exp) AS DOUBLE) END AS k_exp,
  CASE WHEN regexp_matches(props, '^\s*[+-]?((\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?|[nN][aA][nN])\s*$') THEN TRY_CAST(trim(props) AS DOUBLE) END AS props
FROM t
""")(lambda spark, sf: prep.coerce_numeric(_coerce_src(load(spark, sf, "events")),
                                           ["k", "k_bad", "k_exp", "props"]))

register("B4_drop_incomplete", f"""
SELECT doc_id, n_chars, quality, toxic FROM {SQL_DOCS_LABELS}
WHERE n_chars IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL
""")(lambda spark, sf: prep.drop_incomplete(
    _docs_labels(spark, sf).select("doc_id", "n_chars", "quality", "toxic"), ["n_chars", "quality", "toxic"]))

register("B5_complete_pair", f"""
SELECT doc_id, n_chars, quality FROM {SQL_DOCS_LABELS}
WHERE n_chars IS NOT NULL AND quality IS NOT NULL
""")(lambda spark, sf: prep.complete_pair(
    _docs_labels(spark, sf).select("doc_id", "n_chars", "quality"), "n_chars", "quality"))


def _report(spark, sf):
    p = prep.prepare_for_association(_docs_labels(spark, sf), "quality",
                                     ["n_chars", "toxic", "lang_len"], "regression")
    r = p.report()
    return r.select("rows_in", "rows_used", "rows_dropped",
                    F.array_join("skipped_inputs", ",").alias("skipped_inputs"),
                    F.array_join("used_inputs", ",").alias("used_inputs"))


register("B7_cleaning_report", f"""
WITH t AS {SQL_DOCS_LABELS},
c AS (SELECT * FROM t WHERE n_chars IS NOT NULL AND toxic IS NOT NULL AND lang_len IS NOT NULL AND quality IS NOT NULL),
k AS (SELECT min(n_chars) <> max(n_chars) AS u1, min(toxic) <> max(toxic) AS u2, min(lang_len) <> max(lang_len) AS u3 FROM c)
SELECT (SELECT count(*) FROM t)::BIGINT AS rows_in, (SELECT count(*) FROM c)::BIGINT AS rows_used,
  ((SELECT count(*) FROM t) - (SELECT count(*) FROM c))::BIGINT AS rows_dropped,
  concat_ws(',', CASE WHEN NOT u1 THEN 'n_chars' END, CASE WHEN NOT u2 THEN 'toxic' END, CASE WHEN NOT u3 THEN 'lang_len' END) AS skipped_inputs,
  concat_ws(',', CASE WHEN u1 THEN 'n_chars' END, CASE WHEN u2 THEN 'toxic' END, CASE WHEN u3 THEN 'lang_len' END) AS used_inputs
FROM k
""")(_report)

register("B9_resolve_headers", """
SELECT l_quantity AS "L_QUANTITY", l_tax AS "l_tax", l_discount AS "L_Discount" FROM lineitem
""")(lambda spark, sf: prep.resolve_headers(load(spark, sf, "lineitem"), ["L_QUANTITY", "l_tax", "L_Discount"]))

register("B10_one_hot", """
SELECT c_custkey,
  (c_mktsegment = 'AUTOMOBILE')::INTEGER AS c_mktsegment_AUTOMOBILE,
  (c_mktsegment = 'BUILDING')::INTEGER AS c_mktsegment_BUILDING,
  (c_mktsegment = 'FURNITURE')::INTEGER AS c_mktsegment_FURNITURE,
  (c_mktsegment = 'HOUSEHOLD')::INTEGER AS c_mktsegment_HOUSEHOLD,
  (c_mktsegment = 'MACHINERY')::INTEGER AS c_mktsegment_MACHINERY
FROM customer
""")(lambda spark, sf: prep.one_hot(load(spark, sf, "customer").select("c_custkey", "c_mktsegment"),
                                    ["c_mktsegment"]))

register("B13_label_codes", """
SELECT event_id, event_type, (dense_rank() OVER (ORDER BY event_type) - 1)::DOUBLE AS code FROM events
""")(lambda spark, sf: prep.label_codes(
    load(spark, sf, "events").select("event_id", "event_type", F.col("event_type").alias("code")), "code"))

register("B14_standardize", """
SELECT l_orderkey, l_linenumber,
  round((l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER (), 6) + 0.0 AS l_quantity,
  round((l_tax - avg(l_tax) OVER ()) / stddev_pop(l_tax) OVER (), 6) + 0.0 AS l_tax
FROM lineitem
""")(lambda spark, sf: rounded(prep.standardize(
    load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax"),
    ["l_quantity", "l_tax"])))

register("B15_sample_rows", """
SELECT o_orderkey, round(o_totalprice, 6) + 0.0 AS o_totalprice FROM orders
ORDER BY md5('7:' || o_orderkey::VARCHAR), o_orderkey LIMIT 500
""")(lambda spark, sf: rounded(prep.sample_rows(
    load(spark, sf, "orders").select("o_orderkey", "o_totalprice"), 500, 7, "o_orderkey")))

register("B17_slugify", r"""
SELECT page_id, regexp_replace(regexp_replace(url, '[^A-Za-z0-9_-]+', '_', 'g'), '^[_-]+|[_-]+$', '', 'g') AS slug
FROM pages
""")(lambda spark, sf: load(spark, sf, "pages").select("page_id", slugify(F.col("url")).alias("slug")))

# ------------------------------------------------------------------ D
_S = sql_lineitem_scores()
_RANKED = (_S + ", r AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY abs(score) DESC NULLS LAST, feature)"
           " AS rank FROM s)")

register("D1_pearson", _S + """
SELECT feature, round(score, 6) + 0.0 AS score FROM s WHERE metric = 'pearson'
""")(lambda spark, sf: rounded(_li_scores(spark, sf, ["pearson"]).select("feature", "score")))

register("D2_spearman", _S + """
SELECT feature, round(score, 6) + 0.0 AS score FROM s WHERE metric = 'spearman'
""")(lambda spark, sf: rounded(_li_scores(spark, sf, ["spearman"]).select("feature", "score")))

register("D6_associate", _RANKED + """
SELECT metric, feature, round(score, 6) + 0.0 AS score, rank FROM r
""")(lambda spark, sf: rounded(_li_scores(spark, sf).select("metric", "feature", "score", "rank")))


def _pairwise(spark, sf):
    """Scores over the rows that have the one input and the target: quality and
    toxic are missing for most documents, doc_id never is."""
    long, _ = assoc.associate(_docs_labels(spark, sf), "n_chars", "regression", ["pearson", "spearman"],
                              inputs=["doc_id", "quality", "toxic"], pairwise=True)
    return rounded(long.select("metric", "feature", "score", "rank"))


register("D6_associate_pairwise", """
WITH t AS (SELECT d.doc_id, d.n_chars, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
u AS (SELECT 'doc_id' AS feature, doc_id::DOUBLE AS x, n_chars::DOUBLE AS y FROM t UNION ALL SELECT 'quality', quality, n_chars FROM t
  UNION ALL SELECT 'toxic', toxic, n_chars FROM t),
k AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY x) + (count(*) OVER (PARTITION BY feature, x) - 1) / 2.0 AS rx,
  rank() OVER (PARTITION BY feature ORDER BY y) + (count(*) OVER (PARTITION BY feature, y) - 1) / 2.0 AS ry FROM u WHERE x IS NOT NULL AND y IS NOT NULL),
s AS (SELECT 'pearson' AS metric, feature, corr(x, y) AS score FROM k GROUP BY feature
  UNION ALL SELECT 'spearman', feature, corr(rx, ry) FROM k GROUP BY feature)
SELECT metric, feature, round(score, 6) + 0.0 AS score, row_number() OVER (PARTITION BY metric ORDER BY abs(score) DESC NULLS LAST, feature) AS rank FROM s
""")(_pairwise)


def _part_scores(spark, sf):
    long, _ = assoc.associate(load(spark, sf, "part"), "p_retailprice", "r", ["pearson", "spearman"],
                              topk=1)
    return rounded(long.select("metric", "feature", "score", "rank"))


register("D6_associate_part_top1", """
WITH rk AS (SELECT
  (rank() OVER (ORDER BY p_partkey) + (count(*) OVER (PARTITION BY p_partkey) - 1) / 2.0) AS r_k,
  (rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0) AS r_s,
  (rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2.0) AS r_y
  FROM part),
s AS (SELECT 'pearson' AS metric, 'p_partkey' AS feature, corr(p_partkey, p_retailprice) AS score FROM part
  UNION ALL SELECT 'pearson', 'p_size', corr(p_size, p_retailprice) FROM part
  UNION ALL SELECT 'spearman', 'p_partkey', corr(r_k, r_y) FROM rk
  UNION ALL SELECT 'spearman', 'p_size', corr(r_s, r_y) FROM rk),
r AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY abs(score) DESC NULLS LAST, feature) AS rank FROM s)
SELECT metric, feature, round(score, 6) + 0.0 AS score, rank FROM r WHERE rank <= 1
""")(_part_scores)

register("D7_to_wide", _S + """
SELECT feature, round(max(score) FILTER (WHERE metric = 'pearson'), 6) + 0.0 AS pearson,
  round(max(score) FILTER (WHERE metric = 'spearman'), 6) + 0.0 AS spearman
FROM s GROUP BY feature
""")(lambda spark, sf: rounded(assoc.to_wide(_li_scores(spark, sf), ["pearson", "spearman"])))

register("D8_combined", _S + """
SELECT feature, round(avg(abs(score)), 6) + 0.0 AS combined FROM s GROUP BY feature
""")(lambda spark, sf: rounded(assoc.combined(_li_scores(spark, sf))))

register("D9_rank_wide", _S + """
, w AS (SELECT feature, max(score) FILTER (WHERE metric = 'pearson') AS pearson,
  max(score) FILTER (WHERE metric = 'spearman') AS spearman, avg(abs(score)) AS combined FROM s GROUP BY feature)
SELECT feature, round(pearson, 6) + 0.0 AS pearson, round(spearman, 6) + 0.0 AS spearman,
  round(combined, 6) + 0.0 AS combined
FROM w ORDER BY combined DESC NULLS LAST, feature LIMIT 2
""")(lambda spark, sf: rounded(assoc.rank_wide(
    assoc.wide_table(_li_scores(spark, sf), ["pearson", "spearman"]), "combined", 2)))

register("D10_to_long", _RANKED + """
SELECT metric, feature, round(score, 6) + 0.0 AS score FROM r WHERE rank <= 2
""")(lambda spark, sf: rounded(assoc.to_long(_li_scores(spark, sf), topk=2)))

register("D11_top_scores", _S + """
SELECT feature, round(score, 6) + 0.0 AS score FROM s WHERE metric = 'spearman'
ORDER BY abs(score) DESC, feature LIMIT 2
""")(lambda spark, sf: rounded(assoc.top_scores(_li_scores(spark, sf), "spearman", 2)))

register("B2_all_numeric_pearson", """
SELECT feature, round(score, 6) + 0.0 AS score FROM (
  SELECT 'l_orderkey' AS feature, corr(l_orderkey, l_extendedprice) AS score FROM lineitem
  UNION ALL SELECT 'l_partkey', corr(l_partkey, l_extendedprice) FROM lineitem
  UNION ALL SELECT 'l_suppkey', corr(l_suppkey, l_extendedprice) FROM lineitem
  UNION ALL SELECT 'l_linenumber', corr(l_linenumber, l_extendedprice) FROM lineitem
  UNION ALL SELECT 'l_quantity', corr(l_quantity, l_extendedprice) FROM lineitem
  UNION ALL SELECT 'l_discount', corr(l_discount, l_extendedprice) FROM lineitem
  UNION ALL SELECT 'l_tax', corr(l_tax, l_extendedprice) FROM lineitem)
""")(lambda spark, sf: rounded(assoc.associate(load(spark, sf, "lineitem"), LI_TARGET, "r", ["pearson"])[0]
                               .select("feature", "score")))

# ------------------------------------------------------------------ D4


def sql_mi_classif(table: str, key: str, col: str, label: str, k: int = 3, seed=0, jitter: bool = True) -> str:
    """Plain single-node form of D4: window neighbours per class and a range
    join for the counts."""
    from quarry.plans.catalog import sql_digamma, sql_jittered
    j = (sql_jittered(table, key, col, seed, extra=f"t.{label} AS lab,") if jitter else
         f"(SELECT {key}, {label} AS lab, {col} / (SELECT stddev_pop({col}) FROM {table}) AS x FROM {table})")
    lags = ", ".join([f"lag(x, {i}) OVER o AS p{i}" for i in range(1, k + 1)]
                     + [f"lead(x, {i}) OVER o AS n{i}" for i in range(1, k + 1)])
    ds = ", ".join([f"abs(p{i} - x)" for i in range(1, k + 1)] + [f"abs(n{i} - x)" for i in range(1, k + 1)])
    return f"""SELECT '{col}' AS feature, round(greatest({sql_digamma('max(n)')}
    + avg({sql_digamma('kk')}) - avg({sql_digamma('nc')}) - avg({sql_digamma('mm')}), 0), 6) + 0.0 AS score
FROM (WITH j AS {j},
c AS (SELECT lab, count(*) AS nc FROM j GROUP BY lab),
p AS (SELECT j.*, nc, least({k}, nc - 1) AS kk FROM j JOIN c USING (lab) WHERE nc > 1),
w AS (SELECT *, {lags} FROM p WINDOW o AS (PARTITION BY lab ORDER BY x, {key})),
r AS (SELECT *, list_sort(list_filter([{ds}], lambda v: v IS NOT NULL))[kk] AS r FROM w),
g AS (SELECT *, greatest(r * (1 - 4e-15) - 4e-15 * abs(x), 0) AS rg FROM r),
cnt AS (SELECT a.{key}, count(*) AS mm FROM g a JOIN p b
  ON (a.r > 0 AND b.x > a.x - a.rg AND b.x < a.x + a.rg) OR (a.r <= 0 AND b.x = a.x) GROUP BY a.{key})
SELECT g.*, cnt.mm, (SELECT count(*) FROM p) AS n FROM g JOIN cnt USING ({key})) q"""


def _mi_events(spark, sf):
    long, _ = assoc.associate(load(spark, sf, "events"), "event_type", "classification", ["mi"],
                              inputs=["value", "user_id"], key="event_id", seed=0)
    return rounded(long.select("feature", "score"))


register("D4_mi_classif", sql_mi_classif("events", "event_id", "value", "event_type")
         + " UNION ALL " + sql_mi_classif("events", "event_id", "user_id", "event_type"))(_mi_events)


def _mi_discrete(spark, sf):
    """Without jitter, where values repeat: a few users hold many events each."""
    long, _ = assoc.associate(load(spark, sf, "events"), "event_type", "classification", ["mi"],
                              inputs=["user_id", "value"], key="event_id", jitter=False)
    return rounded(long.select("feature", "score"))


register("D4_mi_classif_no_jitter", sql_mi_classif("events", "event_id", "user_id", "event_type", jitter=False)
         + " UNION ALL " + sql_mi_classif("events", "event_id", "value", "event_type", jitter=False))(_mi_discrete)


def _mi_quality(spark, sf):
    d = load(spark, sf, "labels").join(load(spark, sf, "documents"), "doc_id")
    long, _ = assoc.associate(d, "quality", "classification", ["mi"], inputs=["n_chars"], key="doc_id", seed=0)
    return rounded(long.select("feature", "score"))


register("D4_mi_classif_binary", sql_mi_classif(
    "(SELECT l.doc_id, l.quality, d.n_chars FROM labels l JOIN documents d USING (doc_id))",
    "doc_id", "n_chars", "quality"))(_mi_quality)

# ------------------------------------------------------------------ D5


def sql_dcor(src: str, x: str, y: str, name: str) -> str:
    """Brute-force distance correlation over all pairs (the oracle only)."""
    return f"""SELECT '{name}' AS feature, round(sqrt(greatest((mab - 2 * mrab + ma * mb)
  / sqrt((maa - 2 * mra2 + ma * ma) * (mbb - 2 * mrb2 + mb * mb)), 0)), 6) + 0.0 AS score FROM (
WITH d AS (SELECT row_number() OVER () AS i, {x}::DOUBLE AS x, {y}::DOUBLE AS y FROM {src}),
p AS (SELECT a.i, abs(a.x - b.x) AS dx, abs(a.y - b.y) AS dy FROM d a CROSS JOIN d b),
r AS (SELECT i, avg(dx) AS ra, avg(dy) AS rb, avg(dx * dy) AS rab, avg(dx * dx) AS raa, avg(dy * dy) AS rbb
  FROM p GROUP BY i)
SELECT avg(rab) AS mab, avg(ra * rb) AS mrab, avg(ra) AS ma, avg(rb) AS mb, avg(raa) AS maa,
  avg(ra * ra) AS mra2, avg(rbb) AS mbb, avg(rb * rb) AS mrb2 FROM r) s"""


def _dcor_q(table, target, inputs):
    def q(spark, sf):
        long, _ = assoc.associate(load(spark, sf, table), target, "regression", ["dcor"], inputs=inputs)
        return rounded(long.select("feature", "score"))
    return q


register("D5_dcor_events", sql_dcor("events", "user_id", "value", "user_id"))(
    _dcor_q("events", "value", ["user_id"]))
register("D5_dcor_orders", sql_dcor("orders", "o_custkey", "o_totalprice", "o_custkey"))(
    _dcor_q("orders", "o_totalprice", ["o_custkey"]))

# ------------------------------------------------------------------ D3


def sql_mi_regression(src: str, key: str, x: str, y: str, k: int = 3, seed=0) -> str:
    """Brute-force KSG estimate over all pairs (the oracle only)."""
    from quarry.plans.catalog import sql_digamma, sql_jittered
    g = "4e-15"

    def strict(col):
        return (f"(SELECT a.{key}, count(*) - 1 AS c FROM e a JOIN e b ON "
                f"(a.eps > 0 AND b.{col} > a.{col} - greatest(a.eps * (1 - {g}) - {g} * abs(a.{col}), 0) "
                f"AND b.{col} < a.{col} + greatest(a.eps * (1 - {g}) - {g} * abs(a.{col}), 0)) "
                f"OR (a.eps <= 0 AND b.{col} = a.{col}) GROUP BY a.{key})")
    return f"""SELECT '{x}' AS feature, round(greatest({sql_digamma('max(n)')} + {sql_digamma(str(k))}
    - avg({sql_digamma('nx + 1')} + {sql_digamma('ny + 1')}), 0), 6) + 0.0 AS score FROM (
WITH jx AS {sql_jittered(src, key, x, seed)}, jy AS {sql_jittered(src, key, y, seed)},
p AS (SELECT jx.{key}, jx.x AS x, jy.x AS y FROM jx JOIN jy USING ({key})),
pr AS (SELECT a.{key}, greatest(abs(a.x - b.x), abs(a.y - b.y)) AS d FROM p a JOIN p b ON a.{key} <> b.{key}),
kk AS (SELECT {key}, list_sort(min(d, {k}))[{k}] AS eps FROM pr GROUP BY {key}),
e AS (SELECT p.*, kk.eps FROM p JOIN kk USING ({key})),
cx AS {strict('x')}, cy AS {strict('y')}
SELECT cx.c AS nx, cy.c AS ny, (SELECT count(*) FROM p) AS n FROM cx JOIN cy USING ({key})) q"""


_OF_SRC = """(SELECT l_orderkey, count(*) AS n_lines, sum(l_extendedprice) AS sum_price
  FROM lineitem GROUP BY l_orderkey)"""


def _mi_reg_orders(spark, sf):
    li = load(spark, sf, "lineitem")
    of = li.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_lines"), F.sum("l_extendedprice").alias("sum_price"))
    long, _ = assoc.associate(of, "sum_price", "regression", ["mi"], inputs=["n_lines"], key="l_orderkey", seed=0)
    return rounded(long.select("feature", "score"))


register("D3_mi_regression", sql_mi_regression(_OF_SRC, "l_orderkey", "n_lines", "sum_price"))(_mi_reg_orders)


def _mi_reg_events(spark, sf):
    long, _ = assoc.associate(load(spark, sf, "events"), "value", "regression", ["mi"], inputs=["user_id"],
                              key="event_id", seed=0)
    return rounded(long.select("feature", "score"))


register("D3_mi_regression_events", sql_mi_regression("events", "event_id", "user_id", "value"))(_mi_reg_events)
