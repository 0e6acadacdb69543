"""Registered queries for splits and folds (C1-C5) on ``events``."""

from __future__ import annotations

from quarry.operators import split
from quarry.plans.catalog import load, register

_EV = ("event_id", "user_id", "event_type", "ts")


def _ev(spark, sf):
    return load(spark, sf, "events").select(*_EV)


register("C1_split_random", """
WITH o AS (SELECT event_id, row_number() OVER (ORDER BY md5('42:' || event_id::VARCHAR), event_id) - 1 AS pos,
  count(*) OVER () AS n FROM events)
SELECT event_id, CASE WHEN pos < ceil(n * 0.2) THEN 'test' ELSE 'train' END AS split FROM o
""")(lambda spark, sf: split.split_random(_ev(spark, sf), 0.2, 42, "event_id").select("event_id", "split"))

register("C2_split_stratified", """
WITH c AS (SELECT event_type, count(*) AS cnt FROM events GROUP BY 1),
q0 AS (SELECT *, sum(cnt) OVER () AS n FROM c),
q1 AS (SELECT *, n - ceil(n * 0.2) AS n_train FROM q0),
q2 AS (SELECT *, cnt * n_train / n AS exact FROM q1),
q3 AS (SELECT *, floor(exact) AS fl, exact - floor(exact) AS rem FROM q2),
q4 AS (SELECT *, n_train - sum(fl) OVER () AS need, row_number() OVER (ORDER BY rem DESC, event_type) AS r FROM q3),
q AS (SELECT event_type, cnt - (fl + CASE WHEN r <= need THEN 1 ELSE 0 END) AS test_q FROM q4),
o AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type
  ORDER BY md5('42:' || event_id::VARCHAR), event_id) - 1 AS pos FROM events)
SELECT o.event_id, o.event_type, CASE WHEN pos < test_q THEN 'test' ELSE 'train' END AS split
FROM o JOIN q USING (event_type)
""")(lambda spark, sf: split.split_stratified(_ev(spark, sf), "event_type", 0.2, 42, "event_id")
     .select("event_id", "event_type", "split"))

register("C3_split_group", """
WITH g AS (SELECT DISTINCT user_id FROM events),
gp AS (SELECT user_id, row_number() OVER (ORDER BY md5('42:' || user_id::VARCHAR), user_id) - 1 AS pos,
  count(*) OVER () AS n FROM g)
SELECT e.event_id, e.user_id, CASE WHEN pos < ceil(n * 0.2) THEN 'test' ELSE 'train' END AS split
FROM events e JOIN gp USING (user_id)
""")(lambda spark, sf: split.split_group(_ev(spark, sf), "user_id", 0.2, 42).select("event_id", "user_id", "split"))

register("C4_split_time", """
WITH o AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS pos, count(*) OVER () AS n FROM events)
SELECT event_id, CASE WHEN pos < n - 5 * (n // 6) THEN 'train' ELSE 'test' END AS split
FROM o WHERE pos < n - 5 * (n // 6) + n // 6
""")(lambda spark, sf: split.split_time(_ev(spark, sf), ["ts", "event_id"], 0.2).select("event_id", "split"))

register("C4_split_time_holdout", """
WITH o AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS pos, count(*) OVER () AS n FROM events)
SELECT event_id, CASE WHEN pos >= n - ceil(n * 0.2) THEN 'test' ELSE 'train' END AS split FROM o
""")(lambda spark, sf: split.split_time(_ev(spark, sf), ["ts", "event_id"], 0.2, mode="holdout")
     .select("event_id", "split"))

register("C5_kfold", """
SELECT event_id, ((row_number() OVER (ORDER BY md5('42:' || event_id::VARCHAR), event_id) - 1) % 5)::INTEGER AS fold
FROM events
""")(lambda spark, sf: split.kfold(_ev(spark, sf), 5, 42, "event_id").select("event_id", "fold"))

register("C5_kfold_stratified", """
SELECT event_id, event_type, ((row_number() OVER (PARTITION BY event_type
  ORDER BY md5('42:' || event_id::VARCHAR), event_id) - 1) % 5)::INTEGER AS fold
FROM events
""")(lambda spark, sf: split.kfold(_ev(spark, sf), 5, 42, "event_id", label="event_type")
     .select("event_id", "event_type", "fold"))


# NULL classes and groups: documents that no label covers (C4 orders by a column without NULLs)
_DL = "(SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"


def _dl(spark, sf):
    return (load(spark, sf, "documents").select("doc_id")
            .join(load(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left"))


register("C2_split_stratified_nulls", f"""
WITH t AS {_DL}, c AS (SELECT quality, count(*) AS cnt FROM t GROUP BY 1),
q0 AS (SELECT *, sum(cnt) OVER () AS n FROM c),
q1 AS (SELECT *, n - ceil(n * 0.2) AS n_train FROM q0),
q2 AS (SELECT *, cnt * n_train / n AS exact FROM q1),
q3 AS (SELECT *, floor(exact) AS fl, exact - floor(exact) AS rem FROM q2),
q4 AS (SELECT *, n_train - sum(fl) OVER () AS need, row_number() OVER (ORDER BY rem DESC, quality NULLS LAST) AS r FROM q3),
q AS (SELECT quality, cnt - (fl + CASE WHEN r <= need THEN 1 ELSE 0 END) AS test_q FROM q4),
o AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5('42:' || doc_id::VARCHAR)) - 1 AS pos FROM t)
SELECT o.doc_id, o.quality, CASE WHEN pos < test_q THEN 'test' ELSE 'train' END AS split
FROM o JOIN q ON o.quality IS NOT DISTINCT FROM q.quality
""")(lambda spark, sf: split.split_stratified(_dl(spark, sf), "quality", 0.2, 42, "doc_id").select("doc_id", "quality", "split"))

register("C3_split_group_nulls", f"""
WITH t AS {_DL}, g AS (SELECT DISTINCT quality FROM t),
gp AS (SELECT quality, row_number() OVER (ORDER BY md5('42:' || coalesce(quality::VARCHAR, '<null>'))) - 1 AS pos,
  count(*) OVER () AS n FROM g)
SELECT t.doc_id, t.quality, CASE WHEN pos < ceil(n * 0.4) THEN 'test' ELSE 'train' END AS split
FROM t JOIN gp ON t.quality IS NOT DISTINCT FROM gp.quality
""")(lambda spark, sf: split.split_group(_dl(spark, sf), "quality", 0.4, 42).select("doc_id", "quality", "split"))

register("C4_split_time_ties", """
WITH t AS (SELECT event_id, user_id FROM events),
o AS (SELECT *, row_number() OVER (ORDER BY user_id, event_id) - 1 AS pos, count(*) OVER () AS n FROM t)
SELECT event_id, user_id, CASE WHEN pos >= n - ceil(n * 0.2) THEN 'test' ELSE 'train' END AS split FROM o
""")(lambda spark, sf: split.split_time(_ev(spark, sf), ["user_id", "event_id"], 0.2, mode="holdout")
     .select("event_id", "user_id", "split"))

register("C5_kfold_stratified_nulls", f"""
WITH t AS {_DL}
SELECT doc_id, quality, ((row_number() OVER (PARTITION BY quality ORDER BY md5('42:' || doc_id::VARCHAR)) - 1) % 5)::INTEGER AS fold FROM t
""")(lambda spark, sf: split.kfold(_dl(spark, sf), 5, 42, "doc_id", label="quality").select("doc_id", "quality", "fold"))
