import re

import numpy as np

from quarry.llm import quality

SF001, SF01 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, dup = [], 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.append(line)
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    count = {}
    for w in windows:
        count[w] = count.get(w, 0) + 1
    hit = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(5)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(hit))


def test_counts_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    labels = spark.read.parquet(f"{SF001}/labels.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = quality.quality_report(docs, labels).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert tuple(r[c] for c in quality.COUNTS) == brute(texts[r["doc_id"]])
        n, rep = r["n_words"], r["n_repeat_words"]
        assert r["base_failed"] == (n < 10 or 100 * rep > 20 * n)
        assert not (r["kept"] and r["base_failed"])


def test_repeats_with_large_vocabulary():
    rng = np.random.default_rng(0)
    ids = rng.integers(0, 50_000, 30_000)
    ids[20_000:20_010] = ids[100:110]
    n = len(set(ids.tolist()))
    _, dense = np.unique(ids, return_inverse=True)
    assert quality.repeated_words(dense, n) == 20


def test_trees_are_monotonic_and_learn():
    rng = np.random.default_rng(1)
    x = rng.random((3000, len(quality.FEATURES)))
    y = ((x[:, 2] < 0.5) ^ (rng.random(3000) < 0.05)).astype(float)
    m = quality.fit_trees(x, y)
    assert ((quality.predict(m, x) >= 0.5) == (x[:, 2] < 0.5)).mean() > 0.95
    probe = np.repeat(x[:200], 50, axis=0)
    for f, sign in enumerate(quality.FEATURES.values()):
        if sign:
            p = probe.copy()
            p[:, f] = np.tile(np.linspace(0, 1, 50), 200)
            steps = np.diff(quality.predict(m, p).reshape(200, 50), axis=1)
            assert (sign * steps >= -1e-12).all()


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.fit(docs.where("doc_id % 2 = 0"), labels)
    rest = docs.where("doc_id % 2 = 1").join(labels, "doc_id").toPandas()
    out = quality.judge(rest["text"], model)
    assert ((out["quality"] >= 0.5) == (rest["quality"] == 1)).mean() > 0.95


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, None), (None, 1), (2, 1)], "doc_id long, quality int")
    rows = quality.quality_report(odd_docs, labels).collect()
    assert len(rows) == odd_docs.count()
    assert {r["doc_id"] for r in rows} >= {None, 9007199254740993}
    by = {r["doc_id"]: r for r in rows}
    assert all(by[k]["n_words"] == 0 and not by[k]["kept"] for k in (2, 3, 4))
    assert by[1]["kept"]
    kept = quality.good_documents(odd_docs, labels)
    assert kept.columns == odd_docs.columns
    assert quality.quality_report(no_docs, labels).count() == 0


def test_same_model_whatever_the_partitioning(spark):
    """Repeated doc_ids beyond the limit."""
    docs, labels = spark.read.parquet(f"{SF001}/documents.parquet"), spark.read.parquet(f"{SF001}/labels.parquet")
    docs = docs.union(docs.selectExpr("doc_id", "concat(text, ' tail words') as text", "lang", "source", "n_chars")).union(docs)
    models = [quality.fit(docs.repartition(n), labels, max_rows=40) for n in (1, 3, 7)]
    assert models[0] is not None
    for m in models[1:]:
        assert all(np.array_equal(m[k], models[0][k]) for k in models[0])
