
import collections
import math

import numpy as np
import pandas as pd

from quarry.llm import catalog, langid

SF001, SF01 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def test_held_out_accuracy_and_no_leak(spark):
    got = {r["doc_id"]: r for r in catalog.QUERIES["op10_language_id"](spark, SF01).collect()}
    docs = spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "lang").collect()
    held = [r for r in docs if got[r["doc_id"]]["held_out"]]
    assert 200 < len(held) < 500
    assert sum(got[r["doc_id"]]["lang_pred"] == r["lang"] for r in held) / len(held) > 0.98
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_blocks_do_not_change_the_score():
    model = {"langs": ["a", "b"], "at": langid.np.arange(langid._D, dtype="int32"), "t": 1.0,
             "w": langid.np.random.default_rng(0).standard_normal((langid._D, 2)).astype("float32")}
    text = "die der das und the of and to " * 4000
    whole = langid.classify([text, "abc", text], model)
    size, langid.BLOCK = langid.BLOCK, 1000
    try:
        cut = langid.classify([text, "abc", text], model)
    finally:
        langid.BLOCK = size
    assert (abs(whole["score"] - cut["score"]) < 1e-9).all()


def test_every_labelled_language_is_learned(spark):
    ids = [r[0] for r in spark.range(400).orderBy(langid.F.xxhash64("id").desc()).collect()]
    rare = dict.fromkeys(ids[:6], "el")     # the largest hashes: no sample over all languages holds them
    rows = [(i, f"το βιβλίο είναι εδώ και το σπίτι {i}" if i in rare else f"the book is here and the house is there {i}", rare.get(i, "en")) for i in ids]
    rows += [(7, f"das Buch ist hier und das Haus {j}", "de") for j in range(300)]      # one doc_id
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, max_rows=60)
    assert model["langs"] == ["de", "el", "en"]
    assert langid.classify(["το σπίτι είναι εδώ", "the house is there", "das Haus ist hier"], model)["lang_pred"].tolist() == ["el", "en", "de"]
    some, quota = langid.sampled(docs, 60)
    assert quota == {"de": 25, "el": 6, "en": 33}
    assert {r["lang"]: r["count"] for r in some.groupBy("lang").count().collect()} == {"de": 25, "el": 6, "en": 33}
    assert langid.quotas({"a": 5, "b": 9}, 20) == {"a": 5, "b": 9}


def test_the_bound_follows_the_number_of_languages():
    assert langid.least_score(None) == langid.least_score({"langs": ["a"] * 4}) == langid.MIN_SCORE
    assert 1 / 50 < langid.least_score({"langs": ["a"] * 50}) < 1.3 / 50


def test_odd_rows(spark, odd_docs, no_docs):
    model = langid.fit(odd_docs)
    rows = langid.predict_languages(odd_docs, model).collect()
    assert len(rows) == odd_docs.count()
    by = {r["doc_id"]: r for r in rows}
    assert all(by[k]["lang_pred"] == "und" and by[k]["score"] == 0 for k in (2, 3, 4, 8))
    assert 9007199254740993 in by
    assert langid.identified(odd_docs, model).columns == odd_docs.columns
    assert langid.fit(no_docs) is None
    assert langid.predict_languages(no_docs, None).count() == 0
    assert {r["lang_pred"] for r in langid.predict_languages(odd_docs, None).collect()} == {"und"}


def plain_ftrl(rows, y, classes):
    """Coordinate by coordinate, in dictionaries."""
    z, n, w = {}, {}, {}
    for _ in range(langid.EPOCHS):
        for x, k in zip(rows, y, strict=True):
            s = [sum(v * w.get((a, c), 0.0) for a, v in x.items()) for c in range(classes)]
            e = [math.exp(v - max(s)) for v in s]
            p = [v / sum(e) - (c == k) for c, v in enumerate(e)]
            for a, v in x.items():
                for c in range(classes):
                    g, old, i = v * p[c], n.get((a, c), 0.0), (a, c)
                    z[i] = z.get(i, 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / langid.ALPHA * w.get(i, 0.0)
                    n[i] = old + g * g
                    w[i] = 0.0 if abs(z[i]) <= langid.L1 else -(z[i] - math.copysign(langid.L1, z[i])) / ((langid.BETA + math.sqrt(n[i])) / langid.ALPHA + langid.L2)
    return w


def test_learning_and_scores_match_plain_sums(spark):
    """TF-IDF, the regression, its temperature and the score, recomputed plainly."""
    docs = spark.read.parquet(f"{SF001}/documents.parquet").where("length(text) < 900").limit(40)
    texts = {(r["lang"], r["text"]) for r in docs.collect()}
    counts = {t: dict(zip(*[v.tolist() for v in langid.counts_of(t)], strict=True)) for _, t in texts}
    rows = docs.collect()
    df = collections.Counter(a for r in rows for a in counts[r["text"]])
    idf = {a: math.log((1 + len(rows)) / (1 + c)) + 1 for a, c in df.items()}
    model = langid.fit(docs)
    got = np.zeros((langid._D, len(model["langs"])))
    got[model["at"]] = model["w"]
    # the order of learning: as the model shuffles it
    order = sorted(((r["lang"], *[v.tobytes() for v in (langid.counts_of(r["text"])[0].astype(np.int32), langid.counts_of(r["text"])[1])], r["text"])
                    for r in rows if counts[r["text"]]), key=lambda r: r[:3])
    empty = [r for r in rows if not counts[r["text"]]]
    assert not empty
    order = [order[i] for i in pd.DataFrame({"i": range(len(order))}).sample(frac=1, random_state=7)["i"]]
    y = [model["langs"].index(r[0]) for r in order]
    nth, held = collections.Counter(), []
    for k in y:
        held.append(nth[k] % langid.CALIBRATION_SHARE == langid.CALIBRATION_SHARE - 1)
        nth[k] += 1
    x = [{a: langid.TERM_SCALE * c / sum(counts[t].values()) * idf[a] for a, c in counts[t].items()} for *_, t in order]
    w = plain_ftrl([r for r, h in zip(x, held, strict=True) if not h], [k for k, h in zip(y, held, strict=True) if not h], len(model["langs"]))
    for (a, c), v in w.items():
        assert abs(got[a, c] - langid.TERM_SCALE * idf[a] * v) < 1e-5 * max(1, abs(got[a, c]))

    logits = [[sum(v * w.get((a, c), 0.0) for a, v in r.items()) for c in range(len(model["langs"]))] for r in x]

    def loss(t):
        some = [(r, k) for r, k, h in zip(logits, y, held, strict=True) if h]
        return sum(math.log(sum(math.exp((v - max(r)) / t) for v in r)) + (max(r) - r[k]) / t for r, k in some) / len(some) + 1e-4 * math.log(t) ** 2

    assert loss(model["t"]) <= min(loss(math.exp(v / 10)) for v in range(-40, 41, 4)) + 1e-6
    found = langid.classify([t for *_, t in order], model)
    for r, lang, score in zip(logits, found["lang_pred"], found["score"], strict=True):
        e = [math.exp((v - max(r)) / model["t"]) for v in r]
        assert abs(max(e) / sum(e) - score) < 1e-4
        assert sorted(e)[-1] - sorted(e)[-2] < 1e-6 or lang == model["langs"][e.index(max(e))]


def test_a_hot_document_on_many_partitions(spark):
    """A third of the rows is one row; the model is the same wherever rows lie."""
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text", "lang")
    one = docs.limit(1)
    for _ in range(6):
        one = one.union(one)
    models = [langid.fit(docs.union(one).repartition(n), max_rows=50) for n in (2, 11)]
    assert all(np.array_equal(models[0][k], models[1][k]) for k in models[0])
