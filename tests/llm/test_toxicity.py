import pathlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import queries, toxicity


def test_chances_are_cumulative_links():
    model = toxicity.Model({b"bad": 2.0, b"wor*": 1.0}, np.array([1.0, 2.0, 4.0]))
    s = np.array([model.score(b"Bad, bad worst!"), model.score(b"fine"), model.score(b"")])
    assert s[0] == pytest.approx(2 * np.log(3)) and s[1] == s[2] == 0  # "wor*" is no prefix of a used length
    p = model.chances(s)
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    assert np.allclose(p.sum(axis=1), 1) and (p >= 0).all()
    assert np.allclose(p[0, :2].sum(), sigmoid(2.0 - s[0])) and np.allclose(p[0, 0], sigmoid(1.0 - s[0]))


def planted(n, rng):
    plain, toxic = [f"word{k}" for k in range(300)], ["vileone", "vileother", "nastything", "badguy"]
    texts, marks = [], []
    for k in range(n):
        words = list(rng.choice(plain, 80))
        bad = int(k % 4 == 0) * rng.integers(1, 12)
        words += list(rng.choice(toxic, bad)) if bad else []
        rng.shuffle(words)
        texts.append(" ".join(words).encode())
        marks.append(int(bad > 0))
    return texts, marks


def test_severity_rises_and_held_out_accuracy():
    rng = np.random.default_rng(1)
    texts, marks = planted(1200, rng)
    model = toxicity.fit(texts[:800], marks[:800])
    assert (np.diff(model.thresholds) >= 0).all() and all(b"word" not in w for w in model.weights)
    p = model.chances(np.array([model.score(t) for t in texts[800:]]))
    assert ((1 - p[:, 0] >= 0.5) == np.array(marks[800:], bool)).mean() > 0.97
    few, many = (model.chances(np.array([model.score(b"vileone " * n)]))[0] @ np.arange(4) for n in (1, 12))
    assert many > few


def test_nothing_to_learn_from():
    for marks in ([0, 0], [1, 1], []):
        model = toxicity.fit([b"a", b"b"][: len(marks)], marks)
        assert (model.chances(np.array([0.0, model.score(b"a b")]))[:, 0] > 0.999).all()


@pytest.mark.parametrize("name", ["sf0.001", "sf0.1"])
def test_table_by_hand(spark, sf, name):
    """The whole query against one fit to the texts at hand and a score for each document; few labels tell nothing."""
    sf = pathlib.Path(sf).parent / name
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    rated = {}
    for r in spark.read.parquet(f"{sf}/labels.parquet").collect():
        if r["doc_id"] is not None and r["toxic"] is not None:
            rated[r["doc_id"]] = max(r["toxic"], rated.get(r["doc_id"], 0))
    texts = {i: (t or "").encode() for i, t in docs}
    order = sorted(i for i in rated if i in texts)
    model = toxicity.fit([texts[i] for i in order], [rated[i] for i in order])
    assert bool(model.weights) == (name == "sf0.1")
    got = {r["doc_id"]: r for r in queries.op4_toxicity(spark, str(sf)).collect()}
    assert len(got) == len(docs)
    for i, t in docs:
        p = model.chances(np.array([model.score((t or "").encode())]))[0]
        r = got[i]
        assert r["expected_severity"] == pytest.approx(p @ np.arange(4), abs=1e-9) and r["p_toxic"] == pytest.approx(1 - p[0], abs=1e-9) and r["grade"] == p.argmax() and r["toxic"] == (p[0] <= 0.5)


def test_sample_of_repeated_and_large_texts(spark):
    """Repeated texts count once with their first label, and long texts are taken whole, as in the fit at hand."""
    rng = np.random.default_rng(3)
    texts, marks = planted(400, rng)
    texts[7], marks[7] = b"vileone plain " * 20_000, 1
    texts += [texts[3], texts[4], texts[4]]
    marks += [1 - marks[3], marks[4], marks[4]]
    docs = spark.createDataFrame([(k, t.decode(), 1) for k, t in enumerate(texts)], "doc_id long, text string, toxic int")
    labels = spark.createDataFrame(list(enumerate(marks)), "doc_id long, toxic int")
    one, two = toxicity.fit(texts, marks), toxicity.sample(docs, labels)
    assert one.weights == two.weights and (one.thresholds == two.thresholds).all() and one.weights


def test_held_out_on_the_tables(spark, sf):
    """Even documents train, odd ones are judged."""
    folder = pathlib.Path(sf).parent / "sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    odd = toxicity.toxicity(docs, labels.where("doc_id % 2 = 0")).join(labels.where("doc_id % 2 = 1").withColumnRenamed("toxic", "truth"), "doc_id")
    got = odd.agg(F.avg((F.col("toxic") == (F.col("truth") == 1)).cast("int")), F.avg(F.when(F.col("truth") == 1, F.col("toxic").cast("int"))), F.avg(F.when(F.col("truth") == 0, F.col("toxic").cast("int")))).first()
    assert got[0] > 0.96 and got[1] > 0.85 and got[2] < 0.02, got


def test_table_and_cases(spark, sf):
    got = queries.op4_toxicity(spark, sf).collect()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(0 <= r["expected_severity"] <= 3 for r in got)
    docs = spark.createDataFrame([(1, None, "x"), (None, "a", "x"), (2, "a", "y"), (2, "a", "y")], "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([(1, 1), (None, 1), (2, None), (2, 0), (99, 1)], "doc_id long, toxic int")
    rows = toxicity.toxicity(docs, labels).collect()
    assert len(rows) == 4 and not any(r["toxic"] for r in rows)
    assert toxicity.toxicity(docs.limit(0), labels).collect() == [] and len(toxicity.toxicity(docs, labels.limit(0)).collect()) == 4
