import random
import zlib

import numpy as np
import pytest

from ticketlens.llm import toxicity


def word_list(seed, n, start=""):
    draw = random.Random(seed)
    return [start + "".join(draw.choice("abcdefgh") for _ in range(5)) for _ in range(n)]


PLAIN, INSULTS, STEMS = word_list(1, 400), word_list(2, 8, "q"), word_list(3, 40, "zzkr")


def make_rows(n):
    draw = random.Random(11)
    rows, labels = [], []
    for i in range(n):
        w = draw.choices(PLAIN, k=draw.randint(20, 200))
        toxic = draw.random() < 0.15
        if toxic:
            for _ in range(draw.randint(2, 5)):
                w.insert(draw.randrange(len(w)), draw.choice(INSULTS) + "!!" if i % 2 else draw.choice(STEMS).upper())
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 10 != 3), int(toxic)))
    return rows, labels


@pytest.fixture(scope="module")
def trained(spark):
    rows, labels = make_rows(1_500)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    truth = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    return docs, dict((i, t) for i, _, t in labels), toxicity.train(docs, truth)


def test_held_out_rows_are_told_apart(trained):
    docs, truth, model = trained
    got = toxicity.score_documents(docs, model).collect()
    assert len(got) == docs.count()
    out = [r for r in got if r.held_out]
    assert {r.doc_id for r in out} == {i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([r.predicted == truth[r.doc_id] for r in out]) > 0.98
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)


def test_held_out_labels_teach_nothing(spark, trained):
    docs, truth, model = trained
    turned = [(i, 0, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, t in truth.items()]
    again = toxicity.train(docs, spark.createDataFrame(turned, "doc_id bigint, quality int, toxic int"))
    assert again.vocabulary == model.vocabulary
    assert np.allclose(again.weights, model.weights, atol=1e-6)


def test_dropping_keeps_columns_and_clean_documents(documents, trained):
    _, _, model = trained
    docs = documents((1, " ".join(PLAIN[:50])), (2, " ".join(INSULTS * 3)), (3, None), (4, ""), (None, PLAIN[3]), (None, "x " * 200_000))
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "4", "None", "None"]


def test_no_labels_no_rows(spark, documents, trained):
    docs, _, model = trained
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert {r.predicted for r in toxicity.score_documents(docs, toxicity.train(docs, none)).collect()} == {0}
    odd = spark.createDataFrame([(None, 1), (1, None), (2, 7), (10**9, 1), (3, 0)], "doc_id bigint, toxic int")
    assert {r.predicted for r in toxicity.score_documents(docs, toxicity.train(docs, odd)).collect()} == {0}
    assert toxicity.score_documents(documents((1, "a")).limit(0), model).count() == 0


def test_label_model_finds_accuracies_without_labels(spark):
    draw = np.random.default_rng(5)
    n, voters = 6_000, toxicity.VOTERS
    y = draw.random(n) < 0.2
    true = np.full((2, voters), 0.3)
    true[0, :6], true[1, :6] = 0.05, np.linspace(0.5, 0.95, 6)
    bits = draw.random((n, voters)) < true[y.astype(int)]
    bits[:, 7] = bits[:, 6]  # two voters that are one
    masks = (bits.astype(np.int64) << np.arange(voters)).sum(axis=1)
    values, times = np.unique(masks, return_counts=True)
    votes = spark.createDataFrame(list(zip(values.tolist(), times.tolist())), "mask bigint, times bigint")
    rough = np.full((2, voters), 0.3)
    rough[1, :6] = 0.6
    model = toxicity.fit_label_model(votes, toxicity.LabelModel(0.4, rough, np.ones(voters)))
    assert abs(model.prior - y.mean()) < 0.05
    assert np.abs(model.rates[1, 1:6] - true[1, 1:6]).max() < 0.12
    assert model.weights[6] == model.weights[7] == 0.5 and model.weights[0] == 1


def test_an_id_with_many_rows_does_not_fill_the_sample(spark, monkeypatch):
    """A labelled id holds most rows; every other labelled text is still learnt from."""
    stored = {}
    keep = toxicity.keep
    monkeypatch.setattr(toxicity, "keep", lambda df, name: stored.setdefault(name, keep(df, name)))
    rows, labels = make_rows(120)
    hot = next(i for i, _ in rows if zlib.crc32(str(i).encode()) % 5)
    many = rows + [(hot, f"{rows[hot][1]} copy {k % 3}") for k in range(600)]
    docs = spark.createDataFrame(many, "doc_id bigint, text string").repartition(4)
    truth = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    toxicity.train(docs, truth, train_rows=100)
    taught = [r.text for r in stored["labelled"].collect()]
    by_id = {i: t for i, t in rows if zlib.crc32(str(i).encode()) % 5}
    want = min(len(by_id), 100)
    assert len(taught) == want and sum(t.startswith(rows[hot][1]) for t in taught) <= 1
    assert len(set(taught) & set(by_id.values())) >= want - 1
