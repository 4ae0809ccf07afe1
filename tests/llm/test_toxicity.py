import random

import numpy as np

from weft.llm.toxicity import _key, counted, fit, predictions, thinned
from weft.plans.tables import table

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    labels = table(spark, SF, "labels")
    got = predictions(table(spark, SF, "documents"), labels)
    held = got.where("held_out").join(labels, "doc_id").collect()
    assert got.count() == 1000 and len(held) > 50
    clean = [r for r in held if r.toxic == 0]
    toxic = [r for r in held if r.toxic == 1]
    assert sum(r.predicted for r in clean) <= 0.05 * len(clean)
    assert sum(r.predicted for r in toxic) >= 0.5 * len(toxic)


def samples(mention_rate):
    rng = random.Random(2)
    texts, labels = [], []
    for i in range(600):
        toxic = i % 3 == 0
        words = [f"w{rng.randrange(300)}" for _ in range(12)]
        if toxic:
            words.append(f"vile{rng.choice('abcdefgh')}{rng.randrange(50)}")
        # One group is named mostly in toxic texts, another in clean ones.
        if rng.random() < mention_rate:
            words.append("muslims" if toxic else "christians")
        elif rng.random() < 0.1:
            words.append(rng.choice(["muslims", "christians"]))
        rng.shuffle(words)
        texts.append(" ".join(words).encode())
        labels.append(float(toxic))
    return texts, np.array(labels)


def test_a_mention_does_not_move_the_score():
    texts, labels = samples(0.4)
    model = fit(counted(texts), labels)
    a, b, c = model.margins([b"w1 w2 muslims w3", b"w1 w2 christians w3", b"w1 w2 vileq77 w3"])
    assert abs(a - b) < 0.2
    assert 1 / (1 + np.exp(-c)) >= 0.7 > 1 / (1 + np.exp(-a))
    assert _key("muslims") in model.keys.tolist()


def test_a_term_of_toxic_texts_does_not_move_the_score_by_its_prefixes():
    rng = random.Random(4)
    texts, labels = [], []
    for i in range(900):
        toxic = i % 3 == 0
        words = [f"w{rng.randrange(300)}" for _ in range(12)]
        # 95 % of the texts with the term are toxic, some name it more than once.
        if toxic and rng.random() < 0.76:
            words += ["muslims"] * rng.choice([1, 1, 2, 4])
        elif not toxic and rng.random() < 0.02:
            words.append("muslims")
        if toxic and rng.random() < 0.9:
            words.append(f"vile{rng.choice('abcdefgh')}{rng.randrange(50)}")
        rng.shuffle(words)
        texts.append(" ".join(words).encode())
        labels.append(float(toxic))
    named = [y for t, y in zip(texts, labels, strict=True) if b"muslims" in t]
    assert 0.93 < sum(named) / len(named) < 0.97
    model = fit(counted(texts), np.array(labels))
    none, *told = model.margins([b"w1 w2 w3", b"w1 w2 muslims w3", b"w1 w2 christians w3", b"muslims w1 muslims w2 muslims muslims"])
    insult = model.margins([b"w1 w2 vileq77 w3"])[0]
    assert all(abs(m - none) < 0.3 for m in told)
    assert 1 / (1 + np.exp(-insult)) >= 0.7 > 1 / (1 + np.exp(-max(told)))


def scores_of_swaps(penalty, monkeypatch):
    """Scores of one sentence under swaps, where the term is in 40 % of the
    toxic training texts and in no other."""
    from weft.llm import toxicity

    monkeypatch.setattr(toxicity, "SWAP_PENALTY", penalty)
    rng = random.Random(1)
    texts, labels = [], []
    for i in range(1200):
        words = [f"w{rng.randrange(400)}" for _ in range(30)]
        if i % 8 == 0:
            if rng.random() < 0.4:
                words[17] = "muslims"
            if words[17] != "muslims" or rng.random() < 0.3:
                words[3] = rng.choice(["vilea", "vileb", "vilec"])
        rng.shuffle(words)
        texts.append(" ".join(words).encode())
        labels.append(float(i % 8 == 0))
    model = fit(counted(texts), np.array(labels))
    sentences = [f"w1 w2 {x} w3".encode() for x in ("muslims", "christians", "jews", "vilea", "muslims vilea")]
    return 1 / (1 + np.exp(-model.margins(sentences)))


def test_swapped_sentences_score_alike_only_with_the_penalty(monkeypatch):
    *told, insult, both = scores_of_swaps(20.0, monkeypatch)
    assert max(told) - min(told) < 0.05 and max(told) < 0.7 <= min(insult, both)
    *told, _, _ = scores_of_swaps(0.0, monkeypatch)
    assert max(told) - min(told) > 0.5 and max(told) >= 0.7


def test_training_bytes_are_bounded(spark, monkeypatch):
    from weft.llm import toxicity

    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda counts, labels, marks: seen.append(len(counts)))
    docs = spark.createDataFrame([(i, f"word{i} " * 100) for i in range(50)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, toxic int")
    toxicity.train(docs, labels, labels.doc_id >= 0)
    monkeypatch.setattr(toxicity, "TRAIN_BYTES", 7_000)
    toxicity.train(docs, labels, labels.doc_id >= 0)
    assert seen[0] == 50 and 8 <= seen[1] <= 10


def test_copies_are_thinned():
    assert thinned([[1, 2], [3, 2], [1, 4], [5, 6]]) == [0, 3]


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (3, "x " * 50000, 0.5), (None, "x", 0.5), (4, "x", 0.1), (4, "x", 0.1)], "doc_id long, text string, score double")
    none = spark.createDataFrame([(1, None), (None, 1), (77, 1)], "doc_id long, toxic int")
    got = predictions(docs, none).collect()
    assert len(got) == 6 and {r.predicted for r in got} == {0} and all(0 <= r.score <= 1 for r in got)
    assert predictions(docs.limit(0), none.limit(0)).count() == 0
