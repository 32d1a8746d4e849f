"""The factorization machine, trained from tables, learns a label that only pairs of words carry."""

import zlib

import numpy as np

from concord.llm import toxicity


def pair_texts(count=6000, seed=1):
    """(doc_id, text, label): 1 only where one of 8 words meets one of 48 others, among usual ones."""
    rng = np.random.default_rng(seed)
    letters = lambda alphabet: "".join(rng.choice(list(alphabet), 6))
    usual, insults, groups = [letters("aeioudlnst") for _ in range(400)], [letters("bcdfghjklm") for _ in range(8)], [letters("npqrstvwxz") for _ in range(48)]
    rows = []
    for i in range(count):
        words, insult, group = list(rng.choice(usual, 30)), rng.random() < 0.35, rng.random() < 0.35
        words += [rng.choice(insults)] * insult + [rng.choice(groups)] * group
        rng.shuffle(words)
        rows.append((i, " ".join(words), int(insult and group), bool(insult), bool(group)))
    return rows


def test_train_learns_pairs_that_neither_word_carries_alone(spark):
    rows = pair_texts()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    score = model.scores([r[1] for r in held])
    both, alone = np.array([r[2] == 1 for r in held]), np.array([r[2] == 0 and (r[3] or r[4]) for r in held])
    assert (score[both] >= 0.7).mean() >= 0.9
    assert (score[alone] < 0.5).mean() >= 0.97


def test_margin_is_the_sum_over_pairs():
    rng = np.random.default_rng(4)
    machine = toxicity.Machine(-0.3, rng.normal(size=9), rng.normal(size=(9, 5)))
    sets = [[], [3], [0, 4, 8], list(range(9))]
    got = machine.margin(np.array([i for s in sets for i in s], int), np.cumsum([len(s) for s in sets]))
    for s, m in zip(sets, got):
        pairs = sum(float(machine.factor[i] @ machine.factor[j]) for k, i in enumerate(s) for j in s[k + 1 :])
        assert abs(m - (-0.3 + machine.weight[s].sum() + pairs)) < 1e-9


def test_a_repeated_labelled_document_is_learnt_from_once(spark):
    rows = [(i, f"word{i % 7} {'awful' if i % 3 == 0 else 'kind'} thing", int(i % 3 == 0)) for i in range(300)]
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    once = toxicity.train(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), labels)
    many = toxicity.train(spark.createDataFrame([r[:2] for r in rows] + [rows[3][:2]] * 200, "doc_id long, text string"), labels)
    assert once.index == many.index and np.array_equal(once.machine.weight, many.machine.weight)


def test_every_term_that_is_toxic_alone_is_company():
    """The weakest of 100 such terms still shows what means something in its company only."""
    sets, y = [], []
    for term in range(100):
        weakest = term == 99
        for i in range(60 if weakest else 40):
            sets.append([term, 200] if weakest and i % 2 else [term])
            y.append(i % 2 if weakest else int(i % 4 > 0))
    sets += [[200]] * 400 + [[]] * 40_000
    y += [0] * (len(sets) - len(y))
    lengths = np.array([len(s) for s in sets])
    chosen = toxicity.chosen_terms(np.array([i for s in sets for i in s]), lengths, np.array(y, float), 256)
    assert set(chosen.tolist()) >= {0, 98, 99, 200}
