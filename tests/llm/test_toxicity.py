import numpy as np
from flowlens.llm import toxicity as T


def arrays(texts):
    own = [T.features(t) for t in texts]
    return np.repeat(np.arange(len(own)), [len(f) for f in own]), np.array([x for f in own for x in f], np.int64)


def corpus(n, seed):
    """Texts of common words; grade 1 has a mild word, grade 2 a severe one."""
    rng = np.random.default_rng(seed)
    common = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    grades = rng.choice(3, n, p=(0.8, 0.12, 0.08))
    texts = []
    for g in grades:
        own = list(rng.choice(common, 60))
        if g:
            own.insert(int(rng.integers(60)), ("", rng.choice(["drat", "darnation"]), rng.choice(["Vilest!", "horrorful"]))[g])
        texts.append(" ".join(own))
    return texts, grades


def test_held_out_accuracy():
    texts, grades = corpus(1500, 0)
    model = T.fit(*arrays(texts), grades)
    more, want = corpus(500, 1)
    scores = np.array([model.score(t) for t in more])
    got = (model.at_least(scores) > 0.5).sum(axis=1)
    assert (got == want).mean() > 0.99
    severity = model.at_least(scores).sum(axis=1)
    assert severity[want == 0].mean() < severity[want == 1].mean() < severity[want == 2].mean()
    assert (np.diff(model.thresholds) >= 0).all()


def test_long_texts_gather_no_score():
    texts, grades = corpus(1500, 0)
    model = T.fit(*arrays(texts), grades)
    assert model.at_least(np.array([model.score(" ".join(texts[i] for i in np.flatnonzero(grades == 0)))]))[0, 0] < 0.5


def test_one_grade_or_no_rows():
    none = np.empty(0, np.int64)
    for grades in (none, np.zeros(3, np.int64), np.ones(3, np.int64)):
        model = T.fit(none, none, grades)
        assert not model.weights and model.at_least(np.array([1.0]))[0, 0] < 1e-9


def test_documents(spark, sf_dir, docs, empty, edge, clash):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = T.fitted(docs, labels)
    rows = {r["doc_id"]: r for r in T.scored(docs, model).collect()}
    assert len(rows) == docs.count()
    known = labels.collect()
    assert not [r for r in known if r["toxic"] == 0 and rows[r["doc_id"]]["toxic"]]
    assert all(0 <= r["severity"] <= 2 for r in rows.values())
    assert T.scored(empty, model).count() == 0 and T.scored(edge, model).count() == 10 == T.scored(clash, model).count()
    assert not T.fitted(empty, labels).weights and not T.fitted(docs, labels.limit(0)).weights
    doubled = labels.unionByName(labels)
    assert T.fitted(docs, doubled).weights == model.weights


def test_fit_matches_the_dense_likelihood():
    """The fit reaches the optimum of the penalised likelihood, found by Newton steps with numeric derivatives on a dense table."""
    rng = np.random.default_rng(3)
    table = rng.random((900, 5)) < (0.3, 0.4, 0.25, 0.35, 0.5)
    score = table @ np.array([2.0, -1.8, 2.4, 1.6, -2.0])
    chance = 1 / (1 + np.exp(-(score[:, None] - np.array([0.8, 2.2]))))
    grades = (rng.random(900)[:, None] < chance).sum(axis=1)
    rows, cols = np.nonzero(table)
    model = T.fit(rows, cols, grades)
    assert sorted(model.weights) == [0, 1, 2, 3, 4]

    def loss(x):
        total = 0.0
        for own, grade in zip(table, grades, strict=True):
            s = sum(w for w, has in zip(x[:5], own, strict=True) if has)
            reach = [1.0, *(1 / (1 + np.exp(t - s)) for t in x[5:]), 0.0]
            total -= np.log(reach[grade] - reach[grade + 1])
        return total / len(grades) + T.PENALTY * np.abs(x[:5]).sum()

    found = np.array([*(model.weights[i] for i in range(5)), *model.thresholds])
    step, eye = 1e-3, np.eye(7)
    best = found.copy()
    for _ in range(4):
        slope = np.array([(loss(best + step * e) - loss(best - step * e)) / (2 * step) for e in eye])
        bend = np.array([[(loss(best + step * (a + b)) - loss(best + step * (a - b)) - loss(best - step * (a - b)) + loss(best - step * (a + b)))
                          / (4 * step * step) for a in eye] for b in eye])
        best = best - np.linalg.solve(bend, slope)
    assert np.abs(slope).max() < 1e-5
    assert loss(found) - loss(best) < 1e-4 and np.abs(found - best).max() < 0.05


def test_held_out_accuracy_of_each_grade():
    model = T.fit(*arrays(corpus(1500, 0)[0]), corpus(1500, 0)[1])
    texts, want = corpus(2000, 5)
    got = (model.at_least(np.array([model.score(t) for t in texts])) > 0.5).sum(axis=1)
    for grade in range(3):
        assert (got[want == grade] == grade).mean() > 0.95, grade


def test_labels_that_repeat_or_are_null(spark):
    """The gravest label of a document counts; rows without an id or a toxic label are left out."""
    labels = spark.createDataFrame([(1, 0, 1), (1, 1, 0), (1, 1, 1), (2, 1, 1), (2, 0, 0), (3, None, 1), (None, 1, 0), (4, 1, None), (5, 0, None)],
                                   "doc_id long, toxic int, quality int")
    assert {(r["doc_id"], r["grade"]) for r in T.graded(labels).collect()} == {(1, 2), (2, 1), (4, 2), (5, 0)}
