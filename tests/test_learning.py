import numpy as np
import pytest
from pyspark.sql import functions as F

from duotext.catalog import frames
from duotext.operators import learning as ln


@pytest.fixture(scope="module")
def features(spark, sf_dir):
    return ln.pack_features(frames.vectors(spark, sf_dir)).drop("hidden_state").persist()


def points(spark, n=60, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 2))
    y = (x[:, 0] + 0.5 * x[:, 1] + rng.normal(scale=0.7, size=n) > 0).astype(int)
    rows = [(i, [float(v) for v in x[i]], int(y[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "row_id long, hidden_state array<double>, label int")
    return x, y, ln.pack_features(df)


def newton(x, y, weights=None, c=1.0):
    """Minimum of |w|^2 / 2 + C * sum of log losses, intercept unpenalised."""
    z, s = np.c_[x, np.ones(len(x))], np.ones(len(x)) if weights is None else weights
    b, ridge = np.zeros(z.shape[1]), np.diag([1.0] * x.shape[1] + [0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ b))
        grad = ridge @ b + c * z.T @ (s * (p - y))
        hess = ridge + c * (z * (s * p * (1 - p))[:, None]).T @ z
        b = b - np.linalg.solve(hess, grad)
    return b


def test_linear_probe_is_the_regularised_optimum(spark):
    x, y, df = points(spark)
    model = ln.fit_linear_probe(df)
    b = newton(x, y)
    assert np.allclose(model.coefficients.toArray(), b[:2], atol=1e-3)
    assert model.intercept == pytest.approx(b[2], abs=1e-3)
    probs = {r["row_id"]: r["probs"] for r in ln.predict_proba(model, df).collect()}
    assert all(sum(p) == pytest.approx(1) for p in probs.values())
    classes = {r["row_id"]: r["prediction"] for r in ln.predict(model, df).collect()}
    assert all(classes[i] == int(np.argmax(probs[i])) for i in probs)


def test_two_phases_weigh_rows_by_exposure(spark):
    x, y, df = points(spark)
    gold, silver = df.where("row_id % 2 = 0"), df.where("row_id % 2 = 1")
    model = ln.two_phase_fit(gold, silver)
    b = newton(x, y, np.where(np.arange(len(y)) % 2 == 0, 9.0, 2.0))
    # two-class multinomial weights are a pair of opposite vectors, each penalised: compare decisions
    p = np.array([r["probs"][1] for r in ln.predict_proba(model, df).orderBy("row_id").collect()])
    q = 1 / (1 + np.exp(-(np.c_[x, np.ones(len(x))] @ b)))
    assert np.abs(p - q).max() < 0.02


def test_newton_steps_reach_the_optimum_from_anywhere(spark):
    x, y, df = points(spark)
    b, cold = newton(x, y), ln.fit_logistic(df)
    assert np.allclose(cold.weights[0], b[[2, 0, 1]], atol=1e-8)
    for start in (cold, ln.Logistic(np.array([[0.3, -2.0, 5.0]])), ln.Logistic(np.array([[40.0, -30.0, 20.0]]))):
        assert np.allclose(ln.fit_logistic(df.repartition(5), start=start).weights, cold.weights, atol=1e-7)
    assert ln.fit_logistic(df, start=cold).iterations == 0 < cold.iterations
    p = np.array([r["probs"][1] for r in ln.predict_proba(cold, df).orderBy("row_id").collect()])
    assert np.allclose(p, 1 / (1 + np.exp(-(np.c_[x, np.ones(len(x))] @ b))))


def test_newton_steps_of_three_classes_and_weights(spark):
    from pyspark.ml.classification import LogisticRegression

    x, _, df = points(spark, 90)
    df = df.withColumns({"label": (F.col("row_id") % 3).cast("int"), "w": 1.0 + F.col("row_id") % 4})
    own = ln.fit_logistic(df, classes=3, weight="w", C=0.5)
    n = df.agg(F.sum("w")).first()[0]
    given = LogisticRegression(weightCol="w", regParam=1 / (0.5 * n), standardization=False, family="multinomial", tol=1e-12, maxIter=500).fit(df)
    assert np.allclose(own.weights[:, 1:], given.coefficientMatrix.toArray(), atol=1e-4)
    assert max(abs(r["slope"]) for r in ln.loss_slopes(own, df, 1 / (0.5 * n), weight="w").collect()) < 1e-9
    with pytest.raises(Exception, match="not below 2"):
        ln.fit_logistic(df)


def test_a_second_phase_is_tied_to_the_first(spark):
    _, _, df = points(spark)
    gold, silver = df.where("row_id % 3 = 0"), df.where("row_id % 3 > 0")
    alone = ln.fit_logistic(gold, C=10.0)
    first, free = ln.phase_fits(gold, silver, tie=1e6)
    assert np.allclose(first.weights, ln.fit_logistic(df).weights, atol=1e-7)
    assert np.allclose(ln.phase_fits(gold, silver, tie=1e-6)[1].weights[:, 1:], first.weights[:, 1:], atol=1e-3)
    assert np.allclose(free.weights, ln.fit_logistic(gold, C=1e6).weights, atol=1e-2)
    tied = ln.phase_fits(gold, silver, tie=10.0)[1]
    assert not np.allclose(tied.weights, alone.weights, atol=1e-2)
    assert max(abs(r["slope"]) for r in ln.loss_slopes(tied, gold, 1 / (10.0 * gold.count()), center=first).collect()) < 1e-9


def test_self_training_goes_on_from_its_last_weights(spark, features):
    df = features.drop("stance")
    train, pool = df.where("row_id % 2 = 0"), df.where("row_id % 2 = 1").drop("label")
    warm, grown, _, history = ln.self_train(train, pool, threshold=0.6)
    cold, grown2, _, again = ln.self_train(train, pool, fit=lambda t: ln.fit_logistic(t), threshold=0.6)
    assert [(h["moved"], h["left"]) for h in history] == [(h["moved"], h["left"]) for h in again] and len(history) > 2
    assert sum(h["iterations"] for h in history[1:]) < sum(h["iterations"] for h in again[1:])
    assert sorted(grown.select("row_id", "label", "origin").collect()) == sorted(grown2.select("row_id", "label", "origin").collect())
    assert np.allclose(warm.weights, cold.weights, atol=1e-6)


def test_models_learn_the_vectors(features):
    def accuracy(model, label="label"):
        out = ln.predict(model, features)
        return out.agg(F.avg((F.col("prediction") == F.col(label)).cast("double"))).first()[0]

    assert accuracy(ln.fit_linear_probe(features)) > 0.6
    assert accuracy(ln.fit_mlp_head(features, [64, 16, 2])) > 0.6
    assert accuracy(ln.transfer_fit(features, features, "stance", "label")) > 0.6


def test_mlp_head_converges_in_few_passes_at_any_scale(spark):
    """Vectors of length one whose labels are noise: raw, their small components leave all hidden units nearly linear."""
    rnd = np.random.default_rng(5)
    vectors = rnd.normal(size=(400, 16))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    labels = rnd.integers(0, 2, 400).tolist()

    def fitted(scale):
        rows = list(zip(labels, (scale * vectors).tolist(), strict=True))
        df = ln.pack_features(spark.createDataFrame(rows, "label int, hidden_state array<double>").coalesce(1))
        model = ln.fit_mlp_head(df, [16, 16, 2], seed=1)
        scored = ln.predict(model, df)
        assert scored.columns == [*df.columns, "prediction"]
        return ln.iterations(model), scored.where("prediction = label").count()

    steps, right = fitted(1.0)
    small_steps, small_right = fitted(1e-3)
    assert steps < 1000 and small_steps < 1000 and right > 390 and small_right > 390


def test_text_classifier_separates(spark):
    rows = [(i, "good kind words" if i % 2 else "bad cruel words", i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "row_id long, text string, label int")
    assert ln.predict(ln.fit_text_classifier(df, num_features=64), df).where("prediction <> label").count() == 0


def test_unseen_texts_are_scored_once(spark):
    """The filter on the probabilities and the metrics read stored scores."""
    from duotext.catalog import queries as cq

    rows = [(i, "good kind words" if i % 2 else "bad cruel words", i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "row_id long, text string, label int")
    scored = cq._scored(ln.fit_text_classifier(df, num_features=64), df)
    assert scored.where("y_pred = label").count() == 40
    out = cq._held_out(scored, 2)
    assert {(r.k, r.total, r.best) for r in out.collect()} == {(2, 1.0, True)} and out.count() == 40
    assert "UDF(" not in out._jdf.queryExecution().executedPlan().toString()


def test_embedding_by_model(spark):
    def make():
        def run(input_ids, attention_mask):
            return (input_ids * attention_mask)[:, :3].astype("float32")

        return run

    df = spark.createDataFrame([(1, [5, 6, 7, 1], [1, 1, 0, 0])] * 70, "row_id int, input_ids array<int>, attention_mask array<int>")
    out = ln.embed_rows(df, make_predict_fn=make, shapes=[[4], [4]], batch_size=32)
    assert out.count() == 70 and out.first()["hidden_state"] == [5.0, 6.0, 0.0]
    assert out.schema["hidden_state"].dataType.simpleString() == "array<float>"


def test_default_embedding(spark):
    df = spark.createDataFrame([(1, "a b b"), (2, "a"), (3, None)], "row_id int, text string")
    rows = {r["row_id"]: r["hidden_state"] for r in ln.embed_rows(df, size=32).collect()}
    assert all(len(v) == 32 for v in rows.values()) and not any(rows[3])
    # weight ln((n + 1) / (df + 1)): a is in two of three texts, b twice in one
    assert max(rows[1]) == pytest.approx(2 * np.log(4 / 2), rel=1e-5)
    assert max(rows[2]) == pytest.approx(np.log(4 / 3), rel=1e-5)


@pytest.mark.parametrize("sure, converged", [(49, True), (50, False)])
def test_step_stops_below_fifty(spark, sure, converged):
    train = spark.createDataFrame([(1000, 0)], "row_id long, label int")
    pool = spark.range(120).select(F.col("id").alias("row_id"))
    probs = F.when(F.col("row_id") < sure, F.array(F.lit(0.1), F.lit(0.9))).otherwise(F.array(F.lit(0.2), F.lit(0.8)))
    # the last ten pool rows have no score and stay
    scores = pool.where("row_id < 110").withColumn("probs", probs)
    grown, rest, done = ln.self_train_step(train, pool, scores)
    assert done is converged
    assert grown.count() == 1 + sure and rest.count() == 120 - sure
    assert grown.where("origin = 'pseudo' and label <> 1").count() == 0


def test_slopes_vanish_at_the_optimum_only(spark):
    _, _, df = points(spark)
    model = ln.fit_linear_probe(df)
    slopes = {r["pos"]: r["slope"] for r in ln.loss_slopes(model, df, 1 / 60).collect()}
    assert set(slopes) == {-1, 0, 1} and max(map(abs, slopes.values())) < 1e-4
    assert max(abs(r["slope"]) for r in ln.loss_slopes(model, df.where("row_id < 40"), 1 / 40).collect()) > 1e-3


def test_a_fit_that_is_cut_off_fails(spark):
    _, _, df = points(spark)
    with pytest.raises(RuntimeError, match="not converged"):
        ln.fit_linear_probe(df, max_iter=1)


def test_loop_runs_until_it_has_converged(spark, features):
    df = features.drop("stance")
    train, pool = df.where("row_id % 2 = 0"), df.where("row_id % 2 = 1").drop("label")
    *_, history = ln.self_train(train, pool, threshold=0.6)
    assert history[-1]["converged"] and not any(h["converged"] for h in history[:-1])
    *_, cut = ln.self_train(train, pool, threshold=0.6, max_rounds=1, min_moved=1)
    assert not cut[-1]["converged"]


def test_loop_keeps_every_row(spark, features):
    df = features.drop("stance")
    train, pool = df.where("row_id % 2 = 0"), df.where("row_id % 2 = 1").drop("label")
    model, grown, rest, history = ln.self_train(train, pool, threshold=0.6, max_rounds=2, min_moved=1)
    assert 1 <= len(history) <= 2 and sum(h["moved"] for h in history) > 0
    ids = sorted(r["row_id"] for r in grown.select("row_id").union(rest.select("row_id")).collect())
    assert ids == sorted(r["row_id"] for r in df.select("row_id").collect())
    # plans stay short: rounds are cut at written tables
    assert rest._jdf.queryExecution().optimizedPlan().toString().count("Join") == 0


def test_loop_stops_on_an_empty_pool(spark, features):
    df = features.drop("stance")
    _, grown, rest, history = ln.self_train(df, df.drop("label"), threshold=0.0, min_moved=1)
    assert len(history) == 1 and history[0]["left"] == 0 and rest.count() == 0
    assert grown.count() == 2 * df.count()


@pytest.mark.parametrize("name,used", [
    ("fit_linear_probe", "fit_linear_probe"), ("two_phase_fit", "phase_fits"), ("two_phase_fit_weighted", "two_phase_fit"), ("transfer_fit", "transfer_fit"),
])
def test_registered_fits_take_every_row(spark, sf_dir, monkeypatch, name, used):
    from duotext.catalog import queries

    fit, seen = getattr(ln, used), []

    def watched(*frames, **named):
        given = [df for df in frames if hasattr(df, "toDF")]
        seen.extend(r.row_id for df in given for r in df.select("row_id").collect())
        return fit(*frames, **named)

    monkeypatch.setattr(ln, used, watched)
    queries.QUERIES[name](spark, sf_dir)
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id").collect()
    assert sorted(seen) == sorted(r.vec_id for r in rows)
