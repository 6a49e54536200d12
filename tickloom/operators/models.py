"""Risk models: standardized logistic regression with calibration, walk-forward, and rank-based scores."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stage import staged
from ..functions.timeops import from_micros, micros, running_totals


def class_weights(df: DataFrame, y: str = "y") -> DataFrame:
    """Adds ``weight``: n / (2 n of the class); 1 where there is one class."""
    n = {r[y]: r["n"] for r in df.groupBy(y).agg(F.count("*").alias("n")).collect()}  # two rows
    if len(n) < 2:
        return df.withColumn("weight", F.lit(1.0))
    total = sum(n.values())
    return df.withColumn("weight", F.when(F.col(y) == 1, total / (2.0 * n[1])).otherwise(total / (2.0 * n[0])))


def scaling(df: DataFrame, features: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of each feature; a deviation of 0 is 1."""
    row = df.agg(*(f(c).alias(f"{n}_{i}") for i, c in enumerate(features) for n, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    return {c: (row[f"m_{i}"] or 0.0, row[f"s_{i}"] or 1.0) for i, c in enumerate(features)}


def scaled(c: str, by: dict[str, tuple[float, float]], clip: float) -> Column:
    mean, std = by[c]
    return F.greatest(F.lit(-clip), F.least(F.lit(clip), (F.col(c) - mean) / std))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def fit_logistic(df: DataFrame, features: list[str], y: str = "y", clip: float = 5.0, balanced: bool = True, max_iter: int = 100) -> dict:
    """A plain dictionary: features, scaling, clip, weights, intercept. Rows with a NULL are left out.

    The optimum of the unregularized loss, by Spark's own distributed solver.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    rows = df.select(y, *features).dropna()
    by = scaling(rows, features)
    x = rows.select(F.col(y).cast("double").alias("y"), *(scaled(c, by, clip).alias(c) for c in features))
    x = class_weights(x) if balanced else x.withColumn("weight", F.lit(1.0))
    model = LogisticRegression(labelCol="y", weightCol="weight", maxIter=max_iter, regParam=0.0, standardization=False).fit(VectorAssembler(inputCols=features, outputCol="features").transform(x))
    return {"features": features, "scaling": by, "clip": clip, "weights": [float(v) for v in model.coefficients], "intercept": float(model.intercept)}


def fit_by_descent(df: DataFrame, features: list[str], y: str = "y", clip: float = 5.0, balanced: bool = True, steps: int = 500, rate: float = 0.1) -> dict:
    """The same model after so many steps of gradient descent from zero: one aggregation a step, nothing collected but sums."""
    rows = df.select(y, *features).dropna()
    by = scaling(rows, features)
    x = rows.select(F.col(y).cast("double").alias("y"), *(scaled(c, by, clip).alias(c) for c in features))
    x = (class_weights(x) if balanced else x.withColumn("weight", F.lit(1.0))).persist()
    weights, intercept = [0.0] * len(features), 0.0
    try:
        for _ in range(steps):
            score = F.lit(intercept)
            for c, v in zip(features, weights, strict=True):
                score = score + F.lit(v) * F.col(c)
            error = F.col("weight") * (sigmoid(score) - F.col("y"))
            g = x.agg(F.avg(error).alias("b"), *(F.avg(error * F.col(c)).alias(c) for c in features)).first()
            weights, intercept = [v - rate * g[c] for c, v in zip(features, weights, strict=True)], intercept - rate * g["b"]
    finally:
        x.unpersist()
    return {"features": features, "scaling": by, "clip": clip, "weights": weights, "intercept": intercept}


def margin(model: dict) -> Column:
    out = F.lit(model["intercept"])
    for c, v in zip(model["features"], model["weights"], strict=True):
        out = out + F.lit(v) * scaled(c, {k: tuple(s) for k, s in model["scaling"].items()}, model["clip"])
    return out


def fit_isotonic(df: DataFrame, score: str, y: str) -> dict:
    """Points of the isotonic fit of the labels on a score; rows of one score are one weighted row."""
    from pyspark.ml.regression import IsotonicRegression

    rows = df.select(F.col(score).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna()
    means = rows.groupBy("x").agg(F.avg("y").alias("y"), F.count("*").cast("double").alias("n"))
    m = IsotonicRegression(featuresCol="x", labelCol="y", weightCol="n").fit(means)
    return {"x": [float(v) for v in m.boundaries], "y": [float(v) for v in m.predictions]}


def fit_sigmoid(df: DataFrame, score: str, y: str) -> dict:
    """Slope and intercept of a balanced logistic fit of the labels on a score."""
    m = fit_logistic(df.select(score, y), [score], y, clip=float("inf"))
    mean, std = m["scaling"][score]
    return {"slope": m["weights"][0] / std, "intercept": m["intercept"] - m["weights"][0] * mean / std}


def interpolated(x: Column, points: dict) -> Column:
    """Piecewise linear between the points, constant outside. A row looks its place up by halving, not at every point."""
    n = len(points["x"])
    # text that becomes one constant array: an expression for each number would make the plan as long as the points
    xs, ys = (F.split(F.lit(",".join(repr(float(v)) for v in points[k])), ",").cast("array<double>") for k in ("x", "y"))
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(n.bit_length()))))

    def value(x: Column, below: Column) -> Column:
        ax, bx, ay, by = (F.get(v, i) for v in (xs, ys) for i in (below - 1, below))
        return F.when(below == 0, float(points["y"][0])).when(below == n, float(points["y"][-1])).otherwise(ay + (x - ax) / (bx - ax) * (by - ay))

    once = lambda c, use: F.get(F.transform(F.array(c), use), F.lit(0))
    below = lambda x: F.aggregate(steps, F.lit(0), lambda at, s: F.when(F.get(xs, at + s - 1) <= x, at + s).otherwise(at))
    return once(x, lambda x: once(below(x), lambda k: value(x, k)))


def scored(df: DataFrame, model: dict, out: str = "p_hat") -> DataFrame:
    """Adds the probability, calibrated where the model has points for it."""
    if missing := [c for c in model["features"] if c not in df.columns]:
        raise ValueError(f"missing feature columns: {', '.join(missing)}")
    p = sigmoid(margin(model))
    if "isotonic" in model:
        p = interpolated(p, model["isotonic"])
    elif "sigmoid" in model:
        p = sigmoid(F.lit(model["sigmoid"]["intercept"]) + F.lit(model["sigmoid"]["slope"]) * p)
    return df.withColumn(out, p)


def fitted(df: DataFrame, features: list[str], y: str = "y", calibration: str | None = None, **options: object) -> dict:
    """A model with its calibration (``isotonic``, ``sigmoid`` or none) of the probabilities of the rows it was fitted on."""
    model = fit_logistic(df, features, y, **options)
    if calibration:
        raw = scored(df.select(y, *features).dropna(), model)
        model[calibration] = {"isotonic": fit_isotonic, "sigmoid": fit_sigmoid}[calibration](raw, "p_hat", y)
    return model


def saved_models(fitted_: list[dict]) -> str:
    return json.dumps(fitted_, indent=1, default=str)


def loaded_models(text: str) -> list[dict]:
    """Models as saved_models() wrote them; ValueError if one lacks a part."""
    found = json.loads(text)
    for m in found:
        if missing := {"features", "scaling", "clip", "weights", "intercept"} - set(m):
            raise ValueError(f"a model lacks {', '.join(sorted(missing))}")
    return found


def walk_forward_fit(rows: DataFrame, fold_rows: list[dict], features: list[str], key: str = "event_id", t: str = "t", horizon_end: str | None = "horizon_end_ts", y: str = "y", calibration: str | None = None) -> tuple[DataFrame | None, list[dict]]:
    """Out-of-fold probabilities of all test rows, and the models, calibrated on their own training rows.

    Training rows whose horizon reaches into the test go. Without a horizon, the training range has its end in it. A fold
    with one class is left out.
    """
    out, models = None, []
    for fold in fold_rows:
        train = rows.where((F.col(t) >= F.lit(fold["train_start"])) & (F.col(t) < F.lit(fold["train_end"])) & (F.col(horizon_end) < F.lit(fold["test_start"])) if horizon_end else (F.col(t) >= F.lit(fold["train_start"])) & (F.col(t) <= F.lit(fold["train_end"])))
        test = rows.where((F.col(t) >= F.lit(fold["test_start"])) & (F.col(t) <= F.lit(fold["test_end"])))
        if train.select(y).dropna().distinct().count() < 2:
            continue
        model = fitted(train, features, y, calibration)
        models.append({"fold_id": fold["fold_id"], **model})
        p = scored(test, model).select(*dict.fromkeys((key, t, y)), "p_hat", F.lit(fold["fold_id"]).alias("fold_id"))
        out = p if out is None else out.unionByName(p)
    return out, models


def split_at(rows: DataFrame, ts: str, share: float = 0.7) -> dict | None:
    """One fold: the first ``share`` of the rows in order of time (one at least) for training, the others for the test."""
    n = rows.count()
    if n < 2:
        return None
    k = min(max(1, int(n * share)), n - 1)
    c = running_totals(rows.groupBy(micros(F.col(ts)).alias("s")).agg(F.count("*").alias("n")), [], "s", ["n"])
    at = lambda c: from_micros(c)
    cut = lambda i: F.min(F.when(F.col("cum_n") >= i, F.col("s")))
    one = c.agg(at(F.min("s")).alias("train_start"), at(cut(k)).alias("train_end"), at(cut(k + 1)).alias("test_start"), at(F.max("s")).alias("test_end")).first()
    return {"fold_id": 0, **one.asDict()}


def fit_meta(frame: DataFrame, features: list[str], fold_rows: list[dict], key: str = "event_id", ts: str = "entry_ts", y: str = "label", net: str = "net_pnl_est", calibration: str | None = None, thresholds: tuple[float, ...] = (0.1, 0.25, 0.5, 0.75)) -> tuple[DataFrame | None, dict, dict]:
    """Out-of-fold scores, the model of all rows, and a report: measures of each fold and of all rows, and for thresholds
    the share of events accepted and what they should earn. Without folds one split in time, 70 to 30, is the fold."""
    if not fold_rows:
        fold_rows = [f for f in [split_at(frame, ts)] if f]
    oof, _ = walk_forward_fit(frame, fold_rows, features, key, ts, None, y, calibration)
    oof = None if oof is None else staged(oof, "oof")
    model = fitted(frame, features, y, calibration)
    full = staged(scored(frame.select(*dict.fromkeys((y, net, *features))), model), "full")
    measures = lambda df, p: {"rows": df.count(), "auc": auc(df, p, y).first()[0], **precision_recall(df, p, y, 0.5).first().asDict()}
    passed = [F.struct(F.lit(float(x)).alias("threshold"), F.avg((F.col("p_hat") >= x).cast("double")).alias("accept_rate"), F.coalesce(F.sum(F.when(F.col("p_hat") >= x, F.col(net))), F.lit(0.0)).alias(net)) for x in thresholds]
    report = {
        "features": features,
        "folds": [] if oof is None else [{"fold_id": f["fold_id"], **measures(oof.where(F.col("fold_id") == f["fold_id"]), "p_hat")} for f in fold_rows],
        "overall": measures(full, "p_hat"),
        "thresholds": [r.asDict() for r in full.agg(F.array(*passed).alias("x")).first()["x"]],
        "oof_coverage": 0.0 if oof is None else oof.select(key).distinct().count() / max(1, frame.count()),
    }
    return oof, model, report


def gated(scores: DataFrame, score: str = "score", most_missing: float = 0.05) -> DataFrame:
    """The scores as they are; ValueError if more than a share of them is missing."""
    share = scores.agg(F.avg(F.col(score).isNull().cast("double"))).first()[0] or 0.0
    if share > most_missing:
        raise ValueError(f"{share:.4f} of the events have no score")
    return scores


def fused(scores: DataFrame, oof: DataFrame, full: DataFrame, key: str = "event_id") -> DataFrame:
    """Out-of-fold scores where there are, else the full model's, and which."""
    j = scores.join(oof.select(key, F.col("p_hat").alias("score_oof")), key, "left").join(full.select(key, F.col("p_hat").alias("score_full")), key, "left")
    return j.withColumn("score", F.coalesce("score_oof", "score_full")).withColumn("score_source", F.when(F.col("score_oof").isNotNull(), "oof").when(F.col("score_full").isNotNull(), "full"))


def by_score(df: DataFrame, score: str, y: str) -> DataFrame:
    """Counts by distinct score with running totals from below: what rank-based measures need, in one row a score."""
    c = df.where(F.col(score).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(score).alias("s")).agg(F.sum(F.col(y).cast("long")).alias("pos"), F.count("*").alias("n"))
    return running_totals(c, [], "s", ["pos", "n"])


def auc(df: DataFrame, score: str, y: str) -> DataFrame:
    """Area under the ROC curve; ties count half; NULL with one class."""
    neg = F.col("n") - F.col("pos")
    won = F.sum(F.col("pos") * (F.col("cum_n") - F.col("cum_pos") - neg / 2))
    return by_score(df, score, y).agg(F.try_divide(won, F.nullif(F.sum("pos") * F.sum(neg), F.lit(0))).alias("auc"))


def average_precision(df: DataFrame, score: str, y: str) -> DataFrame:
    c = by_score(df, score, y)
    totals = c.agg(F.sum("pos").alias("_pos"), F.sum("n").alias("_n"))  # one row
    pos, n = F.col("_pos") - F.col("cum_pos") + F.col("pos"), F.col("_n") - F.col("cum_n") + F.col("n")
    return c.join(F.broadcast(totals)).agg(F.try_divide(F.sum(F.col("pos") * pos / n), F.nullif(F.max("_pos"), F.lit(0))).alias("ap"))


def brier(df: DataFrame, p: str, y: str) -> DataFrame:
    return df.agg(F.avg(F.pow(F.col(p) - F.col(y), 2)).alias("brier"))


def reliability(df: DataFrame, p: str, y: str, bins: int = 10) -> DataFrame:
    """Right-closed bins of p; p of exactly 0 is in none."""
    b = F.ceil(F.col(p) * bins).cast("int")
    return df.where((F.col(p) > 0) & (F.col(p) <= 1)).groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(y).cast("double")).alias("rate"))


def precision_recall(df: DataFrame, p: str, y: str, threshold: float) -> DataFrame:
    hit, true = F.col(p) >= threshold, F.col(y) == 1
    return df.agg(F.try_divide(F.count_if(hit & true), F.count_if(hit)).alias("precision"), F.try_divide(F.count_if(hit & true), F.count_if(true)).alias("recall"))


def lift(df: DataFrame, p: str, y: str) -> DataFrame:
    """The positive rate of scores at or above the 0.9 quantile (interpolated) against that of all."""
    c = by_score(df, p, y)
    totals = c.agg(F.sum("pos").alias("_pos"), F.sum("n").alias("_n")).withColumn("_at", 0.9 * (F.col("_n") - 1))  # one row
    c = c.join(F.broadcast(totals))
    cut = c.agg(F.min(F.when(F.col("cum_n") > F.floor("_at"), F.col("s"))).alias("_lo"), F.min(F.when(F.col("cum_n") > F.ceil("_at"), F.col("s"))).alias("_hi"), F.max(F.col("_at") - F.floor("_at")).alias("_part"))
    top = c.join(F.broadcast(cut)).where(F.col("s") >= F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_part"))
    return top.agg(F.try_divide(F.sum("pos") / F.sum("n"), F.max(F.col("_pos") / F.col("_n"))).alias("lift"))
