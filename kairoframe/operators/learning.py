"""Learning on Spark ML: features, candidates, selection over time, calibration and counts."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, GeneralizedLinearRegression, IsotonicRegression, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import staged

from . import metrics as M

#: Candidates from the simplest to the most complex; ties go to the simpler one.
CLASSIFIERS = ("logistic", "forest", "boosted")
REGRESSORS = ("linear", "poisson", "hurdle", "boosted")
#: Families by complexity; ties go to the simpler one, then to the first by name.
COMPLEXITY = {"baseline": 0, "linear": 1, "poisson": 2, "hurdle": 2, "boosted": 3}

Predictor = Callable[[DataFrame], DataFrame]


def with_indicators(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Features as doubles (what is no number is null) and a 0/1 column for each missing value."""
    casts = {c: F.col(c).try_cast("double") for c in features}
    return df.withColumns(casts).withColumns({f"{c}_missing": F.col(c).isNull().cast("double") for c in features})


def preparation(train: DataFrame, features: Sequence[str]) -> list:
    """Median imputation (columns without any value are left out), indicators and scaling, as pipeline stages."""
    present = train.agg(*[F.count(c).alias(c) for c in features]).first()
    used = [c for c in features if present[c]]
    imputed = [f"{c}_filled" for c in used]
    return [
        Imputer(strategy="median", inputCols=used, outputCols=imputed),
        VectorAssembler(inputCols=[*imputed, *[f"{c}_missing" for c in features]], outputCol="raw_features"),
        StandardScaler(inputCol="raw_features", outputCol="features", withMean=False),
    ]


def classifier(kind: str, label: str):
    return {
        "logistic": lambda: LogisticRegression(labelCol=label, regParam=0.01, maxIter=50),
        "forest": lambda: RandomForestClassifier(labelCol=label, numTrees=40, maxDepth=6, seed=7),
        "boosted": lambda: GBTClassifier(labelCol=label, maxIter=20, maxDepth=3, seed=7),
    }[kind]()


def regressor(kind: str, label: str):
    return {
        "linear": lambda: LinearRegression(labelCol=label, regParam=0.1),
        "poisson": lambda: GeneralizedLinearRegression(labelCol=label, family="poisson", link="log", regParam=0.01, maxIter=25),
        "boosted": lambda: GBTRegressor(labelCol=label, maxIter=20, maxDepth=3, seed=7),
    }[kind]()


def fit_classifier(train: DataFrame, features: Sequence[str], label: str, kind: str = "logistic") -> PipelineModel:
    prepared = with_indicators(train, features)
    return Pipeline(stages=[*preparation(prepared, features), classifier(kind, label)]).fit(prepared)


def probabilities(model: PipelineModel, df: DataFrame, features: Sequence[str]) -> DataFrame:
    """df with p, the probability of class 1."""
    scored = model.transform(with_indicators(df, features))
    return scored.withColumn("p", vector_to_array("probability")[1]).select(*df.columns, "p")


def select_classifier(df: DataFrame, features: Sequence[str], label: str, period: str, kinds: Sequence[str] = CLASSIFIERS, least_gain: float = 0.005, ece_slack: float = 0.02) -> tuple[str, dict[str, dict[str, float]]]:
    """The candidate that wins over rolling folds, or `baseline` if none beats the Laplace prior by enough.

    A candidate must lower the mean log-loss by `least_gain` of the baseline's
    and may not be worse calibrated by more than `ece_slack`.  Folds are
    periods; the loop over folds and candidates runs on the driver, all work
    on rows in Spark.
    """
    periods = [r[0] for r in df.select(period).distinct().orderBy(period).collect()]
    scores: dict[str, list[tuple[float, float]]] = {k: [] for k in ("baseline", *kinds)}
    y = F.col(label).cast("double")
    for i in range(2, len(periods)):
        fit = df.filter(F.col(period) < periods[i]).persist()
        test = df.filter(F.col(period) == periods[i])
        prior = fit.agg(M.laplace_prior(F.col(label))).first()[0]
        both = fit.select(F.count_distinct(label)).first()[0] == 2
        for kind in ("baseline", *kinds):
            if kind == "baseline":
                scored = test.withColumn("p", F.lit(prior))
            elif not both:
                continue
            else:
                scored = probabilities(fit_classifier(fit, features, label, kind), test, features)
            row = scored.agg(M.log_loss(y, F.col("p")).alias("l")).first()
            scores[kind].append((row["l"], M.calibration_error(scored, label, "p").first()["ece"]))
        fit.unpersist()
    mean = {k: {"log_loss": float(np.mean([a for a, _ in v])), "ece": float(np.mean([b for _, b in v]))} for k, v in scores.items() if v}
    base = mean["baseline"]
    good = [k for k in kinds if k in mean and mean[k]["log_loss"] <= base["log_loss"] * (1 - least_gain) and mean[k]["ece"] <= base["ece"] + ece_slack]
    return min(good, key=lambda k: (mean[k]["log_loss"], kinds.index(k)), default="baseline"), mean


def calibrate(scored: DataFrame, label: str, least_isotonic: int = 500, order: F.Column | None = None) -> tuple[str, object]:
    """Identity, a logistic on the logit (Platt) or, with enough rows, an isotonic curve: the one of least log-loss.

    Each is fitted on one half of the rows and judged on the other, so the one
    that bends most has no edge; the one chosen is then fitted on all.
    `order` deals the rows to the halves; if not given, a hash of the row.
    """
    from ..functions.scalars import logit, sigmoid

    half = F.pmod(F.xxhash64(*scored.columns) if order is None else order, F.lit(2))
    y, rows = F.col(label).cast("double"), scored.withColumns({"_z": logit(F.col("p")), "_half": half}).persist()

    def platt(known: DataFrame):
        model = LogisticRegression(labelCol=label, featuresCol="_zv").fit(VectorAssembler(inputCols=["_z"], outputCol="_zv").transform(known))
        a, b = float(model.coefficients[0]), float(model.intercept)
        return lambda df: df.withColumn("calibrated", sigmoid(F.lit(a) * logit(F.col("p")) + F.lit(b)))

    def isotonic(known: DataFrame):
        curve = IsotonicRegression(labelCol=label, featuresCol="p", predictionCol="calibrated").fit(known.select("p", y.alias(label)))
        return lambda df: curve.transform(df)

    makers = {"identity": lambda known: lambda df: df.withColumn("calibrated", F.col("p")), "platt": platt}
    if rows.count() >= least_isotonic:
        makers["isotonic"] = isotonic
    known, judged = rows.filter("_half = 0"), rows.filter("_half = 1")
    both = known.select(F.count_distinct(label)).first()[0] == 2 and not judged.isEmpty()
    losses = {k: make(known)(judged).agg(M.log_loss(y, F.col("calibrated"))).first()[0] for k, make in makers.items()} if both else {"identity": 0.0}
    best = min(losses, key=lambda k: (losses[k], list(makers).index(k)))
    chosen = makers[best](rows)
    rows.unpersist()
    return best, chosen


def fit_negative_binomial(x: np.ndarray, y: np.ndarray, l2: float = 0.01, rounds: int = 40) -> tuple[np.ndarray, float]:
    """Weights (intercept last) of a log-linear mean, by Newton steps, and the dispersion from the moments of the residuals."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, alpha = np.zeros(x.shape[1]), 0.1
    w[-1] = np.log(max(y.mean(), 1e-6))
    penalty = np.diag([l2] * (x.shape[1] - 1) + [0.0])
    for _ in range(rounds):
        mu = np.exp(np.clip(x @ w, -20, 20))
        weight = mu / (1 + alpha * mu)
        step = np.linalg.solve((x * weight[:, None]).T @ x + penalty + 1e-9 * np.eye(len(w)), x.T @ ((y - mu) / (1 + alpha * mu)) - penalty @ w)
        w = w + np.clip(step, -2, 2)
        mu = np.exp(np.clip(x @ w, -20, 20))
        alpha = max(1e-6, float((((y - mu) ** 2 - mu) / np.maximum(mu, 1e-9) ** 2).mean()))
        if abs(step).max() < 1e-8:
            break
    return w, alpha


#: Groups whose models are fitted side by side; their sums come to the driver in every round.
MOST_GROUPS = 10_000


def fit_negative_binomials(df: DataFrame, group: str, features: Sequence[str], label: str, l2: float = 0.01, rounds: int = 40) -> DataFrame:
    """(group, weights with the intercept last, dispersion, n): `fit_negative_binomial` for every group, over rows that stay where they are.

    Each round is two aggregates over all groups at once: the residuals'
    moments, which give the dispersion, and the sums of a Newton step (as many
    numbers for a group as its features squared); the steps are solved on the
    driver.  Rows with a missing value or group are left out.
    """
    if df.select(group).distinct().count() > MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} groups")
    spark, size = df.sparkSession, len(features) + 1
    rows = df.select(F.col(group).alias("g"), F.array(*[F.col(c).cast("double") for c in features], F.lit(1.0)).alias("x"), F.col(label).cast("double").alias("y"))
    rows = staged(rows.filter(F.col("g").isNotNull() & F.col("y").isNotNull() & ~F.exists("x", lambda v: v.isNull())), "counts")
    kind = rows.schema["g"].dataType.simpleString()
    first = rows.groupBy("g").agg(F.avg("y").alias("m"), F.count("*").alias("n")).collect()
    n = {r["g"]: r["n"] for r in first}
    weights = {r["g"]: np.array([0.0] * (size - 1) + [np.log(max(r["m"], 1e-6))]) for r in first}
    dispersion, open_ = dict.fromkeys(n, 0.1), set(n)
    penalty = np.diag([l2] * (size - 1) + [0.0])
    pairs = [(i, j) for i in range(size) for j in range(i, size)]

    def with_means() -> DataFrame:
        """The open groups' rows with their mean; a few numbers for each group are joined."""
        state = spark.createDataFrame([(g, weights[g].tolist(), dispersion[g]) for g in open_], f"g {kind}, w array<double>, a double")
        linear = F.aggregate(F.zip_with("x", "w", lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
        return rows.join(F.broadcast(state), "g").withColumn("mu", F.exp(F.greatest(F.lit(-20.0), F.least(F.lit(20.0), linear))))

    for _ in range(rounds):
        if not open_:
            break
        scale = 1 + F.col("a") * F.col("mu")
        x = [F.col("x")[i] for i in range(size)]
        sums = with_means().groupBy("g").agg(*[F.sum(x[i] * (F.col("y") - F.col("mu")) / scale).alias(f"s{i}") for i in range(size)], *[F.sum(F.col("mu") / scale * x[i] * x[j]).alias(f"h{i}_{j}") for i, j in pairs])
        done = set()
        for r in sums.collect():
            hessian = np.zeros((size, size))
            for i, j in pairs:
                hessian[i, j] = hessian[j, i] = r[f"h{i}_{j}"]
            w = weights[r["g"]]
            step = np.linalg.solve(hessian + penalty + 1e-9 * np.eye(size), np.array([r[f"s{i}"] for i in range(size)]) - penalty @ w)
            weights[r["g"]] = w + np.clip(step, -2, 2)
            if abs(step).max() < 1e-8:
                done.add(r["g"])
        spread = ((F.col("y") - F.col("mu")) * (F.col("y") - F.col("mu")) - F.col("mu")) / (F.greatest("mu", F.lit(1e-9)) * F.greatest("mu", F.lit(1e-9)))
        dispersion |= {r["g"]: max(1e-6, r["a"]) for r in with_means().groupBy("g").agg(F.avg(spread).alias("a")).collect()}
        open_ -= done
    return spark.createDataFrame([(g, weights[g].tolist(), float(dispersion[g]), n[g]) for g in n], f"{group} {kind}, weights array<double>, dispersion double, n bigint")


def zero_excess(df: DataFrame, count: str) -> DataFrame:
    """One row: the share of zeros, the share that a Poisson of the same mean has, and whether a hurdle is called for."""
    row = df.agg(F.avg((F.col(count) == 0).cast("double")).alias("zeros"), F.exp(-F.avg(count)).alias("poisson_zeros"))
    return row.withColumn("hurdle", F.col("zeros") - F.col("poisson_zeros") > 0.02)


def fit_regressor(train: DataFrame, features: Sequence[str], label: str, kind: str = "linear", low: float = 0.0, high: float | None = None) -> Predictor:
    """A function that adds `prediction`, never outside [low, high]; rows without a label are not learned from."""
    rows = train.filter(F.col(label).isNotNull()).withColumn(label, F.col(label).cast("double"))
    if rows.isEmpty():
        raise ValueError(f"no row has the label {label}")
    if kind == "baseline":
        mean = float(rows.agg(F.avg(label)).first()[0])
        raw = lambda df: df.withColumn("prediction", F.lit(mean))
    elif kind == "hurdle":
        raw = fit_hurdle(rows, features, label)
    else:
        prepared = with_indicators(rows, features)
        model = Pipeline(stages=[*preparation(prepared, features), regressor(kind, label)]).fit(prepared)
        raw = lambda df: model.transform(with_indicators(df, features)).select(*df.columns, "prediction")

    def predict(df: DataFrame) -> DataFrame:
        p = F.greatest(F.col("prediction"), F.lit(low))
        return raw(df).withColumn("prediction", p if high is None else F.least(p, F.lit(high)))

    return predict


def fit_hurdle(train: DataFrame, features: Sequence[str], label: str, least_excess: float = 0.02) -> Predictor:
    """A count model; two parts if there are more zeros than a Poisson regression explains.

    The parts are the probability of any count and a Poisson regression of what
    a positive count has above one.  Labels that are all zero predict zero.
    """
    y = F.col(label)
    seen = train.agg(F.count_if(y > 0).alias("positive"), F.count_if(y == 0).alias("zero"), F.max(y).alias("most")).first()
    if not seen["positive"]:
        return lambda df: df.withColumn("prediction", F.lit(0.0))
    poisson = fit_regressor(train, features, label, "poisson")
    excess = poisson(train).agg(F.avg((y == 0).cast("double")) - F.avg(F.exp(-F.col("prediction")))).first()[0]
    if excess <= least_excess or not seen["zero"]:
        return poisson
    event = fit_classifier(train.withColumn("_event", (y > 0).cast("double")), features, "_event")
    more = fit_regressor(train.filter(y > 0).withColumn(label, y - 1), features, label, "poisson") if seen["most"] > 1 else None

    def predict(df: DataFrame) -> DataFrame:
        above = more(df).withColumnRenamed("prediction", "_above") if more else df.withColumn("_above", F.lit(0.0))
        return probabilities(event, above, features).select(*df.columns, (F.col("p") * (1 + F.col("_above"))).alias("prediction"))

    return predict


@dataclass
class Selection:
    """What the candidates scored, which was chosen, how it did on the last period, and the function that uses it."""

    name: str
    promoted: bool
    scores: dict[str, float]
    holdout: dict[str, float]
    subgroups_passed: bool
    predict: Predictor
    radius: float | None = None
    notes: dict[str, float] = field(default_factory=dict)


def trainable(df: DataFrame, features: Sequence[str], label: str, period: str, least_rows: int = 100, least_periods: int = 4, least_coverage: float = 0.0, binary: bool = False) -> tuple[list[str], str | None]:
    """The features with enough values, and why nothing can be learned (None: it can), from one aggregate."""
    rows = df.filter(F.col(label).isNotNull())
    got = rows.agg(F.count("*").alias("_rows"), F.count_distinct(period).alias("_periods"), F.count_distinct(label).alias("_classes"), *[F.count(F.col(c).try_cast("double")).alias(c) for c in features]).first()
    kept = [c for c in features if got[c] and got[c] >= least_coverage * got["_rows"]]
    said = [(got["_rows"] < least_rows, "too few rows"), (got["_periods"] < least_periods, "too few periods"), (binary and got["_classes"] < 2, "one class"), (not kept, "no feature with values")]
    return kept, next((why for bad, why in said if bad), None)


def _beats(loss: float, other: float, slack: float) -> bool:
    return loss <= other * (1 + slack)


def _no_group_worse(scored: DataFrame, base: DataFrame, group: str | None, loss: F.Column, slack: float, least: int) -> bool:
    """Whether in every group of at least `least` rows the challenger's loss is within the slack of the baseline's."""
    if group is None:
        return True
    of = lambda df, name: df.groupBy(group).agg(loss.alias(name), F.count("*").alias(f"{name}_n"))
    both = of(scored, "a").join(of(base, "b"), group).filter(F.col("a_n") >= least)
    return both.filter(F.col("a") > F.greatest(F.col("b"), F.lit(1e-7)) * (1 + slack)).isEmpty()


def select_regressor(df: DataFrame, features: Sequence[str], label: str, period: str, count: bool = False, kinds: Sequence[str] = REGRESSORS, group: str | None = None, least_gain: float = 0.005, most_loss: float = 0.05, coverage: float = 0.8, low: float = 0.0, high: float | None = None, group_slack: float = 0.25, least_group: int = 100) -> Selection:
    """The regression or count model that wins over rolling folds and holds on the last period, else the mean.

    The loss is the mean absolute error, of counts the Poisson deviance.  All
    but the last period are folds; the winner must gain `least_gain` of the
    baseline's loss there, on the last period lose no more than `most_loss`
    against it, and no more than `group_slack` in any group of at least
    `least_group` rows.  The chosen model learned from all but the last
    period; its interval's radius is of the errors that the same kind of model
    makes in the period before the last, learned from those before.
    """
    rows = df.filter(F.col(label).isNotNull()).withColumn(label, F.col(label).cast("double"))
    rows = staged(rows, "examples")  # every fold and candidate reads them
    y, p = F.col(label), F.col("prediction")
    loss = M.poisson_deviance(y, p) if count else M.mae(y, p)
    periods = [r[0] for r in rows.select(period).distinct().orderBy(period).collect()]
    if len(periods) < 4:
        raise ValueError("fewer than four periods")
    if not rows.filter(y < 0).isEmpty():  # no counts
        kinds = [k for k in kinds if k not in ("poisson", "hurdle")]
    names = ["baseline", *kinds]
    losses: dict[str, list[float]] = {k: [] for k in names}
    for test_period in periods[2:-1]:
        fit, test = rows.filter(F.col(period) < test_period).persist(), rows.filter(F.col(period) == test_period)
        for kind in names:
            losses[kind].append(fit_regressor(fit, features, label, kind, low, high)(test).agg(loss).first()[0])
        fit.unpersist()
    scores = {k: float(np.mean(v)) for k, v in losses.items()}
    least = min(scores.values())
    best = min((k for k in names if np.isclose(scores[k], least, rtol=1e-10, atol=1e-12)), key=lambda k: (COMPLEXITY.get(k, 4), k))
    promoted = best != "baseline" and scores["baseline"] - scores[best] >= least_gain * scores["baseline"]

    fit, last = rows.filter(F.col(period) < periods[-1]), rows.filter(F.col(period) == periods[-1])
    base = fit_regressor(fit, features, label, "baseline", low, high)
    chosen = fit_regressor(fit, features, label, best, low, high) if promoted else base
    held = {k: f(last).agg(loss).first()[0] for k, f in (("selected", chosen), ("baseline", base))}
    passed = _no_group_worse(chosen(last), base(last), group, loss, group_slack, least_group)
    if promoted and not (passed and _beats(held["selected"], held["baseline"], most_loss)):
        promoted, chosen, held["selected"] = False, base, held["baseline"]
    earlier, own = rows.filter(F.col(period) < periods[-2]), rows.filter(F.col(period) == periods[-2])
    told = fit_regressor(earlier, features, label, best if promoted else "baseline", low, high)
    radius = M.conformal_radius(told(own), y - p, coverage).first()["radius"]
    return Selection(best if promoted else "baseline", promoted, scores, held, passed, chosen, radius)


def promote_classifier(df: DataFrame, features: Sequence[str], label: str, period: str, kinds: Sequence[str] = CLASSIFIERS, group: str | None = None, most_loss: float = 0.05, group_slack: float = 0.25, least_group: int = 100) -> Selection:
    """The classifier that wins over rolling folds, calibrated on a period of its own and held to the last one, as a whole and in each group.

    Of the periods the last is the hold-out and the one before it calibrates;
    `select_classifier` sees all but the last, the model learns from those
    before the calibrating one, and what the hold-out judges is calibrated.
    `predict` adds p.
    """
    rows = df.filter(F.col(label).isNotNull())
    periods = [r[0] for r in rows.select(period).distinct().orderBy(period).collect()]
    if len(periods) < 3:
        raise ValueError("fewer than three periods")
    seen, last = rows.filter(F.col(period) < periods[-1]).persist(), rows.filter(F.col(period) == periods[-1])
    fit, own = seen.filter(F.col(period) < periods[-2]), seen.filter(F.col(period) == periods[-2])
    name, means = select_classifier(seen, features, label, period, kinds)
    prior = seen.agg(M.laplace_prior(F.col(label))).first()[0]
    y = F.col(label).cast("double")
    loss = M.log_loss(y, F.col("p"))
    base = lambda rows: rows.withColumn("p", F.lit(prior))
    chosen, kind = base, "identity"
    if name != "baseline":
        model = fit_classifier(fit, features, label, name)
        kind, calibrated = calibrate(probabilities(model, own, features), label)
        chosen = lambda rows: calibrated(probabilities(model, rows, features)).withColumn("p", F.col("calibrated")).select(*rows.columns, "p")
    held = {k: f(last).agg(loss).first()[0] for k, f in (("selected", chosen), ("baseline", base))}
    passed = _no_group_worse(chosen(last), base(last), group, loss, group_slack, least_group)
    promoted = name != "baseline" and passed and _beats(held["selected"], held["baseline"], most_loss)
    if not promoted:
        name, chosen, held["selected"] = "baseline", base, held["baseline"]
    seen.unpersist()
    return Selection(name, promoted, {k: v["log_loss"] for k, v in means.items()}, held, passed, chosen, notes={"isotonic": float(promoted and kind == "isotonic")})
