"""Model zoo (L3a-L3i) behind one small interface.

MLlib estimators cover the linear, tree, forest, boosting and SVM families.
Gaussian naive Bayes is a grouped aggregation (per-class mean / variance)
applied as a projection; KNN is the neighbour join of ``neighbors``.
Every fitted model's ``transform`` adds ``prediction`` (double), and for
classifiers ``probability`` (array<double>, class-index order) and
``score`` (probability of class 1 when binary).
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression,
                                       OneVsRest, RandomForestClassifier)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import (DecisionTreeRegressor, GBTRegressor, LinearRegression,
                                   RandomForestRegressor)
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import huber

SEED = 42
CONSTANT = "_one"       # a feature that is 1 in every row
MAX_DEPTH = 30          # MLlib's ceiling; stands in for "unlimited"
CLASSIFIERS = ["Logistic Regression", "Decision Tree", "Random Forest", "Gradient Boosting", "SVM", "KNN",
               "Naive Bayes"]
REGRESSORS = ["Linear Regression", "Decision Tree", "Random Forest", "Gradient Boosting", "SVM", "KNN"]


def model_names(problem_type: str) -> list[str]:
    """L3: the zoo, in the reference's order (ties in rankings keep it)."""
    return list(CLASSIFIERS if problem_type == "classification" else REGRESSORS)


def _assembler(features):
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="error")


def _finish_cls(df: DataFrame, n_classes: int) -> DataFrame:
    p = F.col("probability")
    out = df
    if n_classes == 2:
        out = out.withColumn("score", F.element_at(p, 2))
    else:
        out = out.withColumn("score", F.lit(None).cast("double"))
    return out


@dataclass
class Fitted:
    name: str
    problem_type: str
    features: list[str]
    kind: str                                  # "mllib" | "huber" | "gnb" | "knn"
    model: object = None                       # PipelineModel for mllib
    params: dict = field(default_factory=dict)
    n_classes: int = 0

    def transform(self, df: DataFrame) -> DataFrame:
        if self.kind == "mllib":
            rff = self.params.get("rff")
            src = df.withColumn("features", rff_vector(self.features, rff)) if rff else df
            if self.params.get("solver") == "liblinear":
                src = src.withColumn(CONSTANT, F.lit(1.0))
            out = self.model.transform(src)
            out = out.drop(CONSTANT)
            drop = [c for c in ("features", "rawPrediction") if c in out.columns]
            if self.problem_type == "classification":
                if "platt" in self.params:
                    z = (F.lit(self.params["platt"]["a"]) * vector_to_array("rawPrediction")[1]
                         + F.lit(self.params["platt"]["b"]))
                    p1 = 1.0 / (1.0 + F.exp(-z))
                    out = out.withColumn("probability", F.array(1.0 - p1, p1))
                elif "probability" in out.columns:
                    out = out.withColumn("probability", vector_to_array("probability"))
                else:
                    out = out.withColumn("probability", F.lit(None).cast("array<double>"))
                out = _finish_cls(out.drop(*drop), self.n_classes)
            else:
                out = out.drop(*drop)
            return out
        if self.kind == "huber":
            return df.withColumn("prediction", rff_prediction(self.features, self.params["rff"], self.params["huber"]))
        if self.kind == "gnb":
            return gnb_transform(df, self)
        if self.kind == "knn":
            from .neighbors import knn_predict
            return knn_predict(df, self)
        raise ValueError(self.kind)

    def importances(self) -> list[float] | None:
        """Impurity importances of the tree families (None otherwise)."""
        if self.kind != "mllib":
            return None
        m = self.model.stages[-1]
        fi = getattr(m, "featureImportances", None)
        return None if fi is None else [float(x) for x in fi.toArray()]

    def save(self, path: str) -> None:
        from ..sources.models import save_fitted
        save_fitted(self, path)


# ---- RBF kernel by random Fourier features (Rahimi & Recht, 2007) ----------------
RFF_DIM = 64


def rff_params(features: list[str], gamma: float, dim: int = RFF_DIM, seed: int = SEED) -> dict:
    """W ~ N(0, 2*gamma), b ~ U[0, 2pi): z(x) = sqrt(2/D) cos(W x + b) approximates exp(-gamma |x-y|^2)."""
    import numpy as np
    rng = np.random.default_rng(seed)
    w = rng.normal(0.0, math.sqrt(2.0 * gamma), size=(dim, len(features)))
    b = rng.uniform(0.0, 2 * math.pi, size=dim)
    return {"w": w.tolist(), "b": b.tolist(), "dim": dim}


def rff_vector(features: list[str], rff: dict) -> Column:
    """The row's map as one vector.  A batch of rows is mapped at once: as 64 projected columns it is a method too long to be compiled."""
    import numpy as np
    w, b, scale = np.array(rff["w"]), np.array(rff["b"]), math.sqrt(2.0 / rff["dim"])

    @F.pandas_udf("array<double>")
    def mapped(x: pd.DataFrame) -> pd.Series:
        lin = np.tile(b, (len(x), 1))
        for i in range(x.shape[1]):
            lin += x.iloc[:, i].to_numpy(np.float64, na_value=np.nan)[:, None] * w[:, i]
        return pd.Series(list(scale * np.cos(lin)))

    values = [_known(f) for f in features]
    return array_to_vector(mapped(F.struct(*[v.alias(f"x{i}") for i, v in enumerate(values)])))


def rff_prediction(features: list[str], rff: dict, model: dict) -> Column:
    """The linear model's value on the row's map, which stays in the worker."""
    import numpy as np
    coef = np.array(model["coef"])

    @F.pandas_udf("double")
    def predicted(x: pd.DataFrame) -> pd.Series:
        mapped, rows = huber.Map(rff), x.to_numpy(np.float64)
        return pd.Series(np.concatenate([mapped(rows[i:i + huber.SLICE]) @ coef + model["intercept"] for i in range(0, max(len(rows), 1), huber.SLICE)]))

    return predicted(F.struct(*[_known(f).alias(f"x{i}") for i, f in enumerate(features)]))


def _known(name: str) -> Column:
    v = F.col(name).cast("double")
    return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == math.inf), F.raise_error(F.lit(f"null, NaN or infinity in {name}"))).otherwise(v)


def _gamma(train: DataFrame, features: list[str], how) -> float:
    """sklearn's 'scale' = 1 / (n_features * X.var()); 'auto' = 1 / n_features."""
    if how == "auto":
        return 1.0 / len(features)
    if isinstance(how, (int, float)):
        return float(how)
    # X.var() over all values: E[x^2] - E[x]^2 pooled across features
    a = train.agg(*[F.avg(F.col(f).cast("double")).alias(f"m{i}") for i, f in enumerate(features)],
                  *[F.avg(F.col(f).cast("double") ** 2).alias(f"q{i}") for i, f in enumerate(features)]).first()
    d = len(features)
    mean = sum(a[f"m{i}"] for i in range(d)) / d
    sq = sum(a[f"q{i}"] for i in range(d)) / d
    var = sq - mean * mean
    return 1.0 / (d * var) if var > 0 else 1.0


# ---- MLlib estimators ---------------------------------------------------------
def mllib_estimator(name: str, problem_type: str, n_rows: int, n_classes: int, params: dict | None = None):
    """The MLlib stage for one zoo entry with the reference's defaults mapped over."""
    p = dict(params or {})
    cls = problem_type == "classification"
    if name == "Logistic Regression":
        c = float(p.get("C", 1.0))
        own = p.get("solver") == "liblinear"  # two classes only; penalises the intercept too: it is the weight of CONSTANT
        return LogisticRegression(maxIter=1000, regParam=1.0 / (c * max(n_rows, 1)), standardization=False, fitIntercept=not own)
    if name == "Linear Regression":
        return LinearRegression(regParam=0.0, solver="normal")
    if name == "Decision Tree":
        kw = dict(maxDepth=int(p.get("max_depth") or MAX_DEPTH), seed=SEED,
                  minInstancesPerNode=max(1, math.ceil(int(p.get("min_samples_split", 2)) / 2)))
        if cls:
            return DecisionTreeClassifier(impurity=p.get("criterion", "gini"), **kw)
        return DecisionTreeRegressor(**kw)
    if name == "Random Forest":
        kw = dict(numTrees=int(p.get("n_estimators", 100)), maxDepth=int(p.get("max_depth") or MAX_DEPTH),
                  minInstancesPerNode=max(1, math.ceil(int(p.get("min_samples_split", 2)) / 2)), seed=SEED)
        if cls:
            return RandomForestClassifier(featureSubsetStrategy=p.get("max_features", "sqrt"), **kw)
        return RandomForestRegressor(featureSubsetStrategy="all", **kw)
    if name == "Gradient Boosting":
        kw = dict(maxIter=int(p.get("n_estimators", 100)), stepSize=float(p.get("learning_rate", 0.1)),
                  maxDepth=int(p.get("max_depth", 3)), subsamplingRate=float(p.get("subsample", 1.0)), seed=SEED)
        if cls:
            g = GBTClassifier(**kw)
            return g if n_classes <= 2 else OneVsRest(classifier=g)
        return GBTRegressor(**kw)
    if name == "SVM":
        c = float(p.get("C", 1.0))
        if cls:
            s = LinearSVC(regParam=1.0 / (c * max(n_rows, 1)), maxIter=100, standardization=True)
            return s if n_classes <= 2 else OneVsRest(classifier=s)
        return LinearRegression(loss="huber", regParam=1.0 / (c * max(n_rows, 1)), maxIter=100)
    raise ValueError(name)


def fit(name: str, train: DataFrame, features: list[str], problem_type: str, label: str = "label",
        params: dict | None = None, n_rows: int | None = None, n_classes: int | None = None, probabilities: bool = True) -> Fitted:
    """Fit one zoo entry on ``train`` (feature columns + ``label``).

    Without ``probabilities`` the SVM's are null and their own fit is left out; predictions do not depend on them.
    """
    if n_rows is None or (problem_type == "classification" and n_classes is None):
        a = train.agg(F.count(F.lit(1)).alias("n"), F.max(label).alias("m")).first()
        n_rows = n_rows if n_rows is not None else a["n"]
        n_classes = n_classes if n_classes is not None else int((a["m"] or 0) + 1)
    n_classes = n_classes or 0
    if name == "Naive Bayes":
        return gnb_fit(train, features, label, float((params or {}).get("var_smoothing", 1e-9)), n_classes)
    if name == "KNN":
        from .neighbors import knn_fit
        return knn_fit(train, features, label, problem_type, params or {}, n_classes)
    est = mllib_estimator(name, problem_type, n_rows, n_classes, params)
    fitted_params = dict(params or {})
    in_cols = list(features)
    if name == "Logistic Regression" and fitted_params.get("solver") == "liblinear":
        if n_classes > 2:
            raise ValueError("the liblinear solver takes two classes")
        in_cols.append(CONSTANT)
        # every row again with all signs turned: the same loss, and CONSTANT varies (MLlib gives constant features no weight)
        x = [F.col(f).cast("double") for f in features]
        train = (train.select(F.col(label).cast("double").alias(label), *[c.alias(f) for f, c in zip(features, x)], F.lit(1.0).alias(CONSTANT))
                 .unionAll(train.select(1 - F.col(label), *[-c for c in x], F.lit(-1.0))))
    if name == "SVM" and (params or {}).get("kernel", "rbf") == "rbf":
        # the RBF kernel through an explicit random feature map, then a linear model
        held = train.select(label, *features).persist(StorageLevel.MEMORY_AND_DISK)
        rff = rff_params(features, _gamma(held, features, (params or {}).get("gamma", "scale")))
        fitted_params["rff"] = rff
        if problem_type == "regression":
            rows = held.select(*[_known(f).alias(f"x{i}") for i, f in enumerate(features)], _known(label).alias("y"))
            fitted_params["huber"] = huber.fit(rows, rff, 1.0 / (float((params or {}).get("C", 1.0)) * max(n_rows, 1)))
            held.unpersist()
            return Fitted(name, problem_type, list(features), "huber", params=fitted_params, n_classes=n_classes)
        # the optimizer keeps the mapped rows in blocks of its own, so only the rows they are made of are held here
        train = held.withColumn("features", rff_vector(features, rff))
    est = est.setFeaturesCol("features").setLabelCol(label) if hasattr(est, "setLabelCol") else est
    stages = [est] if "rff" in fitted_params else [_assembler(in_cols), est]
    pm = Pipeline(stages=stages).fit(train)
    fitted = Fitted(name, problem_type, list(features), "mllib", pm, fitted_params, n_classes)
    if name == "SVM" and problem_type == "classification" and n_classes == 2 and probabilities:
        fitted.params["platt"] = _platt(pm, train, label)
    if "rff" in fitted_params:
        held.unpersist()
    return fitted


def _platt(pm: PipelineModel, train: DataFrame, label: str) -> dict:
    """Probability for the linear SVM: a logistic fit on its margin (Platt scaling)."""
    scored = pm.transform(train).select(vector_to_array("rawPrediction")[1].alias("m"), F.col(label))
    va = VectorAssembler(inputCols=["m"], outputCol="mv")
    lr = LogisticRegression(featuresCol="mv", labelCol=label).fit(va.transform(scored))
    return {"a": float(lr.coefficients[0]), "b": float(lr.intercept)}


# ---- Gaussian naive Bayes (L3i) ---------------------------------------------
def gnb_fit(train: DataFrame, features: list[str], label: str = "label", var_smoothing: float = 1e-9,
            n_classes: int | None = None) -> Fitted:
    """Per-class count, mean and population variance in one grouped aggregation.

    epsilon = var_smoothing * the largest per-feature variance over all rows,
    which follows from the per-class moments without another pass.
    """
    return gnb_from_moments(gnb_moments(train, features, label)[None], features, var_smoothing, n_classes)


def gnb_moments(train: DataFrame, features: list[str], label: str = "label", by: str | None = None) -> dict:
    """Count, means and population variances per class, within each value of ``by`` (None without it)."""
    of = F.col(by) if by else F.lit(None).cast("int")
    g = train.groupBy(of.alias("of"), F.col(label).cast("double").alias("cls")).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(features)],
        *[F.var_pop(F.col(c).cast("double")).alias(f"v{i}") for i, c in enumerate(features)])
    out: dict = {}
    for r in sorted(g.collect(), key=lambda r: r["cls"]):          # one row per class (and fold)
        out.setdefault(r["of"], []).append({"cls": r["cls"], "n": r["n"], "mean": [r[f"m{i}"] for i in range(len(features))],
                                            "var": [r[f"v{i}"] for i in range(len(features))]})
    return out


def gnb_from_moments(moments: list[dict], features: list[str], var_smoothing: float = 1e-9, n_classes: int | None = None) -> Fitted:
    """The model of these per-class moments; any smoothing follows from the same moments."""
    n = sum(m["n"] for m in moments)
    tot_var = []
    for i in range(len(features)):
        mu = sum(m["n"] * m["mean"][i] for m in moments) / n
        tot_var.append(sum(m["n"] * (m["var"][i] + (m["mean"][i] - mu) ** 2) for m in moments) / n)
    eps = var_smoothing * max(tot_var)
    classes = []
    for m in moments:
        var = [v + eps for v in m["var"]]
        const = math.log(m["n"] / n) - 0.5 * sum(math.log(2 * math.pi * v) for v in var)
        classes.append({"cls": m["cls"], "mean": m["mean"], "var": var, "const": const})
    nc = max(n_classes or 0, int(max(m["cls"] for m in moments)) + 1)
    return Fitted("Naive Bayes", "classification", list(features), "gnb",
                  params={"classes": classes, "var_smoothing": var_smoothing}, n_classes=nc)


def gnb_jll(features: list[str], c: dict) -> Column:
    s = None
    for i, f in enumerate(features):
        t = (F.col(f).cast("double") - F.lit(c["mean"][i])) ** 2 / F.lit(c["var"][i])
        s = t if s is None else s + t
    return F.lit(c["const"]) - F.lit(0.5) * s


def gnb_transform(df: DataFrame, m: Fitted) -> DataFrame:
    classes = m.params["classes"]
    jll = F.array(*[gnb_jll(m.features, c) for c in classes])
    out = df.withColumn("_jll", jll).withColumn("_mx", F.array_max("_jll"))
    cls_arr = F.array(*[F.lit(float(c["cls"])) for c in classes])
    out = out.withColumn("prediction", F.element_at(cls_arr, F.array_position(F.col("_jll"), F.col("_mx")).cast("int")))
    ex = F.transform("_jll", lambda x: F.exp(x - F.col("_mx")))
    out = out.withColumn("_ex", ex).withColumn("_z", F.aggregate("_ex", F.lit(0.0), lambda a, b: a + b))
    # probability in class-index order 0..C-1 (absent classes get 0)
    idx = {int(c["cls"]): k for k, c in enumerate(classes)}
    probs = [F.element_at("_ex", idx[j] + 1) / F.col("_z") if j in idx else F.lit(0.0)
             for j in range(m.n_classes)]
    out = out.withColumn("probability", F.array(*probs)).drop("_jll", "_mx", "_ex", "_z")
    return _finish_cls(out, m.n_classes)
