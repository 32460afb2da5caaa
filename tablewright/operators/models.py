"""Model registry: the estimator names offered per task and how each maps
onto ``pyspark.ml``.

Parameter names follow the names users of the registry already know
(``n_estimators``, ``max_depth``, ``learning_rate``, ``C``, ``alpha``,
``max_iter``) and are translated here; a name that a model does not take is
an error. The two kernel-SVM entries are linear learners on random Fourier
features (:mod:`.kernel`), an approximation of the radial kernel; gradient
boosting of more than two classes, and of numbers, is in :mod:`.boosting`.
"""

from __future__ import annotations

import warnings

from pyspark.ml.classification import (GBTClassifier, LogisticRegression,
                                       RandomForestClassifier)
from pyspark.ml.regression import RandomForestRegressor

from .boosting import SoftmaxBoosting, SquareBoosting
from .kernel import DEFAULT_COMPONENTS, DEFAULT_EPSILON, EpsilonSVR, KernelSVC

# The offered names per task, and which learn incrementally.
CLASSIFIERS = ("RandomForestClassifier", "GradientBoostingClassifier", "LogisticRegression",
               "SVC", "SGDClassifier")
REGRESSORS = ("RandomForestRegressor", "GradientBoostingRegressor", "SVR", "SGDRegressor")
INCREMENTAL = ("SGDClassifier", "SGDRegressor")
SEED = 42
SPARK_MAX_DEPTH = 30
# The parameters each model takes.
PARAMETERS = {
    "RandomForestClassifier": ("n_estimators", "max_depth"), "RandomForestRegressor": ("n_estimators", "max_depth"),
    "GradientBoostingClassifier": ("n_estimators", "learning_rate"),
    "GradientBoostingRegressor": ("n_estimators", "learning_rate"), "LogisticRegression": ("C",),
    "SVC": ("C", "max_iter", "gamma", "n_components"), "SVR": ("C", "max_iter", "gamma", "n_components", "epsilon"),
    "SGDClassifier": ("alpha", "max_iter"), "SGDRegressor": ("alpha", "max_iter"),
}


def model_options(task_type: str) -> list[str]:
    return list(CLASSIFIERS if task_type == "classification" else REGRESSORS)


def is_incremental(model_name: str) -> bool:
    return model_name in INCREMENTAL


def check_parameters(model_name: str, params: dict | None) -> dict:
    """A copy of ``params``, refused if the model does not take one of them."""
    params = dict(params or {})
    strange = sorted(set(params) - set(PARAMETERS[model_name]))
    if strange:
        raise ValueError(f"{model_name} takes {', '.join(PARAMETERS[model_name])}, not {', '.join(strange)}.")
    return params


def _depth(params: dict) -> int:
    depth = params.get("max_depth")
    if depth in (None, 0):
        warnings.warn("Unlimited tree depth is capped at Spark's maximum of 30.")
        return SPARK_MAX_DEPTH
    if depth > SPARK_MAX_DEPTH:
        warnings.warn(f"max_depth {depth} is capped at Spark's maximum of 30.")
        return SPARK_MAX_DEPTH
    return int(depth)


def _step(params: dict) -> float:
    rate = float(params.get("learning_rate", 0.1))
    if not 0 < rate <= 1:
        raise ValueError("learning_rate must be in (0, 1] for Spark gradient boosting.")
    return rate


def _gamma(params: dict) -> float | None:
    """A number, or None for the scale of the data."""
    gamma = params.get("gamma", "scale")
    return None if gamma in (None, "scale") else float(gamma)


def _components(params: dict) -> int:
    return int(params.get("n_components", DEFAULT_COMPONENTS))


def build_estimator(model_name: str, task_type: str, params: dict | None, n_train: int,
                    n_classes: int = 2, features_col: str = "features", label_col: str = "label"):
    """The MLlib estimator for a registry name (non-incremental models)."""
    names = CLASSIFIERS if task_type == "classification" else REGRESSORS
    if model_name not in names:
        raise ValueError(f"No {task_type} model is called {model_name!r}; there are {', '.join(names)}.")
    params = check_parameters(model_name, params)
    common = {"featuresCol": features_col, "labelCol": label_col}
    trees = int(params.get("n_estimators", 100))
    if model_name == "RandomForestClassifier":
        return RandomForestClassifier(numTrees=trees, maxDepth=_depth(params), seed=SEED, **common)
    if model_name == "RandomForestRegressor":
        return RandomForestRegressor(numTrees=trees, maxDepth=_depth(params), featureSubsetStrategy="all",
                                     seed=SEED, **common)
    if model_name == "GradientBoostingClassifier":
        if n_classes > 2:
            return SoftmaxBoosting(classes=n_classes, maxIter=trees, stepSize=_step(params), **common)
        return GBTClassifier(maxIter=trees, stepSize=_step(params), maxDepth=3, seed=SEED, **common)
    if model_name == "GradientBoostingRegressor":
        return SquareBoosting(maxIter=trees, stepSize=_step(params), **common)
    reg = 1.0 / (float(params.get("C", 1.0)) * max(n_train, 1))
    if model_name == "LogisticRegression":
        return LogisticRegression(maxIter=2000, regParam=reg, elasticNetParam=0.0,
                                  standardization=False, **common)
    if model_name == "SVC":
        return KernelSVC(classes=n_classes, regParam=reg, gamma=_gamma(params), components=_components(params),
                         maxIter=int(params.get("max_iter", 100)), seed=SEED, **common)
    if model_name == "SVR":
        return EpsilonSVR(regParam=reg, epsilon=float(params.get("epsilon", DEFAULT_EPSILON)), gamma=_gamma(params),
                          components=_components(params), maxIter=int(params.get("max_iter", 50)), seed=SEED, **common)
    raise ValueError(f"{model_name} learns incrementally and has no one-shot estimator.")
