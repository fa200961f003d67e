"""Cross-validated comparison of the three models and the final fit."""

from __future__ import annotations

import logging
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..operators.boosted import BoostedModel, fit_boosted
from ..operators.concordance import concordance
from ..operators.cox import CoxModel, fit_cox
from ..operators.eda import fold_summary
from ..operators.encoding import EVENT, TIME, Encoder, Roles, feature_roles, fit_encoder
from ..operators.forest import ForestModel, fit_forest
from ..operators.sampling import assign_folds
from ..session import materialize

log = logging.getLogger(__name__)
MODELS = [fv.COX, fv.FOREST, fv.BOOSTED]
Model = CoxModel | ForestModel | BoostedModel


def is_fit_error(error: Exception) -> bool:
    """Whether a fit failed on its numbers; a lost executor, say, is no such failure."""
    if isinstance(error, PySparkException):
        return error.getCondition() == "USER_RAISED_EXCEPTION"
    return isinstance(error, (ArithmeticError, ValueError, np.linalg.LinAlgError))


def fit_model(
    name: str, df: DataFrame, features: Sequence[str], fit_col: str | None = None, settings: dict | None = None,
    only: dict | None = None,
) -> Model:
    """Fit by name; ``settings`` holds per-model keyword arguments, ``only`` the features of fits that lack some."""
    options = (settings or {}).get(name, {}) | ({"only": only} if only else {})
    if name == fv.COX:
        return fit_cox(df, features, fit_col, **options)
    if name == fv.FOREST:
        return fit_forest(df, features, fit_col, **options)
    if name == fv.BOOSTED:
        return fit_boosted(df, features, fit_col, **options)
    raise ValueError(f"unknown model: {name}")


def score_model(model: Model, df: DataFrame, fit_col: str | None = None, replace: dict | None = None) -> DataFrame:
    """Add ``risk``; with ``fit_col`` every row is scored by the fit it names."""
    if isinstance(model, CoxModel):
        if fit_col:
            return model.score(df, fit_col)
        columns = {f: F.col(f"`{c}`") for f, c in (replace or {}).items()}
        return df.withColumn("risk", model.risk(columns=columns))
    return model.score(df, fit_col=fit_col, replace=replace)


def _fold_encoders(train: DataFrame, roles: Roles, folds: int) -> dict[int, Encoder]:
    """One encoder per fold, fitted on the rows outside the fold, from a single pass."""
    if not roles.categorical:
        return {k: Encoder(list(roles.numeric)) for k in range(folds)}
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("c"), F.col(f"`{c}`").alias("v")) for c in roles.categorical
    ]))
    seen = train.select("fold", pairs.alias("p")).select("fold", "p.c", "p.v").filter("v is not null").distinct()
    rows = seen.collect()  # names of result columns, per fold
    out = {}
    for k in range(folds):
        categories = {
            c: sorted({r.v for r in rows if r.c == c and r.fold != k}) for c in roles.categorical
        }
        out[k] = Encoder(list(roles.numeric), categories)
    return out


def joint_encoding(encoders: dict) -> tuple[list[str], Encoder, dict]:
    """Columns of all encoders together, an encoder that makes them, and the columns of each that lacks some.

    Every encoder drops its own first category, so one's dropped column may be another's feature.
    """
    some = next(iter(encoders.values()))
    union = {c: sorted({v for e in encoders.values() for v in e.categories[c]}) for c in some.categories}
    # the placeholder in front stands where an encoder's own first category is dropped
    every = Encoder(some.numeric, {c: ["", *values] for c, values in union.items()})
    used = {c for e in encoders.values() for c in e.columns}
    features = [c for c in every.columns if c in used]
    return features, every, {k: e.columns for k, e in encoders.items() if len(e.columns) < len(features)}


def cross_validate(
    train: DataFrame, roles: Roles | None = None, folds: int = 5, models: Sequence[str] = MODELS,
    settings: dict | None = None, row_id: str = "row_id", group_col: str | None = None,
) -> DataFrame:
    """(model_name, fold, c_index) over out-of-fold scores.

    All folds of a model are fitted in the same jobs: each row is copied to the training
    sets it belongs to, under that fold's number, and every fold has its own cut points and the columns of its own
    categories. A fit that fails on its numbers is logged and scores 0.
    """
    folded = materialize(assign_folds(train, folds, row_id=row_id, group_col=group_col), "folds")
    roles = roles or feature_roles(train)
    encoders = _fold_encoders(folded, roles, folds)
    features, every, only = joint_encoding(encoders)
    encoded = materialize(every.transform(folded, [row_id, EVENT, TIME, "fold"]), "encoded")
    parts, failed = [], []

    def run(name: str, members: list[int]) -> None:
        copies = encoded.withColumn("fit", F.explode(F.lit(members))).filter("fit != fold")
        mine = {k: v for k, v in only.items() if k in members}
        model = fit_model(name, copies, features, "fit", settings, mine)
        held_out = encoded.filter(F.col("fold").isin(members))
        scored = score_model(model, held_out.withColumn("fit", F.col("fold")), "fit")
        parts.append(scored.select(F.lit(name).alias("model_name"), "fold", EVENT, TIME, "risk"))

    groups = [list(range(folds))]
    for name in models:
        for members in groups:
            try:
                run(name, members)
            except Exception as joint:  # a failing fold must not take the others along
                if not is_fit_error(joint):
                    raise
                if len(members) == 1:
                    log.error("fit of %s on fold %s failed: %s", name, members, joint)
                    failed.append((name, members[0], 0.0))
                    continue
                for k in members:
                    try:
                        run(name, [k])
                    except Exception as single:
                        if not is_fit_error(single):
                            raise
                        log.error("fit of %s on fold %s failed: %s", name, k, single)
                        failed.append((name, k, 0.0))
    schema = "model_name string, fold int, c_index double"
    out = train.sparkSession.createDataFrame(failed, schema)
    if parts:
        scores = materialize(reduce(DataFrame.unionByName, parts), "oof")
        out = out.unionByName(concordance(scores, ["model_name", "fold"]).select("model_name", "fold", "c_index"))
    return out


@dataclass
class Comparison:
    report: DataFrame
    best: str
    models: dict[str, Model]
    encoder: Encoder
    train: DataFrame
    test: DataFrame


def compare_models(
    split: DataFrame, folds: int = 5, models: Sequence[str] = MODELS, settings: dict | None = None,
    row_id: str = "row_id", group_col: str | None = None,
) -> Comparison:
    """Cross-validation on the training rows, final fits, hold-out scores, best model.

    ``split`` is the feature table with a ``split`` column. The report has one row per
    model: ``model_name, cv_mean_c_index, cv_std_c_index, test_c_index``. With ``group_col``,
    which is no feature, all rows of a group fall into one fold.
    """
    spark = split.sparkSession
    train = split.filter("split = 'train'").drop("split")
    roles = feature_roles(train, [group_col] if group_col else [])
    cv = fold_summary(cross_validate(train, roles, folds, models, settings, row_id, group_col), ["model_name"])
    encoder = fit_encoder(train, roles)
    encoded = materialize(encoder.transform(split, [row_id, EVENT, TIME, "split"]), "encoded")
    encoded_train, encoded_test = encoded.filter("split = 'train'"), encoded.filter("split = 'test'")
    fitted = {name: fit_model(name, encoded_train, encoder.columns, None, settings) for name in models}
    scored = [
        score_model(m, encoded_test).select(F.lit(n).alias("model_name"), EVENT, TIME, "risk")
        for n, m in fitted.items()
    ]
    test = concordance(reduce(DataFrame.unionByName, scored), ["model_name"])
    rank = spark.createDataFrame([(n, i) for i, n in enumerate(models)], "model_name string, position int")
    report = materialize(
        rank.join(cv, "model_name", "left").join(test, "model_name", "left").select(
            "position", "model_name",
            F.coalesce("mean_c_index", F.lit(0.0)).alias("cv_mean_c_index"),
            F.coalesce("std_c_index", F.lit(0.0)).alias("cv_std_c_index"),
            F.col("c_index").alias("test_c_index"),
        ),
        "report",
    )
    best = report.orderBy(F.desc_nulls_last("test_c_index"), "position").first().model_name
    return Comparison(report.drop("position"), best, fitted, encoder, encoded_train, encoded_test)
