"""End-to-end flows: table -> model-ready (Steps 1-12), supervised selection (Step 13),
unsupervised branch. Each is a composition of the operators; every fit is an aggregate and
every transform a projection, so the returned parameters re-apply to new or streaming data.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.functions.exprs import is_numeric
from kiln.operators import clean, encode, outliers, profile, select, split
from kiln.session import cut_lineage, saved


@dataclass(frozen=True)
class PrepConfig:
    """The settings of the preparation flow and their defaults (ranges in brackets)."""
    missing_strategy: str = "auto"        # auto | mean | median | mode | drop
    outlier_method: str = "iqr"           # iqr | zscore | zscore_inlier
    outlier_action: str = "cap"           # cap | remove
    z_threshold: float = 3.0              # [2.0, 4.0]
    iqr_factor: float = 1.5               # [1.0, 3.0]
    encoding: str = "auto"                # onehot | label | auto (the "Both" rule)
    test_size: float = 0.20               # [0.10, 0.40]
    max_onehot: int = 10                  # [2, 30]
    cv_folds: int = 5                     # [2, 10]
    tuning_iterations: int = 12           # [1, 50]
    corr_threshold: float = 0.95
    seed: int = 42
    order: tuple = ("missing", "duplicates", "outliers", "encode", "select")


@dataclass
class Prepared:
    data: DataFrame
    dropped_ids: list = field(default_factory=list)
    fill: object = None
    outliers: object = None
    encoding: object = None
    dropped_zero_variance: list = field(default_factory=list)
    dropped_correlated: list = field(default_factory=list)
    duplicates_removed: int = 0
    target: str | None = None


def prepare(df: DataFrame, config: PrepConfig = PrepConfig(), target: str | None = None,
            order_by: str | None = None, protect_target: bool = True) -> Prepared:
    """Steps 2-11: drop ID columns, missing values, duplicates, outliers, encoding, selection.

    With ``protect_target`` (default) the target passes through the transforms untouched and a text
    target is label-encoded; ``protect_target=False`` reproduces the reference (target transformed
    like any feature).
    """
    ids = profile.id_columns(df, order_by)
    keep_ids = [c for c in ids if c == order_by]
    cur = df.drop(*[c for c in ids if c not in keep_ids])
    out = Prepared(data=cur, dropped_ids=[c for c in ids if c not in keep_ids])
    target = target if target in cur.columns else profile.detect_target(cur)
    out.target = target
    protect = [target] if (protect_target and target) else []
    protect += keep_ids
    for step in config.order:
        if step == "missing":
            if config.missing_strategy == "auto":
                p, cur = clean.fit_fill_auto(cur)
            elif config.missing_strategy == "drop":
                p = clean.FillParams(drop_subset=[c for c in cur.columns])
                cur = p.transform(cur)
            else:
                p = clean.fit_fill(cur, config.missing_strategy)
                cur = p.transform(cur)
            out.fill = p
        elif step == "duplicates":
            n0 = cur.count()
            cur = saved(clean.drop_duplicates(cur), "distinct")  # a checkpoint is computed twice
            out.duplicates_removed = n0 - cur.count()
        elif step == "outliers":
            nums = [c for c in cur.columns if is_numeric(cur.schema[c].dataType) and c not in protect]
            if config.outlier_action == "cap":
                p = outliers.fit_cap(cur, nums, config.outlier_method, config.iqr_factor, config.z_threshold)
                cur = p.transform(cur)
            else:
                cur, p = outliers.remove_outliers(cur, nums, config.outlier_method, config.iqr_factor,
                                                  config.z_threshold)
            out.outliers = p
        elif step == "encode":
            method = {"onehot": "onehot", "label": "label"}.get(config.encoding, "auto")
            p = encode.fit_encode_table(cur, method, config.max_onehot, order_by, protect=protect)
            cur = p.transform(cur)
            if protect_target and target and cur.schema[target].dataType.simpleString() == "string":
                cur = encode.label_encode(cur, target, order_by or cur.columns[0])
            out.encoding = p
        elif step == "select":
            feats = [c for c in cur.columns if is_numeric(cur.schema[c].dataType) and c not in protect]
            zv = select.zero_variance_columns(cur, feats)
            cur = cur.drop(*zv)
            feats = [c for c in feats if c not in zv]
            corr = select.corr_filter_columns(cur, feats, config.corr_threshold)
            cur = cur.drop(*corr)
            out.dropped_zero_variance, out.dropped_correlated = zv, corr
    out.data = cur
    return out


def prepare_and_split(df: DataFrame, key_cols: list[str], config: PrepConfig = PrepConfig(),
                      target: str | None = None, order_by: str | None = None):
    """Step 12: the prepared table split into train / test (stratified for class targets)."""
    prep = prepare(df, config, target, order_by)
    t = prep.target
    strat = t if t and profile.infer_problem_type(prep.data, t) == "classification" else None
    if strat:
        tr, te = split.split_stratified(prep.data, strat, key_cols, config.test_size, config.seed)
    else:
        tr, te = split.split_random(prep.data, key_cols, config.test_size, config.seed)
    return prep, tr, te


def run_supervised(df: DataFrame, target: str, key_cols: list[str], features: list[str] | None = None,
                   config: PrepConfig = PrepConfig(), models_subset: list[str] | None = None):
    """Step 13 (supervised): drop missing target, split, train-safe imputation, scaler choice,
    then one selection run: resampling inside each training part, baseline board, CV and tuning of the
    top 3, refits judged on the test rows. Keys of any number of columns."""
    from kiln.operators import models, scale, selection_run
    ptype = profile.infer_problem_type(df, target)
    base = clean.drop_missing_target(df, target)
    feats = features or [c for c in base.columns if c != target and c not in key_cols
                         and is_numeric(base.schema[c].dataType)]
    base = base.select(*key_cols, *feats, F.col(target).cast("double").alias("label"))
    if ptype == "classification":
        tr, te = split.split_stratified(base, "label", key_cols, config.test_size, config.seed)
    else:
        tr, te = split.split_random(base, key_cols, config.test_size, config.seed)
    imp = clean.fit_train_imputer(tr, te, feats)
    tr, te = imp.transform_train(tr), imp.transform_test(te)
    feats = [c for c in feats if c not in imp.drop_columns]
    scaler = scale.choose_scaler(tr, feats)
    ncls = tr.select("label").distinct().count() if ptype == "classification" else 0
    specs = models.model_registry(ptype, tr.count(), ncls)
    if models_subset:
        specs = [s for s in specs if s.name in models_subset]
    run = selection_run.select_model(tr, te, feats, ptype, scaler, key_cols, specs=specs, k=config.cv_folds, n_iter=config.tuning_iterations, seed=config.seed)
    return {"problem_type": ptype, "scaler": scaler, "features": feats, "leaderboard": run.leaderboard, "cv": run.cross_validation,
            "search": run.tuning, "final": run.final, "selection": run}


def run_unsupervised(df: DataFrame, id_col: str, k_max: int = 8):
    """Step 13 (no target): feature matrix, components, k-means sweep and DBSCAN on them, leaderboard, view
    of the best clusters. None for a table too small to cluster."""
    from kiln.operators import unsupervised as U
    mat = U.unsupervised_matrix(df, id_col)
    feats = [c for c in mat.columns if c != id_col]
    if not U.enough_for_clustering(mat, feats):
        return None
    run = U.cluster_components(cut_lineage(mat), feats, id_col, k_max)
    return {"pca": run.components.report, "components": run.components.chosen, "leaderboard": run.leaderboard,
            "best": run.best, "silhouette": run.silhouette, "view": run.view}
