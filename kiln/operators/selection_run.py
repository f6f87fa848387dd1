"""K9-K12, I7, L7 as one run: baseline, cross-validation, search, refit, holdout and learning curve.

Every score of a fit is a row (task, model, parameters, fold, score) of a table in the shared folder. A
run that is started again on the same table skips the fits it finds there, so a lost driver costs
the fits under way. Scaling and oversampling happen inside each training part, once per part and
scaler choice, and are shared by the models and settings fitted on it.
"""

from __future__ import annotations

import json
import statistics
import uuid
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.functions.exprs import hash_unit
from kiln.operators import models, split
from kiln.operators.stages import prepare_training
from kiln.session import saved

_SCORES = "task string, model string, params string, fold int, metric string, score double"
#: Rows of a partition from which on a fit is spread over more of them.
FIT_ROWS = 32_768
SIZES = (0.1, 0.325, 0.55, 0.775, 1.0)


def spread(rows: DataFrame) -> DataFrame:
    """A saved table of many rows in as many partitions as there are cores at least: few columns make files of few
    bytes, and a fit's passes are work for all cores, whatever the bytes."""
    held = rows.rdd.getNumPartitions()
    wanted = min(rows.sparkSession.sparkContext.defaultParallelism, rows.count() // FIT_ROWS)
    return saved(rows.repartition(wanted), "spread") if wanted > held else rows


class Part:
    """A training part and the rows it is judged on; prepared once per scaler choice."""

    def __init__(self, train: DataFrame, valid: DataFrame, features: list[str], scaler: str, label: str, resample: bool, seed: int):
        self.train, self.valid, self.features, self.scaler = train, valid, features, scaler
        self.label, self.resample, self.seed = label, resample, seed
        self._ready: dict = {}

    def prepared(self, use_scaler: bool) -> tuple[list, DataFrame]:
        if use_scaler not in self._ready:
            stages, rows = prepare_training(self.train, self.features, self.scaler, use_scaler, self.label, self.resample, seed=self.seed)
            self._ready[use_scaler] = stages, spread(saved(rows, "prepared"))
        return self._ready[use_scaler]

    def fit(self, spec: models.ModelSpec, params: dict) -> PipelineModel:
        stages, rows = self.prepared(spec.use_scaler)
        est = spec.make(**params)
        if hasattr(est, "setLabelCol"):
            est = est.setLabelCol(self.label)
        return PipelineModel([*stages, est.fit(rows)])


class Scores:
    """The state table of a run."""

    def __init__(self, spark, path: str | None):
        self.spark, self.path, self.known = spark, path, {}
        if path is not None:
            jvm = spark._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
                found = spark.read.schema(_SCORES).option("recursiveFileLookup", "true").parquet(path)
                for r in found.collect():  # a row per fit and metric
                    self.known.setdefault((r["task"], r["model"], r["params"], r["fold"]), {})[r["metric"]] = r["score"]

    def get(self, task: str, model: str, params: dict, fold: int, work) -> dict:
        """The scores of one fit, from the table or from ``work()``."""
        key = (task, model, json.dumps(params, sort_keys=True), fold)
        if key not in self.known:
            found = work()
            if self.path is not None:
                rows = [(*key, m, None if s is None else float(s)) for m, s in found.items()]
                # a folder per fit: fits that end at the same time do not share a committer
                self.spark.createDataFrame(rows, _SCORES).coalesce(1).write.parquet(f"{self.path}/fit-{uuid.uuid4().hex}")
            self.known[key] = found
        return self.known[key]


@dataclass
class Selection:
    problem_type: str
    resampled: bool
    folds: int
    leaderboard: DataFrame
    cross_validation: DataFrame
    tuning: DataFrame
    final: DataFrame
    before_after: DataFrame
    best_name: str
    best_params: dict
    best_model: PipelineModel
    train_score: float | None
    validation_score: float | None
    curve: DataFrame | None
    models: dict = field(default_factory=dict)

    def summary(self) -> DataFrame:
        """One row about the chosen model: training score beside the cross-validated one."""
        spark = self.leaderboard.sparkSession
        return spark.createDataFrame([(self.best_name, json.dumps(self.best_params, sort_keys=True), self.train_score, self.validation_score)],
                                     "Model string, params string, train_score double, validation_score double")


def needs_resampling(train: DataFrame, label: str) -> bool:
    """Class ratio below 0.60 with two rows of the rarest class at least (I4)."""
    row = split.class_balance(train, label).first()
    return bool(row and row["resample"])


def fold_parts(folded: DataFrame, features: list[str], scaler: str, label: str, resample: bool, seed: int = 42, fold_col: str = "fold") -> list[Part]:
    """A part per fold: trained on the others, judged on its own rows, which are never resampled."""
    folds = sorted(r[0] for r in folded.select(fold_col).distinct().collect())
    return [Part(folded.where(F.col(fold_col) != f), folded.where(F.col(fold_col) == f), features, scaler, label, resample, seed) for f in folds]


def learning_curve(parts: list[Part], spec: models.ModelSpec, params: dict, problem_type: str, key_cols: list[str], metric: str,
                   sizes: tuple = SIZES, scores: Scores | None = None) -> DataFrame:
    """Mean training and validation score over the folds for nested training sizes (the first
    rows in hash order), for any model and either problem type."""
    spark = parts[0].train.sparkSession
    scores = scores or Scores(spark, None)
    rows = []
    for size in sizes:
        def one(i, size=size):
            p = parts[i]

            def work():
                some = p.train.where(hash_unit(key_cols, p.seed + 1) < size) if size < 1 else p.train
                q = Part(some, p.valid, p.features, p.scaler, p.label, p.resample, p.seed)
                model = q.fit(spec, params)
                return {"train": models._score(model.transform(some), problem_type, p.label)[metric],
                        "validation": models._score(model.transform(p.valid), problem_type, p.label)[metric]}
            return scores.get(f"curve {size}", spec.name, params, i, work)

        got = models._parallel(one, range(len(parts)))
        mean = lambda k: statistics.fmean([g[k] for g in got if g[k] is not None]) if any(g[k] is not None for g in got) else None
        rows.append((float(size), mean("train"), mean("validation")))
    return spark.createDataFrame(rows, "train_fraction double, train_score double, validation_score double")


def select_model(train: DataFrame, test: DataFrame, features: list[str], problem_type: str, scaler: str, key_cols: list[str],
                 label: str = "label", specs: list[models.ModelSpec] | None = None, top: int = 3, k: int = 5, n_iter: int = 12,
                 seed: int = 42, state: str | None = None, curve: bool = True) -> Selection:
    """Rank all models with defaults on the holdout, cross-validate and tune the ``top`` of them on folds
    of ``train``, refit each with its best setting, judge the refits on the holdout and choose the best.

    Models without settings, and all models where no two folds are possible, are fitted directly.
    ``state``: a path in the shared folder for the table of scores; give it again to go on after a loss.
    """
    spark = train.sparkSession
    key = "F1" if problem_type == "classification" else "R2"
    scores = Scores(spark, state)
    resample = problem_type == "classification" and needs_resampling(train, label)
    n_classes = train.select(label).distinct().count() if problem_type == "classification" else 0
    specs = specs or models.model_registry(problem_type, train.count(), n_classes)
    whole = Part(train, test, features, scaler, label, resample, seed)

    def judged(part: Part, spec, params):
        return lambda: models._score(part.fit(spec, params).transform(part.valid), problem_type, label)

    models.prepare_all([whole], specs)
    base = models._parallel(lambda s: {"Model": s.name, **scores.get("baseline", s.name, {}, -1, judged(whole, s, {}))}, specs)
    board = models.leaderboard_frame(spark, base, problem_type)
    leaders = [r["Model"] for r in board.orderBy("rank").limit(top).collect()]
    chosen = [s for name in leaders for s in specs if s.name == name]

    folds = split.fold_count(train, k, label if problem_type == "classification" else None)
    parts = []
    if folds >= 2:
        folded = split.assign_folds(train, folds, key_cols, stratify=label if problem_type == "classification" else None)
        parts = fold_parts(folded, features, scaler, label, resample, seed)

    def over_folds(spec, settings: list[dict]) -> list[list[float]]:
        """The folds' scores of each setting; fits of all of them run at the same time."""
        models.prepare_all(parts, [spec])
        got = models._parallel(lambda t: scores.get("fold", spec.name, settings[t[0]], t[1], judged(parts[t[1]], spec, settings[t[0]]))[key],
                               [(j, i) for j in range(len(settings)) for i in range(len(parts))])
        return [[v for v in got[j * len(parts):(j + 1) * len(parts)] if v is not None] for j in range(len(settings))]

    cv_rows, tune_rows, final_rows, best = [], [], [], {}
    for s in chosen:
        cv = over_folds(s, [{}])[0]
        cv_rows.append((s.name, statistics.fmean(cv) if cv else None, statistics.pstdev(cv) if cv else None, cv))
        params, reached, tried = {}, None, 0
        if parts and s.grid:
            settings = models.sample_params(s.grid, n_iter, seed)
            found = [(statistics.fmean(got) if got else float("-inf"), json.dumps(p, sort_keys=True), p)
                     for p, got in zip(settings, over_folds(s, settings), strict=True)]
            tried = len(found)
            reached, _, params = max(found, key=lambda x: (x[0], [-ord(c) for c in x[1]]))  # ties: first by text
        method = "Random search" if tried else "Direct fit"
        tune_rows.append((s.name, method, tried, reached, json.dumps(params, sort_keys=True)))
        model = whole.fit(s, params)
        best[s.name] = (params, model, reached if tried else (cv_rows[-1][1]), s)
        final_rows.append({"Model": s.name, **scores.get("final", s.name, params, -1, lambda m=model: models._score(m.transform(test), problem_type, label))})
    final = models.leaderboard_frame(spark, final_rows, problem_type)
    name = final.orderBy("rank").first()["Model"]
    params, model, validated, spec = best[name]
    at_train = models._score(model.transform(train), problem_type, label)[key]
    return Selection(
        problem_type, resample, folds, board,
        spark.createDataFrame(cv_rows, "Model string, cv_mean double, cv_std double, fold_scores array<double>"),
        spark.createDataFrame(tune_rows, "Model string, method string, iterations int, cv_score double, params string"),
        final, models.before_after(board, final, models.METRICS[problem_type]), name, params, model, at_train, validated,
        learning_curve(parts, spec, params, problem_type, key_cols, key, scores=scores) if curve and parts else None,
        {n: b[1] for n, b in best.items()})
