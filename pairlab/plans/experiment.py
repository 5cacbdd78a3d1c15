"""Whole runs: splits, cross-validation, ablation, exported features, 2-D views."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, replace
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from pairlab.config import MODALITIES, ExperimentConfig
from pairlab.functions.vectors import concat_vectors
from pairlab.operators.features import join_sides, side_table
from pairlab.operators.folds import assign_folds, fold_summary, label_union, train_part, val_part
from pairlab.operators.metrics import cv_summary, evaluate
from pairlab.operators.sampling import negative_pairs
from pairlab.plans import joint
from pairlab.plans.modelling import concat_side, fit_fold, fuse_side, score
from pairlab.session import materialise

Tables = dict[tuple[str, str], DataFrame]

# view -> modalities of the left side, modalities of the right side
VIEWS = {
    "sequence": (("seq",), ("seq",)),
    "structure": (("struct",), ("struct",)),
    "disease": (("disease",), ("disease",)),
}


@dataclass
class CrossValidation:
    """Outcome of one run."""

    predictions: DataFrame
    metrics: DataFrame
    summary: DataFrame


def prepare_splits(positives: DataFrame, cfg: ExperimentConfig) -> DataFrame:
    """left_id, right_id, label, fold: negatives drawn once, then both labels split together."""
    negatives = materialise(
        negative_pairs(positives, cfg.negative_ratio, cfg.seed, dedupe=cfg.dedupe), "negatives"
    )
    kept = positives.select("left_id", "right_id")
    pairs = label_union(kept.distinct() if cfg.dedupe else kept, negatives)
    return assign_folds(pairs, cfg.n_folds, cfg.seed, unique=cfg.dedupe)


def enabled_side(tables: Tables, side: str, cfg: ExperimentConfig) -> dict[str, DataFrame]:
    """Modality tables of one side that the switches leave on, in fixed order.

    Tables under names outside the fixed list always take part.
    """
    order = list(MODALITIES)
    mine = sorted((k for k in tables if k[0] == side), key=lambda k: order.index(k) if k in order else len(order))
    return {k[1]: tables[k] for k in mine if k not in MODALITIES or MODALITIES[k][0] in cfg.enabled}


def with_structure(tables: dict[str, DataFrame], missing: str = "drop") -> dict[str, DataFrame]:
    """Graph and fingerprint tables of a side joined into one modality; under 'zeros' an absent one is zeros."""
    if not {"graph", "ecfp"} <= set(tables):
        return tables
    both = tables["graph"].select("id", F.col("features").alias("_g")).join(
        tables["ecfp"].select("id", F.col("features").alias("_f")), "id", "full" if missing == "zeros" else "inner"
    )
    if missing == "zeros":
        widths = _modality_widths(both, "id")
        zeros = {c: F.array_repeat(F.lit(0.0).cast("float"), w or 0) for c, w in widths.items()}
        both = both.select("id", *[F.coalesce(F.col(c).cast("array<float>"), z).alias(c) for c, z in zeros.items()])
    merged = both.select("id", concat_vectors("_g", "_f").alias("features"))
    return {("struct" if k == "graph" else k): (merged if k == "graph" else t) for k, t in tables.items() if k != "ecfp"}


def _modality_widths(entities: DataFrame, key: str) -> dict[str, int]:
    cols = [c for c in entities.columns if c != key]
    return entities.agg(*[F.max(F.size(c)).alias(c) for c in cols]).first().asDict()


def side_entities(tables: Tables, side: str, cfg: ExperimentConfig) -> DataFrame:
    """One row per entity with all its enabled modalities, stored once for all folds.

    Under the 'zeros' policy an absent modality is filled with zeros; otherwise
    only complete entities are kept, and their pairs decide what a gap means.
    """
    key = f"{side}_id"
    enabled = with_structure(enabled_side(tables, side, cfg), cfg.missing)
    entities = materialise(side_table(enabled, key, side), f"{side}-entities")
    if cfg.missing != "zeros":
        return entities.dropna()
    fill = {c: F.array_repeat(F.lit(0.0).cast("float"), w) for c, w in _modality_widths(entities, key).items()}
    return entities.select(key, *[F.coalesce(F.col(c).cast("array<float>"), zeros).alias(c) for c, zeros in fill.items()])


def side_vectors(entities: DataFrame, side: str, train: DataFrame, cfg: ExperimentConfig, weights=None) -> DataFrame:
    """(side id, side vector) per entity, with projections fitted on the training pairs' entities."""
    key, out = f"{side}_id", f"{side}_fused"
    if cfg.fusion == "concat":
        return concat_side(entities, key, out)
    return fuse_side(entities, key, train.select(key).distinct(), cfg.common_dim, out, weights)


def fold_features(split: DataFrame, left: DataFrame, right: DataFrame, fold: int, cfg: ExperimentConfig) -> DataFrame:
    """The split's pairs with ``left_fused`` and ``right_fused`` as fold ``fold`` sees them."""
    train = train_part(split, fold)
    left_vectors = side_vectors(left, "left", train, cfg)
    right_vectors = side_vectors(right, "right", train, cfg)
    dims = {}
    if cfg.missing == "zeros":
        for side, entities in (("left", left), ("right", right)):
            wide = cfg.fusion == "concat"
            dims[f"{side}_fused"] = sum(_modality_widths(entities, f"{side}_id").values()) if wide else cfg.common_dim
    return join_sides(split, left_vectors, right_vectors, cfg.missing, dims)


def _on_folds(spark, run, cfg: ExperimentConfig) -> list:
    """``run(fold)`` for every fold from a few threads, so that their small jobs overlap."""
    target = inheritable_thread_target(spark)
    with ThreadPool(max(1, cfg.parallel_folds)) as pool:
        return pool.map(target(run), range(cfg.n_folds))


def _sides_and_moments(split: DataFrame, tables: Tables, cfg: ExperimentConfig) -> tuple[tuple, tuple]:
    """Both sides of all enabled modalities and their moments per group of folds."""
    sides = tuple(joint.build_side(side, enabled_side(tables, side, cfg), split, cfg.missing) for side in ("left", "right"))
    return sides, tuple(joint.group_moments(side, cfg.common_dim) for side in sides)


def modality_features(split: DataFrame, tables: Tables, cfg: ExperimentConfig) -> DataFrame:
    """Per held-out pair the vector of every modality of both sides, projected as the pair's fold sees it.

    Adds ``left_<modality>`` and ``right_<modality>`` columns of ``common_dim``
    numbers.  Vectors are projected once per entity and fold it occurs in;
    statistics of all folds come from one pass per side.
    """
    split = materialise(split, "split")
    sides, groups = _sides_and_moments(split, tables, cfg)
    vectors = []
    for side, of_side in zip(sides, groups, strict=True):
        maps = {
            f"{side.name}_{m}": {
                f: joint.modality_map(side, m, joint.training_moments(of_side, m, f), cfg.common_dim) for f in range(cfg.n_folds)
            }
            for m in side.spans
        }
        vectors.append(joint.fold_vectors(side, maps, side.bits(list(side.spans))))
    return joint.pairs_with_vectors(split, *vectors, cfg.missing)


def fused_features(split: DataFrame, tables: Tables, cfg: ExperimentConfig) -> DataFrame:
    """Per held-out pair the fused vector of either side, for export: pooled, or the raw vectors end to end."""
    split = materialise(split, "split")
    if cfg.fusion == "pooled":
        sides, groups = _sides_and_moments(split, tables, cfg)
    else:
        sides = tuple(joint.build_side(side, enabled_side(tables, side, cfg), split, cfg.missing) for side in ("left", "right"))
    vectors = []
    for i, side in enumerate(sides):
        names = list(side.spans)
        if cfg.fusion == "pooled":
            maps = {f: joint.fused_map(side, names, groups[i], f, cfg.fusion, cfg.common_dim) for f in range(cfg.n_folds)}
            vectors.append(joint.fold_vectors(side, {f"{side.name}_fused": maps}, side.bits(names)))
        else:
            whole = side.entities.where(F.col("have") == side.bits(names))
            vectors.append(whole.select(side.key, F.explode("folds").alias("fold"), F.col("x").alias(f"{side.name}_fused")))
    return joint.pairs_with_vectors(split, *vectors, cfg.missing)


def training_class_weights(split: DataFrame) -> dict[int, tuple[float, float]]:
    """Per fold the [class 0, class 1] weights of its training part, from one row per fold."""
    weights = {}
    for row in fold_summary(split).collect():
        pos, neg = row["train_pos"], row["train_neg"]
        weights[row["fold"]] = (2 * pos / (pos + neg), 2 * neg / (pos + neg)) if pos and neg else (1.0, 1.0)
    return weights


def _run_fold(split: DataFrame, left: DataFrame, right: DataFrame, fold: int, cfg: ExperimentConfig, weights) -> DataFrame:
    rows = fold_features(split, left, right, fold, cfg)
    rows = rows.select("left_id", "right_id", "label", "fold", concat_vectors("left_fused", "right_fused").alias("features"))
    model = fit_fold(
        train_part(rows, fold),
        kind=cfg.classifier,
        params=cfg.classifier_params,
        weights=weights,
    )
    return score(model, val_part(rows, fold))


def _merged_names(tables: dict[str, DataFrame]) -> list[str]:
    """Modality names once graph and fingerprint are one."""
    both = {"graph", "ecfp"} <= set(tables)
    return list(dict.fromkeys("struct" if both and m in ("graph", "ecfp") else m for m in tables))


LINEAR_PARAMS = {"maxIter": "most", "regParam": "penalty", "tol": "tol"}


def _fits_jointly(cfg: ExperimentConfig) -> bool:
    return cfg.classifier == "logistic" and set(cfg.classifier_params) <= set(LINEAR_PARAMS)


def _run_weights(split: DataFrame, cfg: ExperimentConfig) -> dict[int, tuple[float, float]] | None:
    if cfg.loss != "weighted_ce":
        return None
    return {f: cfg.class_weights for f in range(cfg.n_folds)} if cfg.class_weights else training_class_weights(split)


def joint_runs(split: DataFrame, tables: Tables, cfgs: dict[str, ExperimentConfig]) -> tuple[tuple, list, list]:
    """Both sides, all folds' runs of every named configuration, and their fitted coefficients.

    The configurations may differ in their switches only.  The number of jobs
    depends on the steps of the slowest run, not on folds, sides, modalities
    or configurations.
    """
    first = next(iter(cfgs.values()))
    union = replace(first, enabled=tuple({s for cfg in cfgs.values() for s in cfg.enabled}))
    sides = tuple(joint.build_side(side, enabled_side(tables, side, union), split, first.missing) for side in ("left", "right"))
    dim = first.common_dim if first.fusion == "pooled" else None
    groups = tuple(joint.group_moments(side, dim) for side in sides)
    counts = {r["fold"]: (r["train_neg"], r["train_pos"]) for r in fold_summary(split).collect()}
    weights = _run_weights(split, first)
    runs = []
    for name, cfg in cfgs.items():
        chosen = [_merged_names(enabled_side(tables, s.name, cfg)) for s in sides]
        for fold in range(cfg.n_folds):
            maps = [joint.fused_map(s, ms, g, fold, cfg.fusion, cfg.common_dim) for s, ms, g in zip(sides, chosen, groups, strict=True)]
            needs = [s.bits(ms) for s, ms in zip(sides, chosen, strict=True)]
            runs.append(joint.Run(name, fold, *maps, *needs, weights[fold] if weights else (1.0, 1.0)))
    pairs = joint.build_pairs(split, *sides)
    params = {LINEAR_PARAMS[k]: v for k, v in first.classifier_params.items()}
    return sides, runs, joint.fit_runs(pairs, runs, groups, counts, **params)


def _evaluated(predictions: DataFrame, weights, cfg: ExperimentConfig, by: str = "fold") -> DataFrame:
    params = {
        "focal": {"alpha": cfg.focal_alpha, "gamma": cfg.focal_gamma},
        "label_smoothing": {"eps": cfg.label_smoothing},
    }.get(cfg.loss, {})
    return evaluate(predictions, by, loss=cfg.loss, weights=weights, **params)


def cross_validate(split: DataFrame, tables: Tables, cfg: ExperimentConfig) -> CrossValidation:
    """Fit and score every fold, then evaluate and summarise.

    Logistic models of all folds are fitted together (see ``joint_runs``); the
    network and the trees are fitted fold by fold.  The split and the held-out
    scores are stored once and all metrics are read from the scores.
    """
    split = materialise(split, "split")
    if _fits_jointly(cfg):
        sides, runs, points = joint_runs(split, tables, {"all": cfg})
        scored = joint.score_runs(split, sides, runs, points, cfg.missing).drop("run")
        weights = {r.fold: r.weights for r in runs} if cfg.loss == "weighted_ce" else None
    else:
        left, right = side_entities(tables, "left", cfg), side_entities(tables, "right", cfg)
        weights = _run_weights(split, cfg)

        def run(fold: int) -> DataFrame:
            return _run_fold(split, left, right, fold, cfg, weights and weights[fold])

        scored = reduce(DataFrame.unionByName, _on_folds(split.sparkSession, run, cfg))
    predictions = materialise(scored, "predictions")
    metrics = _evaluated(predictions, weights, cfg)
    return CrossValidation(predictions, metrics, cv_summary(metrics))


def ablation(split: DataFrame, tables: Tables, cfg: ExperimentConfig, subsets: Sequence[Sequence[str]]) -> DataFrame:
    """Fold metrics of a run per switch subset, with a ``modalities`` column.

    Logistic models of all folds and all subsets are fitted in the same jobs,
    scored in one pass and evaluated together.
    """
    split = materialise(split, "split")
    cfgs = {"+".join(subset): replace(cfg, enabled=tuple(subset)) for subset in subsets}
    if not _fits_jointly(cfg):
        parts = [cross_validate(split, tables, c).metrics.withColumn("modalities", F.lit(name)) for name, c in cfgs.items()]
        return reduce(DataFrame.unionByName, parts)
    sides, runs, points = joint_runs(split, tables, cfgs)
    scored = joint.score_runs(split, sides, runs, points, cfg.missing)
    number = {name: i for i, name in enumerate(cfgs)}
    # folds of all subsets side by side: subset i has folds i * n_folds ..
    place = F.create_map(*[F.lit(v) for kv in number.items() for v in kv])[F.col("run")] * cfg.n_folds + F.col("fold")
    predictions = materialise(scored.withColumn("fold", place.cast("int")), "predictions")
    weights = {number[r.name] * cfg.n_folds + r.fold: r.weights for r in runs} if cfg.loss == "weighted_ce" else None
    metrics = _evaluated(predictions, weights, cfg)
    names = F.array(*[F.lit(n) for n in cfgs])
    named = metrics.withColumn("modalities", F.get(names, F.expr(f"cast(fold div {cfg.n_folds} as int)")))
    return named.withColumn("fold", F.expr(f"cast(fold % {cfg.n_folds} as int)"))


def projection_2d(
    split: DataFrame,
    tables: Tables,
    cfg: ExperimentConfig,
    views: dict[str, tuple[Sequence[str], Sequence[str]]] | None = None,
) -> DataFrame:
    """(view, fold, left_id, right_id, x, y, label): a plane of each view of every fold's held-out pairs.

    The vectors are projected as the fold sees them; the plane is that of the
    first two principal components of the fold's pairs, not centred.  A view
    exists only if both sides have its modalities; ``fused`` is the view of
    the pooled vectors.  All views and folds share three passes.
    """
    split = materialise(split, "split")
    sides, groups = _sides_and_moments(split, tables, cfg)
    chosen = {v: both for v, both in (views or VIEWS).items() if all(set(ms) <= set(s.spans) for s, ms in zip(sides, both, strict=True))}
    if not chosen:
        raise ValueError("no view has vectors on both sides")
    planes = []
    for name, both in [*chosen.items(), ("fused", tuple(list(s.spans) for s in sides))]:
        needs = [s.bits(ms) for s, ms in zip(sides, both, strict=True)]
        for fold in range(cfg.n_folds):
            maps = []
            for side, ms, of_side in zip(sides, both, groups, strict=True):
                if name == "fused":
                    maps.append(joint.fused_map(side, ms, of_side, fold, "pooled", cfg.common_dim))
                    continue
                parts = [joint.modality_map(side, m, joint.training_moments(of_side, m, fold), cfg.common_dim) for m in ms]
                maps.append(joint.LinearMap(np.vstack([p.matrix for p in parts]), np.concatenate([p.offset for p in parts])))
            planes.append(joint.View(name, fold, *maps, *needs))
    pairs = joint.build_pairs(split, *sides)
    axes = [joint.plane_axes(*m) for m in joint.view_moments(pairs, planes)]
    return joint.plane_coordinates(split, sides, planes, axes, cfg.missing)
