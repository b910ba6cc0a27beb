"""The whole study as one Spark application (the reference's 13-process orchestration
re-aimed): exploration and quality tables, union, recoding, reduction, split, optional
oversampling, tuning, comparison, final evaluation, interpretation and scoring.

Stage outputs are Parquet tables under ``out_dir`` (a shared folder on a cluster); the
handovers that later stages reuse are checkpointed, so a lost executor recomputes from the
last written table instead of from the raw sources.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from churnkit.functions.scalar import leave_target
from churnkit.operators import assoc, balance, compare, persist, profile, quality, recode, reduce, score, split, union
from churnkit.plans import experiment
from churnkit.session import materialize
from churnkit.sources.io import write_json_summary, write_table
from churnkit.sources.members import members_left, members_mixed


def run(spark: SparkSession, sf_dir: str, out_dir: str, quick: bool = False, use_smote: bool = False,
        algo: str = "best") -> dict:
    out = out_dir.rstrip("/")
    t1, t2 = members_left(spark, sf_dir), members_mixed(spark, sf_dir)
    # exploration and quality (leaf outputs)
    for name, t in (("table1", t1), ("table2", t2)):
        write_table(profile.univariate_summary(t), f"{out}/exploration/{name}/univariate")
        write_table(assoc.bivariate_summary(t), f"{out}/exploration/{name}/bivariate")
        write_table(quality.missing_report(t, name), f"{out}/quality/missing_{name}")
        write_table(quality.outlier_summary(t, name), f"{out}/quality/outliers_{name}")
    write_table(quality.sentinels_mixed(t2), f"{out}/quality/sentinels_table2")
    write_table(quality.sentinels_left(t1), f"{out}/quality/sentinels_table1")
    # union (partitioned by source) and its summary
    u = materialize(union.union_full(t1, t2))
    write_table(u, f"{out}/union/union_full", partition_by=["source"])
    write_table(union.union_summary(t1, t2), f"{out}/union/summary")
    # recoding
    prepared = materialize(recode.prepare_union(u))
    model = recode.fit_recode(prepared)
    matrix = materialize(model.transform(prepared))
    write_table(matrix, f"{out}/recode/matrix")
    write_table(model.params, f"{out}/recode/params")
    # reduction (terminal)
    pca = reduce.fit_pca(matrix)
    write_table(pca.scores(matrix), f"{out}/reduction/pca_scores")
    write_table(pca.variance_table(spark), f"{out}/reduction/explained_variance")
    # split and optional oversampling
    parts = materialize(split.stratified_split(matrix))
    write_table(split.partition_stats(parts), f"{out}/split/stats")
    train = parts.filter(F.col("split") == "train").drop("split")
    val = parts.filter(F.col("split") == "val").drop("split")
    test = parts.filter(F.col("split") == "test").drop("split")
    feats = reduce.feature_columns(matrix)
    fit_train = train
    if use_smote:
        bal = materialize(balance.smote(train, feats))
        write_table(balance.smote_summary(train, bal), f"{out}/split/smote_summary")
        fit_train = bal.drop("is_synthetic")   # synthetic rows carry negative ids
    # tuning, comparison, final evaluation, interpretation
    tuned = experiment.tune(spark, fit_train, val, "quick" if quick else "grid")
    write_table(tuned.fits, f"{out}/selection/fits")
    write_table(tuned.board, f"{out}/selection/leaderboard")
    write_table(tuned.predictions, f"{out}/selection/validation_predictions")
    algos = [r.key for r in tuned.winners.orderBy("position").select("key").collect()]
    tests = compare.mcnemar(compare.wide_predictions(tuned.predictions, algos), algos)
    write_table(compare.comparison_report(tuned.board, tests), f"{out}/selection/comparison")
    cfg = experiment.choose(tuned.winners, algo)
    final = experiment.final_evaluation(spark, train.unionByName(val), test, cfg)
    write_table(final["metrics"], f"{out}/selection/test_metrics")
    write_table(final["report"], f"{out}/selection/test_report")
    write_table(final["confusion"], f"{out}/selection/test_confusion")
    write_table(experiment.interpretation(spark, final["model"]), f"{out}/selection/interpretation")
    # first pass, and scoring of the members still present
    write_table(experiment.first_pass(spark, fit_train, val), f"{out}/selection/first_pass")
    current = t2.filter(leave_target("DTDEM") == 0).withColumn("source", F.lit("table2"))
    persist.save_scoring(spark, model, final["model"], f"{out}/scoring/model")
    write_table(score.campaign(score.score_rows(current, *persist.load_scoring(spark, f"{out}/scoring/model"))), f"{out}/scoring/campaign")
    summary = {"best": cfg["key"], "params": cfg["params"], "val_roc_auc": cfg["val_roc_auc"]}
    write_json_summary(spark, summary, f"{out}/selection/best_model")
    return summary
