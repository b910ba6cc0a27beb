"""Recoding for modelling (C6-C10, F1-F13): derived ages and tenures, imputation, z-scores,
quantile bins, one-hot and ordinal codes, assembled into the model matrix.

Fit/apply is split: ``fit_recode`` learns every parameter (medians, means, population
standard deviations, quantile edges, category codes) as small Spark tables (a one-row
parameter table and a category-code table); ``RecodeModel.transform`` applies them with a
broadcast of that one row. The same fitted model scores new members (M18).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnkit.functions.ranks import dense_row_ids, exact_quantiles
from churnkit.functions.scalar import (
    MISSING_TOKEN, leave_target, parse_dmy_date, parse_iso_date, years_to_reference,
)
from churnkit.operators.profile import long_form
from churnkit.session import materialize

# Fixed modelling choices of the study.
Z_COLUMNS = ["CDSEXE", "MTREV", "NBENF", "BPADH", "age_ref", "anciennete_adh_ans"]
EXCLUDED_PREDICTORS = ["CDTMT", "CDCATCL", "CDMOTDEM"]        # leak guard (F13)
QCUT_BINS = 5
QCUT_COLUMNS = {"cat_mtrev": "MTREV", "cat_age": "age_ref", "cat_anc": "anciennete_adh_ans"}
SHIFT_COLUMNS = {"cat_sexe": "CDSEXE", "cat_nbenf": "NBENF"}
ONE_HOT_COLUMN, ONE_HOT_PREFIX = "CDSITFAM", "sit"


def _num(c: str) -> Column:
    return F.col(c).try_cast("double")


# ---- derivations (C6-C9, F8-F11) -------------------------------------------------------

def derive_dates_table2(df: DataFrame) -> DataFrame:
    """F8: ``age_ref`` from the birth date (sentinel/unparsable -> NULL) and tenure in years."""
    return (df.withColumn("age_ref", years_to_reference(parse_iso_date("DTNAIS")))
              .withColumn("anciennete_adh_ans", years_to_reference(parse_dmy_date("DTADH"))))


def derive_dates_union(df: DataFrame) -> DataFrame:
    """tenure from the joining date; age by source (C9): table2 from the birth date,
    table1 as age at joining + tenure."""
    tenure = years_to_reference(parse_dmy_date("DTADH"))
    d = df.withColumn("anciennete_adh_ans", tenure)
    age2 = years_to_reference(parse_iso_date("DTNAIS")) if "DTNAIS" in df.columns else F.lit(None).cast("double")
    age1 = (_num("AGEAD") + F.col("anciennete_adh_ans")) if "AGEAD" in df.columns else F.lit(None).cast("double")
    age = (F.when(F.col("source") == "table2", age2).when(F.col("source") == "table1", age1)
           .otherwise(F.lit(None).cast("double")))
    return d.withColumn("age_ref", age)


def qcut_code(x: Column, edges: Column) -> Column:
    """0-based quantile-bin code from distinct sorted edges; intervals ``(a, b]`` with the
    lowest edge included; fewer than two edges -> NULL (the collapsed-qcut behaviour)."""
    below = F.size(F.filter(edges, lambda e: e < x))
    return F.when(x.isNull() | (F.size(edges) < 2), F.lit(None).cast("int")).otherwise(
        F.greatest(F.lit(0), below - 1).cast("int"))


def qcut_edges(df: DataFrame, cols: dict[str, str], q: int = QCUT_BINS) -> DataFrame:
    """Exact linear quantile edges at 0, 1/q, ..., 1 of each column -> one row of sorted
    distinct edge arrays named by the keys of ``cols``."""
    names = list(cols)
    src = df.select(*[_num(c).alias(k) for k, c in cols.items()])
    probs = {f"p{i}": i / q for i in range(q + 1)}
    qs = exact_quantiles(long_form(src, names, "double"), "value", probs, ["colonne"])
    arr = qs.select("colonne", F.array_sort(F.array_distinct(F.array(*[F.col(f"p{i}") for i in range(q + 1)]))).alias("e"))
    return arr.groupBy().pivot("colonne", names).agg(F.first("e"))


def prepare_union(df: DataFrame) -> DataFrame:
    """derived dates, text categories, filled motive, raw income bins (union mode)."""
    d = derive_dates_union(df)
    return _prepare_common(d)


def prepare_table2(df: DataFrame) -> DataFrame:
    """table2 mode: derived dates, target from the leave-date sentinel, categories, bins."""
    d = derive_dates_table2(df).withColumn("cible_churn", leave_target("DTDEM"))
    return _prepare_common(d)


def _prepare_common(d: DataFrame) -> DataFrame:
    d = (d.withColumn("CDSITFAM", F.coalesce(F.col("CDSITFAM").cast("string"), F.lit("nan")))
          .withColumn("CDMOTDEM", F.coalesce(F.col("CDMOTDEM").cast("string"), F.lit(MISSING_TOKEN))))
    edges = materialize(qcut_edges(d, {"MTREV": "MTREV"}))   # one row
    return (d.crossJoin(F.broadcast(edges.withColumnRenamed("MTREV", "_e")))
            .withColumn("MTREV_discrete", qcut_code(_num("MTREV"), F.col("_e"))).drop("_e"))


# ---- fit / transform (F1-F7, F12) ------------------------------------------------------

@dataclass
class RecodeModel:
    """Fitted recoding parameters (all small Spark tables)."""
    z_columns: list[str]
    params: DataFrame          # one row: med_*, mean_*, std_*, min_* and edge arrays
    sitfam_codes: DataFrame    # CDSITFAM -> code (first-appearance order)
    one_hot_levels: list[str]  # sorted category levels -> sit_<level> columns

    def transform(self, prepared: DataFrame, keep=("ID", "cible_churn")) -> DataFrame:
        """``ID, cible_churn`` + z block + one-hot block + ordinal block, one projection."""
        p = prepared.crossJoin(F.broadcast(self.params)).join(F.broadcast(self.sitfam_codes), ONE_HOT_COLUMN, "left")
        out = [F.col(k) for k in keep if k in prepared.columns]
        for c in self.z_columns:
            imputed = F.coalesce(_num(c), F.col(f"med_{c}"))
            std = F.col(f"std_{c}")
            out.append(F.when(std > 0, (imputed - F.col(f"mean_{c}")) / std).otherwise(
                imputed - F.col(f"mean_{c}")).alias(f"z_{c}"))
        for lvl in self.one_hot_levels:
            out.append((F.col(ONE_HOT_COLUMN) == F.lit(lvl)).cast("int").alias(f"{ONE_HOT_PREFIX}_{lvl}"))
        out.append(F.col("_sitfam_code").cast("int").alias("cat_sitfam"))
        for name, c in SHIFT_COLUMNS.items():
            if c in prepared.columns:
                out.append((F.coalesce(_num(c), F.lit(0.0)).cast("int") - F.col(f"min_{c}")).cast("int").alias(name))
        for name, c in QCUT_COLUMNS.items():
            if c in prepared.columns:
                x = F.coalesce(_num(c), F.col(f"med_{c}"))
                out.append(F.coalesce(qcut_code(x, F.col(f"edges_{name}")), F.lit(0)).cast("int").alias(name))
        return p.select(*out)


def fit_recode(prepared: DataFrame, z_columns: list[str] | None = None, exclude=()) -> RecodeModel:
    """Learn every recoding parameter on ``prepared`` (all rows by default, as the study does).

    ``exclude`` drops predictors from the z block (e.g. the source-specific ``BPADH``).
    """
    z_cols = [c for c in (z_columns or Z_COLUMNS) if c in prepared.columns and c not in exclude]
    med_cols = sorted(set(z_cols) | {c for c in QCUT_COLUMNS.values() if c in prepared.columns})
    # exact medians (one row)
    med = exact_quantiles(long_form(prepared, med_cols, "double"), "value", {"m": 0.5}, ["colonne"])
    med_row = med.groupBy().pivot("colonne", med_cols).agg(F.first("m"))
    # one row reused by the moments and the edges below: checkpoint it once
    med_row = materialize(med_row.select(*[F.col(c).alias(f"med_{c}") for c in med_cols]))
    # mean / population std of the imputed columns; F5: minimum of the shifted codes
    d = prepared.crossJoin(F.broadcast(med_row))
    aggs = []
    for c in z_cols:
        imputed = F.coalesce(_num(c), F.col(f"med_{c}"))
        aggs += [F.avg(imputed).alias(f"mean_{c}"), F.stddev_pop(imputed).alias(f"std_{c}")]
    for c in SHIFT_COLUMNS.values():
        if c in prepared.columns:
            aggs.append(F.min(F.coalesce(_num(c), F.lit(0.0)).cast("int")).alias(f"min_{c}"))
    moments = d.agg(*aggs)
    # F3 on the imputed continuous columns
    imputed_src = d.select(*[F.coalesce(_num(c), F.col(f"med_{c}")).alias(c) for c in QCUT_COLUMNS.values()
                             if c in prepared.columns])
    edges = qcut_edges(imputed_src, {k: c for k, c in QCUT_COLUMNS.items() if c in prepared.columns})
    edges = edges.select(*[F.col(k).alias(f"edges_{k}") for k in edges.columns])
    params = med_row.crossJoin(moments).crossJoin(edges)
    # factorize in first-appearance (ID) order -> dense codes 0..K-1, computed in parallel
    first = prepared.groupBy(ONE_HOT_COLUMN).agg(F.min("ID").alias("_first"))
    codes = materialize(dense_row_ids(first, "_first", out_col="_sitfam_code").select(
        ONE_HOT_COLUMN, (F.col("_sitfam_code") - 1).alias("_sitfam_code")))
    # one column per level, so the levels (not rows) define the output schema and are collected
    levels = sorted(r[0] for r in codes.select(ONE_HOT_COLUMN).collect())
    # the fitted parameters are small tables: checkpoint them so later plans do not carry
    # (and re-run) the whole fitting lineage
    return RecodeModel(z_cols, materialize(params), codes, levels)


def model_matrix(prepared: DataFrame, exclude=(), fit_rows: DataFrame | None = None) -> tuple[DataFrame, RecodeModel]:
    """build the matrix (26 columns on the study data). Parameters are fitted on all rows
    as in the study, or on ``fit_rows`` (e.g. the training rows only: no preprocessing leak)."""
    model = fit_recode(prepared if fit_rows is None else fit_rows, exclude=exclude)
    return model.transform(prepared), model


def min_max_block(df: DataFrame, cols: list[str]) -> DataFrame:
    """D1 (legacy): ``mm_*`` = (x - min) / (max - min); constant column -> 0."""
    mm = df.agg(*[F.min(_num(c)).alias(f"mn_{c}") for c in cols], *[F.max(_num(c)).alias(f"mx_{c}") for c in cols])
    d = df.crossJoin(F.broadcast(mm))
    return d.select("ID", *[F.coalesce(F.try_divide(_num(c) - F.col(f"mn_{c}"), F.col(f"mx_{c}") - F.col(f"mn_{c}")),
                                       F.lit(0.0)).alias(f"mm_{c}") for c in cols])


def one_hot_rows(df: DataFrame, col: str, id_col: str = "ID") -> DataFrame:
    """F7 / D2 for any number of levels: the ones only, as ``(ID, level)`` rows (no schema per level)."""
    return df.select(id_col, F.coalesce(F.col(col).cast("string"), F.lit(MISSING_TOKEN)).alias("level"))


def one_hot(df: DataFrame, col: str, prefix: str, levels: list[str] | None = None) -> DataFrame:
    """One-hot of any column, a 0/1 column per level (the levels found, when not given).

    The result is as wide as there are levels; ``one_hot_rows`` is the long form for wide columns.
    """
    v = F.coalesce(F.col(col).cast("string"), F.lit(MISSING_TOKEN))
    if levels is None:
        levels = sorted(r[0] for r in df.select(v).distinct().collect())
    return df.select("ID", *[(v == F.lit(lv)).cast("int").alias(f"{prefix}_{lv}") for lv in levels])
