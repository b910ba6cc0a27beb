"""Schema-level operators (P1-P8) and data-driven column roles.

P1-P6 and P8 read only the schema (no Spark job). ``infer_roles`` (R1) profiles every
column in one fused aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType

from churnkit.functions.scalar import strip

ID_COL = "ID"
TARGET_COL = "cible_churn"
META_COLUMNS = ("ID", "cible_churn", "source", "id_fichier")


def common_columns(a: DataFrame, b: DataFrame) -> list[str]:
    """Columns present in both tables, sorted."""
    return sorted(set(a.columns) & set(b.columns))


def solo_columns(a: DataFrame, b: DataFrame) -> tuple[list[str], list[str]]:
    """(only in a, only in b), each sorted."""
    return sorted(set(a.columns) - set(b.columns)), sorted(set(b.columns) - set(a.columns))


def columns_without_id(df: DataFrame, id_col: str = ID_COL) -> list[str]:
    """Every column but the identifier."""
    return [c for c in df.columns if c != id_col]


def is_quantitative(df: DataFrame, col: str) -> bool:
    dt = df.schema[col].dataType
    return isinstance(dt, NumericType) and not isinstance(dt, BooleanType)


def split_quant_qual(df: DataFrame, cols: list[str] | None = None) -> tuple[list[str], list[str]]:
    """Numeric columns are quantitative, everything else (booleans included) qualitative."""
    cols = columns_without_id(df) if cols is None else cols
    quant = [c for c in cols if is_quantitative(df, c)]
    return quant, [c for c in cols if c not in quant]


def numeric_columns(df: DataFrame, id_col: str = ID_COL) -> list[str]:
    """P5: numeric columns, identifier excluded."""
    return split_quant_qual(df, columns_without_id(df, id_col))[0]


def keep_existing(df: DataFrame, wanted: list[str]) -> DataFrame:
    """Select the wanted columns that exist, in the given order."""
    return df.select(*[c for c in wanted if c in df.columns])


def features_for_mode(df: DataFrame, mode: str) -> list[str]:
    """Feature names of a modelling mode: ``z`` -> ``z_*`` + ``sit_*``; ``cat`` -> ``cat_*``."""
    if mode == "z":
        return [c for c in df.columns if c.startswith("z_") or c.startswith("sit_")]
    if mode == "cat":
        return [c for c in df.columns if c.startswith("cat_")]
    raise ValueError(f"unknown feature mode {mode!r} (expected 'z' or 'cat')")


def select_features(df: DataFrame, mode: str, keep=(ID_COL, TARGET_COL)) -> DataFrame:
    """Identifier + integer target + features of the mode (``cat`` codes clipped at 0, int; NULL stays NULL)."""
    feats = features_for_mode(df, mode)
    cols = [F.col(k) for k in keep if k in df.columns and k != TARGET_COL]
    if TARGET_COL in df.columns and TARGET_COL in keep:
        cols.append(F.col(TARGET_COL).cast("int").alias(TARGET_COL))
    if mode == "cat":
        cols += [F.when(F.col(c).isNotNull(), F.greatest(F.col(c), F.lit(0))).cast("int").alias(c) for c in feats]
    else:
        cols += [F.col(c) for c in feats]
    return df.select(*cols)


def drop_meta(df: DataFrame) -> DataFrame:
    """Drop identifier, target and provenance columns."""
    return df.drop(*[c for c in META_COLUMNS if c in df.columns])


def infer_roles(df: DataFrame, declared: dict[str, str] | None = None) -> DataFrame:
    """Role of each column, with exact counts: ``column, dtype, n_non_null, n_distinct, role``.

    Roles come from the data alone, but for columns the caller has ``declared``:
    a never-null, all-distinct whole number -> ``identifier``; two values or fewer -> ``binary``; other numbers
    -> ``quantitative``; text of dates only -> ``date``; text of dates and other values ->
    ``date_or_sentinel``; other text -> ``nominal``; a column without values -> ``empty``.

    Counts come from one (column, value) aggregate, pre-aggregated before its shuffle.
    """
    declared = declared or {}
    text = df.select(*[F.col(c).cast("string").alias(c) for c in df.columns]).unpivot([], df.columns, "column", "value")
    values = text.groupBy("column", "value").agg(F.count("*").alias("n"))
    s = strip("value")
    dated = F.coalesce(F.try_to_date(s, "d/M/yyyy"), F.try_to_date(s, "yyyy-MM-dd")).isNotNull()
    found = values.groupBy("column").agg(
        F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("n"))), F.lit(0)).alias("n_non_null"),
        F.count("value").alias("n_distinct"), F.coalesce(F.sum(F.when(dated, F.col("n"))), F.lit(0)).alias("dates"))
    known = df.sparkSession.createDataFrame(
        [(i, c, df.schema[c].dataType.simpleString(), is_quantitative(df, c), df.schema[c].dataType.typeName() in ("integer", "long", "short", "byte"), declared.get(c))
         for i, c in enumerate(df.columns)], "position int, column string, dtype string, quantitative boolean, whole boolean, declared string")
    r = known.join(found, "column", "left")
    n, nn, nd = F.coalesce("rows", F.lit(0)), F.coalesce("n_non_null", F.lit(0)), F.coalesce("n_distinct", F.lit(0))
    role = (F.when(nn == 0, "empty").when(F.col("whole") & (nn == n) & (nd == n), "identifier").when(nd <= 2, "binary").when(F.col("quantitative"), "quantitative")
            .when(F.col("dates") == nn, "date").when(F.col("dates") > 0, "date_or_sentinel").otherwise("nominal"))
    return r.select("column", "dtype", nn.cast("long").alias("n_non_null"), nd.cast("long").alias("n_distinct"), F.coalesce("declared", role).alias("role"))
