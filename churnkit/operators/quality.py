"""Data-quality operators: missing values (A4), sentinels (A5, A6), IQR outliers (P15, A7),
all-null rows (P12) and the data-driven quality checks (R2-R5)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from churnkit.functions.ranks import exact_quantiles
from churnkit.functions.scalar import BIRTH_DATE_SENTINEL, LEAVE_DATE_SENTINEL, strip
from churnkit.operators.profile import _rows_from_wide, long_form
from churnkit.operators.schema import numeric_columns

FIRST_BLOCK = 2_000     # rows of the first block that rules dependencies out


def missing_report(df: DataFrame, table: str) -> DataFrame:
    """A4: per column: rows, NULLs, blank strings (after stripping, NULLs excluded), total, pct (4 dp).

    Blank strings are counted directly (not as "blank-or-null minus null", which undercounts
    when both occur).
    """
    aggs = [F.count("*").alias("__n")]
    for c in df.columns:
        aggs.append(F.count_if(F.col(c).isNull()).alias(f"{c}__nulls"))
        if isinstance(df.schema[c].dataType, StringType):
            aggs.append(F.count_if(F.col(c).isNotNull() & (strip(c) == "")).alias(f"{c}__blanks"))
        else:
            aggs.append(F.lit(0).cast("long").alias(f"{c}__blanks"))
    rows = _rows_from_wide(df.agg(*aggs), df.columns, ["nulls", "blanks"])
    total = F.col("nulls") + F.col("blanks")
    return rows.select(
        F.lit(table).alias("table"), "colonne", F.col("n").alias("n_lignes"),
        F.col("nulls").alias("manquants_pandas"), F.col("blanks").alias("chaines_vides"),
        total.alias("total_manquants"),
        F.coalesce(F.round(F.try_divide(total * 100.0, F.col("n")), 4), F.lit(0.0)).alias("pct"))


def sentinels_mixed(df: DataFrame) -> DataFrame:
    """A5: birth-date sentinel / other, leave-date sentinel / other, motive NULL or blank."""
    dtnais, dtdem = strip("DTNAIS"), strip("DTDEM")
    motive = F.col("CDMOTDEM")
    return df.agg(
        F.count_if(dtnais == BIRTH_DATE_SENTINEL).alias("DTNAIS_0000_00_00"),
        F.count_if(dtnais.isNotNull() & (dtnais != BIRTH_DATE_SENTINEL)).alias("DTNAIS_autres"),
        F.count_if(dtdem == LEAVE_DATE_SENTINEL).alias("DTDEM_31_12_1900_non_dem"),
        F.count_if(dtdem.isNotNull() & (dtdem != LEAVE_DATE_SENTINEL)).alias("DTDEM_autres"),
        F.count_if(motive.isNull() | strip(motive).isin("", "nan")).alias("CDMOTDEM_vide_ou_na"),
    )


def sentinels_left(df: DataFrame, col: str = "RANGADH") -> DataFrame:
    """Missing count and percentage (4 dp) of the band column."""
    return df.agg(F.count_if(F.col(col).isNull()).alias(f"{col}_manquants"), F.count("*").alias("_n")).select(
        f"{col}_manquants",
        F.round(F.try_divide(F.col(f"{col}_manquants") * 100.0, F.col("_n")), 4).alias(f"{col}_pct"))


def iqr_fences(df: DataFrame, cols: list[str], k: float = 1.5) -> DataFrame:
    """Per column: exact Q1, Q3 and the fences ``Q1 - k*IQR``, ``Q3 + k*IQR``."""
    q = exact_quantiles(long_form(df, cols, "double"), "value", {"q1": 0.25, "q3": 0.75}, ["colonne"])
    iqr = F.col("q3") - F.col("q1")
    return q.select("colonne", "q1", "q3", (F.col("q1") - k * iqr).alias("low"), (F.col("q3") + k * iqr).alias("high"))


def outlier_flags(df: DataFrame, col: str, k: float = 1.5, keep=("ID",)) -> DataFrame:
    """Per row ``is_outlier`` = value outside the IQR fences; NULL value -> false."""
    fences = iqr_fences(df, [col], k).drop("colonne")   # one row
    x = F.col(col).cast("double")
    flag = F.coalesce((x < F.col("low")) | (x > F.col("high")), F.lit(False))
    return df.crossJoin(F.broadcast(fences)).select(*keep, col, flag.alias("is_outlier"))


def outlier_summary(df: DataFrame, table: str, cols: list[str] | None = None, k: float = 1.5) -> DataFrame:
    """Per numeric column: rows, outliers beyond the IQR fences, pct (4 dp), min, max."""
    cols = numeric_columns(df) if cols is None else [c for c in cols if c in numeric_columns(df)]
    long = long_form(df, cols, "double")
    fences = iqr_fences(df, cols, k)   # one row per column: bounded
    flagged = long.join(F.broadcast(fences), "colonne", "left")
    out = F.coalesce((F.col("value") < F.col("low")) | (F.col("value") > F.col("high")), F.lit(False))
    agg = flagged.groupBy("colonne").agg(
        F.count("*").alias("n"), F.count_if(out).alias("outliers_iqr_1_5"),
        F.min("value").alias("min"), F.max("value").alias("max"))
    return agg.select(F.lit(table).alias("table"), "colonne", "n", "outliers_iqr_1_5",
                      F.coalesce(F.round(F.try_divide(F.col("outliers_iqr_1_5") * 100.0, F.col("n")), 4),
                                 F.lit(0.0)).alias("pct_outliers"), "min", "max")


def all_null_rows(df: DataFrame) -> DataFrame:
    """Number of rows whose every column is NULL."""
    every = F.lit(True)
    for c in df.columns:
        every = every & F.col(c).isNull()
    return df.agg(F.count_if(every).alias("n_all_null_rows"), F.count("*").alias("n_rows"))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Exact duplicate rows (all columns), counted by a grouped aggregation."""
    g = df.groupBy(*df.columns).agg(F.count("*").alias("_c"))
    return g.agg(F.coalesce(F.sum(F.when(F.col("_c") > 1, F.col("_c") - 1)), F.lit(0)).cast("long").alias("n_duplicate_rows"),
                 F.count_if(F.col("_c") > 1).alias("n_duplicated_groups"))


def data_quality_table(df: DataFrame, id_col: str = "ID") -> DataFrame:
    """All-null rows + duplicate rows (identifier excluded) as one row."""
    body = df.drop(id_col) if id_col in df.columns else df
    return all_null_rows(body).crossJoin(duplicate_rows(body))


def near_constant(df: DataFrame, share: float = 0.95, cols: list[str] | None = None) -> DataFrame:
    """Columns whose most frequent value covers at least ``share`` of the non-null rows."""
    from churnkit.operators.profile import qualitative_profile
    cols = [c for c in df.columns if c != "ID"] if cols is None else cols
    p = qualitative_profile(df, cols)
    ratio = F.try_divide(F.col("effectif_mode").cast("double"), F.col("n_non_null"))
    return p.select("colonne", "mode", "effectif_mode", "n_non_null", F.round(ratio, 6).alias("mode_share"),
                    (F.coalesce(ratio, F.lit(0.0)) >= share).alias("near_constant"))


def functional_dependencies(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """R2 (exact part): does A determine B? ``max over A of count_distinct(B) == 1``.

    Each pair is one grouped aggregation; pairs are unioned into one result.
    """
    parts = []
    for a, b in pairs:
        per = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a).agg(
            F.count_distinct(b).alias("_nd"))
        parts.append(per.agg(F.max("_nd").alias("max_levels")).select(
            F.lit(a).alias("determinant"), F.lit(b).alias("dependent"), "max_levels",
            (F.coalesce(F.col("max_levels"), F.lit(0)) <= 1).alias("determines")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _tuple_counts(df: DataFrame, sets: list[tuple[str, ...]]) -> dict[tuple[str, ...], int]:
    """Number of distinct tuples (NULL is a value) of each set of up to three columns, in one pass.

    A row becomes one short tuple per set (a list of places in the array of the row's values, so generated code doesn't
    grow with the sets); equal ones are combined before the only shuffle. A row per set is collected.
    """
    if not sets:
        return {}
    cols = df.columns
    places = F.array(*[F.struct(F.lit(i).alias("i"), *[F.lit(cols.index(s[k]) if k < len(s) else len(cols)).alias(f"p{k}") for k in range(3)])
                       for i, s in enumerate(sets)])
    row = df.select(F.array(*[F.col(f"`{c}`").cast("string") for c in cols], F.lit(None).cast("string")).alias("row"))
    each = F.explode(F.transform(places, lambda p: F.struct(p["i"].alias("i"), *[F.get("row", p[f"p{k}"]).alias(f"v{k}") for k in range(3)])))
    found = row.select(each.alias("t")).select("t.*").groupBy("i", "v0", "v1", "v2").agg(F.lit(1).alias("one")).groupBy("i").agg(F.count("*").alias("n"))
    counts = {r["i"]: r["n"] for r in found.collect()}
    return {s: counts.get(i, 0) for i, s in enumerate(sets)}


def _refuted(n: dict[tuple[str, ...], int], asked: set, of) -> set:
    """The (determinants, column) whose column makes new tuples: two rows agree on the determinants and differ in it."""
    return {(x, c) for x, c in asked if n[x] != n[of(*x, c)]}


def discover_dependencies(df: DataFrame) -> DataFrame:
    """R2: every minimal functional dependency with one or two determinants: ``determinant, dependent, n_levels``.

    Columns X determine c when the partition of the rows by X is as fine as the one by X and c, so when both have as
    many classes (NULL is a value like others). Two rows that contradict a dependency contradict it in the whole table,
    so growing blocks of rows (``FIRST_BLOCK``, then ten times as many) only rule dependencies out; all that no block
    contradicts are counted on all rows, where single determinants go first: pairs are counted only where no smaller set
    already determines the column or makes the pair redundant. No rows: everything determines everything.
    """
    from itertools import combinations
    cols = df.columns

    def of(*names: str) -> tuple[str, ...]:
        return tuple(sorted(names, key=cols.index))

    def counted(rows: DataFrame, asked: set) -> dict[tuple[str, ...], int]:
        return _tuple_counts(rows, sorted({s for x, c in asked for s in (x, of(*x, c))}))

    open_ = {(x, c) for k in (1, 2) for x in combinations(cols, k) for c in cols if c not in x}
    total = df.count()
    size = FIRST_BLOCK
    while 2 * size < total and open_:
        block = df.filter(F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in cols]), F.lit(total // size)) == 0)
        block = block.repartition(df.sparkSession.sparkContext.defaultParallelism)
        open_ -= _refuted(counted(block, open_), open_, of)
        size *= 10
    asked = {(x, c) for x, c in open_ if len(x) == 1}
    n = counted(df, asked)
    single = asked - _refuted(n, asked, of)
    held = {(x[0], c) for x, c in single}
    asked = {((a, b), c) for (a, b), c in (t for t in open_ if len(t[0]) == 2)
             if not {(a, b), (b, a), (a, c), (b, c)} & held}
    n |= counted(df, asked)
    rows = [(", ".join(x), c, n[x]) for x, c in sorted(single) + sorted(asked - _refuted(n, asked, of))]
    return df.sparkSession.createDataFrame(rows, "determinant string, dependent string, n_levels long")


def redundant_pairs(spearman: DataFrame, chi2: DataFrame, kruskal: DataFrame, threshold: float) -> DataFrame:
    """R2: pairs whose association reaches ``threshold``: |rho| of numbers, Cramer's V of categories, epsilon squared of
    a number by a category (the tables of the T families): ``var1, var2, measure, value``."""
    parts = [spearman.select("var1", "var2", F.lit("spearman").alias("measure"), F.col("spearman_rho").alias("value")),
             chi2.select("var1", "var2", F.lit("cramers_v").alias("measure"), F.col("cramers_v").alias("value")),
             kruskal.select("var1", "var2", F.lit("epsilon2").alias("measure"), F.col("epsilon2_kruskal").alias("value"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).filter(F.abs("value") >= threshold)


def quality_summary(left: DataFrame, mixed: DataFrame) -> DataFrame:
    """One row of the headline quality numbers of both tables (A4-A7 inputs)."""
    out = sentinels_mixed(mixed).crossJoin(sentinels_left(left))     # every part is one row
    for df, name in ((left, "table1"), (mixed, "table2")):
        outliers = outlier_summary(df, name).agg(F.sum("outliers_iqr_1_5").cast("long").alias(f"outliers_{name}"))
        nulls = df.agg(sum((F.count_if(F.col(c).isNull()) for c in df.columns), F.lit(0)).cast("long").alias(f"missing_cells_{name}"))
        out = out.crossJoin(outliers).crossJoin(nulls)
    return out


def suggested_treatments(df: DataFrame, income: str, skewed: str, category: str, min_count: int = 30,
                         low: float = 0.01, high: float = 0.99) -> DataFrame:
    """log(1 + income), winsorised skewed column (exact 1 % / 99 % quantiles), rare
    categories (< ``min_count`` rows) grouped as 'other'. Names follow the input columns."""
    q = exact_quantiles(df.select(F.col(skewed).cast("double").alias("v")), "v", {"p01": low, "p99": high})
    counts = df.groupBy(category).agg(F.count("*").alias("_cnt"))
    d = df.join(counts, category, "left").crossJoin(F.broadcast(q))   # q: one row
    x = F.col(skewed).cast("double")
    return d.select("ID", F.log1p(F.col(income).cast("double")).alias(f"log_{income}"),
                    F.when(x.isNull(), F.lit(None).cast("double")).otherwise(F.least(F.greatest(x, F.col("p01")), F.col("p99"))).alias(f"{skewed}_winsorized"),
                    F.when(F.col("_cnt") < min_count, F.lit("other")).otherwise(F.col(category)).alias(f"{category}_grouped"))
