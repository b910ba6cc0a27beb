"""Association measures and tests over column pairs.

Every pair of columns falls in one family:

* quantitative x quantitative: Pearson r (T1), Spearman rho (T2), Kendall tau-b (T3)
* qualitative x qualitative:   chi-square with Yates correction at dof 1 (T4), Cramer's V (T5)
* quantitative x qualitative:  Kruskal-Wallis H (T6), epsilon^2 (T7), one-way ANOVA F (T8)

Nulls are removed listwise inside each pair. Pairs are processed together: Pearson in one
wide aggregation over the table; the rank- and group-based statistics on cells
``(var1, var2, x, y, w)``: the distinct complete values of every pair and their rows. A family builds its own
cells; the runner over all pairs (T9) builds them once for all families, in one scan and one shuffle.
Test statistics are computed in Spark; p-values are added on the small per-pair result.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from churnkit.functions import pvalues as pv
from churnkit.functions.ranks import _below, average_rank_table
from churnkit.functions.scalar import clip, number, pair_key, sanitize_name
from churnkit.operators.schema import columns_without_id, is_quantitative
from churnkit.session import materialize

PAIR = ["var1", "var2"]


# --------------------------------------------------------------------------------------
# pair plan
# --------------------------------------------------------------------------------------

def pair_plan(df: DataFrame, cols: list[str] | None = None) -> dict[str, list[tuple[str, str]]]:
    """All unordered pairs in column order, by family; the quantitative column first in mixed pairs."""
    cols = columns_without_id(df) if cols is None else cols
    plan = {"quant": [], "qual": [], "mixed": []}
    for a, b in combinations(cols, 2):
        qa, qb = is_quantitative(df, a), is_quantitative(df, b)
        if qa and qb:
            plan["quant"].append((a, b))
        elif not qa and not qb:
            plan["qual"].append((a, b))
        else:
            plan["mixed"].append((a, b) if qa else (b, a))
    return plan


QUANT, QUAL, MIXED = "quantitatif_quantitatif", "qualitatif_qualitatif", "quantitatif_qualitatif"


def pair_cells(df: DataFrame, plan: dict[str, list[tuple[str, str]]]) -> DataFrame:
    """Cells of all pairs of a ``pair_plan``: ``(cas, var1, var2, x, y, w)``, ``x`` and ``y`` as structs of a number and a text.

    Equal cells are combined by the pair's number before the only shuffle; the result, with the pair's names, is a checkpoint.
    """
    named = _numbered_pairs(plan)
    names = F.array(*[F.struct(F.lit(cas).alias("cas"), F.lit(a).alias("var1"), F.lit(b).alias("var2")) for cas, a, b, _, _ in named])
    counted = _cell_rows(df, plan).groupBy("pair", "xn", "xt", "yn", "yt").agg(F.count("*").alias("w"))
    return materialize(counted.withColumn("named", F.get(names, F.col("pair"))).select(
        "named.*", F.struct(F.col("xn").alias("number"), F.col("xt").alias("text")).alias("x"),
        F.struct(F.col("yn").alias("number"), F.col("yt").alias("text")).alias("y"), "w"))


def _numbered_pairs(plan: dict[str, list[tuple[str, str]]]) -> list[tuple[str, str, str, str, str]]:
    """(family, column, column, kind, kind) of every pair; a kind is a number (x) or a text (s)."""
    kinds = [(QUANT, plan["quant"], "x", "x"), (MIXED, plan["mixed"], "x", "s"), (QUAL, plan["qual"], "s", "s")]
    return [(cas, a, b, ka, kb) for cas, pairs, ka, kb in kinds for a, b in pairs]


def _cell_rows(df: DataFrame, plan: dict[str, list[tuple[str, str]]]) -> DataFrame:
    """A row per row and pair: ``(pair, xn, xt, yn, yt)``, the pair's number and either the number or the text of its values.

    Every value of a row is converted once, in one array of numbers and one of texts; the pairs are lists of
    places in them, so generated code doesn't grow with the number of pairs. Rows with a missing value (null or
    NaN) are no cell of that pair. No lambda: those are interpreted, row by row.
    """
    named = _numbered_pairs(plan)
    numbers = sorted({c for _, a, b, ka, kb in named for c, kind in ((a, ka), (b, kb)) if kind == "x"})
    texts = sorted({c for _, a, b, ka, kb in named for c, kind in ((a, ka), (b, kb)) if kind == "s"})
    values = df.select(F.array(*[number(c) for c in numbers], F.lit(None).cast("double")).alias("numbers"),
                       F.array(*[F.col(c).cast("string") for c in texts], F.lit(None).cast("string")).alias("texts"),
                       F.explode(F.array(*[F.lit(i) for i in range(len(named))])).alias("pair"))

    def value(of: str, known: list[str], side: int, kind: str):       # a place of -1 is no element: NULL
        places = F.array(*[F.lit(known.index(p[side]) if p[side + 2] == kind else -1) for p in named])
        return F.get(of, F.get(places, F.col("pair")))

    cells = values.select("pair", value("numbers", numbers, 1, "x").alias("xn"), value("texts", texts, 1, "s").alias("xt"),
                          value("numbers", numbers, 2, "x").alias("yn"), value("texts", texts, 2, "s").alias("yt"))
    return cells.filter("(xn IS NOT NULL OR xt IS NOT NULL) AND (yn IS NOT NULL OR yt IS NOT NULL)")


def _cells(df: DataFrame, pairs: list[tuple[str, str]], cas: str, cells: DataFrame | None) -> DataFrame:
    """The family's cells as ``(var1, var2, x, y, w)``, out of the common ones or built here."""
    if cells is None:
        cells = pair_cells(df, {"quant": pairs if cas == QUANT else [], "qual": pairs if cas == QUAL else [],
                                "mixed": pairs if cas == MIXED else []})
    x, y = ("x.text" if cas == QUAL else "x.number"), ("y.number" if cas == QUANT else "y.text")
    return cells.filter(F.col("cas") == cas).select(*PAIR, F.col(x).alias("x"), F.col(y).alias("y"), "w")


def _pairs_frame(df: DataFrame, pairs) -> DataFrame:
    schema = StructType([StructField("var1", StringType()), StructField("var2", StringType())])
    return df.sparkSession.createDataFrame(list(pairs), schema)


# --------------------------------------------------------------------------------------
# quantitative x quantitative
# --------------------------------------------------------------------------------------

def pearson_pairs(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Pair count and Pearson r for every pair, in one aggregation (no shuffle of rows).

    r = covar_pop / (stddev_pop(x) * stddev_pop(y)) on the pair-complete rows; a constant
    column gives NULL (Spark's ``corr`` would raise DIVIDE_BY_ZERO under ANSI mode).
    """
    aggs = []
    for i, (a, b) in enumerate(pairs):
        x, y = number(a), number(b)
        xx = F.when(y.isNotNull(), x)
        yy = F.when(x.isNotNull(), y)
        aggs += [F.count(xx).alias(f"n{i}"), F.covar_pop(x, y).alias(f"c{i}"),
                 F.stddev_pop(xx).alias(f"sx{i}"), F.stddev_pop(yy).alias(f"sy{i}")]
    wide = df.agg(*aggs)
    rows = []
    for i, (a, b) in enumerate(pairs):
        r = F.try_divide(F.col(f"c{i}"), F.col(f"sx{i}") * F.col(f"sy{i}"))
        r = F.when(F.col(f"n{i}") >= 2, clip(r, -1.0, 1.0))
        rows.append(F.struct(F.lit(a).alias("var1"), F.lit(b).alias("var2"),
                             F.col(f"n{i}").cast("long").alias("n_apparies"), r.alias("pearson_r")))
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def pearson_of_cells(cells: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """T1 from the cells of ``pair_cells``: moments centred on each pair's means; same columns as ``pearson_pairs``."""
    c = _cells(cells, pairs, QUANT, cells)
    means = c.groupBy(*PAIR).agg(F.sum("w").alias("N"), (F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("mx"),
                                 (F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("my"),
                                 F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    dx, dy = F.col("x") - F.col("mx"), F.col("y") - F.col("my")
    sums = c.join(F.broadcast(means), PAIR).groupBy(*PAIR).agg(      # one row per pair
        F.sum(F.col("w") * dx * dy).alias("sxy"), F.sum(F.col("w") * dx * dx).alias("sxx"), F.sum(F.col("w") * dy * dy).alias("syy"))
    t = _pairs_frame(cells, pairs).join(means.join(sums, PAIR), PAIR, "left")
    # the mean of a constant column may be off by a rounding error: compare its ends instead of the moment with 0
    r = F.when((F.col("x0") < F.col("x1")) & (F.col("y0") < F.col("y1")), F.try_divide("sxy", F.sqrt("sxx") * F.sqrt("syy")))
    return t.select(*PAIR, F.coalesce("N", F.lit(0)).cast("long").alias("n_apparies"),
                    F.when(F.col("N") >= 2, clip(r, -1.0, 1.0)).alias("pearson_r"))


def _ranked_pairs(cells: DataFrame) -> DataFrame:
    """Cells with average ranks ``rx``, ``ry`` within each pair."""
    rx = average_rank_table(cells, "x", PAIR, weight_col="w", out_col="rx").drop("n")
    ry = average_rank_table(cells, "y", PAIR, weight_col="w", out_col="ry").drop("n")
    return cells.join(rx, PAIR + ["x"]).join(ry, PAIR + ["y"])


def spearman_pairs(df: DataFrame, pairs: list[tuple[str, str]], cells: DataFrame | None = None) -> DataFrame:
    """Spearman rho = Pearson on average ranks recomputed within each pair's complete rows.

    Ranks are centred on their exact mean (N+1)/2 before the weighted moments, so the sums
    do not cancel catastrophically at large N.
    """
    cells = _cells(df, pairs, QUANT, cells)
    n = cells.groupBy(*PAIR).agg(F.sum("w").alias("N"))
    r = _ranked_pairs(cells).join(F.broadcast(n), PAIR)      # one row per pair
    m = (F.col("N") + 1) / 2.0
    dx, dy = F.col("rx") - m, F.col("ry") - m
    agg = r.groupBy(*PAIR).agg(
        F.first("N").alias("N"), F.sum(F.col("w") * dx * dy).alias("sxy"),
        F.sum(F.col("w") * dx * dx).alias("sxx"), F.sum(F.col("w") * dy * dy).alias("syy"))
    rho = F.try_divide(F.col("sxy"), F.sqrt(F.col("sxx") * F.col("syy")))
    rho = F.when(F.col("N") >= 2, clip(rho, -1.0, 1.0))
    out = _pairs_frame(df, pairs).join(agg, PAIR, "left")
    return out.select(*PAIR, F.coalesce(F.col("N"), F.lit(0)).cast("long").alias("n_apparies"), rho.alias("spearman_rho"))


# ---- Kendall tau-b ---------------------------------------------------------------------

def _isolating_bucket(col: str, splits: str, size: int) -> F.Column:
    """Bucket id that gives every split value (at most ``size``, sorted) its own (odd) bucket: a hot value never shares."""
    below = _below(splits, size, F.col(col))
    return 2 * below + F.coalesce(F.get(splits, below) == F.col(col), F.lit(False)).cast("int")


def _discordance(rows: DataFrame, u: str, v: str) -> DataFrame:
    """Discordant weight (u_i < u_j, v_i > v_j) within each ``(pair, grp)``, summed per pair: ``(var1, var2, disc)``.

    Two ranks of v differ first at exactly one bit. Per bit, rows that agree above it meet in the order of u;
    a row with a 0 there is discordant with the weight of the rows with a 1 before it (at equal u the 0 comes
    first, so ties in u add nothing; ties in v differ at no bit). All windows keep the partitioning by group.
    """
    group = PAIR + ["grp"]
    ranked = rows.withColumn("r", F.dense_rank().over(Window.partitionBy(*group).orderBy(v)) - 1)
    ranked = ranked.withColumn("top", F.max("r").over(Window.partitionBy(*group)))
    bits = ranked.filter("top > 0").withColumn("level", F.explode(F.sequence(F.lit(0), F.length(F.bin("top")) - 1)))
    bits = bits.select(*group, u, "w", "level", F.call_function("shiftright", "r", F.col("level") + 1).alias("prefix"),
                       (F.call_function("shiftright", "r", F.col("level")) % 2).alias("bit"))
    before = Window.partitionBy(*group, "level", "prefix").orderBy(u, "bit").rowsBetween(Window.unboundedPreceding, -1)
    met = bits.withColumn("ones", F.sum(F.col("w") * F.col("bit")).over(before))
    return met.filter("bit = 0").groupBy(*PAIR).agg(F.sum(F.col("w") * F.col("ones")).alias("disc"))


#: distinct cells of a pair that one bucket holds about, and buckets at least
CELLS_PER_BUCKET, LEAST_BUCKETS = 250_000, 8


def kendall_pairs(df: DataFrame, pairs: list[tuple[str, str]], n_buckets: int | None = None,
                  cells: DataFrame | None = None) -> DataFrame:
    """Kendall tau-b, exact, with S = n0 - n1 - n2 + n3 - 2 * discordant.

    Discordant pairs (x_i < x_j, y_i > y_j) are split by equi-depth buckets of x and of y
    (split values isolated in their own bucket, so a hot value forms a bucket alone):

    * different x-bucket and different y-bucket: from the dense bucket grid by two
      partitioned running-sum windows (no pair enumeration);
    * same x-bucket: counted per bucket, bit by bit of the ranks of y (``_discordance``);
    * same y-bucket, different x-bucket: the same over (x-bucket, y), per bucket.

    Single-value buckets hold no discordant pair and are skipped. Buckets are as many as the pair with most
    distinct cells needs for CELLS_PER_BUCKET each (``n_buckets`` overrides it), so a window's share doesn't
    grow with the table. Built-in functions only; pairs are never enumerated.
    """
    cells = _cells(df, pairs, QUANT, cells).withColumn("w", F.col("w").cast("double"))
    if n_buckets is None:
        most = cells.groupBy(*PAIR).count().agg(F.max("count")).first()[0] or 0
        n_buckets = max(LEAST_BUCKETS, -(-most // CELLS_PER_BUCKET))
    probs = [i / n_buckets for i in range(1, n_buckets)]
    splits = cells.groupBy(*PAIR).agg(F.percentile_approx("x", probs, 10 * n_buckets * 10).alias("sx"),
                                      F.percentile_approx("y", probs, 10 * n_buckets * 10).alias("sy"))
    c = materialize(cells.join(F.broadcast(splits), PAIR)      # one row per pair
                    .withColumn("bx", _isolating_bucket("x", "sx", n_buckets - 1)).withColumn("by", _isolating_bucket("y", "sy", n_buckets - 1))
                    .drop("sx", "sy"))
    # tie terms
    tx = c.groupBy(*PAIR, "x").agg(F.sum("w").alias("t")).groupBy(*PAIR).agg(
        F.sum(F.col("t") * (F.col("t") - 1) / 2).alias("n1"),
        F.sum(F.col("t") * (F.col("t") - 1) * (F.col("t") - 2)).alias("x0"),
        F.sum(F.col("t") * (F.col("t") - 1) * (2 * F.col("t") + 5)).alias("x1"))
    ty = c.groupBy(*PAIR, "y").agg(F.sum("w").alias("t")).groupBy(*PAIR).agg(
        F.sum(F.col("t") * (F.col("t") - 1) / 2).alias("n2"),
        F.sum(F.col("t") * (F.col("t") - 1) * (F.col("t") - 2)).alias("y0"),
        F.sum(F.col("t") * (F.col("t") - 1) * (2 * F.col("t") + 5)).alias("y1"))
    base = c.groupBy(*PAIR).agg(F.sum("w").alias("N"), F.sum(F.col("w") * (F.col("w") - 1) / 2).alias("n3"))
    # grid term: dense grid of occupied bucket ids per pair
    g = c.groupBy(*PAIR, "bx", "by").agg(F.sum("w").alias("G"))
    dense = (g.select(*PAIR, "bx").distinct().join(g.select(*PAIR, "by").distinct(), PAIR)
             .join(g, PAIR + ["bx", "by"], "left").fillna(0.0, subset=["G"]))
    above = Window.partitionBy(*PAIR, "bx").orderBy(F.col("by").desc()).rowsBetween(Window.unboundedPreceding, -1)
    dense = dense.withColumn("R", F.coalesce(F.sum("G").over(above), F.lit(0.0)))
    left = Window.partitionBy(*PAIR, "by").orderBy("bx").rowsBetween(Window.unboundedPreceding, -1)
    dense = dense.withColumn("K", F.coalesce(F.sum("R").over(left), F.lit(0.0)))
    grid = dense.groupBy(*PAIR).agg(F.sum(F.col("G") * F.col("K")).alias("d_grid"))
    # only multi-value buckets (even ids) hold discordant pairs
    sx = _discordance(c.filter("bx % 2 = 0").withColumn("grp", F.col("bx")), "x", "y").withColumnRenamed("disc", "d_x")
    by_column = c.filter("by % 2 = 0").groupBy(*PAIR, F.col("by").alias("grp"), "bx", "y").agg(F.sum("w").alias("w"))
    sy = _discordance(by_column, "bx", "y").withColumnRenamed("disc", "d_y")
    t = (base.join(tx, PAIR).join(ty, PAIR).join(grid, PAIR, "left").join(sx, PAIR, "left").join(sy, PAIR, "left")
         .fillna(0.0, subset=["d_grid", "d_x", "d_y"]))
    n0 = F.col("N") * (F.col("N") - 1) / 2
    disc = F.col("d_grid") + F.col("d_x") + F.col("d_y")
    s = n0 - F.col("n1") - F.col("n2") + F.col("n3") - 2 * disc
    tau = F.try_divide(s, F.sqrt(n0 - F.col("n1")) * F.sqrt(n0 - F.col("n2")))
    tau = F.when((n0 - F.col("n1") > 0) & (n0 - F.col("n2") > 0), clip(tau, -1.0, 1.0))
    m = F.col("N") * (F.col("N") - 1)
    var = ((m * (2 * F.col("N") + 5) - F.col("x1") - F.col("y1")) / 18
           + (2 * F.col("n1") * F.col("n2")) / m
           + F.try_divide(F.col("x0") * F.col("y0"), 9 * m * (F.col("N") - 2)))
    z = F.when(tau.isNotNull(), F.try_divide(s, F.sqrt(var)))
    out = _pairs_frame(df, pairs).join(t, PAIR, "left")
    return out.select(*PAIR, F.coalesce(F.col("N"), F.lit(0.0)).cast("long").alias("n_apparies"),
                      s.alias("kendall_s"), tau.alias("kendall_tau"), z.alias("kendall_z"),
                      F.col("n1").alias("ties_x"), F.col("n2").alias("ties_y"))


# --------------------------------------------------------------------------------------
# qualitative x qualitative
# --------------------------------------------------------------------------------------

def chi2_pairs(df: DataFrame, pairs: list[tuple[str, str]], cells: DataFrame | None = None) -> DataFrame:
    """T4/T5: chi-square of independence from the sparse contingency table, Cramer's V.

    chi2 = N * (sum O^2 / (R * C) - 1) over observed cells only (equal to the dense form).
    When dof = 1 (2 x 2 table), the Yates-corrected statistic is computed on the four
    cells of the table (zero cells included).
    """
    cells = _cells(df, pairs, QUAL, cells).select(*PAIR, "x", "y", F.col("w").cast("double").alias("O"))
    rows = cells.groupBy(*PAIR, "x").agg(F.sum("O").alias("R"))
    cols = cells.groupBy(*PAIR, "y").agg(F.sum("O").alias("C"))
    shape = (rows.groupBy(*PAIR).agg(F.count("*").alias("r"), F.sum("R").alias("N"))
             .join(cols.groupBy(*PAIR).agg(F.count("*").alias("k")), PAIR))
    j = cells.join(rows, PAIR + ["x"]).join(cols, PAIR + ["y"])
    plain = j.groupBy(*PAIR).agg(F.sum(F.col("O") * F.col("O") / (F.col("R") * F.col("C"))).alias("s"))
    # Yates at dof 1: the 2 x 2 table made dense (4 cells per pair)
    two = shape.filter((F.col("r") == 2) & (F.col("k") == 2)).select(*PAIR, "N")
    dense = (rows.join(two, PAIR).join(cols, PAIR).join(cells, PAIR + ["x", "y"], "left").fillna(0.0, subset=["O"]))
    e = F.col("R") * F.col("C") / F.col("N")
    dev = F.abs(F.col("O") - e)
    yates = dense.groupBy(*PAIR).agg(F.sum(F.pow(dev - F.least(F.lit(0.5), dev), 2) / e).alias("chi2_yates"))
    t = shape.join(plain, PAIR).join(yates, PAIR, "left")
    dof = (F.col("r") - 1) * (F.col("k") - 1)
    chi2 = F.when(dof == 1, F.col("chi2_yates")).otherwise(clip(F.col("N") * (F.col("s") - 1), 0.0))
    chi2 = F.when(F.col("N") >= 2, chi2)
    mn = F.least(F.col("r"), F.col("k"))
    v = F.when((mn > 1) & (F.col("N") >= 2), F.sqrt(F.try_divide(chi2, F.col("N") * (mn - 1))))
    out = _pairs_frame(df, pairs).join(t, PAIR, "left")
    return out.select(*PAIR, F.coalesce(F.col("N"), F.lit(0.0)).cast("long").alias("n_apparies"),
                      chi2.alias("chi2"), F.when(F.col("N") >= 2, dof).cast("long").alias("dof"),
                      clip(v, None, 1.0).alias("cramers_v"))


# --------------------------------------------------------------------------------------
# quantitative x qualitative
# --------------------------------------------------------------------------------------

def kruskal_anova_pairs(df: DataFrame, pairs: list[tuple[str, str]], cells: DataFrame | None = None) -> DataFrame:
    """Kruskal-Wallis H (tie-corrected), epsilon^2, one-way ANOVA F per (quant, qual) pair.

    H from rank sums per group (ranks within the pair's complete rows); ANOVA from per-group
    count / mean / variance, centred on the grand mean. Needs n >= 3 and >= 2 groups.
    Perfect separation (within-group variance 0) gives F = +inf; all-equal values give NULL.
    """
    cells = _cells(df, pairs, MIXED, cells).withColumn("w", F.col("w").cast("double"))
    ranks = average_rank_table(cells, "x", PAIR, weight_col="w", out_col="rk")
    ties = ranks.groupBy(*PAIR).agg(F.sum(F.pow(F.col("n").cast("double"), 3) - F.col("n")).alias("tie"))
    rc = cells.join(ranks.drop("n"), PAIR + ["x"])
    # totals, between and within start from the groups: written once, so that the ranks are joined once
    grp = materialize(rc.groupBy(*PAIR, "y").agg(F.sum("w").alias("ng"), F.sum(F.col("w") * F.col("rk")).alias("Rg"),
                                                 F.sum(F.col("w") * F.col("x")).alias("sx")))
    tot = grp.groupBy(*PAIR).agg(F.sum("ng").alias("N"), F.count("*").alias("k"),
                                 F.sum(F.col("Rg") * F.col("Rg") / F.col("ng")).alias("sr2"),
                                 F.sum("sx").alias("sxt"))
    # ANOVA: between = sum n_g (mean_g - grand)^2, within = sum w (x - mean_g)^2 (exactly 0
    # when every group is constant)
    means = grp.select(*PAIR, "y", "ng", (F.col("sx") / F.col("ng")).alias("mg"))
    gm = tot.select(*PAIR, (F.col("sxt") / F.col("N")).alias("gm"))
    ssb = means.join(gm, PAIR).groupBy(*PAIR).agg(F.sum(F.col("ng") * F.pow(F.col("mg") - F.col("gm"), 2)).alias("ssb"))
    ssw = (cells.join(means.select(*PAIR, "y", "mg"), PAIR + ["y"]).groupBy(*PAIR)
           .agg(F.sum(F.col("w") * F.pow(F.col("x") - F.col("mg"), 2)).alias("ssw")))
    ss = ssb.join(ssw, PAIR)
    t = tot.join(ties, PAIR).join(ss, PAIR)
    N, k = F.col("N"), F.col("k")
    ok = (N >= 3) & (k >= 2)
    h_raw = 12.0 / (N * (N + 1)) * F.col("sr2") - 3 * (N + 1)
    corr = 1 - F.col("tie") / (N * N * N - N)
    h = F.when(ok & (corr > 0), h_raw / corr)
    eps = F.when(ok & (N > k), clip((h - k + 1) / (N - k), 0.0, 1.0))
    ssb, ssw = F.col("ssb"), F.col("ssw")
    f = (F.when(~ok | (N <= k), F.lit(None).cast("double"))
         .when((ssw == 0) & (ssb > 0), F.lit(float("inf")))
         .when(ssw == 0, F.lit(None).cast("double"))
         .otherwise((ssb / (k - 1)) / (ssw / (N - k))))
    out = _pairs_frame(df, pairs).join(t, PAIR, "left")
    return out.select(*PAIR, F.coalesce(N, F.lit(0.0)).cast("long").alias("n_apparies"),
                      F.coalesce(k, F.lit(0)).cast("long").alias("n_groups"),
                      h.alias("kruskal_h"), eps.alias("epsilon2_kruskal"), f.alias("anova_f"))


# --------------------------------------------------------------------------------------
# T9 runner and G4 matrix
# --------------------------------------------------------------------------------------

def bivariate_summary(df: DataFrame, cols: list[str] | None = None, kendall_buckets: int | None = None) -> DataFrame:
    """Every pair, statistics + two-sided p-values, families unioned by name (ragged keys).

    One scan of the table gives the cells of all pairs; every family starts from them.
    """
    plan = pair_plan(df, cols)
    cells = pair_cells(df, plan)
    parts = []
    if plan["quant"]:
        q = plan["quant"]
        pr = pearson_of_cells(cells, q)
        sp = spearman_pairs(df, q, cells).drop("n_apparies")
        kd = kendall_pairs(df, q, kendall_buckets, cells).drop("n_apparies")
        t = pr.join(sp, PAIR).join(kd, PAIR)
        parts.append(t.select(
            *PAIR, F.lit(QUANT).alias("cas"), "n_apparies", "pearson_r",
            pv.corr_pvalue(F.col("pearson_r"), F.col("n_apparies")).alias("pearson_p"),
            "spearman_rho", pv.corr_pvalue(F.col("spearman_rho"), F.col("n_apparies")).alias("spearman_p"),
            "kendall_tau", pv.kendall_pvalue(F.col("n_apparies"), F.col("kendall_s"), F.col("ties_x"), F.col("ties_y"),
                                             F.col("kendall_z")).alias("kendall_p")))
    if plan["qual"]:
        c = chi2_pairs(df, plan["qual"], cells)
        parts.append(c.select(*PAIR, F.lit(QUAL).alias("cas"), "n_apparies", "chi2",
                              pv.chi2_pvalue(F.col("chi2"), F.col("dof")).alias("chi2_p"), "dof", "cramers_v"))
    if plan["mixed"]:
        m = kruskal_anova_pairs(df, plan["mixed"], cells)
        parts.append(m.select(*PAIR, F.lit(MIXED).alias("cas"), "n_apparies", "kruskal_h",
                              pv.chi2_pvalue(F.col("kruskal_h"), F.col("n_groups") - 1).alias("kruskal_p"),
                              "epsilon2_kruskal", "anova_f",
                              pv.f_pvalue(F.col("anova_f"), F.col("n_groups") - 1,
                                          F.col("n_apparies") - F.col("n_groups")).alias("anova_p")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    # Canonical, file-name-safe pair label
    return out.withColumn("paire", pair_key(sanitize_name("var1"), sanitize_name("var2")))


def correlation_matrix(df: DataFrame, cols: list[str], method: str = "pearson") -> DataFrame:
    """Long correlation matrix ``(var1, var2, r)`` incl. the diagonal and both orders."""
    pairs = list(combinations(cols, 2))
    if method == "pearson":
        r = pearson_pairs(df, pairs).select(*PAIR, F.col("pearson_r").alias("r"))
    elif method == "spearman":
        r = spearman_pairs(df, pairs).select(*PAIR, F.col("spearman_rho").alias("r"))
    else:
        raise ValueError("method must be 'pearson' or 'spearman'")
    diag_vals = df.agg(*[F.stddev_pop(F.col(c).cast("double")).alias(c) for c in cols])
    diag = diag_vals.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("var1"), F.lit(c).alias("var2"),
                 F.when(F.col(c) > 0, F.lit(1.0)).alias("r")) for c in cols])).alias("d")).select("d.*")
    return r.unionByName(r.select(F.col("var2").alias("var1"), F.col("var1").alias("var2"), "r")).unionByName(diag)
