"""Stand-in member tables derived from the driver's ``orders`` and ``customer`` tables.

The two member tables of the attrition study are not public. Their shape (column names,
types, sentinels, nulls, heavy-zero income, partly overlapping schemas) is rebuilt from
``orders JOIN customer`` with integer arithmetic only, so Spark and an independent SQL
engine produce identical rows:

* ``members_left``  (the historical leavers table):  orders with ``o_orderstatus = 'F'``
* ``members_mixed`` (the mixed members sample):        every other order

Join: ``orders`` is the fact side, ``customer`` the dimension. Only two customer columns
are read. The join strategy is left to the planner: AQE turns it into a broadcast hash
join when the customer side is measured below ``spark.sql.autoBroadcastJoinThreshold``
(a checked size) and keeps a sort-merge join otherwise; a hot ``o_custkey`` is split by
AQE's skew-join handling.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from churnkit.functions.scalar import LEAVE_DATE_SENTINEL
from churnkit.sources.tables import read_table

# Fixed values of the stand-in construction.
FAMILY_CODES = "ABCDEFGMPSUV"   # twelve family-status letters
COMMON_COLUMNS = ["CDCATCL", "CDMOTDEM", "CDSEXE", "CDSITFAM", "CDTMT", "DTADH", "DTDEM", "ID", "MTREV", "NBENF"]


def _orders_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    return o.join(c, o.o_custkey == c.c_custkey, "inner")


def _dmy(d: Column) -> Column:
    return F.date_format(d, "dd/MM/yyyy")


def _common(ok: Column, ck: Column) -> list[Column]:
    day = F.col("o_orderdate").cast("date")
    nation = F.col("c_nationkey")
    return [
        ok.alias("ID"),
        (F.lit(2) + ok % 3).cast("int").alias("CDSEXE"),
        F.when(ok % 5 == 0, F.floor("o_totalprice").cast("int")).otherwise(F.lit(0)).alias("MTREV"),
        F.when(ok % 7 == 0, ok % 4).otherwise(F.lit(0)).cast("int").alias("NBENF"),
        F.lit(FAMILY_CODES).substr((F.lit(1) + nation % 12).cast("int"), F.lit(1)).alias("CDSITFAM"),
        _dmy(F.date_add(day, (-(ok % 3000)).cast("int"))).alias("DTADH"),
        (ck % 3).cast("int").alias("CDTMT"),
        (F.lit(10) + nation).cast("int").alias("CDCATCL"),
    ]


def _age_band(age: Column, bands: int) -> Column:
    """``'k  low-high'`` in steps of five years: band 1 ends at 25, the last band has no upper end."""
    k = F.greatest(F.lit(1), F.least(F.lit(bands), F.floor((age - 16) / 5).cast("int")))
    low = F.when(k == 1, F.lit(19)).otherwise(16 + 5 * k)
    return F.concat(k.cast("string"), F.lit("  "), low.cast("string"),
                    F.when(k == bands, F.lit("+")).otherwise(F.concat(F.lit("-"), (20 + 5 * k).cast("string"))))


def members_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Historical leavers: 19 columns, ``RANGADH`` has nulls, income mostly zero, ``CDDEM`` nearly constant."""
    j = _orders_customers(spark, sf_dir).filter(F.col("o_orderstatus") == "F")
    ok, ck = F.col("o_orderkey"), F.col("o_custkey")
    day = F.col("o_orderdate").cast("date")
    age = (F.lit(19) + ck % 60).cast("int")
    years = F.floor(ok % 3000 / 365).cast("int")      # of membership: DTADH lies ok % 3000 days before DTDEM
    return j.select(
        *_common(ok, ck),
        F.lit("DV").alias("CDMOTDEM"),
        _dmy(day).alias("DTDEM"),
        age.alias("AGEAD"),
        F.when(ck % 12 == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("r"), (ck % 60).cast("int").cast("string"))).alias("RANGADH"),
        F.when(ok % 1000 == 3, F.lit(1)).otherwise(F.lit(2)).alias("CDDEM"),
        F.year(day).alias("ANNEEDEM"),
        F.concat((F.year(day) - 1991).cast("string"), F.lit("  "), F.year(day).cast("string")).alias("RANGDEM"),
        _age_band(age, 8).alias("RANGAGEAD"),
        (age + years).alias("AGEDEM"),
        _age_band(age + years, 11).alias("RANGAGEDEM"),
        years.alias("ADH"),
    )


def members_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixed sample: leave date is a sentinel for stayers, birth date has a sentinel."""
    j = _orders_customers(spark, sf_dir).filter(F.col("o_orderstatus") != "F")
    ok, ck = F.col("o_orderkey"), F.col("o_custkey")
    day = F.col("o_orderdate").cast("date")
    left = F.col("o_orderstatus") == "P"
    return j.select(
        *_common(ok, ck),
        F.when(left, F.substring("o_orderpriority", 1, 1)).alias("CDMOTDEM"),
        F.when(left, _dmy(day)).otherwise(F.lit(LEAVE_DATE_SENTINEL)).alias("DTDEM"),
        F.when(ck % 50 == 0, F.lit("0000-00-00"))
        .otherwise(F.date_format(F.date_add(day, (-(F.lit(6600) + (ck * 37) % 20000)).cast("int")), "yyyy-MM-dd"))
        .alias("DTNAIS"),
        F.floor("c_acctbal").cast("int").alias("BPADH"),
    )


def _sql_age_band(age: str, bands: int) -> str:
    k = f"greatest(1, least({bands}, ({age} - 16) // 5))"
    return (f"CAST({k} AS VARCHAR) || '  ' || CAST(CASE WHEN {k} = 1 THEN 19 ELSE 16 + 5 * {k} END AS VARCHAR) || "
            f"CASE WHEN {k} = {bands} THEN '+' ELSE '-' || CAST(20 + 5 * {k} AS VARCHAR) END")


# DuckDB view definitions of the same two tables, used by the SQL oracle.
MEMBERS_SQL = f"""
members_left_of_age AS (
  SELECT o.o_orderkey AS ID,
         CAST(2 + o.o_orderkey % 3 AS INTEGER) AS CDSEXE,
         CASE WHEN o.o_orderkey % 5 = 0 THEN CAST(floor(o.o_totalprice) AS INTEGER) ELSE 0 END AS MTREV,
         CAST(CASE WHEN o.o_orderkey % 7 = 0 THEN o.o_orderkey % 4 ELSE 0 END AS INTEGER) AS NBENF,
         substr('ABCDEFGMPSUV', CAST(1 + c.c_nationkey % 12 AS INTEGER), 1) AS CDSITFAM,
         strftime(CAST(o.o_orderdate AS DATE) - CAST(o.o_orderkey % 3000 AS INTEGER), '%d/%m/%Y') AS DTADH,
         CAST(o.o_custkey % 3 AS INTEGER) AS CDTMT,
         CAST(10 + c.c_nationkey AS INTEGER) AS CDCATCL,
         'DV' AS CDMOTDEM,
         strftime(CAST(o.o_orderdate AS DATE), '%d/%m/%Y') AS DTDEM,
         CAST(19 + o.o_custkey % 60 AS INTEGER) AS AGEAD,
         CASE WHEN o.o_custkey % 12 = 0 THEN NULL ELSE 'r' || CAST(CAST(o.o_custkey % 60 AS INTEGER) AS VARCHAR) END AS RANGADH,
         CASE WHEN o.o_orderkey % 1000 = 3 THEN 1 ELSE 2 END AS CDDEM,
         CAST(year(CAST(o.o_orderdate AS DATE)) AS INTEGER) AS ANNEEDEM,
         CAST((o.o_orderkey % 3000) // 365 AS INTEGER) AS ADH
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  WHERE o.o_orderstatus = 'F'),
members_left AS (
  SELECT *, CAST(ANNEEDEM - 1991 AS VARCHAR) || '  ' || CAST(ANNEEDEM AS VARCHAR) AS RANGDEM,
         {_sql_age_band('AGEAD', 8)} AS RANGAGEAD, AGEAD + ADH AS AGEDEM, {_sql_age_band('(AGEAD + ADH)', 11)} AS RANGAGEDEM
  FROM members_left_of_age),
members_mixed AS (
  SELECT o.o_orderkey AS ID,
         CAST(2 + o.o_orderkey % 3 AS INTEGER) AS CDSEXE,
         CASE WHEN o.o_orderkey % 5 = 0 THEN CAST(floor(o.o_totalprice) AS INTEGER) ELSE 0 END AS MTREV,
         CAST(CASE WHEN o.o_orderkey % 7 = 0 THEN o.o_orderkey % 4 ELSE 0 END AS INTEGER) AS NBENF,
         substr('ABCDEFGMPSUV', CAST(1 + c.c_nationkey % 12 AS INTEGER), 1) AS CDSITFAM,
         strftime(CAST(o.o_orderdate AS DATE) - CAST(o.o_orderkey % 3000 AS INTEGER), '%d/%m/%Y') AS DTADH,
         CAST(o.o_custkey % 3 AS INTEGER) AS CDTMT,
         CAST(10 + c.c_nationkey AS INTEGER) AS CDCATCL,
         CASE WHEN o.o_orderstatus = 'P' THEN substr(o.o_orderpriority, 1, 1) END AS CDMOTDEM,
         CASE WHEN o.o_orderstatus = 'P' THEN strftime(CAST(o.o_orderdate AS DATE), '%d/%m/%Y') ELSE '31/12/1900' END AS DTDEM,
         CASE WHEN o.o_custkey % 50 = 0 THEN '0000-00-00'
              ELSE strftime(CAST(o.o_orderdate AS DATE) - CAST(6600 + (o.o_custkey * 37) % 20000 AS INTEGER), '%Y-%m-%d') END AS DTNAIS,
         CAST(floor(c.c_acctbal) AS INTEGER) AS BPADH
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  WHERE o.o_orderstatus <> 'F')
"""
