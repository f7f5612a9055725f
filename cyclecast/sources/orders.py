"""Order lines: CSV or Parquet bases with their checks, and a base derived from a star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cyclecast.session import table

#: The columns of a raw order base and what they are called here.
RAW_COLUMNS = {
    "data_pedido": "order_date",
    "cd_setor": "sector",
    "nm_ciclo": "cycle_number",
    "aa_ciclo": "cycle_year",
    "CICLOS": "cycle",
    "total_pedidos_mascarado": "orders",
    "total_volumes_mascarado": "volumes",
    "total_itens_mascarado": "items",
    "Dt Abertura": "opening_date",
    "Dt Fechamento": "closing_date",
    "dia_ciclo": "cycle_day",
}
OPTIONAL_COLUMNS = {"cd_cd": "cd", "estado": "state", "cidade": "city", "CD_RE": "region", "CD_GV": "management", "Qtde dias": "window_days"}
DATES = ("order_date", "opening_date", "closing_date")
CYCLE_DAYS, LAST_CYCLE = 21, 17


def read_orders(spark: SparkSession, path: str, file_format: str = "csv") -> DataFrame:
    """A raw base: ids stay strings, missing required columns are an error, others are pruned."""
    reader = spark.read.option("header", "true") if file_format == "csv" else spark.read
    return conform(reader.format(file_format).load(path))


def conform(raw: DataFrame) -> DataFrame:
    """Names and types of the library; window length from the dates if absent; fanned-out rows dropped."""
    missing = [c for c in RAW_COLUMNS if c not in raw.columns]
    if missing:
        raise ValueError(f"the order base lacks {', '.join(missing)}")
    known = RAW_COLUMNS | {k: v for k, v in OPTIONAL_COLUMNS.items() if k in raw.columns}
    numbers = {"orders": "double", "volumes": "double", "items": "double", "cycle_day": "int", "window_days": "int", "cycle_number": "int", "cycle_year": "int"}

    def typed(old: str, new: str):
        column = F.col(f"`{old}`")
        return (F.to_date(column) if new in DATES else column.cast(numbers.get(new, "string"))).alias(new)

    base = raw.select(*(typed(old, new) for old, new in known.items()))
    if "window_days" not in base.columns:
        base = base.withColumn("window_days", F.datediff("closing_date", "opening_date") + 1)
    return latest_opening(base)


def latest_opening(base: DataFrame) -> DataFrame:
    """Of rows that differ only by opening date (and what follows from it), the one opened last.

    Nulls compare as equal. One aggregation, which combines before the shuffle; no sort.
    """
    dependent = [c for c in ("opening_date", "cycle_day", "window_days") if c in base.columns]
    keys = [c for c in base.columns if c not in dependent]
    last = base.groupBy(keys).agg(F.max(F.struct(*dependent)).alias("_last"))
    return last.select(*(F.col(f"_last.{c}").alias(c) if c in dependent else F.col(c) for c in base.columns))


#: Bytes of the lines' files for each task of their join: a task's share doesn't grow with the tables.
TASK_BYTES = 16 << 20


def file_states(spark: SparkSession, sf_dir: str, name: str) -> list[tuple[str, int, int]]:
    """Path, bytes and time of each of a table's files."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    return [(s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in found]


def _spread(df: DataFrame, key: str, tasks: int) -> DataFrame:
    """By ``key`` over so many tasks, if the session's own number is less."""
    return df.repartition(tasks, key) if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def _lines_of_star(spark: SparkSession, sf_dir: str, by_order: bool = False) -> DataFrame:
    """``(order_id, order_date, nation, segment, cd, items)`` of each order line, or with ``volumes`` in place of
    the CD: lines summed by order.

    Orders meet their customers before the lines, so the lines move once, as three numbers.
    """
    tasks = -(-sum(n for _, n, _ in file_states(spark, sf_dir, "lineitem")) // TASK_BYTES)
    cd = (100 * (1 + F.col("l_suppkey") % 9)).cast("int").alias("cd")
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", cd, F.col("l_quantity").alias("items"))
    order = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("order_date"))
    customer = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    bought = _spread(order, "o_custkey", tasks).join(_spread(customer, "c_custkey", tasks), F.col("o_custkey") == F.col("c_custkey")).drop("o_custkey", "c_custkey")
    line = _spread(line, "l_orderkey", tasks)
    if by_order:
        line = line.groupBy("l_orderkey").agg(F.sum("items").alias("items"), F.count("*").alias("volumes"))
    joined = line.join(_spread(bought, "o_orderkey", tasks), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select(F.col("o_orderkey").alias("order_id"), "order_date", "nation", "segment", "volumes" if by_order else "cd", "items")


def _named(rows: DataFrame, sf_dir: str, *others: str) -> DataFrame:
    """Rows of a date, nation and segment with the names and the cycle of an order base."""
    spark = rows.sparkSession
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    joined = rows.join(F.broadcast(nation.select("n_nationkey", "n_name", "r_name")), F.col("nation") == F.col("n_nationkey"))
    offset = F.col("n_nationkey") % 5
    day = F.date_sub("order_date", offset)
    cycle = F.least(F.lit(LAST_CYCLE), F.floor((F.dayofyear(day) - 1) / CYCLE_DAYS).cast("int") + 1)
    rows = joined.select(
        "order_date", F.col("n_name").alias("sector"), F.col("r_name").alias("state"), F.col("segment").alias("city"),
        F.col("r_name").alias("region"), F.concat("r_name", F.lit("-"), (F.col("n_nationkey") % 2).cast("string")).alias("management"),
        *others, F.year(day).alias("_y"), cycle.alias("_k"), offset.alias("_o"),
    )
    first = F.make_date("_y", F.lit(1), F.lit(1))
    opening = F.date_add(first, (CYCLE_DAYS * (F.col("_k") - 1) + F.col("_o")).cast("int"))
    end = F.when(F.col("_k") == LAST_CYCLE, F.make_date("_y", F.lit(12), F.lit(31))).otherwise(F.date_add(first, (CYCLE_DAYS * F.col("_k") - 1).cast("int")))
    return rows.select(
        "order_date", "sector", "state", "city", "region", "management", *others,
        (F.col("_y") * 100 + F.col("_k")).cast("string").alias("cycle"), opening.alias("opening_date"), F.date_add(end, F.col("_o").cast("int")).alias("closing_date"),
    )


def orders_of_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order base of a star schema, one row per order line.

    Nations are sectors, market segments their cities; suppliers are dealt to nine distribution
    centres. A year has 17 cycles of 21 days (the last takes the rest), opened later by a sector's
    own offset.
    """
    return _named(_lines_of_star(spark, sf_dir), sf_dir, "cd", "items", "order_id")


def order_days_of_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders_of_star`` with its items summed by all columns but ``order_id``: as many rows as dates, nations,
    segments and CDs allow, however many lines. What sums items, or asks for dates and names, finds the same in it."""
    days = _lines_of_star(spark, sf_dir).groupBy("order_date", "nation", "segment", "cd").agg(F.sum("items").alias("items"))
    return _named(days, sf_dir, "cd", "items")


def city_days_of_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders_of_star`` summed by all columns but ``order_id`` and ``cd``: items, lines (``volumes``) and ``orders``.

    An order counts once in each city and cycle, on its first day there, so these add up to distinct orders.
    """
    rows = _named(_lines_of_star(spark, sf_dir, by_order=True), sf_dir, "items", "volumes", "order_id")
    again = Window.partitionBy("order_id", "sector", "state", "city", "cycle").orderBy("order_date")
    rows = rows.withColumn("orders", (F.row_number().over(again) == 1).cast("long"))
    sums = ("items", "volumes", "orders")
    return rows.groupBy(*(c for c in rows.columns if c not in (*sums, "order_id"))).agg(*(F.sum(c).alias(c) for c in sums))


def complete_rows(base: DataFrame, columns: list[str]) -> tuple[DataFrame, int]:
    """The rows without a null in ``columns``, and how many were dropped."""
    kept = base.dropna(subset=columns)
    return kept, base.count() - kept.count()


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", "true").csv(path)


def unmatched(demand: DataFrame, calendar: DataFrame) -> DataFrame:
    """Demand rows whose (sector, cycle) the calendar lacks."""
    return demand.join(calendar, ["sector", "cycle"], "left_anti")
