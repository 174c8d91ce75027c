"""Delimited text in and out, point tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, path: str, names: list[str] | None = None, delimiters: str = " \t,") -> DataFrame:
    """id and one double column for each cell of a line. Lines that begin with # are left out, as are lines of another width than
    the first; every delimiter separates (two in a row enclose an empty cell); what is no number is NaN. Ids follow the lines.
    """
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("id"), F.regexp_replace("value", "\r$", "").alias("line")).where("not startswith(line, '#')")
    cells = lines.select("id", F.split("line", "[" + "".join("\\" + c if c in "\\]^-" else c for c in delimiters) + "]").alias("c"))
    first = cells.orderBy("id").first()
    if first is None:
        raise ValueError(f"{path} holds no data")
    n = len(first.c)
    names = names or [f"c{i}" for i in range(n)]
    value = lambda i: F.coalesce(F.trim(F.col("c")[i]).try_cast("double"), F.lit(float("nan")))
    return cells.where(F.size("c") == n).select("id", *(value(i).alias(names[i]) for i in range(n)))


def write_table(df: DataFrame, path: str, delimiter: str = " ", order: str | None = "id") -> None:
    """Rows in the order of a column, which isn't written itself; numbers in their shortest round-trip form."""
    if order:
        df = df.repartitionByRange(F.col(order)).sortWithinPartitions(order).drop(order)
    df.select(*(F.col(c).cast("string") for c in df.columns)).write.mode("overwrite").option("sep", delimiter).csv(path)


def points(spark: SparkSession, sf_dir: str, which: str) -> DataFrame:
    """Driver tables as point sets: supplier, customer, part, embeddings or events."""
    t = spark.read.parquet(f"{sf_dir}/{which}.parquet")
    pick = {
        "supplier": "s_suppkey as id, cast(s_suppkey as double) as x, s_acctbal as v",
        "customer": "c_custkey as id, cast(c_custkey as double) as x, cast(c_nationkey as double) as y, c_acctbal as v",
        "part": "p_partkey as id, cast(p_size as double) as x, p_retailprice as y",
        "embeddings": "vec_id as id, cast(embedding[0] as double) as x, cast(embedding[1] as double) as y, cast(embedding[2] as double) as z, cast(label as double) as v",
        "events": "event_id as id, cast(unix_micros(cast(ts as timestamp)) as double) / 1e6 as x, cast(user_id as double) as y, value as v",
    }[which]
    return t.selectExpr(*(c.strip() for c in _split(pick)))


def _split(text: str) -> list[str]:
    out, depth, cur = [], 0, ""
    for ch in text:
        depth += (ch == "(") - (ch == ")")
        if ch == "," and not depth:
            out.append(cur)
            cur = ""
        else:
            cur += ch
    return [*out, cur]
