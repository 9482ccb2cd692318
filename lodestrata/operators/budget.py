"""What fits into an answer: ranked prefixes, equal shares, pages, repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def byte_prefix(items: DataFrame, by: list[str], order: str, size: Column, most: int) -> DataFrame:
    """The items of each group, in order, whose running size stays within the budget."""
    running = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return items.withColumn("used", F.sum(size).over(running)).where(F.col("used") <= most)


def json_size(*columns: str) -> Column:
    return F.octet_length(F.to_json(F.struct(*columns)))


def first_of_each(items: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key; dropDuplicates would take any."""
    return items.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def page(ranked: DataFrame, by: str, rank: str, offset: int, size: int) -> DataFrame:
    """Rows offset+1 to offset+size of each ranking, with the number of matches and the next offset (null at the end)."""
    all_ = F.count("*").over(Window.partitionBy(by))
    counted = ranked.withColumn("total_matches", all_)
    return counted.where(F.col(rank).between(offset + 1, offset + size)).withColumn("next_offset", F.when(F.col("total_matches") > offset + size, F.lit(offset + size)))


def equal_share(sizes: list[int], total: int) -> int:
    """The cap at which items of these sizes, each cut to it, fill the total: small ones give back what they do not use."""
    left, count = total, len(sizes)
    for size in sorted(sizes):
        if size * count >= left:
            return left // count
        left -= size
        count -= 1
    return max(sizes, default=0)


def cut_at_line(text: Column | str, most: int) -> Column:
    """The longest prefix of whole lines within the budget; the bare prefix where the first line is longer."""
    t = F.col(text) if isinstance(text, str) else text
    head = F.substring(t, 1, most)
    whole = F.regexp_extract(head, r"(?s)\A(.*)\n", 1)
    return F.when(F.length(t) <= most, t).when(whole != "", whole).otherwise(head)


def best_excerpt(lines: DataFrame, key: str, line: str, size: str, terms: str, most: int) -> DataFrame:
    """key, start, stop, found: of the runs of lines of at most `most` characters the one with the most different terms, the
    earliest on ties. lines: key, line number, size, array of terms."""
    order = Window.partitionBy(key).orderBy(line)
    placed = lines.withColumn("to", F.sum(size).over(order)).withColumn("from", F.col("to") - F.col(size))
    listed = placed.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(line, "from", "to", terms))).alias("all"))
    one = listed.select(key, "all", F.explode("all").alias("s"))
    run = F.filter("all", lambda x: (x[line] >= F.col("s")[line]) & (x["to"] - F.col("s.from") <= most))
    scored = one.select(key, F.col(f"s.{line}").alias("start"), F.array_max(F.transform(run, lambda x: x[line])).alias("stop"), F.size(F.array_distinct(F.flatten(F.transform(run, lambda x: x[terms])))).alias("found"))
    best = Window.partitionBy(key).orderBy(F.desc("found"), "start")
    return scored.where("stop is not null").withColumn("n", F.row_number().over(best)).where("n = 1").drop("n")
