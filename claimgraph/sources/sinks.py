"""Writers that spare or bound what they write."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimgraph.operators.relational import unused


def fingerprint(df: DataFrame, without: tuple[str, ...] = ("generated",)) -> int:
    """A digest of the rows in any order: the sum of their hashes modulo 2**64 by halves, and their number."""
    cols = sorted(c for c in df.columns if c not in without)
    h = F.xxhash64(*cols)
    r = df.agg(F.sum(F.shiftright(h, 32).cast("decimal(38,0)")), F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF)).cast("decimal(38,0)")), F.count(F.lit(1))).first()
    return hash(tuple(int(x or 0) for x in r))


def write_if_changed(df: DataFrame, path: str, without: tuple[str, ...] = ("generated",)) -> bool:
    """Overwrites the Parquet at ``path`` unless it has the same rows; True if it wrote."""
    spark = df.sparkSession
    try:
        same = fingerprint(spark.read.parquet(path), without) == fingerprint(df, without)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER" not in str(e):
            raise
        same = False
    if not same:
        df.write.mode("overwrite").parquet(path)
    return not same


def append_lines(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def bank(old: DataFrame, new: DataFrame, order: list, most: int = 250) -> DataFrame:
    """New rows before old ones, the first ``most``."""
    age = unused("age", new, old)
    both = new.withColumn(age, F.lit(0)).unionByName(old.withColumn(age, F.lit(1)), allowMissingColumns=True)
    return both.orderBy(age, *order).limit(most).drop(age)


def keep_last_dates(history: DataFrame, date: str, most: int = 400) -> DataFrame:
    """Rows of the last ``most`` dates: ranks are taken over the distinct dates, which are few."""
    dates = history.select(date).distinct().orderBy(F.desc(date)).limit(most)
    return history.join(dates, date, "left_semi")


# How a priority is shown; other priorities are shown as the last.
BADGES = ("P1", "P2", "P3", "P4", "P5")


def cell(text: Column) -> Column:
    """A text as a cell of a Markdown table: on one line, pipes replaced."""
    return F.replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\r\n]+", " "), F.lit("|"), F.lit("/"))


def bulletin_rows(alerts: DataFrame, most: int = 50, order: tuple[str, ...] = ("priority", "summary", "url")) -> DataFrame:
    """place, line: the newest ``most`` alerts (timestamp, priority, source, summary, reference, url, and jurisdiction if they have one) as rows of a Markdown table; alerts of one time stand in the given order."""
    badge = F.coalesce(F.get(F.array(*map(F.lit, BADGES)), F.col("priority").cast("int") - 1), F.lit(BADGES[-1]))
    named = F.coalesce(F.nullif("reference", F.lit("")), F.when(F.coalesce("url", F.lit("")) != "", "Link").otherwise("Primary"))
    link = F.when(F.coalesce("url", F.lit("")) != "", F.concat(F.lit("["), cell(named), F.lit("]("), F.col("url"), F.lit(")"))).otherwise(cell(named))
    where = [F.concat(F.lit("**"), cell(F.col("jurisdiction")), F.lit("**"))] if "jurisdiction" in alerts.columns else []
    cells = [F.coalesce(F.substring(F.col("timestamp").cast("string"), 1, 16), F.lit("")), badge, *where, cell(F.col("source")), cell(F.col("summary")), link]
    line = F.concat(F.lit("| "), F.array_join(F.array(*cells), " | "), F.lit(" |"))
    by = [F.desc_nulls_last("timestamp"), *order]
    return alerts.orderBy(*by).limit(most).select(F.row_number().over(Window.orderBy(*by)).alias("place"), line.alias("line"))


def bulletin(alerts: DataFrame, title: str, most: int = 50) -> str:
    """The bulletin's text; at most ``most`` rows reach the driver."""
    rows = [r["line"] for r in bulletin_rows(alerts, most).orderBy("place").collect()]
    heads = ["Time", "Priority", *["Jurisdiction"] * ("jurisdiction" in alerts.columns), "Source", "Finding", "Reference"]
    return "\n".join([f"# {title}", "", f"| {' | '.join(heads)} |", "|" + "-|" * len(heads), *rows])


def nominations(rows: DataFrame, section: str) -> DataFrame:
    """place, line: a Markdown section of all candidates (name, reason), a row for each line; in the file they stand by place, then line."""
    shown = rows.select(F.lit(2).alias("place"), F.concat(F.lit("- "), cell(F.col("name")), F.lit(": "), cell(F.col("reason"))).alias("line"))
    head = rows.agg(F.count(F.lit(1)).alias("n")).select(F.inline(F.array(F.struct(F.lit(0).alias("place"), F.format_string(f"## {section.replace('%', '%%')} (%d)", "n").alias("line")), F.struct(F.lit(1).alias("place"), F.lit("").alias("line")))))
    return head.unionByName(shown)


def write_lines(rows: DataFrame, path: str, order: tuple[str, ...] = ("place", "line")) -> None:
    """The lines of ``rows`` as one text file, sorted over the cluster and put down by one task as they come."""
    rows.orderBy(*order).select("line").coalesce(1).write.mode("overwrite").text(path)


def batch_writer(path: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each batch is a folder of its own, so a batch that is run again replaces what it wrote."""
    return lambda df, number: df.write.mode("overwrite").parquet(f"{path}/batch={number}")


def notifier(send: Callable[[str, str], None]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: send(title, source) for every urgent new duty (priority 1 or 2), the most urgent first, fetched part by part."""

    def run(df: DataFrame, _: int) -> None:
        for r in df.filter("priority <= 2 and is_duty").orderBy("priority", "title").select("title", "source").toLocalIterator():
            send(r["title"], r["source"])

    return run


def merged_history(history: DataFrame, quotes: DataFrame, most: int = 400) -> DataFrame:
    """date, symbol, price: the history with today's quotes in place of what it had of their date and symbol, stale quotes left out; the last ``most`` dates."""
    fresh = quotes.filter("not coalesce(stale, false)").select("date", "symbol", "price")
    kept = history.select("date", "symbol", "price").join(fresh, ["date", "symbol"], "left_anti")
    return keep_last_dates(kept.unionByName(fresh), "date", most)
