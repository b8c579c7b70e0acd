"""Filters and summaries for interactive use; every result stays lazy."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import valid
from ..schema import METRICS

UNKNOWN_ZONE = "Unknown"


@dataclass(frozen=True)
class Selection:
    """What to keep; an empty list keeps everything."""

    cities: tuple[str, ...] = ()
    zones: tuple[str, ...] = ()
    hours: tuple[int, ...] = ()
    start: str | None = None
    end: str | None = None
    primary_only: bool = False


def frame(layer: DataFrame) -> DataFrame:
    return layer.select("record_id", "city", F.coalesce("zone", F.lit(UNKNOWN_ZONE)).alias("zone"), "ts", "observation_date", "hour", "weekday", "month", *METRICS, "eligible")


def filtered(layer: DataFrame, choice: Selection) -> DataFrame:
    rows = frame(layer)
    for column, members in (("city", choice.cities), ("zone", choice.zones), ("hour", choice.hours)):
        if members:
            rows = rows.filter(F.col(column).isin(*members))
    if choice.start:
        rows = rows.filter(F.col("observation_date") >= F.lit(choice.start).cast("date"))
    if choice.end:
        rows = rows.filter(F.col("observation_date") <= F.lit(choice.end).cast("date"))
    return rows.filter("eligible") if choice.primary_only else rows


def bound(spark: SparkSession, text: str, parameters: dict[str, object] | None = None, **views: DataFrame) -> DataFrame:
    """SQL over the named views, `{view}` in the text, with `:parameter`s as
    bound literals: whatever a value holds, it is data."""
    return spark.sql(text, args=parameters or None, **views)


def in_list(column: str, members, parameters: dict[str, object]) -> str:
    """An IN list of bound parameters, added to `parameters`; true for no
    members.  It reaches the scan as a filter, as literals do."""
    names = []
    for member in members:
        name = f"p{len(parameters)}"
        parameters[name] = member
        names.append(f":{name}")
    return f"{column} IN ({', '.join(names)})" if names else "true"


def filtered_sql(layer: DataFrame, choice: Selection) -> DataFrame:
    """`filtered` as SQL with bound parameters."""
    held: dict[str, object] = {}
    tests = [in_list(column, members, held) for column, members in (("city", choice.cities), ("zone", choice.zones), ("hour", choice.hours))]
    for operator, day in ((">=", choice.start), ("<=", choice.end)):
        if day:
            name = f"p{len(held)}"
            held[name] = day
            tests.append(f"observation_date {operator} CAST(:{name} AS DATE)")
    if choice.primary_only:
        tests.append("eligible")
    return bound(layer.sparkSession, f"SELECT * FROM {{rows}} WHERE {' AND '.join(tests)}", held, rows=frame(layer))


def options(layer: DataFrame) -> DataFrame:
    """(option, value): distinct cities, zones and hours, and the date range."""
    rows = frame(layer)
    each = F.array(F.struct(F.lit("city").alias("option"), F.col("city").alias("value")), F.struct(F.lit("zone").alias("option"), F.col("zone").alias("value")), F.struct(F.lit("hour").alias("option"), F.col("hour").cast("string").alias("value")))
    lists = rows.select(F.explode(each).alias("x")).select("x.*").distinct()
    ends = rows.agg(F.min("observation_date").cast("string").alias("first_date"), F.max("observation_date").cast("string").alias("last_date")).unpivot([], ["first_date", "last_date"], "option", "value")
    return lists.unionByName(ends)


def with_metric_flags(rows: DataFrame, flags: DataFrame) -> DataFrame:
    """Adds speed_primary_valid and temperature_primary_valid; the latter is
    false where any temperature flag says outlier."""
    odd = flags.filter("field_name = 'temperature_c' AND flag_type = 'outlier'").select("record_id").distinct().withColumn("__odd", F.lit(True))
    joined = rows.join(odd, "record_id", "left")
    return joined.withColumn("speed_primary_valid", valid("avg_speed_kmph")).withColumn("temperature_primary_valid", F.col("temperature_c").isNotNull() & F.col("__odd").isNull()).drop("__odd")


def period_means(rows: DataFrame, period: str, columns: list[str]) -> DataFrame:
    """Means by `month` (yyyy-MM) or `hour` (HH:00)."""
    label = F.date_format("ts", "yyyy-MM") if period == "month" else F.format_string("%02d:00", F.col("hour"))
    return rows.groupBy(label.alias("period")).agg(F.count("*").alias("rows"), *(F.avg(c).alias(c) for c in columns))


def grouped_means(rows: DataFrame, group: str) -> DataFrame:
    """Rows and means of valid values for each member, null among them."""
    return rows.groupBy(F.col(group).alias("member")).agg(F.count("*").alias("rows"), *(F.avg(F.when(valid(m), F.col(m).cast("double"))).alias(m) for m in METRICS))


def flags_of(rows: DataFrame, flags: DataFrame, kinds: tuple[str, ...] = ()) -> DataFrame:
    """Flags of the rows selected, by type and field."""
    own = flags.join(rows.select("record_id"), "record_id", "left_semi")
    if kinds:
        own = own.filter(F.col("flag_type").isin(*kinds))
    return own.groupBy("flag_type", "field_name").agg(F.count("*").alias("flags"))


def display(value, digits: int = 2):
    """A number with separators, or n.a."""
    return F.coalesce(F.format_number(value, digits), F.lit("n.a."))


def markdown(df: DataFrame, limit: int = 200) -> str:
    """A small result as a Markdown table; a last line says how many rows
    beyond `limit` are left out."""
    rows = df.limit(limit + 1).collect()
    text = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    lines += ["| " + " | ".join(map(text, r)) + " |" for r in rows[:limit]]
    if len(rows) > limit:
        lines += ["", f"{df.count() - limit} more rows are not shown."]
    return "\n".join(lines)
