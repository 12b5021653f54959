"""Address search: dates and periods that a query spells, then texts that begin with it or contain it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geotrail.functions.text import normal_form, search_form

#: What may stand after a year, after a month before a day, and at the end of each.
_AFTER_YEAR, _AFTER_MONTH, _BETWEEN_SHORT = ("-", "/", ".", "年"), ("-", "/", ".", "月"), ("-", "/", "月")
_END = {"day": "日", "month": "月", "year": "年"}


def _spelt(q: Column) -> Column:
    """``struct<day, month, year, month_day>`` of a query in normal form: the one that it spells is set.

    The query is cut into numbers and what stands between them; how many numbers there are and how wide they are tells what they mean.
    """
    numbers = F.regexp_extract_all(q, F.lit("[0-9]+"), F.lit(0))
    signs = F.split(F.regexp_replace(q, "[0-9]+", "#"), "#", -1)
    number = lambda k: F.get(numbers, F.lit(k))
    sign = lambda k: F.get(signs, F.lit(k))
    count, long = F.size(numbers), F.length(number(0)) == 4
    short = lambda k: F.length(number(k)).between(1, 2)
    two = lambda k: F.lpad(number(k), 2, "0")
    ends = lambda k, kind: sign(k).isin("", _END[kind])
    bare = sign(0) == ""
    day = bare & (count == 3) & long & short(1) & short(2) & sign(1).isin(*_AFTER_YEAR) & sign(2).isin(*_AFTER_MONTH) & ends(3, "day")
    month = bare & (count == 2) & long & short(1) & sign(1).isin(*_AFTER_YEAR) & ends(2, "month")
    year = bare & (count == 1) & long & ends(1, "year")
    month_day = bare & (count == 2) & short(0) & short(1) & sign(1).isin(*_BETWEEN_SHORT) & ends(2, "day")
    return F.struct(
        F.when(day, F.concat_ws("-", number(0), two(1), two(2))).alias("day"),
        F.when(month & two(1).between("01", "12"), F.concat_ws("-", number(0), two(1))).alias("month"),
        F.when(year, number(0)).alias("year"),
        F.when(month_day, F.concat_ws("-", two(0), two(1))).alias("month_day"),
    )


def search_dates(queries: DataFrame, days: DataFrame) -> DataFrame:
    """``query, kind, label`` of days and periods that queries name and that are recorded. ``days`` is ``date_str``."""
    read = queries.select("query", F.regexp_replace(search_form("query"), r"\s+", "").alias("q")).select("query", _spelt(F.col("q")).alias("s")).select("query", "s.*")
    d = days.select("date_str").where(F.col("date_str").isNotNull()).distinct()
    years = d.select(F.substring("date_str", 1, 4).alias("y")).distinct()
    say = lambda df, kind, label: df.select("query", F.lit(kind).alias("kind"), F.col(label).alias("label"))
    parts = [
        say(read.join(d, F.col("day") == F.col("date_str")), "day", "date_str"),
        say(read.join(years, F.substring("month", 1, 4) == F.col("y")), "period", "month"),
        say(read.join(years, F.col("year") == F.col("y")), "period", "year"),
        say(read.join(d, F.col("month_day") == F.substring("date_str", 6, 5)), "day", "date_str"),
    ]
    return reduce(DataFrame.unionByName, parts)


def _scored(candidates: DataFrame, query: str) -> DataFrame:
    """Candidates with ``score``: 0 if one of their keys begins with the query, 1 if one contains it. Keys are the label and any ``names``."""
    q = F.lit(normal_form(query).strip())
    keys = candidates.select("*", F.explode(F.array_append(F.coalesce("names", F.array().cast("array<string>")), F.col("label")) if "names" in candidates.columns else F.array("label")).alias("__key"))
    form = keys.withColumn("__form", search_form("__key"))
    score = F.when(F.startswith("__form", q), 0).when(F.contains("__form", q), 1)
    return form.withColumn("score", score).where(F.col("score").isNotNull()).groupBy("kind", "label").agg(F.min("score").alias("score"), F.bool_and("unvisited").alias("unvisited"))


def _newest() -> Column:
    return F.when(F.col("kind") == "day", -F.unix_date(F.col("label").try_cast("date"))).otherwise(0)


def search_text(candidates: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """Candidates (``kind, label, unvisited``, optional ``names``) one of whose keys begins with or contains the query, each kind and
    label once: prefixes first, visited first, newest days first. Query and keys are compared in normal form."""
    hits = _scored(candidates, query)
    return hits.orderBy("score", F.col("unvisited").cast("int"), _newest(), "kind", "label").limit(limit).select("kind", "label", "unvisited", "score")


def search(candidates: DataFrame, days: DataFrame, query: str, private: bool = False, limit: int = 10) -> DataFrame:
    """``position, kind, label, unvisited, score``: what an address bar offers for a query.

    Days and periods that it spells come first (score -1), then texts as in ``search_text``; of one kind and label only the first.
    Under privacy neither days nor labelled places (kinds ``day`` and ``place``) are offered. Ties go by kind and label.
    """
    spark = candidates.sparkSession
    asked = spark.createDataFrame([(query,)], "query string")
    spelt = search_dates(asked, days).select("kind", "label", F.lit(False).alias("unvisited"), F.lit(-1).alias("score"))
    open_ = candidates.where(~F.col("kind").isin("day", "place")) if private else candidates
    if private:
        spelt = spelt.where(F.col("kind") != "day")
    hits = spelt.unionByName(_scored(open_, query).select("kind", "label", "unvisited", "score"))
    first = hits.groupBy("kind", "label").agg(F.min(F.struct("score", "unvisited")).alias("b")).select("kind", "label", "b.unvisited", "b.score")
    best = first.orderBy("score", F.col("unvisited").cast("int"), _newest(), "kind", "label").limit(limit)
    # At most ``limit`` rows are numbered.
    return best.select(F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("score", F.col("unvisited").cast("int"), _newest(), "kind", "label")).alias("position"), "kind", "label", "unvisited", "score")
