"""Precipitation forecasts: from a service's JSON, or from items that were fetched elsewhere."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perilgrid.functions import fixed
from perilgrid.functions.columns import rain_of_text, strip
from perilgrid.sources import forecasts as source
from perilgrid.sources.frozen import Frozen

ITEM = "struct<fcstDate:string,fcstTime:string,category:string,fcstValue:string>"


def reduce_items(items: DataFrame) -> DataFrame:
    """One row for each request_id (pos numbers its items): available, rain_mm, pop, fcst.

    The earliest slot counts; in it the last amount and the last probability. A probability alone means no rain; neither
    means unavailable, with nulls. A partial aggregation finds the slot, another the last values."""
    slot = F.struct(F.coalesce("fcstDate", F.lit("None")).alias("d"), F.coalesce("fcstTime", F.lit("None")).alias("t"))
    known = items.withColumn("slot", slot)
    first = known.groupBy("request_id").agg(F.min("slot").alias("first"))
    known = known.join(first, "request_id").filter("slot = first")
    amount, chance = F.col("category") == "PCP", F.col("category") == "POP"
    pair = F.struct("pos", "fcstValue")
    out = known.groupBy("request_id").agg(
        F.max(F.when(amount, pair)).alias("pcp"), F.max(F.when(chance, pair)).alias("pop"), F.min("first").alias("first")
    )
    probability = F.when(F.col("pop").isNotNull(), strip(F.col("pop.fcstValue")).try_cast("double"))
    rain = F.when(F.col("pcp").isNotNull(), rain_of_text(F.col("pcp.fcstValue")))
    available = rain.isNotNull() | probability.isNotNull()
    return out.select(
        "request_id",
        available.alias("available"),
        F.when(available, F.coalesce(rain, F.lit(0.0))).alias("rain_mm"),
        probability.alias("pop"),
        F.when(available, F.concat_ws(" ", "first.d", "first.t")).alias("fcst"),
    )


def items_of_json(payloads: DataFrame) -> DataFrame:
    """Items (request_id, pos, ...) from the service's answers (request_id, payload)."""
    schema = f"struct<response:struct<body:struct<items:struct<item:array<{ITEM}>>>>>"
    parsed = F.from_json("payload", schema)
    items = parsed.getField("response").getField("body").getField("items").getField("item")
    return payloads.select("request_id", F.posexplode(items).alias("pos", "item")).select("request_id", "pos", "item.*")


def problems(payloads: DataFrame) -> DataFrame:
    """(request_id, reason) of answers without items: the service's result code (? if it gives none) and message."""
    schema = "struct<response:struct<header:struct<resultCode:string,resultMsg:string>,body:struct<items:struct<item:array<string>>>>>"
    answer = F.from_json("payload", schema).getField("response")
    header = answer.getField("header")
    texts = (F.lit(fixed.BAD_ANSWER), F.coalesce(header.getField("resultCode"), F.lit("?")), F.lit(" "), F.coalesce(header.getField("resultMsg"), F.lit("")))
    missing = answer.getField("body").getField("items").getField("item").isNull()
    return payloads.filter(missing).select("request_id", F.concat(*texts).alias("reason"))


def fetch(spark: SparkSession, key: str | None, base_date: str, base_time: str, nx: int = 60, ny: int = 121, timeout: float = 8.0) -> dict:
    """One forecast: available, source and either rain_mm, pop, base, fcst or a reason. Never raises."""
    no = {"available": False, "source": "unavailable"}
    if not key:
        return no | {"reason": "no service key"}
    try:
        text = source.ask(key, base_date, base_time, nx, ny, timeout)
        json.loads(text)
    except Exception as error:
        return no | {"reason": f"the request failed: {error}"}
    answer = spark.createDataFrame([(0, text)], "request_id int, payload string")
    problem = problems(answer).first()
    if problem:
        return no | {"reason": problem["reason"]}
    row = reduce_items(items_of_json(answer)).first()
    if row is None or not row["available"]:
        return no | {"reason": "no precipitation in the answer"}
    return {"available": True, "source": "kma_api", "rain_mm": row["rain_mm"], "pop": row["pop"], "base": f"{base_date} {base_time}", "fcst": row["fcst"]}


#: What makes a request.
REQUEST = ("base_date", "base_time", "nx", "ny")


def forecasts(spark: SparkSession, **options: str | int | float) -> DataFrame:
    """Forecasts of many grid points and slots, read by executors: the columns of a request, available, rain_mm, pop, fcst and reason.

    ``options`` are those of the data source. A request without a usable answer is unavailable, with the reason."""
    source.register(spark)
    answers = Frozen(spark, "forecasts")(spark.read.format("forecast").options(**options).load(), "answers")  # asked once, read twice
    known = answers.filter("payload IS NOT NULL").select(F.struct(*REQUEST).alias("request_id"), "payload")
    broken = F.when(F.try_parse_json("payload").isNull(), F.lit("the request failed: the answer is no JSON"))
    bad = known.select("request_id", broken.alias("broken")).filter("broken IS NOT NULL")
    why = problems(known).join(bad, "request_id", "full").select("request_id", F.coalesce("broken", "reason").alias("problem"))
    found = answers.select(F.struct(*REQUEST).alias("request_id"), "reason").join(why, "request_id", "left").join(reduce_items(items_of_json(known)), "request_id", "left")
    available = F.coalesce("available", F.lit(False))
    reason = F.when(~available, F.coalesce("reason", "problem", F.lit("no precipitation in the answer")))
    return found.select("request_id.*", available.alias("available"), "rain_mm", "pop", "fcst", reason.alias("reason"))
