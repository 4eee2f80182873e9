"""Inspection cases as append-only events: creation, status changes, reviewer judgements, deletions; states are views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from perilgrid.functions import fixed
from perilgrid.functions.columns import flag_text
from perilgrid.sources.frozen import Frozen


def new_cases(requests: DataFrame, first_id: int = 1, status: str = fixed.STATUSES[0]) -> tuple[DataFrame, DataFrame]:
    """Cases and first history rows from requests (seq, created_at, lat, lon, road_address, ai_available, detections, ...).

    The top detection is the first of the most confident; its count is null unless the analysis ran; JSON only where there is
    something. Ids follow ``seq``, which is distinct: requests are dealt out by ranges of it, counted by range and numbered
    inside each, so no task holds all of them."""
    requests = requests.repartitionByRange("seq").withColumn("_part", F.spark_partition_id())
    requests = Frozen(requests.sparkSession, "cases")(requests, "requests")
    sizes = requests.groupBy("_part").agg(F.count("*").alias("n"))
    sizes = sizes.select("_part", (F.sum("n").over(Window.orderBy("_part")) - F.col("n")).alias("_before"))  # one row for each range
    requests = requests.join(F.broadcast(sizes), "_part")
    order = F.row_number().over(Window.partitionBy("_part").orderBy("seq")) - 1 + F.col("_before") + first_id
    found = F.coalesce(F.col("detections"), F.array().cast(dict(requests.dtypes)["detections"]))
    best = F.array_max(F.transform(found, lambda d, i: F.struct(F.coalesce(d.confidence, F.lit(0.0)).alias("c"), (-i).alias("i"), d.class_name.alias("name"))))
    cases = requests.withColumns(
        {
            "id": order.cast("long"),
            "ai_available": F.coalesce(F.col("ai_available"), F.lit(False)),
            "ai_detection_count": F.when(F.col("ai_available"), F.size(found)),
            "ai_top_class": best.getField("name"),
            "ai_top_confidence": best.getField("c"),
            "ai_detections_json": F.when(F.size(found) > 0, F.to_json(found)),
            "status": F.lit(status),
            "updated_at": F.col("created_at"),
        }
    ).drop("detections", "seq", "_part", "_before")
    history = cases.select(
        F.col("id").alias("inspection_id"),
        F.col("created_at").alias("changed_at"),
        F.lit(None).cast("string").alias("from_status"),
        F.col("status").alias("to_status"),
        F.lit(fixed.NEW_CASE_NOTE).alias("note"),
    )
    return cases, history


def valid_status(status: str) -> str:
    if status not in fixed.STATUSES:
        raise ValueError(f"not a status: {status}")
    return status


def checked_events(events: DataFrame) -> DataFrame:
    """Fails on an event with a status outside the domain."""
    wrong = F.raise_error(F.concat(F.lit("not a status: "), F.coalesce("to_status", F.lit("null"))))
    return events.withColumn("to_status", F.when(F.col("to_status").isin(fixed.STATUSES), F.col("to_status")).otherwise(wrong.cast("string")))


def with_from_status(events: DataFrame) -> DataFrame:
    """The status before each change, in order of time and id; null for the first."""
    by = Window.partitionBy("inspection_id").orderBy("changed_at", "id")
    return events.withColumn("from_status", F.lag("to_status").over(by))


def latest_status(events: DataFrame) -> DataFrame:
    """inspection_id, status, changed_at of the last event; a partial aggregation."""
    last = events.groupBy("inspection_id").agg(F.max(F.struct("changed_at", "id", "to_status")).alias("last"))
    return last.select("inspection_id", F.col("last.to_status").alias("status"), "last.changed_at")


def with_latest_status(cases: DataFrame, events: DataFrame) -> DataFrame:
    """Cases with the last event's status; those without events keep theirs. Events of unknown cases change nothing."""
    last = latest_status(events).select(F.col("inspection_id").alias("id"), F.col("status").alias("_status"), F.col("changed_at").alias("_at"))
    names = [c for c in cases.columns if c not in ("status", "updated_at")]
    updated = [F.coalesce("_at", "updated_at").alias("updated_at")] if "updated_at" in cases.columns else []
    return cases.join(last, "id", "left").select(*names, F.coalesce("_status", "status").alias("status"), *updated)


def with_review(cases: DataFrame, reviews: DataFrame) -> DataFrame:
    """Cases with the last review (id, reviewed_at, reviewer_judgement, reviewer_note, reviewer_name); nothing else changes."""
    names = ("reviewed_at", "reviewer_judgement", "reviewer_note", "reviewer_name")
    last = reviews.groupBy("id").agg(F.max(F.struct(*names)).alias("r")).select("id", *(f"r.{n}" for n in names))
    return cases.drop(*names).join(last, "id", "left")


def without_deleted(rows: DataFrame, deleted: DataFrame, key: str = "id") -> DataFrame:
    """Leaves out cases, or their history, whose id is among the deleted ones."""
    return rows.join(deleted.select(F.col("id").alias(key)).distinct(), key, "left_anti")


def status_counts(spark: SparkSession, cases: DataFrame) -> DataFrame:
    """status and n, 0 for statuses that no case has; statuses outside the domain are kept."""
    domain = spark.createDataFrame([(s,) for s in fixed.STATUSES], "status string")
    counts = cases.groupBy("status").agg(F.count("*").alias("n"))
    return domain.join(counts, "status", "full").select("status", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def list_cases(cases: DataFrame, status: str | None = None, limit: int = 500) -> DataFrame:
    """Newest first, no more than the limit; no status is no filter."""
    return (cases.filter(F.col("status") == status) if status else cases).orderBy(F.desc("id")).limit(limit)


def case_history(events: DataFrame, case_id: int) -> DataFrame:
    return events.filter(F.col("inspection_id") == case_id).orderBy("id")


def display(cases: DataFrame) -> DataFrame:
    """Flags as texts."""
    flags = {"ai_available": fixed.DONE_LABELS, "is_sample_data": fixed.SAMPLE_LABELS}
    return cases.withColumns({c: flag_text(F.col(c), t) for c, t in flags.items() if c in cases.columns})


def labelled(cases: DataFrame) -> DataFrame:
    """The list as people read it: known columns only, with their labels."""
    shown = display(cases)
    return shown.select(*(F.col(c).alias(label) for c, label in fixed.CASE_LABELS.items() if c in shown.columns))


def stops_to_requests(route: DataFrame, stops: DataFrame) -> DataFrame:
    """One request for each stop of a route (route_id, order array<int>), in the order of visits."""
    visits = route.select("route_id", F.posexplode("order").alias("seq", "pos"))
    return visits.join(stops, ["route_id", "pos"])


def register_stops(route: DataFrame, stops: DataFrame, created_at, first_id: int = 1) -> tuple[DataFrame, DataFrame]:
    """Cases, to be inspected, and first history rows from the stops (route_id, pos, lat, lon, road_address, score) of routes, in
    the order of visits. The score is the case's risk; no analysis has run."""
    requests = stops_to_requests(route, stops).select(
        F.struct("route_id", "seq").alias("seq"),
        F.lit(created_at).alias("created_at"),
        "lat",
        "lon",
        "road_address",
        F.col("score").alias("ai_risk_score"),
        F.lit(False).alias("ai_available"),
        F.lit(None).cast("array<struct<class_name:string,confidence:double>>").alias("detections"),
    )
    return new_cases(requests, first_id, fixed.STATUSES[2])


class CaseStore:
    """The event tables in a folder: cases, status events, reviews and deletions are only ever appended to."""

    TABLES = ("cases", "events", "reviews", "deletions")

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def append(self, name: str, rows: DataFrame) -> None:
        if name not in self.TABLES:
            raise ValueError(f"no such table: {name}")
        rows.write.mode("append").parquet(f"{self.root}/{name}")

    def table(self, name: str) -> DataFrame | None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        there = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.parquet(f"{self.root}/{name}") if there else None

    def create(self, requests: DataFrame, status: str = fixed.STATUSES[0]) -> None:
        known = self.table("cases")
        first = 1 if known is None else (known.agg(F.max("id")).first()[0] or 0) + 1
        cases, history = new_cases(requests, first, status)
        self.append("cases", cases)
        self.append("events", history.withColumn("id", F.lit(0).cast("long")))

    def change(self, case_id: int, status: str, changed_at, note: str | None = None) -> bool:
        """False for an unknown case; an error for an unknown status."""
        valid_status(status)
        now = self.current()
        row = None if now is None else now.filter(F.col("id") == case_id).select("status").first()
        if row is None:
            return False
        n = self.table("events").agg(F.max("id")).first()[0] + 1
        self.append(
            "events",
            self.spark.createDataFrame(
                [(case_id, changed_at, row["status"], status, note, n)],
                "inspection_id bigint, changed_at timestamp_ntz, from_status string, to_status string, note string, id bigint",
            ),
        )
        return True

    def delete(self, case_id: int) -> bool:
        now = self.current()
        if now is None or now.filter(F.col("id") == case_id).isEmpty():
            return False
        self.append("deletions", self.spark.createDataFrame([(case_id,)], "id bigint"))
        return True

    def current(self) -> DataFrame | None:
        cases, events, reviews, gone = (self.table(t) for t in self.TABLES)
        if cases is None:
            return None
        cases = with_latest_status(cases, events)
        cases = cases if reviews is None else with_review(cases, reviews)
        return cases if gone is None else without_deleted(cases, gone)
