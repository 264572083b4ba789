"""Listings, names, hierarchies and snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import DASH
from ..storage import scratch

#: Sort orders of the lists; the id makes each total.
ORDERS = {
    "sites": ("name",), "classrooms": ("code",), "cameras": ("code",), "camera_assignments": ("-started_at",), "professors": ("full_name",), "courses": ("name",), "schedules": ("day_of_week", "start_time"),
}


def ordering(table: str, key: str = "id") -> list[Column]:
    return [F.col(c.lstrip("-")).desc() if c[0] == "-" else F.col(c) for c in ORDERS[table]] + [F.col(key)]


def listed(df: DataFrame, table: str, key: str = "id") -> DataFrame:
    """df in the table's order."""
    return df.orderBy(*ordering(table, key))


def most_recent(df: DataFrame, n: int = 100, key: str = "id", most: int = 500) -> DataFrame:
    """The n latest rows by created_at, 1 to `most`."""
    if not 1 <= n <= most:
        raise ValueError(f"a listing has 1 to {most} rows")
    return df.orderBy(F.col("created_at").desc(), key).limit(n)


def segments_in_order(segments: DataFrame) -> DataFrame:
    """Segments by start within each job: one shuffle by job and a sort inside its partitions."""
    return segments.repartition("job_id").sortWithinPartitions("job_id", "start_seconds", "segment_id")


def with_vocabulary(jobs: DataFrame, courses: DataFrame) -> DataFrame:
    """Adds the course's vocabulary, empty without a course."""
    c = courses.select(F.col("id").alias("course_id"), "vocabulary")
    return jobs.join(c, "course_id", "left").withColumn("vocabulary", F.coalesce("vocabulary", F.array().cast("array<string>")))


def denormalise(df: DataFrame, dims: dict[str, tuple[DataFrame, str, str, str]]) -> DataFrame:
    """Adds names: dims has new column -> (table, its name column, df's id column, placeholder)."""
    for new, (table, name, key, placeholder) in dims.items():
        df = df.join(table.select(F.col("id").alias(key), F.col(name).alias(new)), key, "left").withColumn(new, F.coalesce(F.col(new), F.lit(placeholder)))
    return df


def display_names(recordings: DataFrame, sites: DataFrame, classrooms: DataFrame, cameras: DataFrame) -> DataFrame:
    return denormalise(recordings, {"site_name": (sites, "name", "site_id", DASH), "classroom_name": (classrooms, "name", "classroom_id", "Sin asignar"), "camera_name": (cameras, "name", "camera_id", DASH)})


def location_tree(sites: DataFrame, classrooms: DataFrame, cameras: DataFrame) -> DataFrame:
    """Active sites, their active classrooms and the active cameras now in them, a row per camera."""
    s = sites.where("active").select(F.col("id").alias("site_id"), F.col("name").alias("site_name"))
    r = classrooms.where("active").select(F.col("id").alias("classroom_id"), "site_id", F.col("name").alias("classroom_name"))
    c = cameras.where("active").select(F.col("id").alias("camera_id"), "classroom_id", F.col("name").alias("camera_name"))
    return s.join(r, "site_id").join(c, "classroom_id")


def ranked(df: DataFrame, *order: Column) -> DataFrame:
    """df with rank, each row's place from 1 in this order, which must be total.

    Rows are dealt by ranges of the order and written with their range; ranges are counted, and rows take places within
    their own, so no task sees all of them. What meets in one task is a count for each range."""
    path = scratch(df.sparkSession)
    df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()).write.parquet(path)
    rows = df.sparkSession.read.parquet(path)
    past = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("_range").agg(F.count("*").alias("n")).select("_range", F.coalesce(F.sum("n").over(past), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return rows.withColumn("_place", place).join(counts, "_range").select(*df.columns, (F.col("_before") + F.col("_place")).alias("rank"))


def catalog_snapshot(tables: dict[str, DataFrame]) -> DataFrame:
    """(entity, id, rank, document): every row of the lists as JSON, tagged with its table and its place in the table's order."""
    parts = [ranked(df, *ordering(name)).select(F.lit(name).alias("entity"), "id", "rank", F.to_json(F.struct(*df.columns)).alias("document")) for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def provider_union(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Results of both recognisers in one schema; what one lacks is null."""
    return local.unionByName(remote, allowMissingColumns=True)
