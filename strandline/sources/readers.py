"""Reading the source files and writing results: CSV once, Parquet after that."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline import schemas
from strandline.functions.scalar import days


def read_csv(spark: SparkSession, path: str, names: dict[str, str], schema: T.StructType, **options: str) -> DataFrame:
    """CSV (also .gz) with a header; names: source column for each column of the schema that the file has.

    Gzip files cannot be split: write the result as Parquet before working on it.
    """
    raw = spark.read.options(header=True, **options).csv(path)
    kinds = {f.name: f.dataType for f in schema.fields}
    return raw.select(*[F.col(f"`{source}`").try_cast(kinds[name]).alias(name) for name, source in names.items()])


def with_los(encounters: DataFrame) -> DataFrame:
    """Adds the length of stay in fractional days."""
    return encounters.withColumn("los", days(F.col("admit"), F.col("disch")))


def adults(entities: DataFrame, least_age: int = 18) -> DataFrame:
    return entities.filter(F.col("age") >= least_age)


def read_code_list(spark: SparkSession, path: str, column: str = "icd_code", first: int = 47) -> DataFrame:
    """The first codes of a semicolon-separated file, in the order of the file (a small list)."""
    rows = spark.read.options(header=True, sep=";").csv(path).select(F.trim(column).alias("code"))
    return rows.withColumn("place", F.monotonically_increasing_id()).orderBy("place").limit(first).select("code")


def read_edges(spark: SparkSession, path: str, names: dict[str, str]) -> DataFrame:
    """Tab-separated trajectory edges."""
    return read_csv(spark, path, names, schemas.EDGES, sep="\t")


def read_split_lists(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(split, entity): one id a line, a file for each split."""
    parts = [spark.read.text(path).select(F.lit(split).alias("split"), F.trim("value").try_cast("long").alias("entity")) for split, path in paths.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out.filter("entity is not null")


def clean_events(events: DataFrame, banned_items: tuple[int, ...] = ()) -> DataFrame:
    """Events with a value, without banned items."""
    kept = events.filter(F.col("value").isNotNull() & ~F.isnan("value"))
    return kept.filter(~F.col("item").isin(*banned_items)) if banned_items else kept


#: Up to so many wanted entities are written into a scan's filter.
PUSHED_IDS = 1000


def write_event_store(events: DataFrame, path: str, banned_items: tuple[int, ...] = ()) -> None:
    """Cleaned events as Parquet, in ranges of the entity, so that reads of a few entities skip most row groups."""
    kept = clean_events(events, banned_items)
    kept.repartitionByRange("entity", "ts").sortWithinPartitions("entity", "ts").write.mode("overwrite").parquet(path)


def read_event_store(spark: SparkSession, path: str, members: DataFrame) -> DataFrame:
    """Events of some entities from a store: a few ids are pushed into the scan as a list, many as their range, which
    the store's order turns into few row groups; then a semi-join keeps the wanted ones."""
    events = spark.read.schema(schemas.EVENTS).parquet(path)
    wanted = members.select("entity").distinct()
    some = [r[0] for r in wanted.filter("entity is not null").limit(PUSHED_IDS + 1).collect()]
    if len(some) <= PUSHED_IDS:
        return events.filter(F.col("entity").isin(some))
    least, most = wanted.agg(F.min("entity"), F.max("entity")).first()
    return events.filter(F.col("entity").between(least, most)).join(wanted, "entity", "left_semi")


def events_of_entities(events: DataFrame, members: DataFrame) -> DataFrame:
    """Events with a value of some entities; a missing encounter becomes 0, other missing values drop the row."""
    kept = events.filter(F.col("value").isNotNull()).join(members.select("entity").distinct(), "entity", "left_semi")
    return kept.fillna(0, ["encounter"]).dropna().select(*events.columns)


def events_of_items(events: DataFrame, items: list[int]) -> DataFrame:
    """Events of a literal list of items, pushed down to the scan."""
    return events.filter(F.col("item").isin(items))


def events_until_last_end(events: DataFrame, encounters: DataFrame, banned_items: tuple[int, ...] = ()) -> DataFrame:
    """Events of entities up to the end of their last encounter, without banned items."""
    last = encounters.groupBy("entity").agg(F.max("disch").alias("until"))
    kept = events.filter(~F.col("item").isin(*banned_items)) if banned_items else events
    return kept.join(last, "entity").filter(F.col("ts") <= F.col("until")).select(*events.columns)


def items_by_label(items: DataFrame, *texts: str, every: bool = False) -> DataFrame:
    """Items whose label contains one of the texts (or all of them), whatever the case."""
    tests: list[Column] = [F.contains(F.lower("label"), F.lit(t.lower())) for t in texts]
    test = tests[0]
    for other in tests[1:]:
        test = (test & other) if every else (test | other)
    return items.filter(test)


def write_cohorts(cohorts: DataFrame, path: str, columns: list[str] = schemas.STAY_COHORT_COLUMNS, files: int = 16) -> DataFrame:
    """Write the declared columns of all cohorts to one table, a folder of so many files for each; returns the table."""
    kept = schemas.conform(cohorts, columns, ("cohort", "entity", "label"))
    _write_parts(kept, path, ["cohort"], F.pmod(F.xxhash64("entity"), F.lit(files)))
    return _read_parts(cohorts.sparkSession, path, kept.schema)


def _write_parts(rows: DataFrame, path: str, by: list[str], spread: Column, mode: str = "overwrite") -> None:
    """One folder for each value of the columns by, whose rows several tasks write."""
    rows.repartition(*by, spread).write.mode(mode).partitionBy(*by).parquet(path)


def _read_parts(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """With the types as declared: a partition's value is else taken for a number where it looks like one."""
    return spark.read.schema(T.StructType([T.StructField(f.name, f.dataType) for f in schema])).parquet(path)


def cohort_summary(cohorts: DataFrame) -> DataFrame:
    """(cohort, n, entities, positives, percent)."""
    return cohorts.groupBy("cohort").agg(
        F.count("*").alias("n"),
        F.countDistinct("entity").alias("entities"),
        F.sum(F.col("label").cast("long")).alias("positives"),
        F.round(F.avg(F.col("label").cast("double")) * 100, 6).alias("percent"),
    )


def write_features(features: DataFrame, path: str, files: int = 16) -> DataFrame:
    """Long features, a folder for each cohort; returns the table."""
    _write_parts(features, path, ["cohort"], F.pmod(F.xxhash64("encounter"), F.lit(files)))
    return _read_parts(features.sparkSession, path, features.schema)


def write_splits(splits: DataFrame, path: str, files: int = 4) -> DataFrame:
    """Folds of all cohorts as one table, a folder for each split; returns the table."""
    _write_parts(splits, path, ["split"], F.pmod(F.xxhash64("cohort", "entity"), F.lit(files)))
    return _read_parts(splits.sparkSession, path, splits.schema)


def write_catalog(catalog: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """A characterised catalog, and the list of its reliable cohorts; returns both tables."""
    spark = catalog.sparkSession
    catalog.write.mode("overwrite").parquet(f"{path}/summary")
    summary = spark.read.schema(catalog.schema).parquet(f"{path}/summary")
    summary.filter("reliable = 1").select("cohort").write.mode("overwrite").parquet(f"{path}/reliable")
    return summary, spark.read.schema("cohort string").parquet(f"{path}/reliable")


#: What a result's folder says; cohorts, of which there are thousands, are a column of the files.
RESULT_FOLDERS = ["prefix", "model", "fold"]


def append_results(results: DataFrame, path: str) -> None:
    """Result rows of a run, added to those that are there."""
    _write_parts(results, path, RESULT_FOLDERS, F.lit(0), "append")


def read_results(spark: SparkSession, path: str, schema: T.StructType, prefixes: list[str] | None = None, metrics: list[str] = ()) -> DataFrame:
    """Results of all runs; or of the first of the prefixes that a (cohort, model, fold) has, from their folders only."""
    rows = _read_parts(spark, path, schema)
    return rows if prefixes is None else first_prefix(rows.filter(F.col("prefix").isin(prefixes)), prefixes, metrics)


def first_prefix(results: DataFrame, prefixes: list[str], metrics: list[str]) -> DataFrame:
    place = F.array_position(F.array(*map(F.lit, prefixes)), F.col("prefix"))
    best = F.rank().over(Window.partitionBy("cohort", "model", "fold").orderBy("place"))
    kept = results.withColumn("place", place).filter("place > 0").withColumn("best", best).filter("best = 1").drop("place", "best")
    return kept.withColumns({m: F.col(m).try_cast("double") for m in metrics})


def cohorts_on_disk(spark: SparkSession, path: str) -> DataFrame:
    """Names of the cohorts that a table has: partition values, no data read."""
    return spark.read.parquet(path).select("cohort").distinct()
