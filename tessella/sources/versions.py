"""Tables kept as versions: a folder of data for each, and a manifest that names it.

A table is a folder with `data-<name>` folders and `manifests/<number>.json`. A version counts once its manifest exists, which
is made in one step and never replaced; the current one has the highest number. So a writer that fails leaves the
table as it was, two writers of one number are told apart, and readers of an older version go on: no data is changed in
place. Everything goes through Hadoop's file systems, so a table may lie wherever Spark reads."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Step = Callable[[DataFrame], DataFrame]


class Conflict(RuntimeError):
    """Another writer has made the version that this one was to be."""


def _files(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def versions(spark: SparkSession, path: str) -> list[int]:
    """The numbers of a table's versions, ascending."""
    files, place = _files(spark, f"{path}/manifests")
    if not files.exists(place):
        return []
    names = [s.getPath().getName() for s in files.listStatus(place)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdecimal())


def manifest(spark: SparkSession, path: str, version: int) -> dict:
    files, place = _files(spark, f"{path}/manifests/{version}.json")
    stream = files.open(place)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A version of a table, the current one unless told otherwise."""
    known = versions(spark, path)
    if not known or version is not None and version not in known:
        raise FileNotFoundError(f"{path} has no version {version if version is not None else ''}".rstrip())
    said = manifest(spark, path, version or known[-1])
    schema = spark._jvm.org.apache.spark.sql.types.DataType  # the schema as it was written, also of an empty table
    return spark.read.schema(schema.fromJson(said["schema"]).toDDL()).parquet(f"{path}/{said['data']}")


def write(df: DataFrame, path: str, after: int | None = None, notes: list[str] | None = None) -> int:
    """df as the version after `after` (the current one unless told otherwise), which is returned. The data is written
    first; the manifest then makes it count. If that version exists already, this one does not come to be (Conflict)."""
    spark = df.sparkSession
    known = versions(spark, path)
    version = (after if after is not None else known[-1] if known else 0) + 1
    data = f"data-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{data}")
    said = json.dumps({"version": version, "data": data, "schema": df._jdf.schema().json(), "notes": notes or []})
    if not _commit(spark, path, version, said):
        files, place = _files(spark, f"{path}/{data}")
        files.delete(place, True)
        raise Conflict(f"version {version} of {path} is there already")
    return version


def _commit(spark: SparkSession, path: str, version: int, text: str) -> bool:
    """The manifest, written whole beside its place and then renamed there; renaming onto a file that exists fails."""
    files, place = _files(spark, f"{path}/manifests/{version}.json")
    beside = _files(spark, f"{path}/manifests/.{uuid.uuid4().hex}")[1]
    stream = files.create(beside, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    done = not files.exists(place) and files.rename(beside, place)
    if not done:
        files.delete(beside, False)
    return done


# --- steps of a migration --------------------------------------------------------------------------------------------
def added(name: str, kind: str, default: Column | None = None) -> Step:
    """A column, where there is none of that name."""
    value = (F.lit(None) if default is None else default).cast(kind)
    return lambda df: df if name.lower() in map(str.lower, df.columns) else df.withColumn(name, value)


def filled(name: str, value: Column, blank: bool = True) -> Step:
    """The value where a column is null, or blank."""
    lacks = lambda c: c.isNull() | (c == "") if blank else c.isNull()
    return lambda df: df.withColumn(name, F.when(lacks(df[name]), value).otherwise(df[name]))


def unique(keys: list[str], order: str) -> Step:
    """One row for each value of the keys (null is a value), the one with the least `order`. Only keys and order are compared;
    rows are picked by that column, whose values must differ."""

    def run(df: DataFrame) -> DataFrame:
        least = df.groupBy(*keys).agg(F.min(order).alias(order))
        return df.join(least.select(order), order, "left_semi").select(*df.columns)

    return run


def without(*names: str) -> Step:
    """Without columns of older forms, if they are there."""
    return lambda df: df.drop(*names)


def renewed(legacy: list[str], schema: str) -> Step:
    """An empty table of a schema where any column of an older form is there: such a table is not carried over."""

    def run(df: DataFrame) -> DataFrame:
        return df.sparkSession.createDataFrame([], schema) if {n.lower() for n in legacy} & set(map(str.lower, df.columns)) else df

    return run


def migrate(spark: SparkSession, path: str, steps: list[Step], name: str = "migration") -> int:
    """The table after all steps, as its next version; a table that none of them changes keeps its version. Returns the current
    version. (M26)

    Whether rows change is told by their number and the sum of their hashes, columns and types aside, which are compared
    as such; both are found in one pass over each form."""
    known = versions(spark, path)
    before = read(spark, path)
    after = reduce(lambda df, step: step(df), steps, before)
    if before.dtypes == after.dtypes and _sum(before) == _sum(after):
        return known[-1]
    return write(after, path, known[-1], [name])


def _sum(df: DataFrame) -> tuple:
    return tuple(df.agg(F.count("*"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first())


def ensure(spark: SparkSession, tables: dict[str, tuple[str, list[Step]]]) -> dict[str, int]:
    """Tables (name: path and steps) brought to their present form, those that there are; the version of each. A table that
    fails keeps its version and stops the others, whose versions stand. (M26)"""
    done = {}
    for name, (path, steps) in tables.items():
        if versions(spark, path):
            try:
                done[name] = migrate(spark, path, steps, name)
            except PySparkException as error:
                raise RuntimeError(f"{name} keeps its version {versions(spark, path)[-1]}") from error
    return done


# --- the application's tables ----------------------------------------------------------------------------------------
#: The scope of projects that name none, and the columns that tables of older forms have.
SCOPE, OLD_ITEMS, OLD_STATUS = "technical", ["project_id"], ["project_id", "id"]
ITEMS = "id long, folder_path string, title string, resume string, content string, sort_order long"
STATUS = "folder_path string, status string, message string, updated_at timestamp"


def schema_steps() -> dict[str, list[Step]]:
    """What brings each of the application's tables to its present form."""
    return {
        "projects": [added("bid_scope", "string", F.lit(SCOPE)), filled("bid_scope", F.lit(SCOPE))],
        "knowledge_chunks": [added("keywords", "string"), added("context_prefix", "string"), unique(["folder_path", "chunk_hash"], "id")],
        "knowledge_items": [renewed(OLD_ITEMS, ITEMS)],
        "knowledge_folder_status": [renewed(OLD_STATUS, STATUS)],
    }
