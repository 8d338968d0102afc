"""Layer tables: versions of Parquet below ``<base>/<layer>/<table>``, published one at a time.

A version is written to a folder of its own. Then one small entry in the table's ``log`` names it, which is
put there by a rename that fails if the entry exists. Readers look up the last entry, so they see
the old table until the new one is whole, and a job that fails or is run twice at once never leaves half a
table. A table may be rebuilt from itself for the same reason.

A version may be clustered: its rows then stand in the order of some columns from file to file, and the
least and greatest value of each file are stored beside it, so ``read_chosen`` opens only files that
can hold the values asked for.
"""

import json
import uuid
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from viewmart.operators import where_in
from viewmart.sources.bronze_csv import write_csv

#: Versions that stay readable, the last one included; whoever reads longer may lose the files.
KEPT_VERSIONS = 2


#: Where a clustered version keeps the value ranges of its files; Spark does not read such names as data.
RANGES = "_ranges"


class PublishConflict(RuntimeError):
    """Another job published the same version first."""


def layer_path(base: str, layer: str, table: str) -> str:
    return f"{base.rstrip('/')}/{layer}/{table}"


def _file_system(spark: SparkSession, path: str):
    # PySpark has no public calls that rename or list files of any file system.
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return files, files.makeQualified(place)


def _names(spark: SparkSession, path: str) -> list[str]:
    files, place = _file_system(spark, path)
    return sorted(status.getPath().getName() for status in files.listStatus(place)) if files.exists(place) else []


def _entries(spark: SparkSession, path: str) -> dict[int, str]:
    return {int(name[:-5]): name for name in _names(spark, f"{path}/log") if name.endswith(".json") and name[:-5].isdigit()}


def _read_entry(spark: SparkSession, path: str, name: str) -> dict:
    files, place = _file_system(spark, f"{path}/log/{name}")
    stream = files.open(place)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _put_entry(spark: SparkSession, path: str, version: int, entry: dict) -> None:
    files, draft = _file_system(spark, f"{path}/log/draft-{uuid.uuid4().hex}")
    stream = files.create(draft, False)
    try:
        stream.write(json.dumps(entry).encode())
    finally:
        stream.close()
    _, final = _file_system(spark, f"{path}/log/{version:020d}.json")
    jvm = spark._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), spark._jsc.hadoopConfiguration())
    no_options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        context.rename(draft, final, no_options)
    except Py4JJavaError as error:
        files.delete(draft, False)
        if "AlreadyExists" in error.java_exception.getClass().getName():
            raise PublishConflict(f"version {version} of {path} was published by another job") from error
        raise


def _forget(spark: SparkSession, path: str, version: int, keep: int) -> None:
    """Deletes versions beyond ``keep``, and folders that can no longer be published.

    A folder whose number is not above the last published one, and that no entry names, belongs to a
    job that failed or lost the race.
    """
    entries = _entries(spark, path)
    named = {}
    for number in sorted(entries):
        if number <= version - keep:
            files, place = _file_system(spark, f"{path}/log/{entries[number]}")
            files.delete(place, False)
        else:
            named[_read_entry(spark, path, entries[number])["folder"]] = number
    for name in _names(spark, path):
        if name.startswith("v") and name not in named and int(name[1:21]) <= version:
            files, place = _file_system(spark, f"{path}/{name}")
            files.delete(place, True)


def _clustered(df: DataFrame, columns: Sequence[str], files: int | None) -> DataFrame:
    """Rows in the order of ``columns``, NULL first; the last ones also split a frequent value among files.

    Without a number of files, Spark's shuffle partitions hold, joined up to its advised size. The input is
    computed twice, since bounds are sampled from it first.
    """
    dealt = df.repartitionByRange(files, *columns) if files else df.repartitionByRange(*columns)
    return dealt.sortWithinPartitions(*columns)


def _ranges(stored: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per ``file_name``: for each column the least and greatest value and the number of NULLs.

    Least and greatest texts need sorted rows in Spark, so rows are first grouped by their texts, which a
    clustered table's first columns mostly are, and only these groups are sorted.
    """
    kinds = dict(stored.dtypes)
    texts = [i for i, name in enumerate(columns) if kinds[name] == "string"]
    others = [i for i in range(len(columns)) if i not in texts]
    keyed = stored.select("file_name", *[F.col(name).alias(f"c{i}") for i, name in enumerate(columns)])
    narrowed = [F.count("*").alias("rows")]
    for i in others:
        narrowed += [F.min(f"c{i}").alias(f"low{i}"), F.max(f"c{i}").alias(f"high{i}"), F.count_if(F.col(f"c{i}").isNull()).alias(f"nulls{i}")]
    groups = keyed.groupBy("file_name", *[f"c{i}" for i in texts]).agg(*narrowed)
    ranges = []
    for i in range(len(columns)):
        if i in texts:
            low, high, nulls = f"c{i}", f"c{i}", F.when(F.col(f"c{i}").isNull(), F.col("rows")).otherwise(0)
        else:
            low, high, nulls = f"low{i}", f"high{i}", F.col(f"nulls{i}")
        ranges += [F.min(low).alias(f"low{i}"), F.max(high).alias(f"high{i}"), F.sum(nulls).alias(f"nulls{i}")]
    return groups.groupBy("file_name").agg(*ranges)


def _write_ranges(spark: SparkSession, folder: str, columns: Sequence[str]) -> None:
    stored = spark.read.parquet(folder).select("_metadata.file_name", *columns)
    _ranges(stored, columns).coalesce(1).write.parquet(f"{folder}/{RANGES}")


def publish(
    df: DataFrame, path: str, keep: int = KEPT_VERSIONS, cluster_by: Sequence[str] = (), files: int | None = None
) -> tuple[int, str]:
    """Write a new version of the table at ``path`` and make it the current one: (version, folder).

    With ``cluster_by``, rows are stored in the order of these columns, in ``files`` files if given.
    """
    spark = df.sparkSession
    version = max(_entries(spark, path), default=0) + 1
    folder = f"v{version:020d}-{uuid.uuid4().hex}"
    if cluster_by:
        _clustered(df, cluster_by, files).write.parquet(f"{path}/{folder}")
        _write_ranges(spark, f"{path}/{folder}", cluster_by)
    else:
        df.write.parquet(f"{path}/{folder}")
    _put_entry(spark, path, version, {"version": version, "folder": folder, "clustered": list(cluster_by)})
    _forget(spark, path, version, keep)
    return version, f"{path}/{folder}"


def write_layer(
    df: DataFrame, base: str, layer: str, table: str, csv_copy: bool = False, cluster_by: Sequence[str] = (), files: int | None = None
) -> DataFrame:
    """Replace the table and return the version written, as read back from storage."""
    path = layer_path(base, layer, table)
    _, folder = publish(df, path, cluster_by=cluster_by, files=files)
    stored = df.sparkSession.read.schema(df.schema).parquet(folder)
    if csv_copy:
        write_csv(stored, f"{path}_csv")
    return stored


def layer_version(spark: SparkSession, base: str, layer: str, table: str) -> int:
    """The number of the current version; 0 for a plain Parquet folder or none."""
    return max(_entries(spark, layer_path(base, layer, table)), default=0)


def read_layer(spark: SparkSession, base: str, layer: str, table: str, version: int | None = None) -> DataFrame:
    """The current version, or a numbered one that is still kept; a plain Parquet folder is read as it is."""
    path = layer_path(base, layer, table)
    entries = _entries(spark, path)
    if version is not None and version not in entries:
        raise FileNotFoundError(f"no version {version} of the table at {path}; there are {sorted(entries)}")
    if entries:
        folder = _read_entry(spark, path, entries[max(entries) if version is None else version])["folder"]
        return spark.read.parquet(f"{path}/{folder}")
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise FileNotFoundError(f"no table at {path}; build the {layer} layer first") from error
        raise


def _may_hold(place: int, values: Sequence) -> Column:
    """Whether a file's range of a column admits one of the values; None stands for NULL."""
    within = [(F.col(f"low{place}") <= F.lit(v)) & (F.col(f"high{place}") >= F.lit(v)) for v in values if v is not None]
    within += [F.col(f"nulls{place}") > 0] if None in values else []
    met = F.lit(False)
    for one in within:
        met = met | F.coalesce(one, F.lit(False))
    return met


def read_chosen(spark: SparkSession, base: str, layer: str, table: str, **choices: Sequence | None) -> DataFrame:
    """The rows whose columns are among the chosen values, as ``where_in`` has them.

    Of a clustered table only the files are opened whose ranges admit the choice; other tables are filtered alone.
    """
    path = layer_path(base, layer, table)
    entries = _entries(spark, path)
    entry = _read_entry(spark, path, entries[max(entries)]) if entries else {}
    columns = entry.get("clustered") or []
    known = {name: values for name, values in choices.items() if values and name in columns}
    if not known:
        return where_in(read_layer(spark, base, layer, table, max(entries, default=None)), **choices)
    folder = f"{path}/{entry['folder']}"
    whole = spark.read.parquet(folder)
    ranges = spark.read.parquet(f"{folder}/{RANGES}")
    for name, values in known.items():
        ranges = ranges.where(_may_hold(columns.index(name), values))
    # A name for each file to open, which Spark's own listing of files would hold as well.
    names = [row.file_name for row in ranges.select("file_name").collect()]
    opened = spark.read.schema(whole.schema).parquet(*[f"{folder}/{name}" for name in names]) if names else whole.where("false")
    return where_in(opened, **choices)
