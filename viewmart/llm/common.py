"""Small helpers that several operators share.

Every operator takes a DataFrame with an id column and a text column and selects just these, so
further columns, whatever their names, never reach it.
"""

import atexit
import os
import shutil
import tempfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from viewmart.session import new_folder, settle  # noqa: F401

#: Text that a task holds as Python objects or numpy work arrays at once.
SLICE_BYTES = 1 << 20


_shipped: set[str] = set()


#: Bytes of rows that go to or from a Python worker at once, where the session does not name a number.
ARROW_BATCH_BYTES = 4 << 20
_ARROW_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark) -> None:
    """Gives the package to Python workers, unless their path holds it already.

    Spark's own bound for a batch is 64 MB, which each task holds several times over, in the JVM's
    native memory and in Python; a session that has not set another gets a smaller one.
    """
    if spark.sparkContext.getConf().get(_ARROW_SETTING) is None:
        spark.conf.set(_ARROW_SETTING, ARROW_BATCH_BYTES)
    root, context = Path(__file__).resolve().parents[2], spark.sparkContext
    paths = [Path(path or ".").resolve() for path in [*os.environ.get("PYTHONPATH", "").split(os.pathsep), "."]]
    if root in paths or root.suffix == ".zip" or context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    folder = tempfile.mkdtemp(prefix="viewmart-")  # read by the driver alone, which serves the file
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    context.addPyFile(shutil.make_archive(f"{folder}/viewmart", "zip", root, "viewmart"))


def read_table(spark, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def texts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text) with NULL text read as empty, and carried columns under numbered names."""
    ship(docs.sparkSession)
    carried = [F.col(name).alias(f"carried_{i}") for i, name in enumerate(carry)]
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *carried)


def schema_of(table: DataFrame, names: list[str]) -> str:
    return ", ".join(f"`{name}` {table.schema[name].dataType.simpleString()}" for name in names)


def carried_names(carry: tuple[str, ...]) -> list[str]:
    return [f"carried_{i}" for i in range(len(carry))]


def with_own_names(table: DataFrame, carry: tuple[str, ...]) -> DataFrame:
    """Carried columns last and under their own names, in place of others that are called so."""
    kept = [F.col(name) for name in table.columns if name not in carry and not name.startswith("carried_")]
    return table.select(*kept, *[F.col(f"carried_{i}").alias(name) for i, name in enumerate(carry)])


#: The characters that part words, as the inside of a character class.
SPACES = r"\x20\x09-\x0D"


def words_of(text: Column) -> Column:
    """The words between the six spaces of ASCII; an empty array if there is none."""
    inner = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(inner != "", F.split(inner, f"[{SPACES}]+")).otherwise(F.array().cast("array<string>"))


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; NULL for a NULL id."""
    return (F.crc32(doc_id.cast("string").cast("binary")) % folds).cast("int")


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column one after another, and the n + 1 offsets into them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about ``limit`` bytes of text; a longer text is a run of its own."""
    if not batch.num_rows:
        return
    _, offsets = text_bytes(batch.column(text))
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
        end = min(max(end, start + 1), batch.num_rows)
        yield batch.slice(start, end - start)
        start = end


def tokenizer_file(name: str) -> str:
    """Where a public tokenizer file lies on the machine that runs this."""
    import public_tokenizers

    return public_tokenizers.path(name)


def single_threaded_tokenizers() -> None:
    """Spark already runs a task per core."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
