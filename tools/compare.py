"""Run every query beside its SQL and report differences.

    python tools/compare.py [folder] [name ...]
"""

import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

import duckdb  # noqa: E402
import pandas as pd  # noqa: E402

from oracle import ORACLES  # noqa: E402
from fixtures.registry import QUERIES  # noqa: E402
from viewmart.session import local_session  # noqa: E402

TABLES = """region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels
 conversations""".split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        path = f"{folder}/{table}.parquet"
        if os.path.exists(path):
            connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}'")
    return connection


def normal(frame: pd.DataFrame) -> list[tuple]:
    """Rows with columns by name, as sortable text."""
    frame = frame[sorted(frame.columns)]
    columns = []
    for name in frame.columns:
        column = frame[name]
        if pd.api.types.is_float_dtype(column):
            columns.append(["NULL" if pd.isna(v) else repr(float(v) + 0.0) for v in column])
        elif pd.api.types.is_datetime64_any_dtype(column):
            columns.append(["NULL" if pd.isna(v) else str(pd.Timestamp(v)) for v in column])
        else:
            columns.append(["NULL" if v is None or v is pd.NaT or v is pd.NA else str(v) for v in column])
    return sorted(zip(*columns)) if columns else []


DUCK_TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
    "date": "DATE", "timestamp_ntz": "TIMESTAMP",
}


def differences(df, relation) -> list[str]:
    problems = []
    kinds = {name: DUCK_TYPES.get(kind, kind) for name, kind in df.dtypes}
    expected = dict(zip(relation.columns, map(str, relation.types)))
    if kinds != expected:
        odd = {n: (kinds.get(n), expected.get(n)) for n in {*kinds, *expected} if kinds.get(n) != expected.get(n)}
        problems.append(f"schema (ours, SQL): {odd}")
    if set(kinds) != set(expected):
        return problems
    ours = normal(pd.DataFrame([tuple(row) for row in df.collect()], columns=df.columns, dtype=object).infer_objects())
    rows = pd.DataFrame(relation.fetchall(), columns=relation.columns, dtype=object).infer_objects()
    theirs = normal(rows)
    if len(ours) != len(theirs):
        problems.append(f"rows: {len(ours)} against {len(theirs)}")
    if ours != theirs:
        missing = [row for row in ours if row not in set(theirs)][:2]
        extra = [row for row in theirs if row not in set(ours)][:2]
        problems.append(f"values: ours {missing} SQL {extra}")
    return problems


def main() -> int:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = local_session(8)
    connection = connect(folder)
    failures = 0
    for name in names:
        start = time.time()
        try:
            df = QUERIES[name](spark, folder)
            if name in ORACLES:
                problems = differences(df, connection.sql(ORACLES[name]))
            else:
                problems = [] if df.count() >= 0 else ["no result"]
        except Exception as error:  # report and go on with the next query
            problems = [f"{type(error).__name__}: {str(error)[:600]}"]
        failures += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '} {name} {time.time() - start:.2f}s {'; '.join(problems)}", flush=True)
    print(f"{len(names) - failures} of {len(names)} agree")
    return failures


if __name__ == "__main__":
    sys.exit(bool(main()))
