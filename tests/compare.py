"""Run catalog queries beside their SQL in DuckDB and compare schema and rows.

    python tests/compare.py [sf_dir] [query ...]
"""

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def duck(sf_dir):
    connection = duckdb.connect()
    for table in TABLES.split():
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    return connection


def normal(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)]

    def text(value):
        if value is None or value is pd.NA or (isinstance(value, float) and value != value):
            return "null"
        if isinstance(value, float):
            return repr(value + 0.0)
        return str(value)

    frame = frame.apply(lambda column: column.astype(object).map(text))
    return frame.sort_values(list(frame.columns)).reset_index(drop=True)


def rows_of(df):
    return pd.DataFrame([r.asDict() for r in df.collect()], columns=df.columns, dtype=object)


SPARK_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


def differences(spark_df, relation):
    """A list of complaints; empty when both sides agree."""
    theirs = dict(zip(relation.columns, map(str, relation.types)))
    if sorted(spark_df.columns) != sorted(theirs):
        return [f"columns {sorted(spark_df.columns)} != {sorted(theirs)}"]
    out = [f"type of {n}: {t} != {theirs[n]}" for n, t in spark_df.dtypes if SPARK_TYPES.get(t, t) != theirs[n]]
    expected = pd.DataFrame(relation.fetchall(), columns=relation.columns, dtype=object)
    ours, expected = normal(rows_of(spark_df)), normal(expected)
    if len(ours) != len(expected):
        return [*out, f"rows {len(ours)} != {len(expected)}"]
    if not len(ours):
        return [*out, "no rows"]
    wrong = (ours != expected).any(axis=1)
    if wrong.any():
        both = pd.concat([ours[wrong].head(4), expected[wrong].head(4)], keys=["ours", "sql"])
        out.append(f"{int(wrong.sum())} rows differ\n{both.to_string()}")
    return out


def main():
    from undertone.plans.catalog import QUERIES
    from undertone.plans.expected import SQL
    from undertone.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = build_session(master="local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    connection = duck(sf_dir)
    for name in names:
        start = time.time()
        try:
            df = QUERIES[name](spark, sf_dir)
            if name in SQL:
                found = differences(df, connection.sql(SQL[name]))
                verdict = "ok" if not found else "DIFFERS " + "; ".join(found)
            else:
                verdict = f"rows {df.count()}"
        except Exception as error:  # report and go on with the next query
            verdict = f"FAILED {str(error)[:1500]}"
        print(f"{name:36s} {time.time() - start:6.1f}s {verdict}", flush=True)


if __name__ == "__main__":
    main()
