"""Small inline frames for tests."""

import datetime as dt

from pyspark.sql import SparkSession

KINDS = {"Fe": "double", "Cu": "double", "resultFormattedEntry": "double", "FailureConfirmed": "int"}


def frame(spark: SparkSession, **columns):
    """DataFrame from column lists plus a `source_row` key; text unless a value says otherwise."""
    length = max(len(v) for v in columns.values() if isinstance(v, list))
    data = {k: v if isinstance(v, list) else [v] * length for k, v in columns.items()}

    def kind(name, values):
        if name in KINDS:
            return KINDS[name]
        present = [v for v in values if v is not None]
        if present and all(isinstance(v, (dt.datetime, dt.date)) for v in present):
            return "timestamp_ntz"
        if present and all(isinstance(v, float) for v in present):
            return "double"
        if present and all(isinstance(v, int) for v in present):
            return "long"
        return "string"

    kinds = {k: kind(k, v) for k, v in data.items()}
    rows = []
    for i in range(length):
        row = [i]
        for k in data:
            v = data[k][i]
            row.append(float(v) if v is not None and kinds[k] == "double" else v)
        rows.append(tuple(row))
    schema = "source_row long, " + ", ".join(f"`{k}` {t}" for k, t in kinds.items())
    return spark.createDataFrame(rows, schema)


def by(df, key):
    return {row[key]: row for row in df.collect()}
