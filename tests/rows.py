"""Raw rows in, results by key out."""

import json


def lines_of(spark, files: dict[str, list]):
    """Raw lines table from {path: [object or text, ...]}."""
    rows = [
        (path, i + 1, i, item if isinstance(item, str) else json.dumps(item))
        for path, items in files.items() for i, item in enumerate(items)
    ]
    return spark.createDataFrame(rows, "source string, line_no bigint, ordinal bigint, line string")


def by_key(df, key="session_id"):
    return {row[key]: row for row in df.collect()}
