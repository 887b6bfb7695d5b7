"""Results as JSON text, report files and appended tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def json_text(columns: list[str], pretty: bool = True) -> Column:
    options = {"pretty": "true"} if pretty else {}
    return F.to_json(F.struct(*columns), {**options, "ignoreNullFields": "false"})


def with_json(df: DataFrame, keep: list[str], pretty: bool = True, output: str = "json") -> DataFrame:
    """The kept columns beside the whole row as one JSON object."""
    return df.select(*keep, json_text(df.columns, pretty).alias(output))


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_reports(reports: DataFrame, path: str, by: str | None = None, mode: str = "errorifexists") -> None:
    """Report texts; `by` makes a folder per value and suits a small number of projects."""
    if by is None:
        reports.write.mode(mode).parquet(path)
    else:
        reports.select(by, "report").write.mode(mode).partitionBy(by).text(path, lineSep="\n\n")


def write_files(files: DataFrame, root: str) -> None:
    """One file per row: `code` under `path` below root, a folder or the address of a store."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, inner = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)
        for batch in batches:
            for path, code in zip(batch["path"], batch["code"], strict=True):
                target = f"{inner.rstrip('/')}/{path}"
                store.create_dir(target.rpartition("/")[0], recursive=True)
                with store.open_output_stream(target) as f:
                    f.write((code or "").encode())
            yield batch[["path"]]

    # Writing a file again gives the same file, so a task that is run twice does no harm.
    files.select("path", "code").mapInPandas(write, "path string").write.format("noop").mode("overwrite").save()


def append_events(events: DataFrame, path: str) -> None:
    events.write.mode("append").parquet(path)
