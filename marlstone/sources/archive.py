"""Pluggable sources: a read-through table and a data source over a folder of cached JSON responses."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def read_through(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The parquet table at ``path``; made and written first unless a finished one is there.

    A table counts as finished if its writer left ``_SUCCESS``; what a broken run left is written over.
    """
    mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    if not mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def first_available(spark: SparkSession, *paths: str) -> DataFrame:
    """The first of the parquet tables that exists."""
    conf, jvm = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(conf).exists(p):
            return spark.read.parquet(path)
    raise FileNotFoundError(", ".join(paths))


def request_key(query: str, first: str, until: str) -> str:
    """Name under which the response to a request is cached."""
    return hashlib.md5(f"{query}|{first}|{until}".encode()).hexdigest()[:16]


class _Request(InputPartition):
    def __init__(self, query: str, first: str, until: str):
        super().__init__((query, first, until))


class _ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.requests = json.loads(options["requests"])

    def partitions(self) -> list[InputPartition]:
        return [_Request(*r) for r in self.requests]

    def read(self, partition: InputPartition):
        query, first, until = partition.value
        path = os.path.join(self.folder, request_key(query, first, until) + ".json")
        if not os.path.exists(path):
            return  # a failed request leaves nothing, so that a later run asks again
        with open(path, encoding="utf-8") as f:
            yield query, first, until, f.read()


class JsonArchive(DataSource):
    """One partition per request (query, first, until) over cached responses; missing ones give no rows.

    spark.dataSource.register(JsonArchive); spark.read.format("json_archive").option("requests", json).load(folder)
    """

    @classmethod
    def name(cls) -> str:
        return "json_archive"

    def schema(self) -> str:
        return "query string, first string, until string, json string"

    def reader(self, schema) -> DataSourceReader:
        return _ArchiveReader(self.options)
