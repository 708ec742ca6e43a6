"""Incremental runs that commit.

A table is a folder of runs. A run is written into a folder of its own, its keys beside it, and it
counts once a manifest names it: a small file with the runs that make up the table, created under the
next number and never overwritten. A run that is killed leaves folders that no manifest names, and its
retry under the same name writes them anew. Of two runs that commit at the same time one gets the
number and the other fails before any reader sees it.

Keys are kept apart by a prefix of their hash, so the check of what is there reads the keys only, and
of these only the parts that the new rows can touch.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PARTS = 64  # parts of the keys by hash; their numbers are what the check collects


class CommitConflict(RuntimeError):
    """Another run was committed meanwhile; the caller appends again."""


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def _manifest(path: str, number: int) -> str:
    return f"{path}/_commits/{number:012d}.json"


def committed(spark: SparkSession, path: str) -> tuple[int, list[str]]:
    """(number of the last commit, names of the runs that make up the table); 0 and none at first."""
    folder, files = _files(spark, f"{path}/_commits")
    if not files.exists(folder):
        return 0, []
    names = [s.getPath().getName() for s in files.listStatus(folder)]
    last = max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)
    if not last:
        return 0, []
    return last, json.loads(spark.read.text(_manifest(path, last), wholetext=True).first()[0])


def _commit(spark: SparkSession, path: str, number: int, runs: list[str]) -> None:
    """The manifest is written under another name and renamed, so nobody reads half of it."""
    target, files = _files(spark, _manifest(path, number))
    draft, _ = _files(spark, f"{path}/_drafts/{number:012d}-{runs[-1]}.json")
    out = files.create(draft, True)
    out.write(bytearray(json.dumps(runs).encode()))
    out.close()
    files.mkdirs(target.getParent())
    if files.exists(target) or not files.rename(draft, target):
        raise CommitConflict(f"commit {number} of {path} is taken")


def _part(keys: list[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(PARTS)).cast("int").alias("_part")


def _data(path: str, run: str) -> str:
    return f"{path}/rows/{run}"


def _keys(path: str, run: str) -> str:
    return f"{path}/keys/_run={run}"


def read_runs(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows of all committed runs; columns that a run lacks are null. None before the first commit."""
    _, runs = committed(spark, path)
    return spark.read.option("mergeSchema", True).parquet(*[_data(path, r) for r in runs]) if runs else None


def unseen(rows: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Rows whose ``keys`` no committed run has; a key with a null is compared like any other."""
    spark = rows.sparkSession
    _, runs = committed(spark, path)
    if not runs:
        return rows
    touched = rows.agg(F.collect_set(_part(keys))).first()[0]  # at most PARTS numbers
    kind = T.StructType([*rows.select(*keys).schema.fields, T.StructField("_part", T.IntegerType())])
    there = spark.read.schema(kind).option("basePath", f"{path}/keys").parquet(*[_keys(path, r) for r in runs])
    there = there.where(F.col("_part").isin(touched))
    there = there.select(*[F.col(k).alias(f"_there_{k}") for k in keys])
    same = [F.col(k).eqNullSafe(F.col(f"_there_{k}")) for k in keys]
    return rows.join(there, same, "left_anti")


def append(rows: DataFrame, path: str, keys: list[str], run: str, replace: bool = False) -> bool:
    """Add the rows with new ``keys`` as ``run``; with ``replace`` the run becomes the whole table.

    Of rows that share a key within the run all stay. False if the run is committed already: a
    retry changes nothing. An empty run is committed too. Columns named like the helpers
    (``_part``, ``_run``, ``_there_…``) are an error.
    """
    spark = rows.sparkSession
    clash = [c for c in rows.columns if c in ("_part", "_run") or c.startswith("_there_")]
    if clash:
        raise ValueError(f"columns with names of helpers: {clash}")
    number, runs = committed(spark, path)
    if run in runs:
        return False
    new = rows if replace else unseen(rows, path, keys)
    new.write.mode("overwrite").parquet(_data(path, run))
    # from the written rows, so that they are computed once
    written = spark.read.schema(new.schema).parquet(_data(path, run)).select(*keys, _part(keys)).distinct()
    written.repartition("_part").write.mode("overwrite").partitionBy("_part").parquet(_keys(path, run))
    _commit(spark, path, number + 1, [run] if replace else [*runs, run])
    return True
