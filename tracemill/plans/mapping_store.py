"""Stored mappings: an append-only log of versions, of which the last of each name is in force.

Each version is a file of its own, created only if it does not exist: of two writers that follow the same version,
one gets a Conflict. Nothing is ever changed; a version is superseded when its name has a later one.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracemill.plans.mapping import Mapping, from_json, to_json, validate

LOG = "name string, version long, supersedes long, document string"


class Conflict(ValueError):
    """The version that was to be followed has been followed already, or the name is taken."""


def _folder(root: str, name: str) -> str:
    return f"{root}/{hashlib.sha256(name.encode()).hexdigest()}"


def mappings(spark: SparkSession, root: str) -> DataFrame:
    """(name, version, supersedes, document, superseded) of all versions; an empty or absent log has none."""
    try:
        log = spark.read.schema(LOG).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(root)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        log = spark.createDataFrame([], LOG)
    return log.withColumn("superseded", F.col("version") < F.max("version").over(Window.partitionBy("name")))


def current(spark: SparkSession, root: str, name: str) -> Mapping | None:
    """The version of a name that is in force."""
    found = mappings(spark, root).filter((F.col("name") == name) & ~F.col("superseded")).first()
    return from_json(found["document"]) if found else None


def save(spark: SparkSession, root: str, mapping: Mapping, follows: int | None = None) -> Mapping:
    """Store a mapping as version 1 of a new name, or as the one after the version it ``follows``; it must be valid."""
    latest = current(spark, root, mapping.name)
    if (latest.version if latest else None) != follows:
        raise Conflict(f"{mapping.name!r} is at version {latest.version if latest else 'none'}, not {follows if follows is not None else 'none'}")
    made = replace(mapping, version=(follows or 0) + 1)
    if problems := validate(made):
        raise ValueError(f"invalid mapping: {problems}")
    row = json.dumps({"name": made.name, "version": made.version, "supersedes": follows, "document": to_json(made)})
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{_folder(root, made.name)}/{made.version:09d}.json")
    try:
        out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, False)
    except Exception as e:
        if "already exists" not in str(e) and "FileAlreadyExists" not in str(e):
            raise
        raise Conflict(f"version {made.version} of {made.name!r} was stored meanwhile") from e
    try:
        out.write(bytearray((row + "\n").encode()))
    finally:
        out.close()
    return made
