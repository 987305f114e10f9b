"""Stores of blobs, runs as tables, and packages of specifications."""

from __future__ import annotations

import hashlib
import io
import json
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerweave import specs

CORE_VERSION = (1, 0)


class StoreError(ValueError):
    """What a store holds isn't what was put there."""


class BlobStore:
    """Blobs by shelf and name in a shared folder: every save is a version of its own that adds what the store lacks.

    A blob of a later version takes the place of one with its shelf and name. A
    save sends only blobs whose fingerprint isn't there yet, reads back what it
    has written, and is visible as a whole once Spark has committed it.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _rows(self) -> DataFrame | None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where):
            return None
        return self.spark.read.schema("shelf string, name string, document_id string, content binary, version long").parquet(self.path)

    def _append(self, rows: DataFrame, version: int) -> DataFrame:
        rows.write.mode("errorifexists").parquet(f"{self.path}/version={version}")
        return self.spark.read.parquet(f"{self.path}/version={version}")

    def listed(self) -> DataFrame:
        """(shelf, name, document_id, version) of the blobs that count, without their content."""
        rows = self._rows()
        if rows is None:
            return self.spark.createDataFrame([], "shelf string, name string, document_id string, version long")
        last = rows.groupBy("shelf", "name").agg(F.max(F.struct("version", "document_id")).alias("l"))
        return last.select("shelf", "name", "l.document_id", "l.version")

    def restore(self) -> DataFrame:
        """(shelf, name, document_id, content) of the blobs that count; their fingerprints are checked where they are read."""
        rows = self._rows()
        if rows is None:
            return self.spark.createDataFrame([], "shelf string, name string, document_id string, content binary")
        sound = F.when(F.sha2("content", 256) == F.col("document_id"), F.col("content")).otherwise(F.raise_error(F.concat(F.lit("E_STORE_CONTENT "), "name")).cast("binary"))
        return rows.join(self.listed(), ["shelf", "name", "document_id", "version"], "left_semi").select("shelf", "name", "document_id", sound.alias("content"))

    def save(self, sent: DataFrame) -> int:
        """Add (shelf, name, content) rows that the store lacks; how many those were. Of rows that share shelf and name one is sent."""
        own = sent.select("shelf", "name", F.sha2("content", 256).alias("document_id"), "content")
        one = own.groupBy("shelf", "name").agg(F.max("document_id").alias("document_id"))
        there = self.listed()
        lacking = one.join(there, ["shelf", "name", "document_id"], "left_anti")
        last = there.agg(F.max("version")).first()[0] or 0
        rows, wanted = own.join(lacking, ["shelf", "name", "document_id"], "left_semi").dropDuplicates(["shelf", "name"]), lacking.count()
        if not wanted:
            return 0
        n, wrong = self._append(rows, last + 1).agg(F.count("*"), F.count_if(F.sha2("content", 256) != F.col("document_id"))).first()
        if wrong or n != wanted:
            raise StoreError(f"E_STORE_READ_BACK {wrong} wrong, {n} of {wanted}")
        return n


class JdbcBlobStore(BlobStore):
    """The same store as a table of a database: (shelf, name, document_id, content, version)."""

    def __init__(self, spark: SparkSession, url: str, table: str, properties: dict[str, str] | None = None):
        self.spark, self.url, self.table, self.properties = spark, url, table, properties or {}

    def _table(self) -> DataFrame:
        rows = self.spark.read.jdbc(self.url, self.table, properties=self.properties)
        return rows.select(*(F.col(c).cast(k).alias(c) for c, k in (("shelf", "string"), ("name", "string"), ("document_id", "string"), ("content", "binary"), ("version", "long"))))

    def _rows(self) -> DataFrame | None:
        try:
            return self._table()
        except Exception as e:  # a table that isn't there yet; databases say so each in their way
            if any(x in str(e).lower() for x in ("does not exist", "not found", "doesn't exist")):
                return None
            raise

    def _append(self, rows: DataFrame, version: int) -> DataFrame:
        rows.withColumn("version", F.lit(version).cast("long")).write.jdbc(self.url, self.table, mode="append", properties=self.properties)
        return self._table().where(F.col("version") == version)


RUN = "entity string, columns string, rows long"


def save_run(entities: dict[str, DataFrame], path: str) -> None:
    """Each entity of a run as a Parquet table with its types; a run that is there isn't overwritten.

    The list of entities, with their types and counts of rows, is written last: a
    run without it isn't whole and can't be loaded.
    """
    told = []
    for name, df in entities.items():
        df.write.mode("errorifexists").parquet(f"{path}/{name}")
        told.append((name, df.schema.json(), df.sparkSession.read.schema(df.schema).parquet(f"{path}/{name}").count()))
    spark = next(iter(entities.values())).sparkSession
    spark.createDataFrame(told, RUN).coalesce(1).write.mode("errorifexists").json(f"{path}/_run")


def load_run(spark: SparkSession, path: str, names: list[str] | None = None) -> dict[str, DataFrame]:
    """The entities of a whole run, by name, with the types that they were saved with."""
    try:
        told = {r["entity"]: r for r in spark.read.schema(RUN).json(f"{path}/_run").collect()}  # a row for each entity
    except Exception as e:
        raise StoreError(f"E_RUN_NOT_WHOLE {path}") from e
    out = {}
    for name in names if names is not None else told:
        df = spark.read.schema(T.StructType.fromJson(json.loads(told[name]["columns"]))).parquet(f"{path}/{name}")
        if df.count() != told[name]["rows"]:
            raise StoreError(f"E_RUN_ROWS {name}")
        out[name] = df
    return out


def install(data: bytes, core: tuple[int, int] = CORE_VERSION) -> tuple[specs.FamilySpec, str]:
    """A specification from a package's bytes (JSON, or a zip with spec.json), with the package's fingerprint.

    A package that asks for a later core is refused; a package never carries code.
    """
    fingerprint = hashlib.sha256(data).hexdigest()
    if data[:4] == b"PK\x03\x04":
        box = zipfile.ZipFile(io.BytesIO(data))
        extra = [n for n in box.namelist() if n != "spec.json"]
        if extra:
            raise ValueError(f"E_PACKAGE_CONTENT {extra[0]}")
        data = box.read("spec.json")
    spec = specs.load(data.decode("utf-8"))
    least = tuple(int(x) for x in str(spec.content["versioning"].get("min_core", "0.0")).split("."))
    if least > core:
        raise ValueError(f"E_PACKAGE_CORE {least}")
    return spec, fingerprint


def inspect_packages(files: DataFrame, core: tuple[int, int] = CORE_VERSION) -> DataFrame:
    """(document_id, family, fingerprint, refusal) of packages (document_id, content): what install() would say, for each."""

    def one(data: bytes) -> tuple[str | None, str, str | None]:
        try:
            spec, fingerprint = install(data, core)
            return spec.family.name, fingerprint, None
        except (ValueError, KeyError, UnicodeDecodeError, zipfile.BadZipFile) as e:
            said = str(e).split(" ")[0]
            return None, hashlib.sha256(data).hexdigest(), said if said.startswith("E_") else "E_PACKAGE_DAMAGED"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(d, *one(bytes(c))) for d, c in zip(b["document_id"], b["content"], strict=True)], columns=["document_id", "family", "fingerprint", "refusal"])

    return files.select("document_id", "content").mapInPandas(run, "document_id string, family string, fingerprint string, refusal string")
