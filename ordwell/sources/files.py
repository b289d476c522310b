"""Files in and out: configurations, rosters, archives of documents, catalogues, workbooks of tables."""

from __future__ import annotations

import io
import json
import uuid
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENTS = ("metainfo", "frames", "data_sheet1", "data_sheet2", "data_sheet3")


def read_configs(spark: SparkSession, path: str) -> DataFrame:
    """(game_type, version, key, value) of flat JSON files <game type>/<version>.json."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").option("recursiveFileLookup", "true").load(path)
    body = F.regexp_replace(F.decode("content", "utf-8"), "^﻿", "")
    values = F.from_json(body, "map<string,string>")
    game = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    version = F.coalesce(values["VERSION"], F.regexp_extract("path", r"([^/]+)\.json$", 1)).try_cast("int")
    return files.select(game.alias("game_type"), version.alias("version"), F.explode(values).alias("key", "value"))


def lookup(config: DataFrame, df: DataFrame, key: str, to: str) -> DataFrame:
    """df (game_type, version) with a key's number; 0 where it is missing. A config has a row for each version."""
    one = config.where(F.col("key") == key).select("game_type", "version", F.col("value").try_cast("double").alias("found_value"))
    return df.join(one, ["game_type", "version"], "left").withColumn(to, F.coalesce("found_value", F.lit(0.0))).drop("found_value")


def read_roster(spark: SparkSession, path: str) -> DataFrame:
    """left and right team with six players each; defaults where they are missing."""
    side = "struct<team: string, players: array<string>>"
    r = spark.read.schema(f"left {side}, right {side}").option("multiLine", True).json(path)

    def full(name: str, first: int):
        names = F.array(*(F.lit(f"Player {first + k}") for k in range(6)))
        return F.struct(F.coalesce(F.col(f"{name}.team"), F.lit(f"Team {name.title()}")).alias("team"), F.when(F.size(f"{name}.players") == 6, F.col(f"{name}.players")).otherwise(names).alias("players")).alias(name)

    return r.select(full("left", 1), full("right", 7))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(path, document, json) of the documents in zip archives."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path)

    def unzip(batches):
        for batch in batches:
            paths, names, bodies = [], [], []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as z:
                    for n in z.namelist():
                        if n.endswith(".json"):
                            paths.append(path)
                            names.append(n.rsplit("/", 1)[-1].removesuffix(".json"))
                            bodies.append(z.read(n).decode("utf-8-sig"))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in (paths, names, bodies)], ["path", "document", "json"])

    return files.select("path", "content").mapInArrow(unzip, "path string, document string, json string")


def write_documents(documents: dict[str, DataFrame], path: str) -> None:
    """Each document as gzipped JSON lines in a folder of its own."""
    for name, df in documents.items():
        if name not in DOCUMENTS:
            raise ValueError(f"no document named {name}")
        df.write.mode("overwrite").option("compression", "gzip").json(f"{path}/{name}")


def archive(documents: dict[str, list[dict]]) -> bytes:
    """One match's documents as a zip archive; for a match's bounded results."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, rows in documents.items():
            z.writestr(f"{name}.json", json.dumps(rows))
    return out.getvalue()


def write_tables(tables: dict[str, DataFrame], path: str, kind: str = "parquet") -> None:
    """The three result tables, a folder each, as parquet, json or csv."""
    for name, df in tables.items():
        df.write.mode("overwrite").format(kind).save(f"{path}/{name}")


def append_new(spark: SparkSession, found: DataFrame, path: str, key: str) -> DataFrame:
    """Append to the CSV catalogue at path what it doesn't have; returns what was new.

    What is new is written to a folder of its own beside the catalogue first, as the
    catalogue can't change while it is read; nothing comes to the driver.
    """
    try:
        known = spark.read.option("header", True).schema(found.schema).csv(path).select(key)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        known = found.select(key).limit(0)
    fresh = f"{path.rstrip('/')}_new/{uuid.uuid4().hex}"
    found.dropDuplicates([key]).join(known, key, "left_anti").select(*found.columns).write.parquet(fresh)
    new = spark.read.schema(found.schema).parquet(fresh)
    new.write.mode("append").option("header", True).csv(path)
    return new


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, category, bind, content) of icon files named name@category@bind."""
    from ordwell.functions.text import icon_parts, last_stem

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = last_stem(F.regexp_extract("path", r"([^/]+)$", 1))
    return files.select("path", icon_parts(name).alias("p"), "content").select("path", "p.*", "content")


#: What every hero has besides the abilities in its folder.
SHARED = ("ability", "Melee", "v")


def read_heroes(spark: SparkSession, path: str) -> DataFrame:
    """(hero, abilities) of folders <path>/<hero>/<name>@<category>@<bind>.png, the shared ability last."""
    own = read_images(spark, path).withColumn("hero", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1))
    each = F.sort_array(F.collect_list(F.struct("category", "name", "bind")))
    shared = F.struct(*(F.lit(v).alias(k) for k, v in zip(("category", "name", "bind"), SHARED, strict=True)))
    return own.groupBy("hero").agg(F.array_append(each, shared).alias("abilities"))
