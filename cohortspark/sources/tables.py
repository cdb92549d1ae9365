"""Sources and sinks: readers by suffix, partitioned scans, schema facts, manifests and signed results."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None, schema: str | None = None) -> DataFrame:
    """CSV (with header, a byte order mark is passed over), JSON lines or Parquet by suffix; only `columns` are read."""
    suffix = path.rstrip("/").rpartition(".")[2].lower()
    if suffix == "csv":
        reader = spark.read.option("header", True).option("encoding", "UTF-8")
        df = (reader.schema(schema) if schema else reader).csv(path)
        df = df.withColumnsRenamed({c: c.lstrip("﻿") for c in df.columns if c.startswith("﻿")})
    elif suffix in ("json", "jsonl"):
        df = (spark.read.schema(schema) if schema else spark.read).json(path)
    elif suffix == "parquet":
        df = spark.read.parquet(path)
    else:
        raise ValueError(f"no reader for {path}")
    return df.select(*columns) if columns else df


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Parquet, CSV or JSON by suffix. Spark's committer moves files into place when all tasks have ended."""
    suffix = path.rstrip("/").rpartition(".")[2].lower()
    writer = df.write.mode("overwrite").partitionBy(*partition_by)
    {"csv": lambda: writer.option("header", True).csv(path), "json": lambda: writer.json(path), "jsonl": lambda: writer.json(path), "parquet": lambda: writer.parquet(path)}[suffix]()


def resolve(df: DataFrame, aliases: Mapping[str, Sequence[str]]) -> DataFrame:
    """Renames to each name the first column found under one of its aliases, whatever their case and separators."""

    def plain(s: str) -> str:
        return "".join(ch for ch in s.lower() if ch.isalnum())

    have: dict[str, str] = {}
    for c in df.columns:
        have.setdefault(plain(c), c)
    out = {}
    for name, others in aliases.items():
        found = next((have[plain(a)] for a in (name, *others) if plain(a) in have), None)
        if found is None:
            raise ValueError(f"no column for {name}")
        out[found] = name
    return df.withColumnsRenamed(out)


def facts(df: DataFrame) -> DataFrame:
    """(position, field, type): the schema as a table."""
    return df.sparkSession.createDataFrame([(i, n, k) for i, (n, k) in enumerate(df.dtypes)], "position int, field string, type string")


def file_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, sha256) of each file below path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def signature(df: DataFrame, columns: Sequence[Column | str]) -> DataFrame:
    """One row: rows, and a digest of the rows that does not depend on their order: counts and sums of hash parts."""
    text = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string") if isinstance(c, str) else c, F.lit("\x00")) for c in columns])
    digest = F.md5(text.cast("binary"))
    parts = [F.sum(F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long")).alias(f"h{i}") for i in range(4)]
    return df.agg(F.count("*").alias("n"), *parts)


def kept_result(spark: SparkSession, folder: str, key: DataFrame, make) -> DataFrame:
    """The table stored under the signature of `key`, made and stored if it is not there yet."""
    row = key.first()
    path = f"{folder.rstrip('/')}/{'-'.join(str(x) for x in row)}"
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def discover(candidates: Mapping[str, DataFrame], wanted: Mapping[str, Sequence[str]], key: str, ids: DataFrame) -> DataFrame:
    """(source, fields, rows, known, score, place): which of several tables holds the wanted fields (each with its aliases) and
    the ids that are asked for. fields: how many it has; known: the share of the ids (one column, distinct) that stand in its
    column for `key`; score: 0.6 of the share of the fields and 0.4 of known. Place 0 is the best; of equal scores the table of
    more rows, then the first by name. Schemas are read without data; only a table with a key is scanned, for one column."""
    from ..operators.graph import durable

    plain = lambda s: "".join(ch for ch in s.lower() if ch.isalnum())
    asked = durable(ids.toDF("_id").where("_id is not null").distinct())
    total, rows = asked.count(), []
    for name, df in candidates.items():
        have = {plain(c): c for c in reversed(df.columns)}
        found = {f: next((have[plain(a)] for a in (f, *others) if plain(a) in have), None) for f, others in wanted.items()}
        fields = sum(c is not None for c in found.values())
        n = df.select(F.lit(1)).count()
        known = df.select(F.col(found[key]).alias("_id")).distinct().join(asked, "_id", "left_semi").count() if found.get(key) else 0
        rows.append((name, fields, n, known / total if total else 0.0, 0.6 * fields / max(1, len(wanted)) + 0.4 * (known / total if total else 0.0)))
    rows.sort(key=lambda r: (-round(r[4], 9), -r[2], r[0]))
    return ids.sparkSession.createDataFrame([(*r, i) for i, r in enumerate(rows)], "source string, fields long, rows long, known double, score double, place long")
