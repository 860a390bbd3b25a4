"""Reading: the parquet tables of a folder, and packages of JSON lines with a manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_package(spark: SparkSession, folder: str, schemas: dict[str, T.StructType], *, max_bytes: int = 1 << 20) -> tuple[dict[str, DataFrame], DataFrame]:
    """The files of a package, one `name.jsonl` for each schema, and its problems (file, problem, n).

    Problems: TOO_LONG (a record over max_bytes), MALFORMED (not an object of the schema). Such records are left
    out of the tables; nothing is filled in.
    """
    tables, problems = {}, None
    for name, schema in schemas.items():
        lines = spark.read.text(f"{folder}/{name}.jsonl").where(F.length(F.trim("value")) > 0)
        parsed = lines.select(
            (F.octet_length("value") > max_bytes).alias("too_long"),
            F.from_json("value", T.StructType([*schema.fields, T.StructField("_bad", T.StringType())]), {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"}).alias("r"),
        )
        state = F.when(F.col("too_long"), "TOO_LONG").when(F.col("r").isNull() | F.col("r._bad").isNotNull(), "MALFORMED")
        judged = parsed.withColumn("problem", state)
        tables[name] = judged.where("problem is null").select(*(F.col(f"r.{f.name}").alias(f.name) for f in schema.fields))
        found = judged.where("problem is not null").groupBy(F.lit(name).alias("file"), "problem").agg(F.count(F.lit(1)).alias("n"))
        problems = found if problems is None else problems.unionByName(found)
    return tables, problems


def manifest(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    """file, bytes and sha256 of each file of a package, computed where the files are read."""
    files = spark.read.format("binaryFile").load([f"{folder}/{n}.jsonl" for n in names])
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def new_rows(incoming: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """The rows to insert: of incoming one for each key that existing lacks, the least of several by all its columns.

    A key with a null is not equal to any other, as a unique constraint has it, so such rows all stay.
    """
    whole = F.struct(*incoming.columns)
    known = F.lit(True)
    for k in keys:
        known &= F.col(k).isNotNull()
    single = incoming.where(known).groupBy(*keys).agg(F.min(whole).alias("_row")).select("_row.*")
    return single.join(existing.select(*keys).distinct(), keys, "left_anti").select(*incoming.columns).unionByName(incoming.where(~known))


def package_problems(tables: dict[str, DataFrame], references: list[tuple[str, str, str, str]], counts: dict[str, int] | None = None) -> DataFrame:
    """Problems (file, problem, n) across the files of a package.

    references: (file, column, other file, its key): DANGLING records name a key that the other file lacks. counts: the
    records that a manifest promises; another number is a COUNT_MISMATCH, n the number found.
    """
    found = []
    for name, column, other, key in references:
        keys = tables[other].select(F.col(key).alias("_k")).distinct()
        lost = tables[name].where(F.col(column).isNotNull()).join(keys, F.col(column) == F.col("_k"), "left_anti")
        found.append(lost.agg(F.count(F.lit(1)).alias("n")).where("n > 0").select(F.lit(name).alias("file"), F.lit("DANGLING").alias("problem"), "n"))
    for name, promised in (counts or {}).items():
        own = tables[name].agg(F.count(F.lit(1)).alias("n")).where(F.col("n") != promised)
        found.append(own.select(F.lit(name).alias("file"), F.lit("COUNT_MISMATCH").alias("problem"), "n"))
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out
