"""Readers of records, tables, archives and listings."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import parse_list


def scan_jsonl(spark: SparkSession, path: str, schema: str | StructType, strict: bool = False) -> DataFrame:
    """One object per line; blank lines are skipped and a broken line stops the job. strict: text after an object stops it too."""
    if not strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    lines = spark.read.text(path).where("trim(value) <> ''")
    wrapped = F.from_json(F.concat(F.lit('{"v":'), "value", F.lit("}")), F.lit(f"v {_struct_ddl(spark, schema)}"), {"mode": "FAILFAST"})
    return lines.select(wrapped["v"].alias("v")).select("v.*")


def _struct_ddl(spark: SparkSession, schema: str | StructType) -> str:
    kind = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    return kind.simpleString()


def scan_documents(spark: SparkSession, path: str, schema: str | StructType | None = None, kind: str = "json") -> DataFrame:
    """Files that each hold one object or a list of them, in JSON or (kind yaml, with a schema) YAML; an empty YAML file holds none."""
    if kind == "yaml":
        return _scan_yaml(spark, path, schema)
    reader = spark.read.option("multiLine", True).option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(path)


def _scan_yaml(spark: SparkSession, path: str, schema: str | StructType | None) -> DataFrame:
    """Each file is read by one task, its objects become JSON, and Spark reads those by the schema."""
    if schema is None:
        raise ValueError("YAML needs a schema")
    try:
        import yaml  # noqa: F401
    except ImportError as e:
        raise RuntimeError("YAML documents need PyYAML") from e

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import json

        import yaml

        for batch in batches:
            for content in batch.column(0).to_pylist():
                loaded = yaml.safe_load(content)
                items = [] if loaded is None else loaded if isinstance(loaded, list) else [loaded]
                yield pa.RecordBatch.from_arrays([pa.array([json.dumps(x, default=str) for x in items], pa.string())], names=["value"])

    found = spark.read.text(path, wholetext=True).mapInArrow(run, "value string")
    parsed = F.from_json("value", F.lit(_struct_ddl(spark, schema)), {"mode": "FAILFAST"})
    return found.select(parsed.alias("v")).select("v.*")


def scan_jsonl_tolerant(spark: SparkSession, path: str, schema: str | StructType) -> tuple[DataFrame, DataFrame]:
    """(rows, quarantine): the object that a line begins with, text after it notwithstanding; broken lines with their text and file."""
    lines = spark.read.text(path).where("trim(value) <> ''").select("value", F.input_file_name().alias("file"))
    parsed = lines.withColumn("v", F.try_parse_json("value"))
    kind = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    good = F.col("v").isNotNull() & F.schema_of_variant("v").startswith("OBJECT")
    rows = parsed.where(good).select(*[F.try_variant_get("v", f"$.{f.name}", f.dataType.simpleString()).alias(f.name) for f in kind.fields])
    return rows, parsed.where(~F.coalesce(good, F.lit(False))).select("file", "value")


def scan_ragged_tsv(spark: SparkSession, path: str, columns: Sequence[str], rest: str = "tags", header: bool = True) -> DataFrame:
    """Lines of fixed columns and any number of further cells, as an array of strings; short lines have null columns."""
    cells = F.split("value", "\t")
    lines = spark.read.text(path).where("trim(value) <> ''")
    if header:
        lines = lines.where(F.get(cells, F.lit(0)) != columns[0])
    n = len(columns)
    tail = F.filter(F.slice(cells, n + 1, F.greatest(F.size(cells) - n, F.lit(0))), lambda x: x != "")
    return lines.select(*[F.get(cells, F.lit(k)).alias(c) for k, c in enumerate(columns)], tail.alias(rest))


#: Clip columns of each CSV source: column -> expression on its raw columns. Lists are literals.
ADAPTERS: dict[str, Mapping[str, str]] = {}


def register_adapter(name: str, columns: Mapping[str, str]) -> None:
    """Adds a source; a name stands for one source only."""
    if name in ADAPTERS:
        raise ValueError(f"two adapters are named {name}")
    ADAPTERS[name] = columns


def scan_csv_metadata(spark: SparkSession, path: str, adapter: str | None = None, lists: Sequence[str] = ()) -> DataFrame:
    """A CSV table with a header and quoted cells over several lines, as text; list cells as arrays; an adapter's projection on top."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    for c in lists:
        rows = rows.withColumn(c, parse_list(F.col(c)))
    return rows.selectExpr(*[f"{e} AS `{c}`" for c, e in ADAPTERS[adapter].items()]) if adapter else rows


def scan_parquet(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Only the columns asked for."""
    return spark.read.parquet(path).select(*columns)


def scan_xml(spark: SparkSession, path: str, row_tag: str, schema: str | StructType) -> DataFrame:
    """One row for each element."""
    kind = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    return spark.read.format("xml").option("rowTag", row_tag).option("mode", "FAILFAST").schema(kind).load(path)


def scan_ordered_pipeline(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(file, position, plugin, parameters; file, issue) of JSON files {order: [...], plugins: {name: {control: value}}}: an order
    that is missing, and plugins of the order without settings, are issues."""
    files = spark.read.option("multiLine", True).schema("`order` array<string>, plugins map<string,map<string,string>>").json(path).withColumn("file", F.input_file_name())
    steps = files.select("file", F.posexplode("order").alias("position", "plugin"), "plugins").select("file", "position", "plugin", F.element_at("plugins", F.col("plugin")).alias("parameters"))
    issues = files.where(F.col("order").isNull()).select("file", F.lit("missing order").alias("issue")).unionByName(steps.where("parameters is null").select("file", F.concat(F.lit("no settings: "), "plugin").alias("issue")))
    return steps.where("parameters is not null"), issues


def scan_zip_members(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """path, member, text of every member of zip archives with the suffix; an archive is read by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for member in z.namelist():
                        if member.endswith(suffix):
                            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([member]), pa.array([z.read(member).decode("utf-8", "replace")])], names=["path", "member", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, member string, text string")


def scan_lookup(spark: SparkSession, path: str, key: str, value: str) -> DataFrame:
    """Key and value of a CSV table; stops if a column is missing, skips empty ones."""
    rows = spark.read.option("header", True).csv(path)
    missing = {key, value} - set(rows.columns)
    if missing:
        raise ValueError(f"{path} lacks {sorted(missing)}")
    return rows.select(key, value).where((F.coalesce(F.col(key), F.lit("")) != "") & (F.coalesce(F.col(value), F.lit("")) != ""))


def list_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, length, modified of files below a folder; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return files.select("path", "length", F.col("modificationTime").alias("modified"))


def verify_inventory(spark: SparkSession, path: str, inventory: DataFrame, parts: int = 1) -> DataFrame:
    """inventory (name, sha256) with status: ok, differs or missing; names are the last ``parts`` parts of the files' paths."""
    name = F.array_join(F.slice(F.split("path", "/"), -parts, parts), "/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(name.alias("name"), F.sha2("content", 256).alias("_found"))
    status = F.when(F.col("_found").isNull(), "missing").when(F.col("_found") == F.col("sha256"), "ok").otherwise("differs")
    return inventory.join(files, "name", "left").select(*inventory.columns, status.alias("status"))


def scan_many(spark: SparkSession, paths: Sequence[str], schema: str | StructType, limit: int | None = None) -> DataFrame:
    """Rows of several JSON lines files with their file; limit: so many of them, by file and text."""
    rows = spark.read.schema(schema).json(list(paths)).withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    return rows.orderBy("file", F.to_json(F.struct("*"))).limit(limit) if limit else rows
