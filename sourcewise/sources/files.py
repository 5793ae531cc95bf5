"""Sources and sinks: sniffed delimited files, column aliases, checked tables, manifests, bundles.

Bulk data moves through Spark's readers and writers; only listings, manifests
and small bundles pass through the driver.
"""

from __future__ import annotations

import csv
import hashlib
import json
import platform
import zipfile
from pathlib import Path

import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sourcewise.functions.expressions import heading

SNIFF_BYTES, DELIMITERS = 65_536, ",;\t|"
#: Bytes of an uploaded file, beyond which it is refused.
MOST_UPLOAD = 50 << 20
# Logical fields and the headings under which exports carry them.
ALIASES = {
    "entry": ("molecule chembl id", "molecule id", "compound id", "compound", "id"),
    "parent": ("parent molecule chembl id", "parent molecule", "parent id"),
    "structure": ("smiles", "canonical smiles", "structure"),
    "value": ("pchembl value", "pchembl", "p activity", "value"),
    "target": ("target chembl id", "target id", "target"),
    "type": ("standard type", "activity type", "type"),
    "relation": ("standard relation", "relation"),
    "unit": ("standard units", "units", "unit"),
    "comment": ("data validity comment", "validity comment"),
    "duplicate": ("potential duplicate", "duplicate"),
    "document": ("document chembl id", "document id", "document", "source", "batch"),
}


def sniff(spark: SparkSession, path: str) -> str:
    """The delimiter of a text file, from its first bytes; a comma if none stands out."""
    head = spark.read.option("wholetext", False).text(path).limit(50)
    sample = "\n".join(r[0].lstrip("﻿") for r in head.toLocalIterator())[:SNIFF_BYTES]
    try:
        return csv.Sniffer().sniff(sample, DELIMITERS).delimiter
    except csv.Error:
        return ","


def read_delimited(spark: SparkSession, path: str, text_only: bool = False, delimiter: str | None = None) -> DataFrame:
    """A delimited file with header; ``text_only`` keeps leading zeros of ids. An empty file is an error."""
    out = spark.read.csv(path, header=True, sep=delimiter or sniff(spark, path), inferSchema=not text_only, encoding="UTF-8")
    if not out.columns:
        raise ValueError(f"no columns in {path}")
    return out.toDF(*(c.lstrip("﻿") for c in out.columns))


def resolve(columns: list[str]) -> dict[str, str]:
    """Logical field to physical column: the first column of a normal form, then the first alias that matches."""
    first: dict[str, str] = {}
    for c in columns:
        first.setdefault(heading(c), c)
    return {field: first[heading(a)] for field, names in ALIASES.items() for a in reversed(names) if heading(a) in first}


def rename(table: DataFrame) -> DataFrame:
    """The resolved columns under their logical names, then all others, and a source row number in file order."""
    found = resolve(table.columns)
    named = [F.col(f"`{c}`").alias(field) for field, c in found.items()]
    others = [F.col(f"`{c}`") for c in table.columns if c not in found.values()]
    return number_rows(table.select(*named, *others))


def number_rows(table: DataFrame, name: str = "source_row") -> DataFrame:
    """Contiguous numbers in file order, from one small count per partition."""
    part = table.withColumn("_part", F.spark_partition_id()).withColumn("_mono", F.monotonically_increasing_id())
    starts, total = {}, 0
    for r in part.groupBy("_part").agg(F.count(F.lit(1)).alias("n"), F.min("_mono").alias("least")).orderBy("_part").collect():
        starts[r["_part"]] = total - r["least"]
        total += r["n"]
    if not starts:
        return table.withColumn(name, F.lit(None).cast("bigint"))
    shift = F.create_map(*(F.lit(x) for pair in starts.items() for x in pair))
    return part.withColumn(name, F.col("_mono") + shift[F.col("_part")]).drop("_part", "_mono")


def write_checked(table: DataFrame, path: str, schema: StructType, fmt: str = "parquet") -> None:
    """Write a table whose columns and types must be those of ``schema``; never over an existing one."""
    have = [(f.name, f.dataType.simpleString()) for f in table.schema]
    want = [(f.name, f.dataType.simpleString()) for f in schema]
    if have != want:
        raise ValueError(f"columns {have}, not {want}")
    table.write.mode("errorifexists").format(fmt).save(path)


def flat(table: DataFrame) -> DataFrame:
    """Array columns joined by semicolons, as delimited files need."""
    return table.select(*(F.array_join(F.transform(c, lambda x: x.cast("string")), ";").alias(c) if k.startswith("array") else F.col(c) for c, k in table.dtypes))


def fresh_folder(base: str) -> str:
    """``base``, or ``base-2``, ``base-3``: the first that does not exist."""
    path, n = Path(base), 1
    while path.exists():
        n += 1
        path = Path(f"{base}-{n}")
    return str(path)


def digests(paths: list[str]) -> dict[str, str]:
    """SHA-256 of local files, by name."""
    return {Path(p).name: hashlib.sha256(Path(p).read_bytes()).hexdigest() for p in paths}


def row_digest(table: DataFrame) -> str:
    """Order-free digest of a table's rows, made by the executors."""
    row = F.sha2(F.to_json(F.struct(*table.columns)), 256)
    parts = [F.conv(F.substring(row, 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)") for i in range(4)]
    sums = table.agg(F.count(F.lit(1)), *(F.sum(p) for p in parts)).first()
    return hashlib.sha256(":".join(map(str, sums)).encode()).hexdigest()


def manifest(path: str, parameters: dict, inputs: dict[str, str], outputs: dict[str, str], timings: dict[str, float] | None = None) -> None:
    """Parameters, versions, stage timings, and digests of inputs and outputs of a run."""
    versions = {"python": platform.python_version(), "pyspark": pyspark.__version__}
    Path(path).write_text(json.dumps({"parameters": parameters, "versions": versions, "timings": timings or {}, "inputs": inputs, "outputs": outputs}, indent=1, sort_keys=True))


def verify_manifest(path: str, folder: str) -> list[str]:
    """Outputs of a manifest whose bytes have changed or are missing."""
    outputs = json.loads(Path(path).read_text())["outputs"]
    return [n for n, d in outputs.items() if not (Path(folder) / n).exists() or digests([str(Path(folder) / n)])[n] != d]


def bundle(paths: list[str], to: str) -> None:
    with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(paths):
            z.write(p, Path(p).name)


def read_upload(spark: SparkSession, path: str, text_only: bool = True) -> DataFrame:
    """A delimited file of at most ``MOST_UPLOAD`` bytes with at least one row."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength()
    if size > MOST_UPLOAD:
        raise ValueError(f"{size} bytes; at most {MOST_UPLOAD} are taken")
    table = read_delimited(spark, path, text_only) if size else None
    if table is None or table.isEmpty():
        raise ValueError(f"{path} is empty")
    return table


def example(spark: SparkSession, name: str, folder: str) -> DataFrame:
    """A table of the example folder by name."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        raise ValueError(f"no example {name}")
    return spark.read.parquet(f"{folder}/{name}.parquet")


def save_tables(tables: dict[str, DataFrame], folder: str, fmt: str = "parquet") -> dict[str, str]:
    """Each table below a folder that does not exist yet (``folder``, else ``folder-2``, ...), with its row digest; delimited files have flat columns."""
    to, found = fresh_folder(folder), {}
    for name, table in tables.items():
        out = flat(table) if fmt == "csv" else table
        writer = out.write.mode("errorifexists").format(fmt)
        (writer.option("header", True) if fmt == "csv" else writer).save(f"{to}/{name}")
        found[name] = row_digest(out)
    (Path(to) / "tables.json").write_text(json.dumps({"format": fmt, "tables": found}, indent=1, sort_keys=True))
    return found


def open_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of ``save_tables``, after their digests have been checked; any change is an error."""
    note = json.loads((Path(folder) / "tables.json").read_text())
    if note["format"] != "parquet":
        raise ValueError("only parquet tables can be opened again")
    tables = {name: spark.read.parquet(f"{folder}/{name}") for name in note["tables"]}
    wrong = [n for n, t in tables.items() if row_digest(t) != note["tables"][n]]
    if wrong:
        raise ValueError(f"changed since they were saved: {', '.join(wrong)}")
    return tables


def with_totals(offsets: DataFrame, totals: DataFrame) -> DataFrame:
    """Offsets with the totals of their one-row table on each row, as a flat file carries them."""
    return offsets.join(F.broadcast(totals.limit(1)))


def json_rows(table: DataFrame) -> DataFrame:
    """Each row as JSON, with nulls written; numbers that are not finite become null."""
    clean = [F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(F.col(c)).alias(c) if k in ("double", "float") else F.col(c) for c, k in table.dtypes]
    return table.select(F.to_json(F.struct(*clean), {"ignoreNullFields": "false"}).alias("json"))
