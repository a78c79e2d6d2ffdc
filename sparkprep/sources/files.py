"""Tables in files: CSV, TSV, JSON and parquet in and out, and recognising what a file holds."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.columns import categorical, normalize_nan, ref, replace

FORMATS = ("csv", "tsv", "json", "parquet", "orc")
# File name endings and the format they stand for.
ENDINGS = {
    "csv": "csv", "tsv": "tsv", "txt": "tsv", "json": "json", "jsonl": "json",
    "xlsx": "excel", "xls": "excel", "parquet": "parquet",
}
SNIFF_BYTES = 1000
# Other names of the encodings Spark reads.
ENCODINGS = {"latin-1": "iso-8859-1", "latin1": "iso-8859-1", "ascii": "us-ascii", "utf8": "utf-8"}
_C1 = [i for i in range(0x80, 0xA0) if bytes([i]).decode("cp1252", "ignore")]  # where cp1252 leaves latin-1


def read(
    spark: SparkSession,
    path: str | list[str],
    fmt: str = "csv",
    schema: T.StructType | str | None = None,
    encoding: str = "utf-8",
    multiline: bool = False,
    keep_bad_rows: str | None = None,
) -> DataFrame:
    """Read a table; NaN becomes null. Give ``schema`` for large inputs: inference reads the files once more.

    ``multiline`` reads records that span lines, and then a file is one task; JSON is read as lines unless asked. ``encoding`` also takes cp1252, and ``auto``: one more pass looks for bytes that are not utf-8 and falls
    back to latin-1.

    ``keep_bad_rows`` names a column for lines that do not parse (it must then be part of ``schema``).
    """
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}, expected one of {FORMATS}")
    encoding = encoding.lower()
    if encoding == "auto":
        lines = spark.read.text(path).filter(~F.is_valid_utf8("value"))
        encoding = "utf-8" if lines.isEmpty() else "iso-8859-1"
    windows = encoding in ("cp1252", "windows-1252")
    encoding = "iso-8859-1" if windows else ENCODINGS.get(encoding, encoding)
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if fmt in ("csv", "tsv"):
        reader = reader.option("header", True).option("sep", "\t" if fmt == "tsv" else ",")
        reader = reader.option("encoding", encoding).option("escape", '"').option("multiLine", multiline)
        reader = reader.option("inferSchema", schema is None)
    elif fmt == "json":
        reader = reader.option("multiLine", multiline).option("encoding", encoding)
    if fmt in ("csv", "tsv", "json") and keep_bad_rows:
        reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", keep_bad_rows)
    df = reader.format("csv" if fmt == "tsv" else fmt).load(path)
    if windows:
        raw, meant = "".join(map(chr, _C1)), bytes(_C1).decode("cp1252")
        df = replace(df, {c: F.translate(ref(c), raw, meant) for c in categorical(df)})
    return normalize_nan(df)


def write(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """Write a table with a header and without row numbers."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}, expected one of {FORMATS}")
    writer = df.write.mode(mode)
    if fmt in ("csv", "tsv"):
        writer = writer.option("header", True).option("sep", "\t" if fmt == "tsv" else ",").option("escape", '"')
    writer.format("csv" if fmt == "tsv" else fmt).save(path)


def _by_content(head: Column) -> Column:
    """Format from the first characters: commas or tabs in each of the first three lines, or a JSON opening."""
    lines = F.filter(F.slice(F.split(head, "\n"), 1, 3), lambda line: F.trim(line) != "")
    some = F.size(lines) > 0
    return (
        F.when(F.trim(head).rlike(r"^[{\[]"), "json")
        .when(some & F.forall(lines, lambda line: line.contains("\t")), "tsv")
        .otherwise("csv")
    )


def _open(path: str, size: int) -> bytes:
    uri = "file://" + path[len("file:"):] if path.startswith("file:/") and not path.startswith("file://") else path
    store, inner = fs.FileSystem.from_uri(uri)
    with store.open_input_stream(inner) as f:
        return f.read(size)


def _heads(size: int):
    """First bytes of the files whose ending says nothing; nothing else of any file is read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["head"] = [_open(p, size) if f is None else None for p, f in zip(b["path"], b["known"])]
            yield b

    return run


def sniff(spark: SparkSession, path: str, pattern: str = "*", head_bytes: int = SNIFF_BYTES, by_ending: bool = True) -> DataFrame:
    """(path, fmt, n_bytes) of every file under ``path``: by its ending, else by its first ``head_bytes`` bytes.

    Without ``by_ending`` every file is judged by what it holds.
    """
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true")
        .load(path)
        .select("path", "length")
    )
    ending = F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1))
    known = F.element_at(F.create_map(*[F.lit(x) for kv in ENDINGS.items() for x in kv]), ending)
    read = files.withColumn("known", known if by_ending else F.lit(None).cast("string")).mapInPandas(_heads(head_bytes), "path string, length bigint, known string, head binary")
    head = F.decode(F.col("head"), "ISO-8859-1")
    return read.select("path", F.coalesce("known", _by_content(head)).alias("fmt"), F.col("length").alias("n_bytes"))
