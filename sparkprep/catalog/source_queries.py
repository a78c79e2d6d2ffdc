"""Sources, sinks, stages and snapshots."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import features
from ..plans.ledger import Ledger
from ..session import checkpoint_dir
from ..sources import files, stages
from .registry import load, query, source, table

_ITEMS = ["l_orderkey", "quantity", "price", "flag", "target"]


def scratch(spark, name: str) -> str:
    """A new path in the shared folder."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _round_trip(spark, folder, fmt, **options):
    """Written, and read back with its types inferred."""
    path = scratch(spark, fmt)
    files.write(load(spark, folder, "items", _ITEMS), path, fmt)
    return files.read(spark, path, fmt, **options).select(*_ITEMS)


@query("read_csv", source("items", _ITEMS))
def read_csv(spark, folder):
    return _round_trip(spark, folder, "csv")


@query("read_tsv", source("items", _ITEMS))
def read_tsv(spark, folder):
    return _round_trip(spark, folder, "tsv")


@query("read_json", source("items", _ITEMS))
def read_json(spark, folder):
    return _round_trip(spark, folder, "json")


# what has no place in the encoding is written as a question mark
_DOCS = "SELECT doc_id, lang, regexp_replace(text, '[^\\x{00}-\\x{FF}]', '?', 'g') AS text FROM documents"


@query("read_csv_latin1", _DOCS)
def read_csv_latin1(spark, folder):
    """Texts with line breaks and quotes, stored in another encoding, which is found by looking."""
    path = scratch(spark, "latin1")
    df = table(spark, folder, "documents").select("doc_id", "lang", "text")
    df.write.option("header", True).option("escape", '"').option("encoding", "iso-8859-1").csv(path)
    return files.read(spark, path, "csv", schema=df.schema, encoding="auto", multiline=True)


_KINDS = ("csv", "json", "tsv")


@query("sniff_formats", "SELECT fmt, fmt AS found, true AS some FROM (VALUES ('csv'), ('json'), ('tsv')) k(fmt)")
def sniff_formats(spark, folder):
    """A given table written in three formats, its files without endings, told apart by what they hold."""
    root, out = scratch(spark, "sniff"), None
    df = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    for k in _KINDS:
        if k == "json":
            lines = df.select(F.to_json(F.struct(*df.columns)).alias("value"))
        else:
            lines = df.select(F.concat_ws("," if k == "csv" else "\t", *[F.col(c).cast("string") for c in df.columns]).alias("value"))
        # the sink of no ending: plain text in a folder whose files are listed by their content only
        lines.write.option("compression", "none").text(f"{root}/{k}")
        found = files.sniff(spark, f"{root}/{k}", "part-*", by_ending=False).groupBy("fmt").agg(F.count(F.lit(1)).alias("n"))
        one = found.select(F.lit(k).alias("fmt"), F.col("fmt").alias("found"), (F.col("n") > 0).alias("some"))
        out = one if out is None else out.unionByName(one)
    return out


@query("write_csv", "SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def write_csv(spark, folder):
    path = scratch(spark, "csv")
    df = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    files.write(df, path, "csv")
    return spark.read.option("header", True).schema(df.schema).csv(path)


@query("save_stage", source("sales"))
def save_stage(spark, folder):
    return stages.save(load(spark, folder, "sales"), scratch(spark, "run"), "r1", "cleaned")


@query("load_stage", source("clicks", ["event_id", "event_type", "value"]))
def load_stage(spark, folder):
    root = scratch(spark, "run")
    stages.save(load(spark, folder, "clicks", ["event_id", "event_type", "value"]), root, "r1", "processed")
    return stages.load(spark, root, "r1", "processed")


_SELECTED = ["quantity", "price", "discount", "target"]  # revenue follows the price


@query("select_features", source("items", _SELECTED))
def select_features(spark, folder):
    """The columns that a correlation filter leaves, taken from the table by the ledger."""
    df = load(spark, folder, "items", ["quantity", "price", "discount", "revenue", "target"])
    ledger = Ledger(df.columns)
    ledger.add("correlation", {"threshold": 0.8}, features.filter_corr(df, "target", 0.8).columns)
    return ledger.select(df)


@query("revert_features", source("items"))
def revert_features(spark, folder):
    df = load(spark, folder, "items")
    ledger = Ledger(df.columns)
    ledger.add("iv", {"threshold": 0.02}, ["price", "discount", "target"])
    ledger.revert("after_cleaning")
    return ledger.select(df)
