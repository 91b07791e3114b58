"""The four-table export: bucketed Parquet tables that appear together.

Element tables are bucketed and sorted by element, exports by export: what is joined on
these keys later is read where it lies, without a shuffle.  An export is a folder of
its own for each version, and one row of a manifest names its tables, their columns and
buckets.  The row is written last, as one file that its commit renames into place: readers
see all tables of a version or none of them, and a write that fails changes nothing that
they see.

Where every content row is its own element (content_id = element_id, observed while the
table is written), styles join on element_id too; otherwise on content_id, with a shuffle of
the content.
"""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .catalog import joined

KEYS = {"exports": "export_id", "content": "element_id", "styles": "element_id", "semantics": "element_id"}
_MANIFEST = "version string, written timestamp, one_key boolean, tables string"


def _name(version: str, table: str) -> str:
    return f"export_{version}_{table}"


def write_export(tables: dict[str, DataFrame], folder: str, buckets: int | None = None) -> str:
    """Writes exports, content, styles and semantics as a new version of the export in ``folder``; the version's name.

    buckets: of each table, the shuffle partitions if not given.
    """
    if set(tables) != set(KEYS):
        raise ValueError(f"an export has the tables {', '.join(KEYS)}")
    spark = tables["content"].sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    version, seen, described = uuid.uuid4().hex, Observation(), {}
    for table, key in KEYS.items():
        frame = tables[table]
        if table == "content":
            frame = frame.observe(seen, F.count_if(~F.col("content_id").eqNullSafe(F.col("element_id"))).alias("others"))
        # dealt out as the buckets are: each task writes one file
        placed = frame.repartition(n, key).write.bucketBy(n, key).sortBy(key).format("parquet")
        placed.option("path", f"{folder}/{version}/{table}").saveAsTable(_name(version, table))
        described[table] = {"schema": frame.schema.jsonValue(), "buckets": n, "key": key}
    row = spark.range(1).select(F.lit(version).alias("version"), F.current_timestamp().alias("written"), F.lit(seen.get["others"] == 0).alias("one_key"), F.lit(json.dumps(described)).alias("tables"))
    row.coalesce(1).write.mode("append").json(f"{folder}/manifest")
    return version


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _register(spark: SparkSession, at: str, name: str, table: dict) -> DataFrame:
    """The table, told to Spark with its buckets: these aren't in the files."""
    if not spark.catalog.tableExists(name):
        columns = ", ".join(f"{_quoted(f.name)} {f.dataType.simpleString()}" for f in T.StructType.fromJson(table["schema"]).fields)
        key = _quoted(table["key"])
        location = at.replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(f"CREATE TABLE {_quoted(name)} ({columns}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {int(table['buckets'])} BUCKETS LOCATION '{location}'")
    return spark.table(_quoted(name))


class Export:
    """One version of an export: its tables by name, as attributes, and their join."""

    def __init__(self, spark: SparkSession, folder: str, version: str, one_key: bool, tables: dict):
        self.version, self.one_key = version, one_key
        self.exports, self.content, self.styles, self.semantics = (_register(spark, f"{folder}/{version}/{t}", _name(version, t), tables[t]) for t in KEYS)

    def elements(self) -> DataFrame:
        """Content with its styles and semantics."""
        if not self.one_key:
            return joined(self.content, self.styles, self.semantics)
        return self.content.join(self.styles, "element_id").join(self.semantics, "element_id")

    def forget(self, spark: SparkSession) -> None:
        """Takes the tables out of the session's catalog; their files stay."""
        for table in KEYS:
            spark.sql(f"DROP TABLE IF EXISTS {_quoted(_name(self.version, table))}")


def open_export(spark: SparkSession, folder: str, version: str | None = None) -> Export:
    """The export in ``folder`` as last written, or in a version of it."""
    try:
        rows = spark.read.schema(_MANIFEST).json(f"{folder}/manifest")
    except AnalysisException as e:
        raise FileNotFoundError(f"no export in {folder}") from e
    chosen = rows if version is None else rows.where(F.col("version") == version)
    last = chosen.orderBy(F.desc("written"), "version").limit(1).collect()
    if not last:
        raise FileNotFoundError(f"no export {version or ''} in {folder}")
    return Export(spark, folder, last[0].version, last[0].one_key, json.loads(last[0].tables))


def summary(export: Export) -> DataFrame:
    """A row for each export with what its elements hold.  These are summed up before they are dealt out by export."""
    e = export.elements()
    bold = F.col("style_bold")
    by_export = e.groupBy("export_id").agg(
        F.count("*").alias("elements"), F.count_if(bold).alias("bold"), F.count_if(F.col("semantic_role") == "header").alias("headers"),
        F.count_if(bold & (F.col("semantic_role") == "financial_text")).alias("bold_financial"), F.sum("word_count").alias("words"), F.sum("char_count").alias("chars"), F.min("confidence_score").alias("least_confidence"), F.max("font_size").alias("largest_font"),
    )
    changed = F.col("original_html") != F.col("edited_html")
    return export.exports.select("export_id", F.unix_seconds("exported_at").alias("exported_s"), "source_path", "qc_user", "edit_count", changed.alias("changed")).join(by_export, "export_id", "left")
