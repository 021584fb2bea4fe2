"""Single-cell and array expression: per-cell tables, identifiers, series matrices, annotations and label sheets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def annotated(rows: DataFrame, annotation: DataFrame, key: str) -> DataFrame:
    """Rows that the annotation knows."""
    return rows.join(annotation, key, "left_semi")


def cell_counts(spark: SparkSession, glob: str) -> DataFrame:
    """(gene, cell_id, value, timepoint, date, batch) from tables of genes by cells named GSM<n>_<timepoint>_<date>_<batch>.csv.

    Files with other columns each are read as lines and unpivoted by their own header, in one distributed scan."""
    lines = spark.read.text(glob, wholetext=True).select(F.col("value").alias("_t"), F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"))
    split = lines.select("file", F.split("_t", "\r?\n").alias("_l")).select("file", F.split(F.get("_l", F.lit(0)), ",").alias("_h"), F.explode(F.slice("_l", F.lit(2), F.greatest(F.size("_l") - 1, F.lit(0)))).alias("_row"))
    cells = split.filter("_row != ''").select("file", "_h", F.split("_row", ",").alias("_v"))
    clean = lambda c: F.btrim(c, F.lit('" '))
    long = cells.select("file", clean(F.get("_v", F.lit(0))).alias("gene"), F.posexplode(F.slice(F.arrays_zip(F.col("_h").alias("h"), F.col("_v").alias("v")), F.lit(2), F.greatest(F.size("_v") - 1, F.lit(0)))).alias("_i", "_p"))
    part = lambda i: F.regexp_extract("file", r"GSM\d+_([^_]+)_([^_]+)_([^_.]+)", i)
    return long.select("gene", clean(F.col("_p.h")).alias("cell_id"), F.expr("try_cast(btrim(_p.v, '\" ') as double)").alias("value"), part(1).alias("timepoint"), part(2).alias("date"), part(3).alias("batch"))


def with_zeros(counts: DataFrame) -> DataFrame:
    """cell_counts() with a row for every gene of any file in every cell: 0 where a cell's file doesn't have it. The sparse form holds the same in less."""
    cell = ["cell_id", "timepoint", "date", "batch"]
    every = counts.select(*cell).distinct().crossJoin(counts.select("gene").distinct())
    known = counts.select(*(F.col(c).alias(f"_{c}") for c in [*cell, "gene"]), "value")
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in [*cell, "gene"]]
    return every.join(known, on, "left").select("gene", "cell_id", F.coalesce("value", F.lit(0.0)).alias("value"), *cell[1:])


def cell_fields(cells: DataFrame) -> DataFrame:
    """condition, time and cluster number and name from a cell's timepoint (LD or DD, hours) and its 'number:name' label."""
    return cells.select(
        "*", F.regexp_extract("cell_id", "(LD|DD|ZT|CT)", 1).alias("condition"), F.expr("try_cast(regexp_extract(timepoint, '([0-9]+)', 1) as int)").alias("time_hours"),
        F.expr("try_cast(split(ident, ':')[0] as int)").alias("cluster"), F.get(F.split("ident", ":"), F.lit(1)).alias("cluster_name"),
    )


def series_matrix(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(metadata, values) of an array series file, plain or compressed: (field, sample, text) and (probe, sample, value)."""
    text = spark.read.text(path, wholetext=True).select(F.split("value", "\r?\n").alias("_l"))
    lines = text.select(F.posexplode("_l").alias("at", "line")).filter("line != ''")
    plain = lambda c: F.btrim(c, F.lit('"'))
    fields = lines.filter(F.col("line").startswith("!") & F.col("line").contains("\t")).select(F.substring(F.split_part("line", F.lit("\t"), F.lit(1)), 2, 200).alias("field"), F.split("line", "\t").alias("v"), "at")
    meta = fields.select("field", "at", F.posexplode(F.slice("v", F.lit(2), F.size("v") - 1)).alias("sample", "_x")).select("field", "sample", plain(F.col("_x")).alias("text"))
    body = lines.filter(~F.col("line").startswith("!")).select(F.split("line", "\t").alias("v"))
    head = text.select(F.filter("_l", lambda x: F.btrim(x, F.lit('"')).startswith("ID_REF")).alias("h")).select(F.split(F.get("h", F.lit(0)), "\t").alias("h"))
    rows = body.filter(plain(F.get("v", F.lit(0))) != "ID_REF").crossJoin(F.broadcast(head))  # one row
    pairs = rows.select(plain(F.get("v", F.lit(0))).alias("probe"), F.explode(F.slice(F.arrays_zip("h", "v"), F.lit(2), F.size("v") - 1)).alias("p"))
    return meta, pairs.select("probe", plain(F.col("p.h")).alias("sample"), F.expr("try_cast(nullif(nullif(p.v, 'null'), 'NA') as double)").alias("value"))


def sample_hours(text: Column) -> Column:
    """Hours in a sample's free text: 'ZT4', 'CT 12', 'time point: 18 h', '6 hours'; null without any."""
    patterns = [r"(?i)\b(?:ZT|CT)\s*[:=]?\s*(\d+(?:\.\d+)?)", r"(?i)time\s*(?:point)?\s*[:=]?\s*(\d+(?:\.\d+)?)", r"(?i)(\d+(?:\.\d+)?)\s*(?:h|hr|hrs|hours?)\b"]
    return F.coalesce(*(F.nullif(F.regexp_extract(text, p, 1), F.lit("")).cast("double") for p in patterns))


def probe_symbols(spark: SparkSession, path: str, probe: str = "ID", symbol: str = "Gene symbol") -> DataFrame:
    """(probe, symbol) of a platform table, after its lines of !, # and ^; of several symbols the first."""
    lines = spark.read.text(path).filter("value != '' and left(value, 1) not in ('!', '#', '^')")
    head = lines.filter(F.col("value").startswith(probe + "\t")).limit(1).select(F.split("value", "\t").alias("h"))
    v = lines.filter(~F.col("value").startswith(probe + "\t")).select(F.split("value", "\t").alias("v")).crossJoin(F.broadcast(head))  # one row
    at = lambda name: F.get("v", (F.array_position("h", name) - 1).cast("int"))
    first = F.btrim(F.split_part(at(symbol), F.lit("///"), F.lit(1)))
    return v.select(at(probe).alias("probe"), F.nullif(first, F.lit("")).alias("symbol")).filter("symbol is not null")


def label_sets(sheet: DataFrame, q: str, period: str, strict: float = 0.01, loose: float = 0.2, around: tuple[float, float] = (20.0, 28.0)) -> DataFrame:
    """sheet with label: R (rhythmic: q under strict and the period in range), N (q over loose), or ambiguous."""
    label = F.when((F.col(q) < strict) & F.col(period).between(*around), "R").when(F.col(q) > loose, "N").otherwise("ambiguous")
    return sheet.withColumn("label", F.when(F.col(q).isNotNull(), label))
