"""Writers of result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def flat(df: DataFrame, most: int = 5) -> DataFrame:
    """Structs become columns named parent_child; arrays and maps become JSON, or '[N items]' beyond ``most``."""

    def columns(c: Column, kind: T.DataType, name: str) -> list[Column]:
        if isinstance(kind, T.StructType):
            return [x for f in kind for x in columns(c.getField(f.name), f.dataType, f"{name}_{f.name}")]
        if isinstance(kind, T.ArrayType | T.MapType):
            return [F.when(F.size(c) <= most, F.to_json(c)).when(c.isNotNull(), F.concat(F.lit("["), F.size(c).cast("string"), F.lit(" items]"))).alias(name)]
        return [c.alias(name)]

    return df.select(*(x for f in df.schema for x in columns(F.col(f"`{f.name}`"), f.dataType, f.name)))


def export(df: DataFrame, path: str) -> None:
    """Write a table by the suffix of its path: csv, tsv, json, parquet, orc, or xlsx where pandas can."""
    kind = path.rstrip("/").rpartition(".")[2].lower()
    if kind in ("csv", "tsv"):
        flat(df).write.mode("overwrite").csv(path, header=True, sep="," if kind == "csv" else "\t")
    elif kind in ("json", "parquet", "orc"):
        df.write.mode("overwrite").format(kind).save(path)
    elif kind == "xlsx":
        flat(df).toPandas().to_excel(path, index=False)
    else:
        raise ValueError(f"no writer for .{kind}")


def export_all(tables: dict[str, DataFrame], folder: str, kind: str = "csv") -> None:
    for name, df in tables.items():
        export(df, f"{folder}/{name}.{kind}")
