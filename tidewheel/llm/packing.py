"""Best-fit packing planned over the histogram of lengths.

Cost: the driver sees one row per distinct length (at most ``capacity``), whatever the corpus holds, and the plan that it
makes of them has a few rows for each. Documents meet their slot by joining on rank within length; a rank is a position inside a hash
bucket of its length plus the bucket's offset. A length has a bucket for each BUCKET_ROWS of its pieces, so that no task sorts more
of them, however frequent the length is.

Defined cases: null and blank texts, and lengths that are null or not positive, have no tokens and take no slot; a text longer
than the capacity is cut into full pieces and a rest, all of which are packed; rows that repeat an id are separate
documents, and a null id is kept as null; ties are broken by id, piece and text digest;
an empty table gives an empty result; columns other than id, text and length are ignored.
"""

from __future__ import annotations

import bisect
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewheel.llm.common import table, words, written

CAPACITY = 2048
#: Pieces of one length whose ranks a task counts.
BUCKET_ROWS = 200_000


def plan(histogram: Mapping[int, int], capacity: int) -> pd.DataFrame:
    """Best-fit decreasing over counts.

    Bins with equal room form ranges of ids, so that placing n pieces of one length costs a step per
    range, not per piece. Each row says: the pieces of ``length`` ranked ``rank_from`` to ``rank_to``
    (exclusive) go ``per_bin`` to a bin, from bin ``bin_from`` on, the first at ``offset`` in its bin.
    """
    rows: list[tuple[int, int, int, int, int, int]] = []
    room: dict[int, list[tuple[int, int]]] = {}  # free tokens: ranges of bins (from, to)
    sizes: list[int] = []  # the keys of room, sorted
    bins = 0

    def add(free: int, start: int, end: int) -> None:
        if free > 0 and end > start:
            if free not in room:
                bisect.insort(sizes, free)
                room[free] = []
            room[free].append((start, end))

    for length in sorted((n for n, k in histogram.items() if k > 0), reverse=True):
        left, rank = int(histogram[length]), 0
        while left:
            at = bisect.bisect_left(sizes, length)
            if at < len(sizes):
                free = sizes[at]
                start, end = room[free].pop()
                if not room[free]:
                    del room[free], sizes[at]
            else:
                free, start = capacity, bins
                end = bins = bins + -(-left // (capacity // length))
            each = free // length
            full = min(end - start, left // each)
            if full:
                rows.append((length, rank, rank + full * each, each, start, capacity - free))
                add(free - each * length, start, start + full)
                rank, left, start = rank + full * each, left - full * each, start + full
            if start < end and 0 < left < each:
                rows.append((length, rank, rank + left, left, start, capacity - free))
                add(free - left * length, start, start + 1)
                rank, left, start = rank + left, 0, start + 1
            add(free, start, end)
    return pd.DataFrame(rows, columns=["length", "rank_from", "rank_to", "per_bin", "bin_from", "offset"], dtype="int64")


def pack(docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(doc_id, piece, token_start, n_tokens, bin_id, bin_offset): the slot of every piece of every document.

    length_col: a column with the documents' lengths in tokens, such as token_counts gives; by default words between white space count."""
    spark = docs.sparkSession
    n = F.col("_n")
    length = words(F.col(text_col)) if length_col is None else F.col(length_col).cast("long")
    pieces = written(
        docs.select(F.col(id_col).alias("doc_id"), length.alias("_n"), F.md5(F.col(text_col)).alias("_d"))
        .filter(n > 0)
        .select("doc_id", "_d", n, F.explode(F.sequence(F.lit(0), ((n - 1) / capacity).cast("int"))).alias("piece"))
        .select(
            "doc_id", "_d", "piece", (F.col("piece").cast("long") * capacity).alias("token_start"),
            F.least(n - F.col("piece").cast("long") * capacity, F.lit(capacity)).alias("n_tokens"),
        ),
        "packing-pieces",
    )
    histogram = {r.n_tokens: r.k for r in pieces.groupBy("n_tokens").agg(F.count("*").alias("k")).collect()}
    kind = "length long, rank_from long, rank_to long, per_bin long, bin_from long, offset long"
    made = plan(histogram, capacity)
    slots = spark.createDataFrame(made, kind) if len(made) else spark.createDataFrame([], kind)
    many = {k: -(-v // bucket_rows) for k, v in histogram.items() if v > bucket_rows}
    buckets = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in sorted(many.items()) for x in kv)), F.col("n_tokens")), F.lit(1)) if many else F.lit(1)
    pieces = pieces.withColumn("_b", F.pmod(F.xxhash64("doc_id", "_d", "piece"), buckets))
    counts = pieces.groupBy("n_tokens", "_b").agg(F.count("*").alias("_k"))
    before = counts.select(
        "n_tokens", "_b",
        (F.sum("_k").over(Window.partitionBy("n_tokens").orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_k")).alias("_before"),
    )
    ranked = pieces.withColumn("_r", F.row_number().over(Window.partitionBy("n_tokens", "_b").orderBy("doc_id", "_d", "piece")))
    ranked = ranked.join(before, ["n_tokens", "_b"]).withColumn("_rank", F.col("_before") + F.col("_r") - 1)
    r = F.col("_rank") - F.col("rank_from")
    return ranked.join(
        F.broadcast(slots),  # its rows follow from the capacity
        (F.col("n_tokens") == F.col("length")) & (F.col("_rank") >= F.col("rank_from")) & (F.col("_rank") < F.col("rank_to")),
    ).select(
        "doc_id", "piece", "token_start", "n_tokens",
        (F.col("bin_from") + F.expr("(_rank - rank_from) div per_bin")).alias("bin_id"),
        (F.col("offset") + (r % F.col("per_bin")) * F.col("length")).alias("bin_offset"),
    )


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
