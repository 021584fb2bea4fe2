"""Token counts behind a digest cache.

The cache is a Parquet table of (tokenizer, content, n_tokens), partitioned by tokenizer: digests of the tokenizer's vocabulary and
pattern and of the normalised text. Counts that are stored are joined; of the rest each digest is encoded once,
and its count appended to the cache in as few files as it fills. Readers take one row of each key, so that a
repeated or concurrent append changes nothing.

Cost: the first scan moves digests only. Texts move once, spread by digest and id, and only to meet the
list of misses; a text that many ids share doesn't gather in one task, and where nothing is missing no text moves at all. Of the rows of a digest
those with the least id are sent on, and one of them is encoded. The vocabulary is read by the driver and broadcast.

Defined cases: texts are normalised by unifying line ends and trimming white space; null and blank texts have
0 tokens and no entry; strings of special tokens are ordinary text; very long texts are encoded whole; rows that repeat an id, or have none, each have a
row, and equal texts among them one entry; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.llm.common import pieces, shared_dir, table, written

#: A rank file for byte-level pair encoding, on the driver.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SCHEMA = "tokenizer string, content string, n_tokens long"
#: Entries in a file of the cache.
FILE_ROWS = 5_000_000


@lru_cache(4)
def encoder(vocabulary: bytes, pattern: str):  # noqa: ANN201
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def version(vocabulary: bytes, pattern: str) -> str:
    return hashlib.sha256(vocabulary + b"\0" + pattern.encode()).hexdigest()


def normalised(text: Column) -> Column:
    return F.btrim(F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")), F.lit(" \t\n"))


def stored(spark: SparkSession, cache: str, tokenizer: str) -> DataFrame:
    """(content, n_tokens) of this tokenizer in the cache, which may not exist yet."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache)
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    rows = spark.read.schema(SCHEMA).parquet(cache) if there else spark.createDataFrame([], SCHEMA)
    return rows.filter(F.col("tokenizer") == tokenizer).groupBy("content").agg(F.min("n_tokens").alias("n_tokens"))


def counts(docs: DataFrame, cache: str, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, n_tokens, content) for every document; encodes what the cache lacks and appends it."""
    spark = docs.sparkSession
    with open(vocabulary, "rb") as f:
        ranks = f.read()
    tokenizer = version(ranks, pattern)
    text, who = normalised(F.col("text").cast("string")), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_who")
    keyed = docs.select("doc_id", who, text.alias("_text")).withColumn("content", F.when(F.col("_text") != "", F.sha2("_text", 256)))
    light = written(keyed.select("doc_id", "_who", "content"), "token-digests")
    missing = light.filter("content is not null").groupBy("content").agg(F.min("_who").alias("_who")).join(stored(spark, cache, tokenizer), "content", "left_anti")
    missing = written(missing, "token-misses")
    n_missing = missing.count()
    if n_missing:
        shipped = spark.sparkContext.broadcast(ranks)

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            enc = encoder(shipped.value, pattern)
            for b in pieces(batches):
                n = [len(enc.encode_ordinary(t)) for t in b.column("_text").to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([tokenizer] * len(n), pa.string()), b.column("content"), pa.array(n, pa.int64())], ["tokenizer", "content", "n_tokens"])

        # rows that are alike in digest and id lie together after the join: one of them stays, without another shuffle
        todo = keyed.select("content", "_who", "_text").join(missing, ["content", "_who"], "left_semi").dropDuplicates(["content", "_who"])
        new = written(todo.select("content", "_text").mapInArrow(encode, SCHEMA), "token-new")
        new.coalesce(-(-n_missing // FILE_ROWS)).write.mode("append").partitionBy("tokenizer").parquet(cache)
    return light.join(stored(spark, cache, tokenizer), "content", "left").select("doc_id", F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"), "content")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts with an empty cache, so that every distinct text is encoded."""
    return counts(table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/token-counts-{uuid.uuid4().hex}")
