"""Mixing sources to target weights by weighted sampling without replacement.

Each document gets an exponential key, -ln(u) / w, from a digest of its id and its quality weight w
(Efraimidis and Spirakis): ascending keys are a weighted sample of any size. A source whose budget
exceeds its tokens gives complete epochs first; the rest of its budget is filled in the order of keys
for as long as the running sum of tokens stays within it.

Cost: a light table (source, tokens, key, digest) is spread by ranges of source and key; the sums of the ranges
tell in which one a source's budget ends, and only that range is ordered row by row, so that no task orders a
source. ``mix`` then scans the texts again and tells each row by its source's cut whether it is taken: texts aren't shuffled
while the cuts, a row for each source, are few enough to be broadcast; more of them are met by a shuffle over salted sources.
The driver sees nothing but plans.

Defined cases: null and blank texts have no tokens and are left out; a null source is a source of its
own; a source without a target weight gets no tokens; a quality weight that is null, NaN or under LEAST_WEIGHT counts as
LEAST_WEIGHT; rows that repeat an id are separate documents with equal keys if their weights are, ordered by tokens and
digest, and rows that are equal in all of it are taken or left together; very long texts are rows as any other; an empty
table gives an empty result; any other columns pass through ``mix`` unchanged, whatever their names.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewheel.llm.common import small, table, whole, words, words_sql, written

SEED = 17
#: Exponent of a source's share of the tokens in its default target weight; 1 keeps the shares.
ALPHA = 0.7
#: Tokens to select, in tokens of the corpus.
RATIO = 1.0
#: Parts of a source that meet its cut apart where there are too many sources to broadcast.
SALTS = 64
#: Characters that lower a document's quality weight.
SYMBOLS = "%$#&*|!~^<>{}[]"
LEAST_WEIGHT = 0.05


def quality(text: Column) -> Column:
    """1 for plain prose, down to LEAST_WEIGHT as a quarter of the characters are symbols."""
    share = 1 - F.length(F.translate(text, SYMBOLS, "")) / F.length(text)
    return F.greatest(F.lit(LEAST_WEIGHT), 1 - 4 * share)


def keys(docs: DataFrame, seed: int = SEED, weight: str | None = None) -> DataFrame:
    """docs with _n (tokens) and _at, the place in the order of its source; without texts that have no tokens.

    weight: a column with the documents' quality weights; by default quality() of the text."""
    text = F.col("text")
    u = (F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("doc_id").cast("string"))), 1, 12), 16, 10).cast("double") + 0.5) / float(2**48)
    w = quality(text) if weight is None else F.greatest(F.lit(LEAST_WEIGHT), F.nanvl(F.coalesce(F.col(weight).cast("double"), F.lit(0.0)), F.lit(0.0)))
    return docs.withColumn("_n", words(text)).filter("_n > 0").withColumn("_at", F.struct((-F.log(u) / w).alias("_key"), F.col("doc_id").alias("_id"), "_n", F.md5(text).alias("_digest")))


def cuts(keyed: DataFrame, targets: Mapping[str, float] | None = None, ratio: float | None = RATIO, alpha: float = ALPHA) -> DataFrame:
    """For each source: _s, _epochs (complete ones) and _cut: what lies at it or before is taken once more; null: nothing is.

    targets: the weight of each source; by default its tokens to the power of alpha.
    ratio: tokens to select against those of the corpus; None for the least at which each source
    with a weight has a complete epoch, so that no document of theirs is lost.
    """
    spark = keyed.sparkSession
    ranges = written(keyed.select("source", "_n", "_at").repartitionByRange("source", "_at").withColumn("_p", F.spark_partition_id()), "mixing-ranges")
    sums = ranges.groupBy("source", "_p").agg(F.sum("_n").alias("_t"), F.max("_at").alias("_last"))
    per = sums.groupBy("source").agg(F.sum("_t").alias("_tokens"))
    if targets is None:
        per = per.withColumn("_w", F.pow(F.col("_tokens").cast("double"), F.lit(alpha)))
    else:
        given = spark.createDataFrame([(k, float(v)) for k, v in targets.items()], "_k string, _w double")
        per = per.join(given, F.col("source").eqNullSafe(F.col("_k")), "left").drop("_k").fillna(0.0, ["_w"])
    of_all = Window.partitionBy(F.lit(0))  # a row for each source
    per = per.withColumn("_share", F.col("_w") / F.sum("_w").over(of_all))
    if ratio is None:
        total = F.max(F.when(F.col("_share") > 0, F.col("_tokens") / F.col("_share"))).over(of_all)
        budget = F.ceil(F.round(total * F.col("_share"), 3))
    else:
        budget = F.floor(F.round(F.sum("_tokens").over(of_all) * F.lit(ratio) * F.col("_share"), 3))
    per = per.withColumn("_budget", F.coalesce(budget, F.lit(0)).cast("long"))
    per = per.select(F.col("source").alias("_s"), F.expr("_budget div _tokens").alias("_epochs"), F.expr("_budget % _tokens").alias("_rest"))
    by_range = Window.partitionBy("source").orderBy("_p")  # a row for each range of a source
    bounds = written(
        sums.withColumn("_before", F.sum("_t").over(by_range.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_t"))
        .withColumn("_low", F.lag("_last").over(by_range))  # the cut if nothing of the range is taken
        .join(per, F.col("source").eqNullSafe(F.col("_s")))
        .filter("_before <= _rest and _rest < _before + _t")
        .select("_s", "_epochs", "_low", F.col("_p").alias("_cut_p"), (F.col("_rest") - F.col("_before")).alias("_left")),
        "mixing-bounds",
    )
    ends = bounds.select("_s", "_cut_p", "_left")
    at_end = F.col("source").eqNullSafe(F.col("_s")) & (F.col("_p") == F.col("_cut_p"))
    within = Window.partitionBy("source").orderBy("_at")  # rows that are equal in everything stand or fall together
    inside = (
        ranges.join(F.broadcast(ends) if small(bounds) else ends, at_end)
        .withColumn("_sum", F.sum("_n").over(within))
        .filter("_sum <= _left")
        .groupBy("source")
        .agg(F.max("_at").alias("_cut"))
        .withColumnRenamed("source", "_cs")
    )
    joined = bounds.join(inside, F.col("_s").eqNullSafe(F.col("_cs")), "left")
    return written(joined.select("_s", "_epochs", F.coalesce("_cut", "_low").alias("_cut")), "mixing-cuts")


def taken(keyed: DataFrame, cut: DataFrame) -> DataFrame:
    """keyed's rows, once for each copy to take; _epoch counts the copies from 0."""
    mine = F.col("source").eqNullSafe(F.col("_s"))
    if small(cut):
        met = keyed.join(F.broadcast(cut), mine)
    else:
        salted = keyed.withColumn("_salt", F.pmod(F.hash("_at"), F.lit(SALTS)))
        met = salted.join(cut.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), mine & (F.col("_salt") == F.col("_part")))
    return (
        met.withColumn("_copies", F.col("_epochs") + F.coalesce(F.col("_at") <= F.col("_cut"), F.lit(False)).cast("long"))
        .filter("_copies > 0")
        .withColumn("_epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1)))
    )


def select(docs: DataFrame, seed: int = SEED, weight: str | None = None, **how) -> DataFrame:
    """(doc_id, source, epoch, n_tokens, sort_key), a row for each copy; weight: see keys(), how: see cuts()."""
    keyed = written(keys(docs.select("doc_id", "source", "text", *([weight] if weight else [])), seed, weight).select("doc_id", "source", "_n", "_at"), "mixing-keys")
    return taken(keyed, cuts(keyed, **how)).select("doc_id", "source", F.col("_epoch").alias("epoch"), F.col("_n").alias("n_tokens"), F.round("_at._key", 6).alias("sort_key"))


def mix(docs: DataFrame, seed: int = SEED, weight: str | None = None, **how) -> DataFrame:
    """The rows of docs, with all their columns, as often as they are taken; weight: see keys(), how: see cuts()."""
    more = [F.col(weight).alias("_weight")] if weight else []
    given = docs.select("doc_id", "source", "text", *more, whole(docs))
    named = "_weight" if weight else None
    light = written(keys(given.drop("_row"), seed, named).select("source", "_n", "_at"), "mixing-keys")
    return taken(keys(given, seed, named), cuts(light, **how)).select("_row.*")


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select(table(spark, sf_dir, "documents"))


def select_sql(docs: str, seed: int = SEED, ratio: float | None = RATIO, alpha: float = ALPHA) -> str:
    """DuckDB's select() with default targets, from one running sum over each source; docs: a relation."""
    u = f"(('0x' || substr(md5(concat_ws('|', '{seed}', doc_id::VARCHAR)), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0"
    symbols = SYMBOLS.replace("'", "''")
    weight = f"greatest({LEAST_WEIGHT}::DOUBLE, 1 - 4 * (1 - length(translate(text, '{symbols}', ''))::DOUBLE / length(text)))"
    budget = "ceil(round(max(tokens / share) OVER () * share, 3))" if ratio is None else f"floor(round(sum(tokens) OVER () * {ratio}::DOUBLE * share, 3))"
    return f"""
WITH worded AS (SELECT doc_id, source, text, {words_sql("text")} AS n FROM {docs}),
keyed AS (SELECT doc_id, source, n, md5(text) AS digest, -ln({u}) / {weight} AS k FROM worded WHERE n > 0),
per AS (SELECT source, sum(n)::BIGINT AS tokens FROM keyed GROUP BY source),
shares AS (SELECT source, tokens, pow(tokens::DOUBLE, {alpha}::DOUBLE) / sum(pow(tokens::DOUBLE, {alpha}::DOUBLE)) OVER () AS share FROM per),
budgets AS (SELECT source, tokens, {budget}::BIGINT AS budget FROM shares),
summed AS (SELECT *, sum(n) OVER (PARTITION BY source ORDER BY k, doc_id NULLS FIRST, n, digest) AS run FROM keyed),
copies AS (SELECT s.*, b.budget // b.tokens + CASE WHEN s.run <= b.budget % b.tokens THEN 1 ELSE 0 END AS copies
           FROM summed s JOIN budgets b ON s.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, source, e.epoch::BIGINT AS epoch, n::BIGINT AS n_tokens, round(k, 6) AS sort_key
FROM copies, LATERAL (SELECT unnest(range(copies.copies)) AS epoch) e"""
