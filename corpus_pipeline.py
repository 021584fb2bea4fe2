"""Cleaning and packing a corpus: five stages, each an operator of tidewheel.llm over all that the one before kept.

1. toxicity: documents that the induced lexicon finds toxic go.
2. near_duplicates: of each group of near copies the document with the least id stays.
3. personal_data: findings are replaced by the name of their kind; all documents stay.
4. mixing: the sources are brought to their target shares of the tokens; the total is the least at which every
   source has a complete epoch, so that no clean document is lost and the others' sources repeat documents.
5. packing: every document, as often as it was taken, gets its slots in bins of CAPACITY tokens.

All but the last keep the columns of documents, and further ones whatever their names. What each does with the odd cases:
1. null and blank texts aren't toxic and stay, as does everything where labels are missing or of one kind; repeated rows stand or fall together;
   a null id or language is one as any other.
2. null texts and texts without a word stay; of repeated rows one stays, and of equal ids with different texts each that is no near copy; rows
   without an id come last in their group.
3. null and blank texts stay as they are; very long texts are redacted whole; repeated rows get the same text.
4. null and blank texts have no tokens and go; a null source is a source of its own; rows that are equal in id and text are taken equally often;
   ties of keys go by id, tokens and digest.
5. texts longer than a bin are cut into full pieces and a rest; repeated rows get slots of their own; a null id is kept.
Each gives an empty result of its columns for an empty table. tests/llm/test_edge_cases.py runs all of them over such rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewheel.llm import mixing, near_dup, packing, pii, toxicity
from tidewheel.llm.common import release, table, tables_made, written


def toxic_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return written(toxicity.clean(docs, table(spark, sf_dir, "labels")), "clean")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.dedup(docs)


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return written(pii.redact(docs), "redacted")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, ratio=None)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxic_stage),
    ("near_duplicates", near_duplicate_stage),
    ("personal_data", personal_data_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Stages whose functions write their result themselves: Python functions over texts get small Arrow batches while they do, which bounds the memory of
#: executors whoever writes the stage's result.
WRITES = {"toxicity", "personal_data"}

#: The fields and walks of the first three stages have no SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written as Parquet and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        since = tables_made()
        docs = stage(spark, docs, sf_dir)
        docs = docs if name in WRITES else written(docs, f"stage-{name}")
        release(since, keep_last=True)  # what the stage wrote on its way
    return STAGES[-1][1](spark, docs, sf_dir)
