"""A training corpus from raw documents, in five stages, each written and read again before the next one.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from liftworks.llm.common import staged, table, temporaries
from liftworks.llm.minhash import without_near_duplicates
from liftworks.llm.mixing import mixed
from liftworks.llm.packing import pack, pieces
from liftworks.llm.pii import without_pii
from liftworks.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the toxicity score rejects, in the documents' columns, whatever further ones there are.

    Null, empty and wordless texts get the training rows' share of toxic ones as score; repeated rows fare alike; very long texts are read
    whole; a score at the threshold rejects; without a labelled row of both classes all stay; an empty table stays empty."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate group: that of the least doc_id (nulls last), then of the least hash of its text.

    Texts without words are no copies of others: of rows alike in id and text one stays. Of repeated rows one stays, the first by its
    other columns. Columns of any name are carried along; an empty table stays empty."""
    return without_near_duplicates(docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put pseudonyms in place of personal data; equal values stay equal across documents, rows keep their number and columns.

    Null texts stay null, texts without a finding untouched; very long texts are rewritten whole; repeated rows alike."""
    return without_pii(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take each source's words up to its target, as documents: one row for each time that words of a document are taken, the last cut.

    Null, empty and wordless texts have no words to take and are left out; a null source is a source; repeated rows (alike in id, source
    and text) are one row that takes their sum; columns of any name are carried along; an empty table stays empty."""
    return mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the mix into sequences: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Each row is a document of its own, whether repeated or without id; null texts are empty (the final id alone); longer ones are cut."""
    return pack(pieces(docs))


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("pii", pii), ("mixing", mixing), ("packing", packing)]

#: Tokenising, compression distances and keyed permutations have no SQL: the stages are tested one by one instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other. What a stage writes besides its rows goes when it ends, the rows of all but the last at the end."""
    docs = table(spark, sf_dir, "documents")
    with temporaries():
        for _, stage in STAGES[:-1]:
            with temporaries():
                docs = staged(stage(spark, docs, sf_dir), keep=True)
        return staged(STAGES[-1][1](spark, docs, sf_dir), keep=True)
