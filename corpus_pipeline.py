"""The corpus pipeline: quality rules, near-dedup, substring dedup, personal data, packing.

Each stage takes (spark, docs, sf_dir), works on all the rows its predecessor kept and returns a
DataFrame; all but the last return the columns of documents. ``run`` writes each stage's result to
the shared folder and reads it for the next, so that a lost executor costs one stage at most; a stage's
table goes once the next one's is written.

Every stage ignores further columns of its input, whatever their names, and gives an empty result for
an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadence.llm import packing, pii, quality, simhash, substring
from cadence.llm.common import discard, materialise, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _as_documents(docs: DataFrame) -> DataFrame:
    """The columns of documents, with n_chars (code points) of the text as it now is."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality rules keep, as they are. Null and empty texts fail the base rules
    and go; a very long text is measured whole; rows without doc_id or lang are judged like any other;
    repeated rows share one verdict, so all stay or all go."""
    return quality.keep(docs.select(*COLUMNS), table(spark, sf_dir, "labels"), by_text=True)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, that with the smallest doc_id; repeats of that row stay once. Texts
    without words (null ones too) are copies of one another; rows without doc_id keep each distinct text once."""
    return simhash.deduplicate(docs.select(*COLUMNS))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of repeated windows. A null text stays null, with null n_chars; a
    text under 35 words stays as it is; repeated rows are repeats of one another and lose all windows."""
    return _as_documents(substring.deduplicate(docs.select(*COLUMNS)))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each run of personal spans replaced by a marker. A null text stays null, with
    null n_chars; a text without spans stays as it is, of whatever length; repeated rows stay."""
    return _as_documents(pii.redact(docs.select(*COLUMNS)))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents. A null text is the empty text, whose only token is the end id;
    long documents are cut over several windows; repeated rows and rows without doc_id are packed row by row."""
    return packing.checksums(docs, packing.word_bpe_path())


STAGES = [
    ("quality", keep_quality),
    ("near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("pii", mask_personal_data),
    ("packing", pack_windows),
]

#: The certified cutoffs, XXH64 fingerprints and tokenizer ids are beyond SQL; the tests compare
#: the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            discard(before)  # nothing reads it again
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
