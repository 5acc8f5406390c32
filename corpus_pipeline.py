"""Five stages over documents: language ID, near duplicates, decontamination, personal data, tokens.

Each stage works on all that the one before kept; all but the last return the columns of documents, extra columns of any name
with them. What the stages do with null and empty texts, long texts, ties, repeated rows and empty tables is said at each; an
empty table gives an empty result in all of them, and no stage takes only a part of a text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stratalith.llm import bpe, decontaminate, jaccard_join, language_id, pii
from stratalith.llm.shared import table, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language cannot be told go: null and empty texts, and those without a letter. Repeated rows are judged each."""
    return language_id.keep_known(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 on five-word shingles the one with the least doc_id stays.

    Of equal ids the one of the least class, of rows equal in id and text one; a row without an id only where no other is in its
    group. Texts without words (null, empty, blank) have no copies: all of them stay.
    """
    return jaccard_join.keep_first(docs, 5, 80)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents of which more than half the words are benchmark go. Null and empty texts have no words
    and stay; half exactly stays; repeated rows are judged each."""
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data, secrets and terms that give them away are replaced; all rows stay, null and empty texts as they are."""
    return pii.sanitise(docs)


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests of the ids and of the decoded text, and the ids; a null text is encoded as an empty one."""
    return bpe.tokens(docs).drop("decoded")


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("personal_data", personal_data), ("tokens", tokenised)]
#: SQL cannot express the classifier, the similarity join or the encoder; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(spark, stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
