"""A corpus from raw documents to packed windows, stage by stage.

Every stage works on all rows that the one before it kept and, but for the last,
returns the columns of ``documents``, extra ones included.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import langid, minhash, packing, repeats, toxicity
from tickloom.llm.common import stored, table

#: The vocabulary that windows are counted in.
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
#: A document whose main language has a smaller share goes.
LEAST_SHARE = 0.35
#: Passages of more words that stand in several texts are cut out. So many words have more bytes, four to a word with its space.
PASSAGE_WORDS, PASSAGE_BYTES = 50, 200


def _whole(docs: DataFrame) -> DataFrame:
    """Rows as one struct beside their text, so that no column can clash."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("document"), "text")


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that the lexicon learned from ``labels`` finds more likely toxic than not."""
    lexicon = toxicity.learn(docs, table(spark, sf_dir, "labels"), F.lit(True))
    return toxicity.score(_whole(docs), lexicon).filter("predicted = 0").select("document.*")


def in_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that have no letters, or no language with a share of ``LEAST_SHARE``.

    Where no document names a language none is known, and only those without letters go.
    """
    model = langid.learn(docs, F.lit(True))
    if not model.names:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    found = langid.identify(_whole(docs), model)
    return found.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SHARE)).select("document.*")


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that share 80 % of their five-word shingles, that with the smallest doc_id stays.

    Of rows equal in doc_id and text one stays; rows without a doc_id stay.
    """
    kept = minhash.near_duplicates(docs).filter("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    named = docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return named.unionByName(docs.filter("doc_id IS NULL")).select(*(F.col(f"`{c}`") for c in docs.columns))


def without_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of more than ``PASSAGE_WORDS`` words that stand in several texts are cut out of them.

    A passage is what strings of ``PASSAGE_BYTES`` bytes cover that stand in another text too.
    """
    return repeats.without_repeats(docs, PASSAGE_BYTES, words=PASSAGE_WORDS, across=True)


def in_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document in a window of 2048 ids."""
    return packing.pack(packing.cut(docs.select("doc_id", "text"), VOCABULARY, added=True))


STAGES = [
    ("toxicity", without_toxic),
    ("language", in_known_languages),
    ("near copies", without_near_copies),
    ("repeated strings", without_repeated_strings),
    ("packing", in_windows),
]

#: Learned models, sorted signatures, names of strings and differencing have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
