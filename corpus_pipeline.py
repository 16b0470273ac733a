"""A training corpus from documents: language ID, toxicity, near-duplicates, packing.

Every stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but the last
return the columns of ``docs``. Decisions hold for rows, not for ids: null and repeated ids are fine,
and columns besides doc_id, text and lang are handed on as they are. An empty table gives an empty
table. Texts are judged whole, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import cut, table, unused
from quarry.llm.langid import CHANCE, UNKNOWN, identified, learn
from quarry.llm.minhash import without_copies
from quarry.llm.packing import pack_documents
from quarry.llm.toxicity import THRESHOLD, known_labels, scored_in_place
from quarry.llm.toxicity import learn as learn_toxicity

#: Share of the leading language below which a document is rejected as not being in any language.
LEAST_SHARE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language.

    Texts that are null or without letters go, and so do those without a leading language and those
    whose letters no learned language explains better than chance. If nothing can be learned, all stay.
    """
    langs, model = learn(docs, "text", "lang")
    if not langs:
        return docs
    lang, share, fit = unused(docs, "lang_pred", "lang_share", "lang_fit")
    found = identified(docs, langs, model, names=(lang, share, fit))
    return found.where((F.col(lang) != UNKNOWN) & (F.col(share) >= LEAST_SHARE) & (F.col(fit) >= CHANCE)).drop(lang, share, fit)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled examples don't call toxic; without labels all stay."""
    chosen, index = learn_toxicity(docs, known_labels(table(spark, sf_dir, "labels")))
    (score,) = unused(docs, "toxicity")
    return scored_in_place(docs, chosen, index, name=score).where(F.col(score) < THRESHOLD).drop(score)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near-duplicates: five words, 0.8.

    Of rows that repeat id and text one stays; null and blank texts all stay.
    """
    return without_copies(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of the documents that are left; a null text is one piece, the end mark."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language_id", language), ("toxicity", toxicity), ("near_dedup", near_dedup), ("packing", packing)]
#: SQL cannot express the trained stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
