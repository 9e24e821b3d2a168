"""A corpus pipeline: toxic documents go, one of each group of near-copies stays, personal data is replaced, sources are
mixed to target weights, and what is left is packed into sequences. Each stage works on what the one before wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortpanel.llm import mixing, neardup, packing, pii, toxicity
from cohortpanel.llm.common import shared_folder, table, word_array

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: No SQL: the toxicity model and the sketches have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def _documents(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones, doesn't predict to be toxic.

    Null and empty texts have the score of the model's bias and stay unless everything known is toxic. Documents without
    id are judged like others, but teach nothing. Repeated rows go or stay together. Without labels all documents stay; an
    empty table gives none. Columns beyond those of documents are dropped, whatever their names.
    """
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return toxicity.classify(docs.select(*COLUMNS), labels).where("predicted = 0").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each component of near-copies, which share shingles of five words (op5's contract
    states four for its query alone); repeated rows go too.

    Null and empty texts are near-copies of nothing and stay, once an id. Documents without id stay, one for each text,
    where no document with an id is their near-copy. Texts of any length count in full. Of rows with equal id and text one stays, any
    of them. An empty table gives none; columns beyond those of documents are dropped.
    """
    kept = neardup.near_duplicates(docs.select("doc_id", "text")).where("kept").select(F.col("doc_id").alias("_kept")).distinct()
    near = docs.select(*COLUMNS).join(kept, F.col("doc_id").eqNullSafe(F.col("_kept")), "left_semi")
    return near.dropDuplicates(["doc_id", "text"]).select(*COLUMNS)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and the terms that disclose it replaced; n_chars is that of the new text.

    Null texts stay null (n_chars null), empty ones empty; repeated rows and those without id are all kept. An empty table
    gives none; columns beyond those of documents are dropped.
    """
    return _documents(pii.sanitised(docs.select(*COLUMNS)))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: a row for each whole repetition, and one cut short where a run ends.

    A null source is one of its own, the last. Documents without words, null ones too, come as often as their source is
    taken whole. Repeated rows count each by itself. A document that is cut short has its words joined by single spaces;
    whole ones are as they were. An empty table gives none; columns beyond those of documents are dropped.
    """
    mixed = mixing.mix(docs.select(*COLUMNS), F.size(word_array(F.col("text"))))
    return _documents(mixing.repeated(mixed))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, placed in sequences.

    Null and empty texts are their end id alone; long ones are cut at the capacity. Repeated rows and those without id are
    documents of their own. An empty table gives none; other columns than id and text are dropped.
    """
    # workers beside executors that earlier stages have filled get less memory for words
    return packing.pack(docs, cache_bytes=48 << 20)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("personal_data", replace_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each result is written as Parquet in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        result = stage(spark, docs, sf_dir)
        if k + 1 == len(STAGES):
            return result
        path = f"{shared_folder(spark)}/{name}"
        result.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
