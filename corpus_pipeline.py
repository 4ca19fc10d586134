"""The corpus pipeline: from `documents` to token ids, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes it as Parquet in the shared folder and reads
it again for the next. All but the last return the columns that they were given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanspark.llm import mixing, pii, simhash, toxicity, unigram
from gleanspark.llm.common import columns, free_prefix, spool, table
from gleanspark.llm.near_copies import row_hash

ORACLE_SQL = None
BATCH_ROWS = 1024


def _bounded(spark: SparkSession) -> None:
    """Arrow batches of BATCH_ROWS whole texts at most in this session, so that buffers of the JVM and its workers stay small.

    A stage returns a plan that runs later, so the setting stays; a smaller one is left as it is.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows = int(spark.conf.get(key))
    spark.conf.set(key, str(min(rows, BATCH_ROWS) if rows > 0 else BATCH_ROWS))


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, learned from `labels`, doesn't reject.

    A null or empty text is scored like any other, a long one as a whole. Repeated rows share their fate. Columns of any
    name stay as they are. An empty table gives an empty one, and so few labels that nothing can be learned reject by the
    share of toxic ones among them.
    """
    _bounded(spark)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    margin = f"{free_prefix(docs)}margin"
    return toxicity.with_margin(docs, model, out=margin).where(toxicity.score_of(margin, model) < toxicity.THRESHOLD).select(*columns(docs))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies (five-word shingles, similarity 0.8 or more), the one of smallest id.

    Candidates are the links of SimHash fingerprints by Golay codewords, and MinHash keys for pairs further apart than those
    reach; all are compared by their shingles.

    Null texts and texts without words are copies of each other. Rows without an id stay. Of repeated rows one stays; ties
    of one id go by a hash of the text. Columns of any name stay as they are. An empty table gives an empty one.
    """
    _bounded(spark)
    return simhash.one_of_each_group(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every span of personal data replaced by its kind; n_chars follows the text where it changes.

    Null and empty texts, repeated rows and columns of any other name stay as they are; long texts are read whole. An empty
    table gives an empty one.
    """
    spans = f"{free_prefix(docs)}spans"
    masked = pii.mask(pii.with_spans(docs, out=spans), spans=spans)
    return masked.withColumn("n_chars", F.when(F.size(spans) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*columns(docs))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, none to three times; whole ones, so a source is off by half of one.

    A null source is a source of its own. Documents without words (null and empty texts too) are taken once where their
    place is. Rows that repeat id and text are all taken as often as the first of them. Long texts count by their words.
    Columns of any name stay as they are. An empty table gives an empty one.
    """
    p = free_prefix(docs)
    size, tie, copy = f"{p}size", f"{p}tie", f"{p}copy"
    words = docs.select(*columns(docs), mixing.n_words(F.col("text")).alias(size), row_hash().alias(tie))
    copies = mixing.whole_copies(words, F.array("source"), F.col(size), tie=F.col(tie))
    again = copies.groupBy("doc_id", "tie").agg(F.max("copies").alias(f"{p}copies")).where(f"{p}copies > 0")
    again = spool(again.withColumnsRenamed({"doc_id": f"{p}id", "tie": f"{p}of"}), "copies")
    same = F.col("doc_id").eqNullSafe(F.col(f"{p}id")) & (F.col(tie) == F.col(f"{p}of"))
    # The copies grow with the documents, so this join always shuffles.
    return words.join(again.hint("merge"), same).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(f"{p}copies").cast("int")))).select(*columns(docs))


def as_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, with their number, log score and byte pieces, and whether they decode to the text.

    One row per row of `docs`, repeated ones too; a null or empty text has no ids, a long one is read whole; columns of
    other names are left out. An empty table gives an empty one.
    """
    _bounded(spark)
    made = unigram.encode(docs.select("doc_id", "source", "text"), unigram.model_path())
    return made.select("doc_id", "source", "ids", F.size("ids").cast("long").alias("n_ids"), "n_bytes", "log_score", "round_trip")


STAGES = [
    ("toxicity", without_toxic),
    ("simhash", without_near_copies),
    ("pii", without_personal_data),
    ("mixing", mixed),
    ("sentencepiece", as_token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; odd rows as each stage says."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = spool(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
