"""A corpus pipeline over the documents table: quality rules, line dedup, near-dedup, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the
next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tarazu.llm import bpe, minhash, mixture, quality, queries, templates
from tarazu.llm.common import materialize, table, with_key


def with_length(rows: DataFrame, columns: list[str]) -> DataFrame:
    """n_chars follows the text, where there is such a column."""
    return rows.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; the others lose the lines that too many documents of their source share.

    A null or empty text is rejected (it has too few words); rows that repeat get one verdict each; a null
    source is a source; columns of any other names are kept; no rows give no rows.
    """
    return with_length(quality.accepted(docs), docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go, and identical lines from a lower count on; n_chars follows the text.

    No document goes; one whose lines all go keeps an empty text, a null text stays null; the document with
    the least id keeps its lines, all rows of that id do; other columns are kept; no rows give no rows.
    """
    return with_length(templates.drop_recurring_lines(docs, identical=True), docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (5-word shingles, similarity 0.8 or more; SimHash and MinHash propose, whole shingle sets confirm) the document with the least id stays; of repeated rows one.

    Texts without words, null ones too, are one group; a null id comes after all others; rows of one id
    with different texts are told apart; of rows that repeat an id and a text the one with the least other columns,
    as JSON, stays; other columns are kept; no rows give no rows.
    """
    found = minhash.grouped(docs)
    stay = found.filter("_id = first_id and _h = first_h").select("_id", "_h").distinct()
    rows = with_key(docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text")).select("row", "_id", "_h")
    others = F.to_json(F.struct(*(F.col("row").getField(c).alias(c) for c in docs.columns if c != "text")))
    return rows.join(stay, ["_id", "_h"], "left_semi").groupBy("_id", "_h").agg(F.min_by("row", others).alias("row")).select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in as many copies as the mix takes.

    A document without words takes part like any other (it adds no words); a null source is a source, the
    last; repeated rows are drawn each on its own; other columns are kept; no rows give no rows.
    """
    return mixture.resampled(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each copy.

    A null or empty text has no tokens; a null id is kept; repeated rows are encoded each; no rows give no rows.
    """
    return queries.digests(bpe.encoded(docs.select("doc_id", "text"), queries.tokenizer_path()))


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("near-dedup", near_dedup), ("mixing", mix_sources), ("encoding", encode)]

#: MinHash, md5-placed copies over deduplicated texts and BPE are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
