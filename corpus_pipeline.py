"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read by the next.

Quality removes what the classifier rejects; near dedup keeps one document of
each group; decontamination removes documents that the benchmark's passages
fill; mixing brings the sources to their weights; the last stage writes token
ids and returns their digests.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from trafficlens.llm import decontaminate, mixing, near_dedup, quality, tokens
from trafficlens.llm.common import free_name, stored, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores at its floor or above; labels come from ``labels``.

    A null or empty text is scored like a text without words.
    """
    model = quality.learn(docs, table(spark, sf_dir, "labels"))
    score = free_name(docs, "score")
    return quality.scored(docs, model, score=score).where(F.col(score) >= quality.FLOOR).drop(score)


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """The documents with a row number, because ids may be null or repeated; and the number's name.

    A row of a file is numbered by the place of the file and its own place in
    it, however the files are split, so that no numbered copy has to be written.
    Rows that do not come from files are written once with their numbers.
    """
    number, path, row = (free_name(docs, name) for name in ("number", "path", "row"))
    try:
        place = docs.metadataColumn("_metadata")
        rows = docs.select("*", place["file_path"].alias(path), place["row_index"].alias(row))
    except AnalysisException:
        return stored(docs.withColumn(number, F.monotonically_increasing_id()), "numbered"), number
    files = rows.select(path).distinct()  # one row per file
    files = stored(files.select(path, F.row_number().over(Window.orderBy(path)).cast("bigint").alias(number)), "files")
    return rows.join(files, path).select(*docs.columns, (F.shiftleft(number, 40) + F.col(row)).alias(number)), number


def _without(docs: DataFrame, dropped: DataFrame, number: str) -> DataFrame:
    """The documents whose row number is not in the stored table ``dropped``, without their numbers.

    Spark knows the size of a stored table and broadcasts it only if it is small.
    """
    return docs.join(dropped, number, "left_anti").drop(number)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near copies: shingles of five words, similarity 0.8.

    Null and empty texts are no copies and stay. Rows are removed by number, so
    an id may be null (such a row comes last in its group) or shared with
    another text.
    """
    docs, number = _numbered(docs)
    search = near_dedup.NearDuplicates(docs, number, width=5)
    member = docs.select(F.col(number).alias("row"), F.col("doc_id").alias("id"))
    member = search.groups().select(F.col("doc_id").alias("row"), F.col("component_id").alias("group")).join(member, "row")
    first = member.groupBy("group").agg(
        F.min(F.struct(F.isnull("id").alias("none"), "id", "row")).getField("row").alias("stays"), F.count("*").alias("many"))
    dropped = member.join(first.where("many > 1"), "group").where("row <> stays")
    dropped = stored(dropped.select(F.col("row").alias(number)), "dropped")
    search.discard()
    return _without(docs, dropped, number)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words stand in benchmark windows. Rows are removed by number."""
    docs, number = _numbered(docs)
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"), id=number)
    dropped = stored(found.where("contaminated").select(F.col("doc_id").alias(number)), "dropped")
    return _without(docs, dropped, number)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes, as documents: once, twice, or in part. Null texts have no words to take."""
    return mixing.Mix(docs).documents()


def write_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests read back from the token table, one row per row; a null text has its end id only."""
    return tokens.encode_corpus(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("MinHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources to target weights", mix_sources),
    ("token-ID output", write_ids),
]

#: The classifier, the permutations of the mix and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.lower().replace(" ", "-"))
    return docs
