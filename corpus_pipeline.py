"""A corpus made ready for training: language, duplicates, mix, packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caseframe.llm import exact, languages, mixing, neardup, packing
from caseframe.llm.shared import keep, without_ids
from caseframe.operators.sizes import join_dimension

#: Least mean posterior of its language that a document needs.
LEAST_SCORE = 0.35
#: Similarity from which documents are near duplicates, in percent.
PERCENT = 80
#: Files whose numbers are broadcast; more are joined by a shuffle.
MOST_FILES = 1_000_000

ORACLE_SQL = None


def _free(docs: DataFrame, name: str) -> str:
    """A column name that docs do not have."""
    while name in docs.columns:
        name += "_"
    return name


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a number for each row, and the number's name.

    Decisions go by row, so rows that share an id, or have none, are told apart. Rows of files are
    numbered by the file, whose number is kept, and their place in it, which every scan tells
    alike; other rows are written with numbers first.
    """
    row, file, place = (_free(docs, name) for name in ("row_number", "row_file", "row_place"))
    try:
        placed = docs.select("*", F.col("_metadata.file_path").alias(file),
                             F.col("_metadata.row_index").alias(place))
    except AnalysisException:
        return keep(docs.withColumn(row, F.monotonically_increasing_id()), "numbered"), row
    number = F.row_number().over(Window.orderBy(file)).cast("bigint").alias(row)
    files = keep(placed.select(file).distinct().select(file, number), "files")
    numbered = join_dimension(placed, files, files, file, limit=MOST_FILES)
    return numbered.select(*docs.columns, (F.col(row) * 2**40 + F.col(place)).alias(row)), row


def _one_of_each(docs: DataFrame, row: str, groups: DataFrame) -> DataFrame:
    """docs without all but one row of each group of `groups` (group, row).

    The row with the smallest doc_id stays; one without an id only if all are, and of equal ids
    the first row.
    """
    ids = docs.select(F.col(row).alias("row"), F.col("doc_id").alias("id"))
    members = keep(groups.join(ids, "row"), "members")
    best = members.groupBy("group").agg(F.min(F.struct(F.col("id").isNull(), "id", "row")).alias("best"))
    dropped = members.select("row").join(best.select(F.col("best.row").alias("row")), "row", "left_anti")
    return without_ids(docs, keep(dropped.select(F.col("row").alias(row)), "dropped"), row).drop(row)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; texts that are null, empty, have no letter or are like none go.

    The model learns from rows with lang and doc_id. If there are rows, but none of them tells a
    language, that is an error: nothing could be kept. Rows are decided one by one, repeated
    ones and ties alike, texts of any length as a whole; no column of docs is overwritten. An
    empty table stays empty.
    """
    model = languages.train(docs, ~languages.held_out() & F.col("doc_id").isNotNull())
    if not model.languages and not docs.isEmpty():
        raise ValueError("no row has a doc_id, a text and a lang to learn from")
    names = _free(docs, "lang_pred"), _free(docs, "lang_score")
    found = languages.predict(docs, model, names)
    return found.filter((F.col(names[0]) != languages.UNKNOWN)
                        & (F.col(names[1]) >= LEAST_SCORE)).select(docs.columns)


def drop_exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows with equal texts, one: that with the smallest doc_id.

    Null and empty texts are equal to one another. Rows without an id go before those with one
    do; of rows that repeat an id and a text the first stays. Rows that share an id but not the
    text are told apart. Texts of any length are compared by digest; other columns stay with
    their row, whatever their names. An empty table stays empty.
    """
    numbered, row = _numbered(docs)
    history = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    found = exact.exact_duplicates(numbered.select(F.col(row).alias("doc_id"), "text"), history)
    groups = found.filter("group_size > 1").select(
        F.col("keep_id").alias("group"), F.col("doc_id").alias("row"))
    return _one_of_each(numbered, row, groups).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows that are near duplicates, directly or over others, one: that with the smallest doc_id.

    Null texts and those without words are near nothing and stay. Rows without an id go before
    those with one do; rows that share an id are told apart. Texts of any length are compared as
    a whole; other columns stay with their row, whatever their names. An empty table stays empty.
    """
    numbered, row = _numbered(docs)
    found = keep(neardup.near_duplicates(
        numbered.select(F.col(row).alias("doc_id"), "text"), PERCENT), "near")
    several = found.filter("not kept").select("component_id").distinct()
    groups = found.join(several, "component_id", "left_semi").select(
        F.col("component_id").alias("group"), F.col("doc_id").alias("row"))
    return _one_of_each(numbered, row, groups).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it; repeats are rows of their own.

    Null and empty texts count no words; a null source is a source of its own. Rows that share an
    id, or have none, are taken each as often as the mix says of that row. Ties in size are
    broken by a hash of id and text. Other columns stay with their row, whatever their names.
    An empty table stays empty.
    """
    numbered, row = _numbered(docs)
    copies, times = _free(numbered, "copies"), _free(numbered, "time")
    taken = mixing.mixed(numbered, row=row).filter("copies > 0").select(
        F.col("row").alias(row), F.col("copies").alias(copies))
    each = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(copies)))
    return numbered.join(taken, row).select(*docs.columns, each.alias(times)).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 1024 tokens.

    A null or empty text is its closing id; longer ones than a sequence are cut. Rows that share
    an id, or have none, are documents of their own; pieces that tie in length are told apart by a
    hash. Other columns are ignored; an empty table has no pieces.
    """
    return packing.packed_documents(docs)


STAGES = [
    ("language", identify_language),
    ("exact_duplicates", drop_exact_duplicates),
    ("near_duplicates", drop_near_duplicates),
    ("mix", mix_sources),
    ("pack", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder of tables."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    *first, (_, last) = STAGES
    for name, stage in first:
        docs = keep(stage(spark, docs, sf_dir), f"stage-{name}")
    return last(spark, docs, sf_dir)
