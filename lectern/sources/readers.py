"""Readers for corpora, question sets, text files and prediction files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.sources.split_json import json_entries
from lectern.sources.writers import CSV

CORPUS_VALUE = (
    "struct<text:string,title:string,document_id:bigint,corpus_source:string,url:string,domain:string,author:string,html:string>"
)
QA_SCHEMA = (
    "id string, title string, question string, context string, document_id bigint, "
    "answers struct<answer_start:array<int>,text:array<string>>"
)
TEST_SCHEMA = "id string, question string"
NESTED_SCHEMA = (
    "data array<struct<title:string,paragraphs:array<struct<context:string,qas:array<struct<"
    "id:string,question:string,answers:array<struct<text:string,answer_start:int>>>>>>>>"
)
NBEST_ENTRY = "struct<text:string,start_logit:double,end_logit:double,probability:double>"
# Supported extensions and the reader of each.
TEXT_FORMATS = {"csv": "csv", "json": "json", "txt": "text"}


def read_table(spark: SparkSession, path: str, spread: bool = False) -> DataFrame:
    """A Parquet table.

    A row group is read by one task, so a file with a single one leaves all row work to that
    task. ``spread`` deals the rows out where a scan has fewer tasks than the cluster has cores;
    a scan with enough tasks stays as it is and nothing is shuffled.
    """
    table, cores = spark.read.parquet(path), spark.sparkContext.defaultParallelism
    return table.repartition(cores) if spread and table.rdd.getNumPartitions() < cores else table


def _json_objects(spark: SparkSession, path: str, value: str, whole_file: bool) -> DataFrame:
    """``(key, value)`` rows of JSON objects: one object per line, or one per file.

    An object that fills a file is cut into its entries by all tasks that have a split of it.
    """
    if whole_file:
        text = json_entries(spark, path).select(F.concat(F.lit("{"), "entry", F.lit("}")).alias("value"))
    else:
        text = spark.read.text(path)
    objects = text.select(F.from_json("value", f"map<string,{value}>").alias("m"))
    # The outer form keeps the optimizer from parsing every object a second time for a size filter.
    return objects.select(F.explode_outer("m").alias("key", "value")).where(F.col("key").isNotNull())


def read_corpus(spark: SparkSession, path: str, whole_file: bool = True) -> DataFrame:
    """Documents of a JSON object keyed by id: ``(doc_id, text, title, ...)``.

    A single object is cut into its documents in parallel. Where it is known that there is one
    object per line, ``whole_file=False`` spares a pass.
    """
    rows = _json_objects(spark, path, CORPUS_VALUE, whole_file)
    return rows.select(F.col("key").cast("long").alias("doc_id"), "value.*")


def read_qa(spark: SparkSession, path: str, split: str | None = None, schema: str = QA_SCHEMA) -> DataFrame:
    """A stored question set, one directory per split."""
    return spark.read.schema(schema).parquet(f"{path.rstrip('/')}/{split}" if split else path)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """One ``text`` row per line of a csv, json or txt file.

    The column named ``text`` is taken, else the first one.
    """
    extension = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if extension not in TEXT_FORMATS:
        raise ValueError(f"unsupported text file extension {extension!r}, expected one of {sorted(TEXT_FORMATS)}")
    reader = spark.read
    if extension == "csv":
        reader = reader.option("header", True).option("multiLine", True).option("escape", '"')
    df = reader.format(TEXT_FORMATS[extension]).load(path)
    name = "text" if "text" in df.columns else df.columns[0]
    return df.select(F.col(f"`{name}`").cast("string").alias("text"))


def read_nested_qa(spark: SparkSession, path: str) -> DataFrame:
    """A nested question file as written by its publisher, flattened; its articles are cut apart in parallel."""
    article = NESTED_SCHEMA.removeprefix("data array<").removesuffix(">")
    articles = json_entries(spark, path, 2).select(F.from_json("entry", article).alias("a")).where("a.paragraphs is not null")
    return flatten_nested_qa(articles.select(F.array("a").alias("data")))


def flatten_nested_qa(df: DataFrame, data: str = "data") -> DataFrame:
    """Articles > paragraphs > questions as one row per question with ``answers`` arrays."""
    articles = df.select(F.explode(data).alias("a"))
    paragraphs = articles.select(F.col("a.title").alias("title"), F.explode("a.paragraphs").alias("p"))
    questions = paragraphs.select("title", F.col("p.context").alias("context"), F.explode("p.qas").alias("q"))
    answers = F.struct(
        F.transform("q.answers", lambda x: x["answer_start"]).alias("answer_start"),
        F.transform("q.answers", lambda x: x["text"]).alias("text"),
    )
    return questions.select("title", "context", F.col("q.question").alias("question"), F.col("q.id").alias("id"), answers.alias("answers"))


def read_predictions(spark: SparkSession, path: str, whole_file: bool = True) -> DataFrame:
    """``(id, text)`` rows of ``{id: text}`` objects."""
    return _json_objects(spark, path, "string", whole_file).select(F.col("key").alias("id"), F.col("value").alias("text"))


def read_nbest(spark: SparkSession, path: str, whole_file: bool = True) -> DataFrame:
    """``(id, rank, text, start_logit, end_logit, probability)`` rows of ``{id: [{...}]}`` objects."""
    rows = _json_objects(spark, path, f"array<{NBEST_ENTRY}>", whole_file)
    entries = rows.select(F.col("key").alias("id"), F.posexplode_outer("value").alias("pos", "e")).where(F.col("pos").isNotNull())
    return entries.select("id", _rank(F.col("pos")).alias("rank"), "e.*")


def read_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV written by ``write_csv``."""
    return spark.read.schema(schema).options(**CSV).option("multiLine", True).csv(path)


def _rank(position: Column) -> Column:
    return (position + 1).cast("long")
