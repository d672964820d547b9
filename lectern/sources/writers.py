"""Writers for predictions, n-best lists, null odds and CSV reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import normalize_answer
from lectern.session import materialized

IDS_PER_OBJECT = 10_000
# Bytes that are copied at a time when pieces are put together.
COPY_BYTES = 1 << 20
# Options of CSV files on both sides. A null is written as a mark that no quoted text can be.
CSV = {
    "header": True, "escape": '"', "nullValue": "\\N",
    "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
}


def prefixed(directory: str, name: str, prefix: str | None) -> str:
    """``directory/name.json`` or ``directory/name_prefix.json``."""
    return f"{directory.rstrip('/')}/{name}_{prefix}.json" if prefix else f"{directory.rstrip('/')}/{name}.json"


def run_prefix(max_features: int, lsa: int | None = None, clusters: int | None = None, metric: str | None = None) -> str:
    """Name of a sparse run, made of its parameters."""
    parts = [f"tfidf{max_features}"]
    if lsa:
        parts.append(f"lsa{lsa}")
    if clusters:
        parts.append(f"faiss{clusters}_{metric}")
    return "_".join(parts)


def write_predictions(df: DataFrame, directory: str, prefix: str | None = None, single: bool = False) -> str:
    """``{id: text}`` objects, one per line."""
    return _write_objects(df, F.col("text"), prefixed(directory, "predictions", prefix), single)


def write_nbest(predicted: DataFrame, directory: str, prefix: str | None = None, single: bool = False) -> str:
    """``{id: [{text, start_logit, end_logit, probability}]}`` objects, one per line."""
    entries = F.transform(
        "nbest", lambda x: F.struct(x["text"].alias("text"), x["start_logit"].alias("start_logit"), x["end_logit"].alias("end_logit"), x["probability"].alias("probability"))
    )
    return _write_objects(predicted, entries, prefixed(directory, "nbest_predictions", prefix), single)


def write_null_odds(df: DataFrame, directory: str, prefix: str | None = None, single: bool = False) -> str:
    """``{id: score_diff}`` objects, one per line."""
    return _write_objects(df, F.col("score_diff"), prefixed(directory, "null_odds", prefix), single)


def write_cleaned(df: DataFrame, directory: str, prefix: str | None = None, single: bool = False) -> str:
    """Predictions after answer clean-up."""
    cleaned = df.withColumn("text", normalize_answer(F.col("text")))
    return _write_objects(cleaned, F.col("text"), prefixed(directory, "processed_predictions", prefix), single)


def _write_objects(df: DataFrame, value: Column, path: str, single: bool) -> str:
    """JSON objects of bounded size, or one object in one file if ``single``."""
    pairs = df.select(F.col("id").cast("string").alias("id"), value.alias("value"))
    if single:
        return _write_one_object(pairs, path)
    parts = F.ceil(pairs.agg(F.count("*")).scalar() / IDS_PER_OBJECT).cast("long")
    part = F.pmod(F.xxhash64("id"), F.greatest(parts, F.lit(1).cast("long")))
    grouped = pairs.groupBy(part.alias("part")).agg(F.map_from_entries(F.collect_list(F.struct("id", "value"))).alias("m"))
    grouped.select(F.to_json("m").alias("value")).write.mode("overwrite").text(path)
    return path


def _write_one_object(pairs: DataFrame, path: str) -> str:
    """One JSON object, on one line, in the only file of a folder; ids are distinct.

    Tasks write their entries, each after a comma. The first entry and both braces
    are files of their own, and the file system puts all of them together, so no task and not
    the driver holds more than an entry.
    """
    entry = F.expr("substring(j, 2, length(j) - 2)")
    entries = materialized(pairs.select("id", F.to_json(F.create_map("id", "value")).alias("j")), "entries")
    first = entries.agg(F.min_by("j", "id").alias("j"), F.min("id").alias("id")).select(entry.alias("line"), "id").first()
    pieces = f"{path.rstrip('/')}.pieces"
    entries.where(F.col("id") != F.lit(first["id"])).select(F.concat(F.lit(","), entry)).write.mode("overwrite").text(pieces, lineSep=" ")
    context = pairs.sparkSession.sparkContext
    jvm, conf = context._jvm, context._jsc.hadoopConfiguration()
    folder, target = jvm.org.apache.hadoop.fs.Path(pieces), jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(conf)
    fs.delete(target, True)
    names = sorted(str(s.getPath().toString()) for s in fs.listStatus(folder) if s.getPath().getName().startswith("part-"))
    out = fs.create(jvm.org.apache.hadoop.fs.Path(target, "part-00000.json"))
    try:
        out.write(bytearray(("{" + (first["line"] or "") + " ").encode()))
        for name in names:
            piece = fs.open(jvm.org.apache.hadoop.fs.Path(name))
            try:
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(piece, out, COPY_BYTES, False)
            finally:
                piece.close()
        out.write(bytearray(b"}\n"))
    finally:
        out.close()
    fs.delete(folder, True)
    return path


def write_rows(df: DataFrame, path: str) -> str:
    """JSON Lines, one row per line: the scale path for any table."""
    df.write.mode("overwrite").json(path)
    return path


def write_csv(df: DataFrame, path: str) -> str:
    """CSV with a header; empty text, nulls and outer spaces come back as they were (see ``read_rows``)."""
    df.write.mode("overwrite").options(**CSV).csv(path)
    return path


def write_qa(df: DataFrame, path: str, split: str | None = None) -> str:
    """Parquet, one directory per split."""
    target = f"{path.rstrip('/')}/{split}" if split else path
    df.write.mode("overwrite").parquet(target)
    return target


def to_reader_input(df: DataFrame) -> DataFrame:
    """``(context, id, question)``, all strings."""
    return df.select(*[F.col(c).cast("string").alias(c) for c in ("context", "id", "question")])
