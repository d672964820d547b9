"""Context to answer: windows, scores from a reader, answer texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import normalize_answer
from lectern.operators.prepare import align_answer, chunk_windows, inference_features
from lectern.operators.spans import best_answer, predictions

# A reader takes features and adds ``start_logits`` and ``end_logits``.
Reader = Callable[[DataFrame], DataFrame]


def training_features(examples: DataFrame, max_length: int = 384, stride: int = 128, specials: int = 3) -> DataFrame:
    """Windows with answer positions."""
    return align_answer(chunk_windows(examples, max_length, stride, specials))


def answer_questions(
    contexts: DataFrame, reader: Reader, max_length: int = 384, stride: int = 128, specials: int = 3, clean: bool = True, **options
) -> DataFrame:
    """``(id, text)`` for reader input ``(context, id, question)``."""
    chunks = chunk_windows(contexts, max_length, stride, specials)
    features = reader(inference_features(chunks, max_length))
    answers = best_answer(predictions(contexts, features, **options))
    return answers.withColumn("text", normalize_answer(F.col("text"))) if clean else answers
