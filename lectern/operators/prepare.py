"""Reader and encoder training data: windows, answer positions, hard negatives, packing, masking, batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.arrays import let, rows_of
from lectern.functions.text import SpanTokenizer, Tokenizer, compact_key, hash32, is_blank, space_spans, space_tokens, token_ids
from lectern.operators.ranking import with_hashed_position, with_position
from lectern.operators.sparse import Bm25Index, bm25_top_n
from lectern.session import materialized

# Label of tokens that are not predicted, filler for missing negatives.
IGNORED_LABEL = -100
NO_PASSAGE = "None"


def hard_negatives(
    examples: DataFrame, corpus: DataFrame, index: Bm25Index, k: int = 4, keep: int = 3, tokenizer: Tokenizer = space_tokens
) -> DataFrame:
    """Best-scored passages for each gold passage ``(id, context)``, the gold passage itself left out.

    Returns ``passage_top1 .. passage_top<keep>``, filled with ``"None"``. Examples that share a
    passage share its search.
    """
    passages = examples.groupBy("context").agg(F.min("id").alias("qid"))
    queries = materialized(passages.select("qid", F.col("context").alias("question")), "passages")
    hits = bm25_top_n(queries, index, corpus, k, tokenizer=tokenizer)
    other = hits.join(queries, "qid").where(compact_key(F.col("text")) != compact_key(F.col("question")))
    place = F.row_number().over(Window.partitionBy("qid").orderBy("rank"))
    kept = other.withColumn("place", place).where(F.col("place") <= keep)
    columns = [F.max(F.when(F.col("place") == i, F.col("text"))).alias(f"passage_top{i}") for i in range(1, keep + 1)]
    wide = kept.groupBy("qid").agg(*columns)
    filled = [F.coalesce(f"passage_top{i}", F.lit(NO_PASSAGE)).alias(f"passage_top{i}") for i in range(1, keep + 1)]
    same = examples.select("id", "context").join(queries, F.col("context").eqNullSafe(F.col("question"))).select("id", "qid")
    return same.join(wide, "qid", "left").select("id", *filled)


def _room(max_length: int, specials: int, tokenizer: SpanTokenizer) -> Column:
    """Context tokens that fit beside the question, whose tokens are only counted."""
    return F.lit(max_length - specials) - F.size(getattr(tokenizer, "tokens", tokenizer)(F.col("question")))


def too_long(
    examples: DataFrame, max_length: int = 384, stride: int = 128, specials: int = 3, tokenizer: SpanTokenizer = space_spans
) -> DataFrame:
    """Examples whose question leaves no room for a window; ``chunk_windows`` leaves them out."""
    return examples.where(_room(max_length, specials, tokenizer) <= stride)


def chunk_windows(
    examples: DataFrame, max_length: int = 384, stride: int = 128, specials: int = 3, tokenizer: SpanTokenizer = space_spans
) -> DataFrame:
    """Overlapping context windows that fit the question and the special tokens.

    ``examples(id, question, context[, answers])`` becomes one row per window with the
    context tokens and their character offsets, as the tokenizer gives them; neighbouring
    windows share ``stride`` tokens and the question is never cut (see ``too_long``).
    Windows are sliced before they become rows, so a long text is not copied once per window.
    """

    def windows(tokens: Column, offsets: Column, room: Column) -> Column:
        step = room - stride
        last = F.greatest(F.lit(0), F.ceil((F.size(tokens) - room) / step).cast("int"))

        def cut(c: Column) -> Column:
            own = lambda values, name: F.slice(values, c * step + 1, room).alias(name)
            return F.struct(c.cast("long").alias("chunk"), (c * step).cast("long").alias("token_start"), own(tokens, "tokens"), own(offsets, "offsets"))

        return F.transform(F.sequence(F.lit(0), last), cut)

    # columns of their own, since a tokenizer in Python cannot stand inside a lambda
    room, kept = F.col("_room"), ["id"] + (["answers"] if "answers" in examples.columns else [])
    fitting = examples.select(*kept, _room(max_length, specials, tokenizer).alias("_room"), tokenizer(F.col("context")).alias("_spans"))
    tokens = F.transform("_spans", lambda x: x["token"])
    offsets = F.transform("_spans", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))
    # no filter on the room: it would go below the other columns and have the question tokenized twice
    cut_up = F.when(room > stride, let(tokens, lambda t: let(offsets, lambda o: let(room, lambda r: windows(t, o, r)))))
    context_start = (F.lit(max_length - 1) - room).cast("long").alias("context_start")
    return rows_of(fitting, [*kept, context_start], cut_up, "w").select(*kept, "context_start", "w.*")


def align_answer(chunks: DataFrame) -> DataFrame:
    """Add ``start_position`` / ``end_position``: the answer's token positions within the window.

    Position 0 (the class token) marks windows that do not hold the whole answer.
    """
    offsets = F.col("offsets")
    begin = F.get("answers.answer_start", F.lit(0))
    end = begin + F.length(F.get("answers.text", F.lit(0)))
    inside = (
        (F.size("answers.answer_start") > 0)
        & (F.size(offsets) > 0)
        & (F.get(offsets, F.lit(0))["s"] <= begin)
        & (F.try_element_at(offsets, F.lit(-1))["e"] >= end)
    )
    first = F.size(F.filter(offsets, lambda o: o["s"] <= begin)) - 1
    last = F.size(F.filter(offsets, lambda o: o["e"] < end))
    position = lambda i: F.when(inside, F.col("context_start") + i).otherwise(0).cast("long")
    return chunks.withColumn("start_position", position(first)).withColumn("end_position", position(last))


def inference_features(chunks: DataFrame, max_length: int = 384) -> DataFrame:
    """``(id, chunk, offset_mapping)`` of full length, null outside the context."""
    nothing = F.lit(None).cast("struct<s:int,e:int>")
    before = F.col("context_start").cast("int")
    after = F.lit(max_length) - before - F.size("offsets")
    mapping = F.concat(F.array_repeat(nothing, before), F.col("offsets"), F.array_repeat(nothing, after))
    return chunks.select("id", "chunk", mapping.alias("offset_mapping"))


def mlm_lines(df: DataFrame, max_len: int = 512, text: str = "text", tokenizer: Tokenizer = space_tokens) -> DataFrame:
    """One token sequence per non-blank line, truncated to the model length."""
    lines = df.where(~is_blank(F.col(text)))
    return lines.withColumn("tokens", F.slice(tokenizer(F.col(text)), 1, max_len))


def pack_blocks(
    df: DataFrame, block: int = 512, batch: int = 1000, key: str = "doc_id", text: str = "text", tokenizer: Tokenizer = space_tokens
) -> DataFrame:
    """Concatenate the tokens of every ``batch`` rows and cut them into equal blocks.

    ``(batch, block_id, tokens)``; the remainder of a batch is dropped unless the whole
    batch is shorter than one block. Rows are cut into block pieces before the shuffle,
    so a group holds exactly one block.
    """
    rows = with_position(df.select(key, text), key)
    sized = rows.select(
        F.floor(F.col("position") / batch).cast("long").alias("batch"), "position", tokenizer(F.col(text)).alias("tokens")
    ).withColumn("n", F.size("tokens").cast("long"))
    in_batch = Window.partitionBy("batch")
    before = in_batch.orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.select(
        "batch", "tokens", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"), F.sum("n").over(in_batch).alias("total")
    ).where(F.col("n") > 0)

    first = F.floor(F.col("start") / block)
    last = F.floor((F.col("start") + F.col("n") - 1) / block)

    def piece(b: Column) -> Column:
        begin = F.greatest(b * block - F.col("start"), F.lit(0))
        stop = F.least((b + 1) * block - F.col("start"), F.col("n"))
        cut = F.slice("tokens", (begin + 1).cast("int"), (stop - begin).cast("int"))
        return F.struct(b.cast("long").alias("block_id"), (F.col("start") + begin).alias("at"), cut.alias("part"))

    pieces = rows_of(placed, ["batch", "total"], F.transform(F.sequence(first, last), piece), "p").select(
        "batch", "total", "p.*"
    )
    whole = (F.col("block_id") < F.floor(F.col("total") / block)) | (F.col("total") < block)
    parts = F.sort_array(F.collect_list(F.struct("at", "part")))
    return (
        pieces.where(whole)
        .groupBy("batch", "block_id")
        .agg(F.flatten(F.transform(parts, lambda x: x["part"])).alias("tokens"))
    )


def mask_tokens(
    df: DataFrame, key: str = "doc_id", ids: str = "input_ids", p: float = 0.15, mask_id: int = 4, vocab_size: int = 32000, seed: int = 42
) -> DataFrame:
    """Masked-token training pairs: ``input_ids`` after masking and ``labels``.

    A hash of (key, position, seed) takes the place of a random stream, so a task that
    runs again makes the same choice: 80% mask, 10% random token, 10% unchanged.
    """
    limit = int(p * (1 << 32))

    def draw(token: Column, i: Column) -> Column:
        digest = F.md5(F.concat_ws(":", F.col(key).cast("string"), i.cast("string"), F.lit(str(seed))))

        def choose(h: Column) -> Column:
            number = lambda at: F.conv(F.substring(h, at, 8), 16, 10).cast("long")
            chosen = number(1) < limit
            action = number(9) % 10
            replaced = F.when(action < 8, mask_id).when(action == 8, (number(17) % vocab_size).cast("int")).otherwise(token)
            return F.struct(
                F.when(chosen, replaced).otherwise(token).alias("input_id"),
                F.when(chosen, token).otherwise(IGNORED_LABEL).alias("label"),
            )

        return let(digest, choose)

    drawn = df.withColumn("_drawn", F.transform(ids, draw))
    return (
        drawn.withColumn(ids, F.transform("_drawn", lambda x: x["input_id"]))
        .withColumn("labels", F.transform("_drawn", lambda x: x["label"]))
        .drop("_drawn")
    )


def hashed_ids(df: DataFrame, text: str = "text", tokenizer: Tokenizer = space_tokens, vocab_size: int = 32000) -> DataFrame:
    """Add ``input_ids`` of a text."""
    return df.withColumn("input_ids", token_ids(tokenizer(F.col(text)), vocab_size))


def training_batches(df: DataFrame, size: int, drop_last: bool = True, key: str = "id", seed: int = 42) -> DataFrame:
    """Add a ``batch`` number: repeatable shuffle, then groups of ``size`` rows."""
    order = hash32(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))
    batched = with_hashed_position(df, order, key).withColumn("batch", F.floor(F.col("position") / size).cast("long"))
    if drop_last:
        whole = df.agg(F.floor(F.count("*") / size)).scalar()
        batched = batched.where(F.col("batch") < whole)
    return batched
