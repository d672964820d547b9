"""Language identification: words first, shorter and shorter character n-grams for unseen words.

The model holds, per language, log frequencies of words and of character n-grams of
``LONGEST`` to 1 characters. A word of the model adds its log frequency for every language; an
unseen word takes the mean log frequency of its known n-grams of the greatest length that has
any, and nothing if it has none at all. A text's language is the one with the highest sum.

Words are runs of letters, lower-cased. The model is fitted on a bounded sample of labelled
rows (``max_rows``) and keeps every word and n-gram of theirs, so it can be broadcast; all rows
are predicted from their whole text.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; so is every text
if there are no labelled rows, or if no language says anything about any word; ties go to the
first language in order; a null id counts as the empty text in the split.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.bpe import _groups
from lectern.llm.words import mix, powers, range_hashes

LONGEST = 4
UNKNOWN = "und"
FLOOR = 0.5
_tables: dict[str, np.ndarray] = {}


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    if "letters" not in _tables:
        _tables["letters"] = np.fromiter(
            (not 0xD800 <= c < 0xE000 and chr(c).isalpha() for c in range(0x110000)), bool, 0x110000
        )
    return _tables["letters"]


@dataclass
class Letters:
    """Words of several texts: hash, place and text of each."""

    hashes: np.ndarray
    starts: np.ndarray
    stops: np.ndarray
    texts: np.ndarray
    sums: np.ndarray


def letter_words(texts: list[str | None]) -> Letters:
    """Words of all the texts, in order."""
    lowered = [(t or "").lower() for t in texts]
    points = np.frombuffer("\n".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t) + 1 for t in lowered])
    solid = letters()[points]
    edge = np.diff(np.concatenate([[0], solid.astype(np.int8), [0]]))
    starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, _ = powers(len(points) + 1)
    sums = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(mix(points.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    return Letters(range_hashes(sums, starts, stops), starts, stops, np.searchsorted(ends, starts, "right"), sums)


def grams(words: Letters, which: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``(index into which, hash)`` of the ``n``-grams of some words; word ends are marked."""
    starts, stops = words.starts[which], words.stops[which]
    counts = np.maximum(stops - starts - n + 1, 0)
    owner = np.repeat(np.arange(len(which)), counts)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    first = starts[owner] + place
    edges = (place == 0).astype(np.uint64) + np.uint64(2) * (place + 1 == counts[owner]).astype(np.uint64)
    return owner, mix(range_hashes(words.sums, first, first + n) + edges)


@dataclass
class Model:
    """Languages; for each length (0: words) sorted keys and their log frequencies."""

    languages: list[str]
    keys: dict[int, np.ndarray]
    logs: dict[int, np.ndarray]

    def _known(self, n: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = self.keys[n]
        if not len(keys):
            return np.zeros(len(hashes), bool), np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        return keys[at] == hashes, at

    def word_scores(self, words: Letters, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log scores by language of some words, and which of them have any."""
        out = np.zeros((len(which), len(self.languages)))
        known, at = self._known(0, words.hashes[which])
        out[known] = self.logs[0][at[known]]
        todo = np.flatnonzero(~known)
        for n in range(LONGEST, 0, -1):
            if not len(todo):
                break
            owner, hashes = grams(words, which[todo], n)
            seen, at = self._known(n, hashes)
            owner, at = owner[seen], at[seen]
            hits = np.bincount(owner, minlength=len(todo))
            found = hits > 0
            for k in range(len(self.languages)):
                sums = np.bincount(owner, self.logs[n][at, k], len(todo))
                out[todo[found], k] = sums[found] / hits[found]
            known[todo[found]] = True
            todo = todo[~found]
        return out, known

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and posterior (equal priors) of each text."""
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        words = letter_words(texts)
        _, which, back = np.unique(words.hashes, return_index=True, return_inverse=True)
        scores, known = self.word_scores(words, which)
        told = np.bincount(words.texts, known[back], len(texts)) > 0
        totals = np.stack(
            [np.bincount(words.texts, scores[back, k], len(texts)) for k in range(len(self.languages))], axis=1
        )
        best = totals.argmax(axis=1)
        odds = np.exp(totals - totals.max(axis=1, keepdims=True))
        posterior = 1.0 / odds.sum(axis=1)
        names = [self.languages[b] if ok else UNKNOWN for b, ok in zip(best, told, strict=True)]
        return names, np.where(told, posterior, 0.0)


def _sample(labelled: DataFrame, max_rows: int) -> DataFrame:
    """At most ``max_rows`` rows: those with the smallest hash of their id, found without their texts."""
    order = F.xxhash64(F.col("_id"))
    ids = labelled.select(order.alias("_h")).orderBy("_h").limit(max_rows)
    cut = ids.agg(F.max("_h")).first()[0]
    return labelled.where(order <= F.lit(cut)) if cut is not None else labelled.limit(0)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, langs = batch.column("_text").to_pylist(), batch.column("_lang").to_pylist()
        at = 0
        for group in _groups(texts):
            own = np.array(langs[at : at + len(group)], dtype=object)
            at += len(group)
            words = letter_words(group)
            for lang in sorted(set(own)):
                mine = np.flatnonzero((own == lang)[words.texts])
                for n in range(LONGEST + 1):
                    hashes = words.hashes[mine] if n == 0 else grams(words, mine, n)[1]
                    keys, times = np.unique(hashes, return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([lang] * len(keys), pa.string()),
                            pa.array(np.full(len(keys), n, np.int32)),
                            pa.array(keys.view(np.int64)),
                            pa.array(times.astype(np.int64)),
                        ],
                        names=["lang", "n", "key", "times"],
                    )


def fit(
    labelled: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    max_rows: int = 20_000,
) -> Model:
    """Fit on labelled rows; rows with a null text or language are left out."""
    rows = labelled.select(F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{text}`").alias("_text"), F.col(f"`{lang}`").alias("_lang"))
    rows = _sample(rows.where("_text is not null and _lang is not null"), max_rows)
    counts = rows.mapInArrow(_counts, "lang string, n int, key long, times long").groupBy("lang", "n", "key").agg(
        F.sum("times").alias("times")
    )
    table = counts.select("lang", "n", "key", "times").toArrow().to_pandas()
    languages = sorted(table["lang"].unique())
    keys, logs = {}, {}
    for n in range(LONGEST + 1):
        own = table[table["n"] == n]
        keys[n] = np.unique(own["key"].to_numpy(np.int64).view(np.uint64))
        held = np.full((len(keys[n]), len(languages)), FLOOR)
        for k, name in enumerate(languages):
            mine = own[own["lang"] == name]
            held[np.searchsorted(keys[n], mine["key"].to_numpy(np.int64).view(np.uint64)), k] += mine["times"].to_numpy()
        logs[n] = np.log(held / held.sum(axis=0)) if len(held) else held
    return Model(languages, keys, logs)


def predict(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default all but the new ones), ``lang_pred`` and ``score``."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score")]
    rows = docs.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text}`").alias("_in"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = [], [np.empty(0)]
            for group in _groups(x.as_py() for x in batch.column(batch.num_columns - 1)):
                some, values = shared.value.predict(group)
                names.extend(some)
                scores.append(values)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(names, pa.string()), pa.array(np.concatenate(scores))],
                names=[*batch.schema.names[:-1], "lang_pred", "score"],
            )

    return rows.mapInArrow(run, ", ".join([*fields, "lang_pred string", "score double"]))
