"""Language identification by words first, then ever shorter character n-grams.

Each word that any language knows scores -log10 of its relative frequency in
each language (a fixed penalty where a language lacks it).  A word that none
knows falls back to its character n-grams, longest first, until some language
knows one.  A text's score for a language is the mean over its words; the least
wins, ties go to the first name.

Learnt from at most DOCS_A_LANGUAGE documents of each language, chosen by a hash
of doc_id among rows that are not held out; all their words and n-grams count,
of which the KEEP most frequent of each language and length stay.

Edge cases: a null text, or one without a letter, is ``und`` with score 0, as is
every text where nothing could be learnt; documents without lang teach nothing;
rows with a null doc_id count as held out and are predicted; very long texts are
read whole, in bounded slices of a batch; an empty table gives an empty one.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import held_out, small_batches, table
from .words import claim, row_sums, slices

DOCS_A_LANGUAGE = 1000
KEEP = 5000
LONGEST = 5
PENALTY = 7.0
#: Words from which on more do not make the score more certain.
SURE_WORDS = 20
#: Words that fell back to n-grams a worker remembers, twice over, and counts a task holds before it passes them on.
CACHE_WORDS, HELD_WORDS = 60_000, 50_000
#: Words are maximal runs of Unicode letters in lower case.
_OTHER = r"[^\p{L}]+"


def letters(column: pa.Array) -> pa.Array:
    """Texts in lower case with a blank for all that is no letter; null stays."""
    return pc.replace_substring_regex(pc.utf8_lower(column.cast(pa.large_string())), _OTHER, " ")


def grams(word: str, n: int) -> list[str]:
    """Character n-grams of a word between blanks; single characters without them."""
    padded = word if n == 1 else f" {word} "
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


@dataclass
class Model:
    langs: list[str]
    #: by length (0: whole words): entry -> -log10 frequency in each language
    known: list[dict[str, np.ndarray]]
    #: rows of words met lately, and of those met before them
    cache: dict[str, np.ndarray] = field(default_factory=dict)
    old: dict[str, np.ndarray] = field(default_factory=dict)

    def __getstate__(self):
        return {"langs": self.langs, "known": self.known, "cache": {}, "old": {}}

    def forget(self) -> None:
        self.cache, self.old = {}, {}

    def known_rows(self, words: list[str]) -> np.ndarray:
        """The scores of words, a row each; worked out once while a worker remembers a word."""
        if len(self.cache) > CACHE_WORDS:
            self.old, self.cache = self.cache, {}
        cache, old, out = self.cache, self.old, np.zeros((len(words), len(self.langs)))
        for i, w in enumerate(words):
            row = cache.get(w)
            if row is None:
                row = self.known[0].get(w)
                if row is None:
                    row = old.get(w)
                    if row is None:
                        row = self.word(w)
                    if len(w) <= 64:
                        cache[w] = row
            out[i] = row
        return out

    def word(self, word: str) -> np.ndarray:
        """Score of a lower-case word for each language."""
        if (found := self.known[0].get(word)) is not None:
            return found
        for n in range(min(LONGEST, len(word) + 2), 0, -1):
            if hits := [s for g in grams(word, n) if (s := self.known[n].get(g)) is not None]:
                return sum(hits) / len(hits)
        return np.full(len(self.langs), PENALTY, dtype=np.float32)

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        claim(f"langid-{id(self)}", self.forget)
        names, sure = [], []
        for t in slices(letters(column)):
            vocab = t.vocab.to_numpy(zero_copy_only=False).tolist()
            sums = row_sums(self.known_rows(vocab)[t.codes], t.bounds) if len(t.codes) else np.zeros((len(t.bounds) - 1, len(self.langs)))
            words = np.diff(t.bounds)
            if not self.langs:
                names += ["und"] * len(words)
                sure.append(np.zeros(len(words)))
                continue
            mean = sums / np.maximum(words, 1)[:, None]
            best = mean.argmin(axis=1)
            odds = np.exp(-math.log(10) * (mean - mean.min(axis=1)[:, None]) * np.minimum(words, SURE_WORDS)[:, None])
            names += [self.langs[b] if w else "und" for b, w in zip(best.tolist(), words.tolist())]
            sure.append(np.where(words > 0, 1 / odds.sum(axis=1), 0.0))
        return names, np.concatenate(sure) if sure else np.zeros(0)


def fit(docs: DataFrame, docs_a_language: int = DOCS_A_LANGUAGE, keep: int = KEEP) -> Model:
    """Learn from text and non-null lang of documents that are not held out."""
    small_batches(docs.sparkSession)
    ids = docs.select("doc_id", "lang").where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    # of n documents the least hashes lie below a share of their range that only the count sets: the window of a
    # language then orders little more than it keeps, however large the language
    sizes = ids.groupBy("lang").agg(F.count("*").alias("n"))
    share = F.lit(docs_a_language + 8 * math.sqrt(docs_a_language)) / F.col("n")
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / F.lit(float(1 << 53))
    by_hash = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    near = ids.withColumn("place", place).join(F.broadcast(sizes), "lang").where(F.col("place") < share)  # a row a language
    some = near.withColumn("k", F.row_number().over(by_hash)).where(F.col("k") <= docs_a_language).select("doc_id").distinct()
    chosen = some.toArrow().column(0).to_pylist()  # at most docs_a_language for each language
    few = docs.sparkSession.createDataFrame([(i,) for i in chosen], f"doc_id {docs.schema['doc_id'].dataType.simpleString()}")

    def count(batches):
        held: dict[str, Counter] = {}

        def out():
            counts: Counter = Counter()
            for lang, words in held.items():
                for w, c in words.items():
                    counts[lang, 0, w] += c
                    for n in range(1, LONGEST + 1):
                        for g in grams(w, n):
                            counts[lang, n, g] += c
            held.clear()
            cols = list(zip(*((lang, n, g, c) for (lang, n, g), c in counts.items()))) or [(), (), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int32(), pa.string(), pa.int64()))], ["lang", "n", "gram", "c"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), letters(batch.column(1)).to_pylist()):
                held.setdefault(lang, Counter()).update((text or "").split())
                if sum(map(len, held.values())) > HELD_WORDS:
                    yield out()
        yield out()

    text = docs.where("lang is not null").select("doc_id", "lang", "text").join(F.broadcast(few), "doc_id").select("lang", "text")
    counts = text.mapInArrow(count, "lang string, n int, gram string, c long").groupBy("lang", "n", "gram").agg(F.sum("c").alias("c"))
    each = Window.partitionBy("lang", "n")
    top = counts.withColumn("total", F.sum("c").over(each)).withColumn("k", F.row_number().over(each.orderBy(F.desc("c"), "gram"))).where(F.col("k") <= keep)
    rows = top.select("lang", "n", "gram", (-F.log10(F.col("c") / F.col("total"))).alias("s")).toArrow()
    langs = sorted(set(rows.column("lang").to_pylist()))
    place = {x: i for i, x in enumerate(langs)}
    known: list[dict] = [{} for _ in range(LONGEST + 1)]
    for batch in rows.to_batches(20_000):
        for lang, n, g, s in zip(*(batch.column(i).to_pylist() for i in range(4))):
            row = known[n].get(g)
            if row is None:
                row = known[n][g] = np.full(len(langs), PENALTY, dtype=np.float32)
            row[place[lang]] = s
    return Model(langs, known)


_models: dict[int, Model] = {}


def _shared(broadcast) -> Model:
    """One model a worker, with what it has cached, for as long as the broadcast is the same."""
    if broadcast.value is not _models.get(0):
        _models[0] = broadcast.value
    return _models[0]


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) of every document."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded: languages * (LONGEST + 1) * KEEP entries

    def each(batches):
        m = _shared(sent)
        for batch in batches:
            names, sure = m.predict(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(sure)], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(each, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of docs whose language is told with a score of least or more, all columns kept."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def each(batches):
        m = _shared(sent)
        for batch in batches:
            names, sure = m.predict(batch.column(at))
            yield batch.filter(pa.array((np.array(names, dtype=object) != "und") & (sure >= least), pa.bool_()))

    return docs.mapInArrow(each, docs.schema)


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = predict(docs, fit(docs.select("doc_id", "lang", "text")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
