"""Token counts by a count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton lists every vocabulary piece that ends at each
character; a pass over the ends carries the best score and its number of pieces
and keeps no path.  Of equal scores the piece that starts first stays; a
character that no piece covers costs the least score less 10, and neighbouring
unknown characters are one piece.  A text's words (between ASCII white space),
each after the word mark, are counted one distinct word once a worker.

Edge cases: a null text, or one without words, has no pieces; null and repeated
doc_ids are counted like any other; very long texts are read whole, in bounded
slices of a batch; an empty table gives an empty one; further columns are ignored.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import small_batches, table
from .words import claim, row_sums, slices

MARK = "▁"
UNKNOWN_COST = 10.0
#: Words that a worker remembers, and characters of a word that is worth it.
CACHE_WORDS, CACHE_CHARS = 300_000, 64


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@lru_cache(maxsize=2)
def vocabulary(path: str) -> tuple[tuple[str, float], ...]:
    """Pieces of a sentencepiece model that stand for text, with scores by Zipf's law of their rank."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [m.id_to_piece(i) for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
    return tuple((p, -math.log(k + 2.0)) for k, p in enumerate(pieces))


class Counter:
    def __init__(self, pieces):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for p, score in pieces:
            self.automaton.add_word(p, (len(p), float(score)))
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_COST
        self.longest = max((len(p) for p, _ in pieces), default=1)
        if len(pieces):
            self.automaton.make_automaton()
        self.cache: dict[str, int] = {}

    def count(self, text: str) -> int:
        """Pieces of the best segmentation of text."""
        # a ring of as many ends as the longest piece has characters: a text without blanks may be very long
        ring = self.longest + 1
        score, pieces, open_unknown = [0.0] * ring, [0] * ring, [False] * ring
        matches = self.automaton.iter(text) if len(self.automaton) else iter(())
        match = next(matches, None)
        for e in range(len(text)):
            best = None
            single = False
            while match is not None and match[0] == e:  # longest first, which is the order of their starts
                length, s = match[1]
                here = s + score[(e + 1 - length) % ring]
                if best is None or here > best:
                    best, start = here, (e + 1 - length) % ring
                single = single or length == 1
                match = next(matches, None)
            unknown = False
            if not single:
                here = self.unknown + score[e % ring]
                if best is None or here > best:
                    best, start, unknown = here, e % ring, True
            at = (e + 1) % ring
            score[at], pieces[at], open_unknown[at] = best, pieces[start] + (not (unknown and open_unknown[start])), unknown
        return pieces[len(text) % ring]

    def words(self, words: list[str]) -> np.ndarray:
        cache = self.cache
        if len(cache) > CACHE_WORDS:
            cache.clear()
        out = list(map(cache.get, words))
        for i, known in enumerate(out):
            if known is None:
                out[i] = self.count(MARK + words[i])
                if len(words[i]) <= CACHE_CHARS:
                    cache[words[i]] = out[i]
        return np.array(out, dtype=np.int64)


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(vocabulary(path))


def count_texts(column: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    claim("counts", counter.cache_clear)
    words, pieces = [], []
    for t in slices(column):
        each = counter(path).words(t.vocab.to_numpy(zero_copy_only=False).tolist())
        words.append(np.diff(t.bounds))
        pieces.append(row_sums(each[t.codes], t.bounds).astype(np.int64) if len(t.codes) else np.zeros(len(t.bounds) - 1, np.int64))
    none = np.zeros(0, np.int64)
    return np.concatenate(words or [none]), np.concatenate(pieces or [none])


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_words, n_tokens) of every document."""
    small_batches(docs.sparkSession)
    path = path or default_path()

    def each(batches):
        for batch in batches:
            words, pieces = count_texts(batch.column(1), path)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words), pa.array(pieces)], ["doc_id", "n_words", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(each, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_tokens long")


def op9_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
