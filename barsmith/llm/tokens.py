"""Ids of whole texts by the tokenizers library, one call a distinct word.

The tokenizer's pre-tokenizer never joins anything across white space, so a
text's ids are those of its space- or newline-separated chunks in order.  Arrow
makes ASCII letters small, parts words from the marks after them, splits and
dictionary-encodes a batch; each chunk that this worker has not met goes through
the library once, and Arrow gathers the ids.
"""

from __future__ import annotations

import gc
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .words import claim

#: Remembered chunks a worker holds: up to so many new ones beside the last so many old ones; longer chunks are not remembered.
CACHE_CHUNKS, CHUNK_CHARS = 120_000, 64
#: Characters of text that are gathered at once.
SLICE_CHARS = 1 << 20
#: Words that share one call of the library.
JOINED = 200
#: A letter or digit that stays one through normalising, and what ends a clause after it: the pre-tokenizer parts them in any case.
_CLAUSE = "([0-9A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f])([.,!?;:])"
#: Texts whose capitals say something: of a special token, or below a mark that only the small letter joins.
_CASED = "<\\||[\u0300-\u036f]"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class ChunkEncoder:
    """ids(chunk) for chunks without spaces or newlines, through a bounded cache."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # small ASCII letters are what normalising makes of them, and one word: the same model takes them as they are
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.cache: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}
        n = self.tokenizer.get_vocab_size()
        last = [self.tokenizer.id_to_token(i) or "" for i in range(n)]
        self.ends_word = np.array([t.endswith("</w>") for t in last])
        gc.freeze()  # what is loaded by now stays, and is not gone through for cycles again

    def _joined(self, tokenizer, words: list[str], into: dict[str, bytes]) -> None:
        """Encode words of letters alone.  Each is one word, and a word's last id says that it is
        the last, so many share one call; where that does not come out even, none of the call is taken."""
        for lo in range(0, len(words), JOINED):
            some = words[lo : lo + JOINED]
            ids = np.array(tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) == len(some):
                raw, start = ids.tobytes(), 0
                for word, end in zip(some, (4 * ends).tolist()):
                    into[word] = raw[start:end]
                    start = end

    def _learn(self, chunks: list[str]) -> dict[str, bytes]:
        """Ids of new chunks: letters in joint calls, the others by themselves."""
        found: dict[str, bytes] = {}
        letters = [c for c in chunks if c.isalpha()]
        plain = [c for c in letters if c.isascii() and c.islower()]
        self._joined(self.bare, plain, found)
        self._joined(self.tokenizer, [c for c in letters if c not in found], found)
        rest = [c for c in chunks if c not in found]
        for c, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)):
            found[c] = np.array(e.ids, dtype="<u4").tobytes()
        return found

    def ids(self, chunks: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each chunk.

        The collector of cycles stands still meanwhile: there are none here, and it would go through all chunks again and again."""
        collects = gc.isenabled()
        gc.disable()
        try:
            return self._ids(chunks)
        finally:
            if collects:
                gc.enable()

    def _ids(self, chunks: list[str]) -> list[bytes]:
        if len(self.cache) > CACHE_CHUNKS:
            self.old, self.cache = self.cache, {"": b""}
        cache, old = self.cache, self.old
        out = list(map(cache.get, chunks))
        missing = [i for i, known in enumerate(out) if known is None]
        new: dict[str, None] = {}
        for i in missing:
            c = chunks[i]
            if (known := old.get(c)) is not None:
                out[i] = cache[c] = known
            else:
                new[c] = None
        if new:
            found = self._learn(list(new))
            for i in missing:
                if out[i] is None:
                    out[i] = found[chunks[i]]
            cache.update((c, known) for c, known in found.items() if len(c) <= CHUNK_CHARS)
        return out


@lru_cache(maxsize=4)
def encoder(path: str) -> ChunkEncoder:
    return ChunkEncoder(path)


def vocabulary_size(path: str) -> int:
    return len(encoder(path).ends_word)


def _slices(sizes: np.ndarray):
    """Runs of rows with about SLICE_CHARS bytes each."""
    ends = np.cumsum(sizes)
    lo = 0
    while lo < len(sizes):
        before = ends[lo - 1] if lo else 0
        hi = int(np.searchsorted(ends, before + SLICE_CHARS, side="right"))
        hi = max(hi, lo + 1)
        yield lo, hi
        lo = hi


def _apart(texts: pa.Array) -> pa.Array:
    """The texts with ASCII capitals made small and a space between words and marks after them: the same ids from fewer distinct chunks."""
    small = pc.if_else(pc.match_substring_regex(texts, _CASED), texts, pc.ascii_lower(texts))
    return pc.replace_substring(pc.replace_substring_regex(small, _CLAUSE, "\\1 \\2"), "\n", " ")


def encode_texts(texts: pa.Array, path: str, end_id: int | None = None):
    """Yield (first row, ids u4, bounds) for runs of rows: row i of a run has ids[bounds[i]:bounds[i + 1]].

    Null texts count as empty; end_id, if given, follows each row's own ids."""
    claim("tokens", encoder.cache_clear)
    enc = encoder(path)
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    for lo, hi in _slices(sizes):
        lists = pc.split_pattern(_apart(texts.slice(lo, hi - lo)), " ")
        words = lists.flatten().dictionary_encode()
        counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        codes = words.indices.to_numpy()
        parts = enc.ids(words.dictionary.to_numpy(zero_copy_only=False).tolist())
        if end_id is not None:  # one more chunk at each row's end
            parts.append(np.array([end_id], dtype="<u4").tobytes())
            codes = np.insert(codes, np.cumsum(counts), len(parts) - 1)
            counts = counts + 1
        flat = pa.array(parts, pa.large_binary()).take(pa.array(codes))
        ends = np.frombuffer(flat.buffers()[1], dtype=np.int64, count=len(codes) + 1) // 4
        ids = np.frombuffer(flat.buffers()[2] or b"", dtype="<u4", count=int(ends[-1]))
        yield lo, ids, ends[np.concatenate([[0], np.cumsum(counts)])]
