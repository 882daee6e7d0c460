"""Token counts by prefix dynamic programming over a byte-level BPE vocabulary.

A text is cut into the vocabulary's pre-tokens; within one, pair_bpe gives the exact token count of
every prefix, and the counts of whole pre-tokens add up. PrefixCounter.prefix_counts() holds the
count of text[:i] for every i, so that "how many tokens has this prefix" and "where does a budget of
n tokens end" are look-ups, without encoding anything again. Counts equal those of the tokenizer
library without added special tokens; a special string inside a text counts as its one token.

Defined results: null and empty texts have 0 tokens and 0 bytes. Repeated rows give repeated rows, an
empty table an empty result; other columns are not read. Very long texts are walked once, with memory
in proportion to that one text.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from math import inf

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .pair_bpe import MEMO, PrefixEncoder

LIMIT = 512
#: The byte-level pre-tokenizer's pattern (fixed by the vocabulary).
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_alphabet() -> dict[str, int]:
    """The printable character by which byte-level vocabularies write each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class PrefixCounter:
    """Exact token counts for a byte-level BPE vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_alphabet()
        raw = lambda s: bytes(letters[c] for c in s)
        ranks: dict[tuple[bytes, bytes], int] = {}
        for k, m in enumerate(spec["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            ranks.setdefault((raw(a), raw(b)), k)
        special = [t["content"] for t in spec["added_tokens"]]
        pieces = [raw(s) for s in spec["model"]["vocab"] if s not in special]
        self.bpe = PrefixEncoder(pieces, lambda a, b: ranks.get((a, b), inf), lambda s: [s[i : i + 1] for i in range(len(s))])
        self.pretoken = regex.compile(PRETOKEN)
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.known: dict[str, int] = {}

    def of_word(self, word: str) -> int:
        n = self.known.get(word)
        if n is None:
            n = self.bpe.counts(word.encode())[-1]
            if len(word) <= 64:
                if len(self.known) > MEMO:
                    self.known.clear()
                self.known[word] = n
        return n

    def _parts(self, text: str) -> Iterator[tuple[int, int, bool]]:
        """Start, end and kind of the stretches between special strings, and of these."""
        at = 0
        for m in self.special.finditer(text) if self.special else ():
            if m.start() > at:
                yield at, m.start(), False
            yield m.start(), m.end(), True
            at = m.end()
        if at < len(text):
            yield at, len(text), False

    def count(self, text: str | None) -> int:
        """Tokens of the whole text: the count of its longest prefix."""
        if not text:
            return 0
        known, total = self.known, 0
        for start, end, special in self._parts(text):
            if special:
                total += 1
                continue
            for word in self.pretoken.findall(text, start, end) if (start, end) == (0, len(text)) else self.pretoken.findall(text[start:end]):
                n = known.get(word)
                total += self.of_word(word) if n is None else n
        return total

    def prefix_counts(self, text: str | None) -> np.ndarray:
        """out[i] is the token count of text[:i], for every i from 0 to len(text)."""
        text = text or ""
        out = np.zeros(len(text) + 1, np.int64)
        begin = 0  # of the ordinary text before
        for start, end, special in self._parts(text):
            if special:
                for k in range(start + 1, end):  # cut short, it is ordinary text
                    out[k] = out[begin] + sum(map(self.of_word, self.pretoken.findall(text[begin:k])))
                out[end] = out[start] + 1
                begin = end
            else:
                out[start : end + 1] = out[start] + self._plain(text[start:end])
                begin = start
        return out

    def _plain(self, text: str) -> np.ndarray:
        """Counts for text without special strings.

        A prefix has the pre-tokens of the whole text up to its last one, and the prefix of a
        pre-token is one, but for two cases: white space at the end of a prefix is one pre-token,
        and a contraction that is cut short is not one.
        """
        out = np.zeros(len(text) + 1, np.int64)
        total, blank = 0, None  # blank: start of the white space that ends here
        for m in self.pretoken.finditer(text):
            start, end = m.span()
            word = m[0]
            first = start
            if word.isspace():
                blank = start if blank is None else blank
                self._by_symbol(out, text, blank, start + 1, end, out[blank])
            else:
                if word[0] == " " and blank is not None:
                    self._by_symbol(out, text, blank, start + 1, start + 1, out[blank])
                    first = start + 1
                if word[0] == "'" and len(word) > 1:
                    for k in range(start + 1, end + 1):
                        out[k] = total + sum(map(self.of_word, self.pretoken.findall(text[start:k])))
                else:
                    self._by_symbol(out, text, start, first + 1, end, total)
                blank = None
            total += self.of_word(word)
        return out

    def _by_symbol(self, out: np.ndarray, text: str, start: int, first: int, last: int, before: int) -> None:
        """out[k] for first <= k <= last, where text[start:k] is one pre-token."""
        counts, size = self.bpe.counts(text[start:last].encode()), 0
        for k in range(start + 1, last + 1):
            size += len(text[k - 1].encode())
            if k >= first:
                out[k] = before + counts[size]

    def truncate(self, text: str | None, budget: int) -> str:
        """The longest prefix with no more than `budget` tokens."""
        text = text or ""
        return text[: int(np.flatnonzero(self.prefix_counts(text) <= budget)[-1])]


_counters: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    """One counter for each vocabulary file in a worker; its memo serves later tasks."""
    if path not in _counters:
        _counters[path] = PrefixCounter(path)
    return _counters[path]


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row; path: a byte-level BPE vocabulary on each machine."""
    key = docs.schema["doc_id"].dataType.simpleString()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for batch in batches:
            texts = batch.column(1)
            n = [c.count(x.as_py()) for x in texts]
            size = [len(x.as_buffer()) if x.is_valid else 0 for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", "text").mapInArrow(counted, f"doc_id {key}, n_bytes bigint, n_tokens bigint, over_limit boolean")


def op6_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
