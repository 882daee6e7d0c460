"""Language identification as inference of a mixture of languages.

A model holds, for each language seen in training, the smoothed likelihood of every byte n-gram, the
n-grams being hashed into a fixed number of cells. A document is a bag of n-grams drawn from a mixture
of languages, with two separators before and behind its text, so that a single letter has n-grams too.
Expectation-maximisation estimates the mixture's proportions; starting from all languages, the least is
dropped for as long as that raises the log likelihood less a penalty of half the logarithm of the
document's n-grams for each language beyond the first. The language with the largest proportion in the
set that is left is the prediction, and its proportion the score.

EM runs until the likelihood, which is concave in the proportions, can't rise by more than TOLERANCE, by the
bound that its gradient gives, or has stopped rising. Documents leave it as they get there, or as soon as
the bound shows that no mixture beats the best single language by the penalty of a second one.

n-gram counts cover every training document and become one vector of likelihoods for each language before
they reach the driver. The vectors have CELLS cells, or fewer where there are so many languages that all of them
would exceed MODEL_CELLS: the model, which is broadcast, has at most MODEL_CELLS numbers and every
language is learned, with coarser cells.

Defined results: a null text, or one without a letter, is `und` with score 0. With no training rows
every text is `und`. Ties go to the language whose name sorts first. Very long texts are bags like any
other. Repeated rows give repeated rows; empty tables give an empty result; columns other than doc_id, text
and, for training, lang are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .slabs import mix, slabs

GRAM = 4
CELLS = 1 << 16
#: Numbers in a model, of four bytes each.
MODEL_CELLS = 1 << 25
#: Log likelihood that EM may leave; rounds between looks at it; a rise over these that counts as none.
TOLERANCE, EVERY, STALLED = 0.02, 4, 1e-5
_SLAB, _PAD = 1 << 20, 2
#: Languages x n-grams that are worked on at once, if a single document hasn't more.
_AT_ONCE = 1 << 22

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[:65] = _FOLD[91:97] = _FOLD[123:128] = 32  # digits, white space and punctuation are one separator


def gram_cells(data: np.ndarray, offsets: np.ndarray, n: int = GRAM, cells: int = CELLS) -> tuple[np.ndarray, np.ndarray]:
    """Cell of each n-gram of letters and separators, and its row; grams don't cross rows."""
    rows = len(offsets) - 1
    size = np.diff(offsets) + 2 * _PAD
    end = np.cumsum(size)
    folded = np.full(int(size.sum()), 32, np.uint64)
    folded[np.arange(len(data)) + np.repeat(_PAD * (2 * np.arange(rows) + 1), np.diff(offsets))] = _FOLD[data]
    many = max(0, len(folded) - n + 1)
    code = np.zeros(many, np.uint64)
    blank = np.ones(many, bool)
    for k in range(n):
        x = folded[k : k + many]
        code = code << np.uint64(8) | x
        blank &= x == 32
    row = np.repeat(np.arange(rows), size)[:many]
    keep = ~blank & (np.arange(many) + n <= end[row])
    return (mix(code[keep]) % np.uint64(cells)).astype(np.int64), row[keep]


@dataclass
class LanguageModel:
    names: list[str]
    log_likelihood: np.ndarray  # cells x languages


def cells_for(languages: int) -> int:
    """CELLS, or the largest power of two with which so many languages have at most MODEL_CELLS cells."""
    return min(CELLS, 1 << max(0, (MODEL_CELLS // max(1, languages)).bit_length() - 1))


def train(docs: DataFrame, cells: int | None = None, smoothing: float = 0.5) -> LanguageModel:
    """Model of the rows of docs (text, lang) whose lang is not null."""
    known = docs.where("lang is not null").select("text", "lang")
    cells = cells or cells_for(known.select("lang").distinct().count())

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part, data, offsets in slabs(batch, limit=_SLAB):
                lang = part.column(1).dictionary_encode()
                cell, row = gram_cells(data, offsets, cells=cells)
                key, n = np.unique(lang.indices.to_numpy(zero_copy_only=False).astype(np.int64)[row] * cells + cell, return_counts=True)
                names = lang.dictionary.to_pylist()
                cuts = np.searchsorted(key, np.arange(len(names) + 1) * cells)
                for k, name in enumerate(names):
                    if name not in sums:
                        sums[name] = np.zeros(cells, np.int64)
                    own = slice(cuts[k], cuts[k + 1])
                    sums[name][key[own] - k * cells] += n[own]
        for name, n in sums.items():
            at = np.flatnonzero(n)
            at = at if len(at) else np.zeros(1, np.int64)  # a language without n-grams is still known
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(n[at])], names=["lang", "cell", "n"])

    def vector(table: pa.Table) -> pa.Table:
        n = np.full(cells, smoothing)
        n[table.column("cell").to_numpy()] += table.column("n").to_numpy()
        return pa.table({"lang": table.column("lang")[:1], "v": pa.array([np.log(n / n.sum()).astype("<f4").tobytes()], pa.binary())})

    sums = known.mapInArrow(counted, "lang string, cell bigint, n bigint").groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    rows = sorted(sums.groupBy("lang").applyInArrow(vector, "lang string, v binary").collect(), key=lambda r: r.lang)
    vectors = [np.frombuffer(r.v, "<f4") for r in rows]
    return LanguageModel([r.lang for r in rows], np.stack(vectors, 1) if rows else np.zeros((cells, 0), np.float32))


@dataclass
class Bags:
    """n-grams of some documents: likelihoods (languages x n-grams) over the largest of each, weights, and each one's document."""

    p: np.ndarray
    weight: np.ndarray
    of: np.ndarray

    def __post_init__(self):
        self.first = np.flatnonzero(np.diff(self.of, prepend=-1))
        self.total = np.add.reduceat(self.weight, self.first)

    def sum(self, x: np.ndarray) -> np.ndarray:
        return np.add.reduceat(x, self.first, axis=-1)

    def pick(self, docs: np.ndarray, kind: type | None = None) -> Bags:
        """Those of some documents, in order."""
        keep = np.zeros(len(self.first), bool)
        keep[docs] = True
        at = np.flatnonzero(keep[self.of])
        p = self.p[:, at]
        return Bags(p.astype(kind) if kind else p, self.weight[at].astype(kind) if kind else self.weight[at], (np.cumsum(keep) - 1)[self.of[at]])

    def round(self, share: np.ndarray) -> np.ndarray:
        """One round of EM."""
        spread = share[:, self.of]
        spread *= self.p
        spread *= self.weight / np.maximum(spread.sum(0), 1e-30)
        return self.sum(spread) / self.total

    def standing(self, share: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log likelihood, and by how much it may still rise."""
        mean = np.maximum((share[:, self.of] * self.p).sum(0), 1e-30)
        gain = (self.sum(self.p * (self.weight / mean)) / self.total * live).max(0)
        return self.sum(self.weight * np.log(mean)), self.total * np.log(np.maximum(gain, 1))


def fit(bags: Bags, share: np.ndarray, live: np.ndarray, enough: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Proportions of the live languages by EM from `share`, their log likelihood, and whether it can't reach `enough`."""
    docs = share.shape[1]
    share, ll, short = share.copy(), np.zeros(docs), np.zeros(docs, bool)
    going, now, before = np.arange(docs), share, np.full(docs, -np.inf)
    while len(going):
        for _ in range(EVERY):
            now = bags.round(now)
        value, rise = bags.standing(now, live[:, going])
        below = value + rise <= enough[going]
        done = below | (rise <= TOLERANCE) | (value - before <= STALLED)
        ended = going[done]
        share[:, ended], ll[ended], short[ended] = now[:, done], value[done], below[done]
        left = np.flatnonzero(~done)
        bags, now, before, going = bags.pick(left) if len(ended) else bags, now[:, left], value[left], going[left]
    return share, ll, short


def mixtures(model: LanguageModel, cell: np.ndarray, row: np.ndarray, n_rows: int) -> np.ndarray:
    """Proportions (rows x languages) of the selected languages; a row without n-grams gets zeros."""
    k = len(model.names)
    out = np.zeros((n_rows, k))
    if not k or not len(cell):
        return out
    cells = len(model.log_likelihood)
    key, weight = np.unique(row * cells + cell, return_counts=True)
    row, cell = key // cells, key % cells
    first = np.flatnonzero(np.diff(row, prepend=-1))
    ends = np.append(first[1:], len(row))
    done = 0
    while done < len(first):  # some documents at a time, bounded by languages x n-grams
        until = max(done + 1, int(np.searchsorted(ends, first[done] + _AT_ONCE // k, "right")))
        a, b = first[done], ends[until - 1]
        rows = row[first[done:until]]
        log_p = model.log_likelihood[cell[a:b]].T
        log_p = log_p - log_p.max(0)
        bags = Bags(np.exp(log_p), weight[a:b].astype(np.float32), np.searchsorted(rows, row[a:b]))
        out[rows] = _select(bags, bags.sum(bags.weight * log_p)).T
        done = until
    return out


def _select(bags: Bags, alone: np.ndarray) -> np.ndarray:
    """Proportions (languages x documents) of the languages that the penalty leaves; alone: log likelihoods of single ones."""
    k, docs = alone.shape
    penalty = 0.5 * np.log(bags.total + 1)
    live = np.ones((k, docs), bool)
    share = np.full((k, docs), 1 / k, np.float32)
    # where no mixture beats the best single language by the penalty of a second one, that is the set
    share, ll, single = fit(bags, share, live, alone.max(0) + penalty if k > 1 else np.full(docs, np.inf))
    going = np.flatnonzero(~single)
    share = share.astype(np.float64)
    share[:, single] = np.arange(k)[:, None] == alone[:, single].argmax(0)
    if not len(going):
        return share
    exact = bags.pick(going, np.float64)
    share[:, going], ll[going], _ = fit(exact, share[:, going], live[:, going], np.full(len(going), -np.inf))
    tries = np.zeros(docs, np.int64)  # of the live languages from the least on, how many are needed
    while len(going):
        fewer = live[:, going].copy()
        masked = np.where(fewer, share[:, going], np.inf)
        least = np.argsort(masked[::-1], axis=0, kind="stable")[tries[going], np.arange(len(going))]
        fewer[k - 1 - least, np.arange(len(going))] = False
        start = (0.9 * share[:, going] + 0.1 / k) * fewer
        new_share, new_ll, less = fit(exact, start / start.sum(0), fewer, ll[going] - penalty[going])
        moved = going[~less]
        live[:, moved], share[:, moved], ll[moved] = fewer[:, ~less], new_share[:, ~less], new_ll[~less]
        tries[going] = np.where(less, tries[going] + 1, 0)
        many = live[:, going].sum(0)
        on = np.flatnonzero((many > 1) & (tries[going] < many))
        exact, going = exact.pick(on), going[on]
    return share


def _has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def identify(docs: DataFrame, model: LanguageModel, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns with lang_pred, score and n_langs (languages in the selected set)."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    kept = ", ".join(f"k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        for batch in batches:
            for part, data, offsets in slabs(batch, limit=_SLAB):
                cell, row = gram_cells(data, offsets, cells=len(m.log_likelihood))
                share = mixtures(m, cell, row, part.num_rows)
                ok = np.array([_has_letter(t) for t in part.column(part.num_columns - 1).to_pylist()], bool) & bool(m.names)
                best = share.argmax(1) if m.names else np.zeros(part.num_rows, int)
                score = np.where(ok, np.clip(share.max(1), 0, 1), 0.0) if m.names else np.zeros(part.num_rows)
                pred = [m.names[b] if o else "und" for b, o in zip(best, ok, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array((share > 0.005).sum(1), pa.int64())], names=[*part.schema.names[:-1], "lang_pred", "score", "n_langs"])

    found = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], "text").mapInArrow(named, f"{kept}, lang_pred string, score double, n_langs bigint")
    return found.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "lang_pred", "score", "n_langs")


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves this remainder; a null id is never held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus)) == remainder, F.lit(False))


def op1_language_mixture(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fold = held_out(F.col("doc_id"), 4, 2)
    found = identify(docs, train(docs.where(~fold)))
    return found.select("doc_id", fold.alias("held_out"), "lang_pred", "score", "n_langs")
