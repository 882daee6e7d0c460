"""Toxic spans and document scores by a linear-chain conditional random field.

Words carry features (whole word, byte prefixes and suffixes, hashed). From a bounded sample of SAMPLE
labelled rows, features that stand in toxic documents far more often than in clean ones are candidates;
a greedy cover keeps those that explain toxic documents not explained yet, so that what copies of one
document share by chance is left out. A word that has a kept feature in a toxic training document is a
token labelled toxic, every other token is clean, and the field's emission and transition weights are
fitted to these labelled tokens by gradient ascent.

Scoring is an exact forward-backward pass over each whole text. Tokens without any kept feature share
one transfer matrix, so that a run of g of them is its g-th power in closed form; only the others are
walked. Their marginals give the offending offsets, and the largest and the sum of them, through a
logistic curve fitted on the sample, the document's score.

Defined results: null and empty texts, and texts of no words, have no spans and the score of a document
without evidence. Without labels of both kinds every score is 0. Labels other than 0 and 1 and null
labels are left out; repeated labels of a document count each. Repeated rows give repeated rows; empty
tables give an empty result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .language_mixture import held_out
from .slabs import mix, prefix_hash, range_hash, slabs, words

#: Labelled rows for training: those with the smallest hash of their ids.
SAMPLE = 8000
CANDIDATES = 4000
#: Features by kind: 0 is the whole word, else the number of bytes of a prefix, or below zero of a suffix.
KINDS = (0, 4, 5, 6, -4, -6)
#: Upper ends of the log odds that share an emission weight.
BINS = (2.0, 3.0, 4.0, 5.0, 6.0)
#: 0 is a word without a kept feature.
N_BINS = len(BINS) + 2
THRESHOLD = 0.7
#: A toxic document is explained by this many kept features.
COVER = 3


def features(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, kinds=KINDS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word, hash) of each kind of feature; words shorter than a prefix or suffix don't have it."""
    p = prefix_hash(low)
    for kind in kinds:
        has = np.flatnonzero(ends - starts >= abs(kind) + (kind != 0)) if kind else np.arange(len(starts))
        s = np.where(kind < 0, ends[has] + kind, starts[has])
        e = np.where(kind > 0, starts[has] + kind, ends[has])
        yield has, mix(range_hash(p, s, e) + np.uint64((kind + 64) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))


@dataclass
class ToxicModel:
    hashes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))  # sorted
    bins: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # from 1, of each hash
    crf: np.ndarray = field(default_factory=lambda: np.zeros(N_BINS + 3))
    curve: np.ndarray = field(default_factory=lambda: np.zeros(3))
    fitted: bool = False

    def __post_init__(self):
        self.sieve = np.zeros(1 << 16, bool)
        self.sieve[(self.hashes & np.uint64(0xFFFF)).astype(np.int64)] = True

    def word_bins(self, low, starts, ends) -> np.ndarray:
        """The strongest bin of each word (0: no kept feature)."""
        out = np.zeros(len(starts), np.int64)
        if len(self.hashes) and len(starts):
            for word, h in features(low, starts, ends):
                some = self.sieve[(h & np.uint64(0xFFFF)).astype(np.int64)]
                word, h = word[some], h[some]
                at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
                hit = self.hashes[at] == h
                np.maximum.at(out, word[hit], self.bins[at[hit]])
        return out


class Chains:
    """Event tokens of documents: bin of each, plain tokens before it, and plain tokens after the last."""

    def __init__(self, bins: np.ndarray, gaps: np.ndarray, doc: np.ndarray, tail: np.ndarray):
        self.n = np.bincount(doc, minlength=len(tail))
        self.first = np.cumsum(self.n) - self.n
        self.order = np.argsort(-self.n, kind="stable")  # documents with more events first
        self.bins, self.gaps, self.doc, self.tail = bins, gaps, doc, tail
        self.width = [int((self.n > k).sum()) for k in range(int(self.n.max(initial=0)))]

    def power(self, crf: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(m, scale): the transfer matrix of `gap` plain tokens, m being scaled down by exp(scale)."""
        m = _transfer(crf) * np.exp([0, crf[0]])
        half, root = (m[0, 0] + m[1, 1]) / 2, np.sqrt(((m[0, 0] - m[1, 1]) / 2) ** 2 + m[0, 1] * m[1, 0])
        big, small = half + root, half - root
        one = (m - small * np.eye(2)) / (big - small)
        return one + ((small / big) ** gap)[:, None, None] * (np.eye(2) - one), gap * np.log(big)

    def run(self, crf: np.ndarray, marginals: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Log partition of each document, and the probability of toxic of each event."""
        weight = np.exp(crf[:N_BINS])
        t = _transfer(crf)
        docs = len(self.tail)
        alpha, log_z = np.tile([1.0, 0.0], (docs, 1)), np.zeros(docs)  # before the first token: clean
        kept = np.zeros((len(self.bins), 2))
        gap_m, gap_s = self.power(crf, self.gaps)
        for k, w in enumerate(self.width):
            d = self.order[:w]
            e = self.first[d] + k
            a = np.einsum("di,dij->dj", alpha[d], gap_m[e]) @ t
            a[:, 1] *= weight[self.bins[e]]
            size = a.sum(1)
            log_z[d] += np.log(size) + gap_s[e]
            alpha[d] = kept[e] = a / size[:, None]
        tail_m, tail_s = self.power(crf, self.tail)
        beta = tail_m.sum(2)
        log_z += np.log((alpha * beta).sum(1)) + tail_s
        p = np.zeros(len(self.bins))
        if marginals:
            for k in reversed(range(len(self.width))):
                d = self.order[: self.width[k]]
                e = self.first[d] + k
                both = kept[e] * beta[d]
                p[e] = both[:, 1] / both.sum(1)
                b = beta[d].copy()
                b[:, 1] *= weight[self.bins[e]]
                b = np.einsum("dij,dj->di", gap_m[e], b @ t.T)
                beta[d] = b / b.sum(1, keepdims=True)
        return log_z, p


def _transfer(crf: np.ndarray) -> np.ndarray:
    return np.exp([[0.0, crf[-3]], [crf[-2], crf[-1]]])


def events(bins: np.ndarray, row: np.ndarray, rows: int) -> tuple[Chains, np.ndarray]:
    """The chains of a slab's words, and the word of each event."""
    n = np.bincount(row, minlength=rows)
    first = np.cumsum(n) - n
    at = np.flatnonzero(bins)
    doc = row[at]
    before = np.concatenate([[-1], at[:-1]]) if len(at) else at
    fresh = np.ones(len(at), bool)
    fresh[1:] = doc[1:] != doc[:-1]
    gaps = at - np.where(fresh, first[doc], before + 1)
    last = first - 1
    last[doc] = at  # the last event of a document stays
    return Chains(bins[at], gaps, doc, first + n - 1 - last), at


def evidence(chains: Chains, p: np.ndarray) -> np.ndarray:
    """1, largest marginal and log(1 + expected toxic tokens) of each document."""
    out = np.zeros((len(chains.tail), 3))
    out[:, 0] = 1
    np.maximum.at(out[:, 1], chains.doc, p)
    out[:, 2] = np.log1p(np.bincount(chains.doc, p, minlength=len(chains.tail)))
    return out


def _ascend(f, x: np.ndarray, rounds: int = 50, rate: float = 0.4) -> np.ndarray:
    """Adam on differences; f is smooth and has few parameters."""
    m, v = np.zeros_like(x), np.zeros_like(x)
    for i in range(1, rounds + 1):
        here = f(x)
        g = np.array([(f(x + d) - here) / 1e-5 for d in 1e-5 * np.eye(len(x))])
        m, v = 0.8 * m + 0.2 * g, 0.95 * v + 0.05 * g * g
        x = x + rate * (m / (1 - 0.8**i)) / (np.sqrt(v / (1 - 0.95**i)) + 1e-9) / (1 + i / 25)
    return x


def fit_field(chains: Chains, toxic: np.ndarray) -> np.ndarray:
    """Weights that fit the labelled tokens: events of toxic documents are toxic, all other tokens clean."""
    tag = toxic[chains.doc]
    n = np.bincount(chains.bins[tag], minlength=N_BINS)
    follow = (chains.gaps == 0) & (np.concatenate([[-1], chains.doc[:-1]]) == chains.doc)
    enter, stay = int((tag & ~follow).sum()), int((tag & follow).sum())
    ends = np.zeros(len(chains.tail), np.int64)
    np.add.at(ends, chains.doc[tag & ~np.append(follow[1:], False)], 1)
    shut = chains.tail == 0
    final = np.zeros(len(chains.tail), bool)
    final[chains.doc[tag]] = True
    leave = int(ends.sum() - (shut & final).sum())
    size = max(1, len(chains.bins))

    def likelihood(crf: np.ndarray) -> float:
        own = (crf[: len(n)] * n).sum() + crf[-3] * enter + crf[-2] * leave + crf[-1] * stay
        return (own - chains.run(crf, False)[0].sum()) / size - 0.002 * (crf**2).sum()

    start = np.zeros(N_BINS + 3)
    start[0], start[-3] = -3, -3
    return _ascend(likelihood, start)


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_curve(x: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps with a small ridge."""
    w = np.zeros(x.shape[1])
    ridge = 0.05 * np.eye(len(w))
    ridge[0, 0] = 1e-3
    for _ in range(40):
        p = _logistic(x @ w)
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge
        w = w + np.clip(np.linalg.solve(h, x.T @ (toxic - p) - ridge @ w), -4, 4)
    return w


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> ToxicModel:
    """Model from docs (doc_id, text) and labels (doc_id, toxic)."""
    known = labels.where("toxic in (0, 1) and doc_id is not null").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(sample)
    text = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id").select("text", "toxic")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in slabs(batch):
                low, starts, ends, row = words(data, offsets)
                toxic = part.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
                pairs = [np.stack([row[w].astype(np.uint64), h]) for w, h in features(low, starts, ends)]
                seen = np.unique(np.concatenate(pairs, 1), axis=1) if pairs else np.zeros((2, 0), np.uint64)
                h, back = np.unique(seen[1], return_inverse=True)
                bad = np.bincount(back, toxic[seen[0].astype(np.int64)], minlength=len(h)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(bad), pa.array(np.bincount(back, minlength=len(h)) - bad)], names=["h", "bad", "good"])

    totals = {r.toxic: r["count"] for r in text.groupBy("toxic").count().collect()}
    if len(totals) < 2:
        return ToxicModel()
    bad, good = totals[1], totals[0]
    odds = F.log((F.col("bad") + 0.5) / (bad + 1)) - F.log((F.col("good") + 0.5) / (good + 1))
    sums = text.mapInArrow(counted, "h bigint, bad bigint, good bigint").groupBy("h").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    strong = sums.where("bad >= 2").withColumn("odds", odds).where("odds > 1.5").withColumn("z", F.col("odds") / F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("good") + 0.5)))
    top = strong.orderBy(F.desc("z"), "h").limit(CANDIDATES).collect()
    if not top:
        return ToxicModel(curve=fit_curve(np.repeat([[1.0, 0, 0]], bad + good, 0), np.repeat([1, 0], [bad, good])), fitted=True)
    h = np.array([r.h for r in top], np.int64).view(np.uint64)
    order = np.argsort(h)
    h, log_odds, z = h[order], np.array([r.odds for r in top])[order], np.array([r.z for r in top])[order]
    tag = ToxicModel(h, np.ones(len(h), np.int64))
    shipped = docs.sparkSession.sparkContext.broadcast(tag)

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        for batch in batches:
            for part, data, offsets in slabs(batch):
                low, starts, ends, row = words(data, offsets)
                found = []
                for w, x in features(low, starts, ends):
                    at = np.minimum(np.searchsorted(m.hashes, x), len(m.hashes) - 1)
                    hit = m.hashes[at] == x
                    found.append(np.stack([w[hit], at[hit]]))
                word, feature = np.concatenate(found, 1) if found else np.zeros((2, 0), np.int64)
                base = np.searchsorted(row, np.arange(part.num_rows))
                n = np.bincount(row, minlength=part.num_rows)
                cuts = [word[row[word] == r] - base[r] for r in range(part.num_rows)] if len(word) else [word] * part.num_rows
                of = [feature[row[word] == r] for r in range(part.num_rows)] if len(word) else [feature] * part.num_rows
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array(n, pa.int64()), pa.array(cuts, pa.list_(pa.int64())), pa.array(of, pa.list_(pa.int64()))], names=["toxic", "n", "word", "feature"])

    rows = text.mapInArrow(looked_up, "toxic int, n bigint, word array<bigint>, feature array<bigint>").collect()
    toxic = np.array([r.toxic for r in rows]) == 1
    kept = cover([set(r.feature) for r in rows], toxic, z, log_odds)
    bins = np.zeros(len(h), np.int64)
    bins[kept] = 1 + np.searchsorted(BINS, log_odds[kept])
    seqs = []
    for r in rows:
        own = np.zeros(r.n, np.int8)
        np.maximum.at(own, np.array(r.word, np.int64), bins[np.array(r.feature, np.int64)].astype(np.int8))
        seqs.append(own)
    row = np.repeat(np.arange(len(rows)), [len(s) for s in seqs])
    chains, _ = events(np.concatenate(seqs).astype(np.int64), row, len(rows))
    crf = fit_field(chains, toxic)
    x = evidence(chains, chains.run(crf)[1])
    return ToxicModel(h[kept], bins[kept], crf, fit_curve(x, toxic.astype(float)), True)


def cover(has: list[set[int]], toxic: np.ndarray, z: np.ndarray, odds: np.ndarray, need: int = COVER) -> np.ndarray:
    """Features, strongest first, that occur in enough toxic documents which lack `need` kept ones so far."""
    docs: dict[int, list[int]] = {}
    for d, s in enumerate(has):
        if toxic[d]:
            for f in s:
                docs.setdefault(f, []).append(d)
    left, kept, least = np.full(len(has), need), [], max(2, int(0.01 * toxic.sum()))
    for f in sorted(docs, key=lambda f: (-z[f], f)):
        open_docs = [d for d in docs[f] if left[d] > 0]
        if len(open_docs) >= least and odds[f] > 1.5:
            kept.append(f)
            left[open_docs] -= 1
    return np.array(sorted(kept), np.int64)


def score_slab(m: ToxicModel, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[list[dict]]]:
    """Score of each text of a slab, and its spans (start and end in UTF-8 bytes, largest marginal)."""
    rows = len(offsets) - 1
    low, starts, ends, row = words(data, offsets)
    chains, at = events(m.word_bins(low, starts, ends), row, rows)
    p = chains.run(m.crf)[1] if m.fitted else np.zeros(len(at))
    score = _logistic(evidence(chains, p) @ m.curve) if m.fitted else np.zeros(rows)
    spans: list[list[dict]] = [[] for _ in range(rows)]
    for k in np.flatnonzero(p >= 0.5):
        mine, w = spans[row[at[k]]], at[k]
        if mine and w and mine[-1]["end"] == ends[w - 1] - offsets[row[w]]:
            mine[-1]["end"], mine[-1]["p"] = int(ends[w] - offsets[row[w]]), max(mine[-1]["p"], float(p[k]))
        else:
            mine.append({"start": int(starts[w] - offsets[row[w]]), "end": int(ends[w] - offsets[row[w]]), "p": float(p[k])})
    return score, spans


SPANS = "array<struct<start:bigint,end:bigint,p:double>>"


def scorer(spark: SparkSession, model: ToxicModel):
    """A column function: text to struct of score and spans. Only the text goes to Python."""
    shipped = spark.sparkContext.broadcast(model)
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))

    @F.arrow_udf(f"score double, spans {SPANS}")
    def scored(text: pa.Array) -> pa.Array:
        score, spans = [np.zeros(0)], []
        for _, data, offsets in slabs(pa.RecordBatch.from_arrays([text], names=["text"])):
            x, y = score_slab(shipped.value, data, offsets)
            score.append(x)
            spans += y
        return pa.StructArray.from_arrays([pa.array(np.concatenate(score)), pa.array(spans, span)], names=["score", "spans"])

    return scored


def score_documents(docs: DataFrame, model: ToxicModel, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id with score, predicted and spans (start and end in UTF-8 bytes, largest marginal) of each row."""
    out = docs.select("doc_id", scorer(docs.sparkSession, model)("text").alias("found"))
    return out.select("doc_id", "found.score", (F.col("found.score") >= threshold).cast("int").alias("predicted"), "found.spans")


def reject_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, with their columns, that are not predicted to be toxic; learnt from rows that aren't held out."""
    model = train(docs.where(~held_out(F.col("doc_id"), 3, 1)), labels)
    return docs.where(scorer(docs.sparkSession, model)("text")["score"] < THRESHOLD)


def op4_toxic_crf(spark, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    fold = held_out(F.col("doc_id"), 3, 1)
    model = train(docs.where(~fold), labels)
    found = score_documents(docs, model)
    return found.select("doc_id", fold.alias("held_out"), "score", "predicted", F.size("spans").cast("bigint").alias("n_spans"), "spans")


def tag_text(model: ToxicModel, text: str) -> pd.DataFrame:
    """Marginals of the words with evidence in one text."""
    data = np.frombuffer(text.encode(), np.uint8)
    low, starts, ends, row = words(data, np.array([0, len(data)]))
    chains, at = events(model.word_bins(low, starts, ends), row, 1)
    return pd.DataFrame({"start": starts[at], "end": ends[at], "p": chains.run(model.crf)[1]})
