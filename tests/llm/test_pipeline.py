"""corpus_pipeline.run() against plain Python."""

import hashlib
import random

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from test_llm import brute_classes, brute_hits, brute_repeats, prose

from meshflow.llm import run_index

TOXIC = ("grubnarf", "zorblatt")


def corpus(seed=3):
    """(id, text): clean, toxic, copied, repeating and contaminated texts, null, empty and odd ones, repeats and null ids."""
    rng = random.Random(seed)
    clean = [prose(rng, rng.randint(20, 60)) for _ in range(160)]
    texts = []
    for i, t in enumerate(clean):
        w = t.split(" ")
        if i % 4 == 0:
            w[7:7] = [rng.choice(TOXIC) + rng.choice(["", "ung", "el"])] * 2
        texts.append(" ".join(w))
    passage, leaked = prose(rng, 25), prose(rng, 14)
    for i in (3, 9, 27, 55):
        texts[i] += " " + passage
    for i in (5, 7, 70):
        texts[i] += " " + leaked
    texts += [texts[1], texts[1] + "!", texts[2], None, "", "...", "é", "ab" * 300, prose(rng, 2500)]
    rows = [(i, t) for i, t in enumerate(texts)]
    return rows + [rows[6], rows[13], (None, texts[17]), (None, "alone " + prose(rng, 9))], leaked


def plain(rows, items):
    """(id, ids of pieces) of what the pipeline leaves."""
    rows = [(d, t) for d, t in rows if not any(x in (t or "") for x in TOXIC)]
    classes = brute_classes([(d, t) for d, t in rows if d is not None])
    rows = [(d, t) for d, t in rows if d is None or classes[d] == d]
    # a null id is larger than all, and its rows don't count against each other
    least = {}
    w = run_index.WINDOW
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - w + 1):
            least[b[i : i + w]] = min(run_index._LAST_ID if d is None else d, least.get(b[i : i + w], run_index._LAST_ID))
    cut = []
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - w + 1):
            if least[b[i : i + w]] < (run_index._LAST_ID if d is None else d):
                gone[i : i + w] = True
        cut.append((d, None if t is None else bytes(np.frombuffer(b, np.uint8)[~gone]).decode("utf-8", "ignore")))
    found = brute_hits(list(enumerate(t for _, t in cut)), items)
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    return sorted((-1 if d is None else d, library.encode(t or "")) for k, (d, t) in enumerate(cut) if not found[k][1])


def written(spark, folder, rows, items, labels):
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for name in ("row", "kept", "found", "class_id", "score", "block"):  # names that stages use
        docs = docs.withColumn(name, F.lit("clash"))
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_pipeline(spark, tmp_path):
    rows, leaked = corpus()
    items = [(1, leaked.upper()), (2, "not in any of the documents at all, not even once"), (3, None), (4, "")]
    labels = [(i, 1, int(i % 4 == 0)) for i in range(160)] + [(None, 1, 1), (3, 1, None)]
    got = corpus_pipeline.run(spark, written(spark, tmp_path, rows, items, labels)).collect()
    want = plain(rows, items)
    assert len(want) > 100 and sorted((-1 if r.doc_id is None else r.doc_id, r.ids) for r in got) == want
    assert all(r.ids_sha256 == hashlib.sha256(np.array(r.ids, "<i4").tobytes()).hexdigest() for r in got)


def test_stages_keep_the_columns(spark, tmp_path):
    rows, leaked = corpus(5)
    folder = written(spark, tmp_path, rows[:60], [(1, leaked)], [(i, 1, int(i % 4 == 0)) for i in range(160)])
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "suffix_dedup", "decontamination", "piece_encoding"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert dict(out.dtypes) == dict(docs.dtypes)


@pytest.mark.parametrize("what", ["documents", "labels", "benchmark"])
def test_pipeline_on_empty_tables(spark, tmp_path, what):
    rows, leaked = corpus(7)
    rows = [] if what == "documents" else [(d, t) for d, t in rows[:12] if d is None or d % 4]
    items, labels = [] if what == "benchmark" else [(1, leaked)], [] if what == "labels" else [(i, 1, int(i % 4 == 0)) for i in range(8)]
    got = corpus_pipeline.run(spark, written(spark, tmp_path, rows, items, labels)).collect()
    assert sorted((r.doc_id, r.ids) for r in got) == plain(rows, items)


def test_brute_force_agrees_with_itself():
    assert plain([(1, "a b c"), (2, "a b c")], [])[0][0] == 1 and brute_repeats([(1, "x" * 60), (2, "x" * 60)])[2][1] == 60
