"""Quality rules: log-likelihood ratio of hashed n-grams between a trusted target and the raw corpus.

Words and word pairs fall into hashed buckets. Two multinomials over the buckets, one of all documents and one of trusted
documents, are smoothed by one count for each bucket; a document's score is the mean over its n-grams of the log ratio of the
two probabilities. A document is kept if it reaches a threshold, which is a low quantile of the scores of trusted documents that
were left out of the fit (one in ``left_out``): nothing is drawn at random, so a rerun decides alike.

The raw counts cover every document, the target counts and the threshold every trusted one. Up to ``broadcast_ids`` trusted ids
are broadcast, and each pass reads the texts where they lie; beyond that the first pass shuffles the texts once to their ids.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import checkpointed, in_small_batches
from tessera.llm.words import IS_WORD, SYMBOL, Texts, U, chunks, mix, sums


@dataclass(frozen=True)
class QualityRules:
    buckets: int = 1 << 15
    broadcast_ids: int = 1 << 20
    left_out: int = 4
    quantile: float = 0.002
    least_words: int = 20
    repeat_window: int = 8
    most_repeat_percent: int = 30


def _buckets(texts: Texts, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text) of each word and word pair."""
    owner = texts.owner
    pairs, at = texts.grams(2)
    return (np.concatenate((mix(texts.hashes), pairs)) % U(size)).astype(np.int64), np.concatenate((owner, owner[at]))


def _dealt(batches: Iterator[pa.RecordBatch], left_out: int) -> Iterator[pa.RecordBatch]:
    """Whether a trusted id is left out of the fit, by its own bits."""
    for batch in batches:
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(mix(ids.view(U)) % U(left_out) == 0)], names=["doc_id", "judged"])


def _count(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    raw, target = np.zeros(size, np.int64), np.zeros(size, np.int64)
    for batch in batches:
        for part in chunks(batch, "text"):
            bucket, owner = _buckets(Texts(part.column("text")), size)
            raw += np.bincount(bucket, minlength=size)
            target += np.bincount(bucket[part.column("fitted").to_numpy(zero_copy_only=False)[owner]], minlength=size)
    used = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(raw[used]), pa.array(target[used])], names=["bucket", "raw", "target"])


def _repeated_words(texts: Texts, window: int) -> np.ndarray:
    """Words of each text that lie in a window of so many words that the text has twice or more."""
    found, at = texts.grams(window)
    owner = texts.owner[at]
    order = np.lexsort((found, owner))
    same = (found[order][1:] == found[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    twice = np.zeros(len(found), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    change = np.zeros(len(texts.hashes) + 1, np.int64)
    np.add.at(change, at[twice], 1)
    np.add.at(change, at[twice] + window, -1)
    return sums((np.cumsum(change)[:-1] > 0).astype(np.int64), texts.first)


def _repeated_lines(text: str | None) -> int:
    lines = [line for line in (text or "").split("\n") if line.strip(" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines))


MEASURES = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, score double"


def _measure(batches: Iterator[pa.RecordBatch], weights: np.ndarray, rules: QualityRules) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch, "text"):
            texts = Texts(part.column("text"))
            bucket, owner = _buckets(texts, rules.buckets)
            grams_of = np.bincount(owner, minlength=len(texts))
            score = np.bincount(owner, weights[bucket], len(texts)) / np.maximum(grams_of, 1)
            points = IS_WORD[texts.data] & ((texts.data & 0xC0) != 0x80)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array(texts.counts, pa.int64()),
                    pa.array(sums(points, texts.offsets), pa.int64()),
                    pa.array(sums(SYMBOL[texts.data], texts.offsets), pa.int64()),
                    pa.array([_repeated_lines(x) for x in part.column("text").to_pylist()], pa.int64()),
                    pa.array(_repeated_words(texts, rules.repeat_window), pa.int64()),
                    pa.array(score),
                ],
                names=[x.split()[0] for x in MEASURES.split(", ")],
            )


def _percentile(scores: DataFrame, share: float) -> float | None:
    """As ``percentile``, but each task keeps only its lowest scores up to the one wanted, not all distinct ones in one place."""
    place = share * (scores.count() - 1)
    low = math.floor(place)
    if low < 0:
        return None
    ends = [r[0] for r in scores.orderBy("score").offset(low).limit(math.ceil(place) - low + 1).collect()]
    return ends[0] if ends[0] == ends[-1] else (low + 1 - place) * ends[0] + (place - low) * ends[-1]


def quality(documents: DataFrame, labels: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score) for every row.

    ``labels`` holds (doc_id, quality, toxic): trusted are documents of quality 1 that are not toxic, in all their labels.
    A null text has no words. A document without n-grams scores 0. ``kept`` is false where the base rules fail, else it is
    whether the score reaches the threshold; without trusted documents only the base rules decide. A null doc_id is never
    trusted; repeated rows count, and are judged, as often as they occur. An empty table gives no rows.
    """
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    good = good.filter("doc_id is not null and quality = 1 and toxic = 0").select(F.col("doc_id").cast("long"))
    good = checkpointed(good.mapInArrow(lambda b: _dealt(b, rules.left_out), "doc_id long, judged boolean"))
    total, left = good.agg(F.count("*"), F.count_if("judged")).first()
    few = left in (0, total)  # too few to leave some out
    fitted, judged = (good if few else good.filter(x) for x in ("not judged", "judged"))
    spark = documents.sparkSession
    docs = in_small_batches(documents).select("doc_id", "text")
    fitted = fitted.select("doc_id", F.lit(True).alias("_fitted"))
    # Only the ids are built into a table, so that texts which are shuffled need no sort.
    marked = docs.join(F.broadcast(fitted) if total <= rules.broadcast_ids else fitted.hint("shuffle_hash"), "doc_id", "left")
    marked = marked.select("text", F.coalesce("_fitted", F.lit(False)).alias("fitted"))
    counted = marked.mapInArrow(lambda b: _count(b, rules.buckets), "bucket long, raw long, target long")
    # One row for each bucket.
    table = counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    raw, target = np.zeros(rules.buckets), np.zeros(rules.buckets)
    raw[table["bucket"]], target[table["bucket"]] = table["raw"], table["target"]
    weights = spark.sparkContext.broadcast(np.log((target + 1) / (target.sum() + rules.buckets)) - np.log((raw + 1) / (raw.sum() + rules.buckets)))
    measured = checkpointed(docs.mapInArrow(lambda b: _measure(b, weights.value, rules), MEASURES))
    failed = (F.col("n_words") < rules.least_words) | (100 * F.col("n_repeat_words") > rules.most_repeat_percent * F.col("n_words"))
    measured = measured.withColumn("base_failed", failed)
    threshold = _percentile(measured.filter("not base_failed").join(judged.select("doc_id"), "doc_id", "left_semi").select("score"), rules.quantile)
    kept = ~F.col("base_failed") & (F.lit(True) if threshold is None else F.col("score") >= threshold)
    return measured.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "score")
