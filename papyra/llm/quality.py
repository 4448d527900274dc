"""Quality rules: a length-normalised log-likelihood ratio between trusted and raw text.

Every document is a bag of hashed n-grams: its words and pairs of neighbouring words as they are written, and the
unigrams and bigrams of its words' shapes (case, kind of the last characters, whether a word repeats its neighbour),
which speak for words that no labelled text holds. Two multinomials over BINS bins are counted: one over all documents
(the raw corpus), one over the trusted target, documents labelled good. A document's score is the mean over its
n-grams of log p_target(bin) - log p_raw(bin).

At most LABELLED labels take part. One half of them, by a hash of the id, gives the target's counts; the other half sets the
threshold, from documents that pass the base rules. Where a half lacks what it has to give, all labels do both. The
threshold is applied to every document alike; a document that fails the fixed base rules is never kept.

Only arrays of BINS counts and a histogram of the labelled documents' scores reach the driver, whatever the
size of the corpus. Without labelled documents of both kinds no threshold is set and the base rules decide.

Null or empty texts have no words, score 0 and fail the base rules. Repeated rows are judged each on their
own; ties at the threshold are kept. An empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dist import apart, lean, schema_of, ship, stage, together
from .text import SPACED, U, Words, blocks, mix, per_doc

BINS = 1 << 16
SMOOTHING = 0.5
MIN_WORDS, REPEAT_WINDOW, REPEAT_PERCENT = 20, 8, 30
#: The least share of the documents labelled good that a threshold must keep.
KEEP_GOOD = 0.995
#: The model is fitted on at most so many labelled documents, those whose ids hash lowest; the raw counts cover every document.
LABELLED = 20_000
#: Labelled scores are counted in steps of this width; the bound on what the driver sees is 2 * SCORE_LIMIT / STEP.
STEP, SCORE_LIMIT = 0.005, 40.0

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def shapes(words: Words) -> np.ndarray:
    """A word's shape: how it begins, how it ends, and whether it is in capitals; 64 bits."""
    if not len(words):
        return np.zeros(0, U)
    letters = np.add.reduceat(_LETTER[words.data].astype(np.int32) * words.inside, words.start)
    capitals = np.add.reduceat(_UPPER[words.data].astype(np.int32) * words.inside, words.start)
    last, before = words.data[words.end - 1], words.data[np.maximum(words.end - 2, words.start)]
    plain = lambda b: np.where(_LETTER[b], 97, b).astype(U)  # noqa: E731  all letters alike
    kind = (capitals == letters).astype(U) * U(2) + (capitals > 0).astype(U) + (letters == 0).astype(U) * U(4)
    return kind * U(1 << 16) + plain(before) * U(256) + plain(last)


def grams(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Bin and text of every n-gram: words and pairs of words, shapes and pairs of shapes with whether the two words are the same."""
    shape, word = shapes(words), words.hashes()
    pair = np.flatnonzero(words.doc[:-1] == words.doc[1:])
    twice = (word[pair] == word[pair + 1]).astype(U) * U(1 << 40)
    kinds = [word + U(11), word[pair] * U(0x100000001B3) + word[pair + 1] + U(12), shape + U(1), shape[pair] * U(0x100000001B3) + shape[pair + 1] + twice + U(2)]
    bins = np.concatenate([mix(x) for x in kinds]) & U(BINS - 1)
    return bins.astype(np.int64), np.concatenate((words.doc, words.doc[pair]) * 2)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BINS, np.int64)
    for batch in blocks(batches):
        total += np.bincount(grams(Words(batch.column("text"), SPACED))[0], minlength=BINS)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bin", "n"])


def counted(texts: DataFrame) -> np.ndarray:
    """Counts of the n-grams of a column text: one array for each task, summed; BINS rows reach the driver."""
    total = np.zeros(BINS)
    for r in texts.mapInArrow(lean(_counts), "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect():
        total[r.bin] = r.n
    return total


def ratio(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """log p_target - log p_raw of each bin; all zero without a target."""
    if not target.any():
        return np.zeros(BINS)
    p, q = ((n + SMOOTHING) / (n.sum() + SMOOTHING * BINS) for n in (target, raw))
    return np.log(p) - np.log(q)


def scores(words: Words, weights: np.ndarray, n_docs: int) -> np.ndarray:
    bin_, doc = grams(words)
    n = np.bincount(doc, minlength=n_docs)
    return np.bincount(doc, weights[bin_], minlength=n_docs) / np.maximum(n, 1)


def _repeated(words: Words, hashes: np.ndarray) -> np.ndarray:
    """Of each text: words in windows that are found twice or more in it."""
    window, at = words.windows(hashes, REPEAT_WINDOW)
    doc = words.doc[at].astype(U)
    key = mix(window + doc * U(0x9E3779B97F4A7C15))
    order = np.lexsort((window, key))
    k, w, d = key[order], window[order], doc[order]
    same = (k[1:] == k[:-1]) & (w[1:] == w[:-1]) & (d[1:] == d[:-1])
    twice = np.zeros(len(k), bool)
    twice[1:] |= same
    twice[:-1] |= same
    change = np.zeros(len(words) + 1, np.int64)
    starts = at[order[twice]]
    np.add.at(change, starts, 1)
    np.add.at(change, starts + REPEAT_WINDOW, -1)
    return per_doc((np.cumsum(change[:-1]) > 0).astype(np.int64), words.first)


_NOT_LINE = np.ones(256, bool)
_NOT_LINE[0x0A] = False


def _dup_lines(texts: pa.Array, words: Words) -> np.ndarray:
    """Of each text: lines with a word that equal an earlier line."""
    lines = Words(texts, _NOT_LINE)
    if not len(lines):
        return np.zeros(len(texts), np.int64)
    with_word = np.searchsorted(words.start, lines.end) > np.searchsorted(words.start, lines.start)
    hashes, other, doc = lines.hashes()[with_word], lines.hashes(1)[with_word], lines.doc[with_word]
    order = np.lexsort((np.arange(len(doc)), other, hashes, doc))
    again = (hashes[order][1:] == hashes[order][:-1]) & (other[order][1:] == other[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    return np.bincount(doc[order][1:][again], minlength=len(texts))


def _judge(weights: np.ndarray, carried: list[str]):
    """carried: columns that go along as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            text = batch.column("text")
            text = text.fill_null("") if text.null_count else text
            words = Words(text, SPACED)
            chars = np.concatenate(([0], np.cumsum(words.inside & ((words.data & 0xC0) != 0x80))))
            symbols = np.concatenate(([0], np.cumsum(_SYMBOL[words.data])))
            count = lambda total: pa.array((total[words.offsets[1:]] - total[words.offsets[:-1]]).astype(np.int64))  # noqa: B023, E731
            base = [pa.array(np.diff(words.first).astype(np.int64)), count(chars), count(symbols), pa.array(_dup_lines(text, words).astype(np.int64)), pa.array(_repeated(words, words.hashes()))]
            score = pa.array(scores(words, weights, batch.num_rows))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), *base, score], [*carried, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score"])

    return run


JUDGED = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, score double"


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def threshold(scored: DataFrame) -> float | None:
    """The cut that tells good from bad labels best while it keeps KEEP_GOOD of the good; of a run of equally good cuts the middle."""
    step = F.floor(F.least(F.greatest(F.col("score"), F.lit(-SCORE_LIMIT)), F.lit(SCORE_LIMIT)) / STEP).cast("int")
    rows = scored.groupBy("good", step.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect()
    good = {r.step: r.n for r in rows if r.good}
    bad = {r.step: r.n for r in rows if not r.good}
    if not good or not bad:
        return None
    n_good, n_bad = sum(good.values()), sum(bad.values())
    best, cuts, below_good, below_bad = 0.0, [], 0, 0
    for s in range(min([*good, *bad]), max([*good, *bad]) + 2):
        if below_good > (1 - KEEP_GOOD) * n_good:
            break
        gain = below_bad / n_bad - below_good / n_good
        if gain > best:
            best, cuts = gain, [s]
        elif gain == best and cuts and cuts[-1] == s - 1:
            cuts.append(s)
        below_good += good.get(s, 0)
        below_bad += bad.get(s, 0)
    return cuts[len(cuts) // 2] * STEP if cuts else None


def judge(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """For each row of docs: doc, a struct of its columns (all, or those of keep), the base counts, score, base_failed and kept.

    labels: doc_id and quality (1 good, 0 bad; null, or labelled both ways: left out).
    """
    ship(docs.sparkSession)
    text = F.col("text").cast("string").alias("text")
    marks = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.min("quality").alias("low"), F.max("quality").alias("high"))
    marks = marks.where(F.col("low") == F.col("high")).select("label_id", (F.col("low") == 1).alias("good"))
    marks = F.broadcast(marks.orderBy(F.xxhash64("label_id"), "label_id").limit(LABELLED))
    labelled = stage(docs.select(F.col("doc_id").cast("long").alias("own_id"), text).join(marks, F.col("own_id") == F.col("label_id"), "inner").select("text", "good", (F.pmod(F.xxhash64("label_id", F.lit("half")), F.lit(2)) == 0).alias("counted")), "labelled")
    raw, target, rest = counted(docs.select(text)), counted(labelled.where("good AND counted").select("text")), "NOT counted"
    if not target.any() or labelled.where(rest).select("good").distinct().count() < 2:
        target, rest = counted(labelled.where("good").select("text")), "true"
    weights = ratio(raw, target)
    cut = threshold(labelled.where(rest).mapInArrow(lean(_judge(weights, ["good"])), f"good boolean, {JUDGED}").where(~base_failed()))
    names, doc, kind, back = apart(docs, keep)
    schema = schema_of(("text string, " if back else "") + JUDGED, doc=kind)
    judged = together(docs.select(doc, text).mapInArrow(lean(_judge(weights, ["doc", "text"] if back else ["doc"])), schema), names, back)
    judged = judged.withColumn("base_failed", base_failed())
    return judged.withColumn("kept", ~F.col("base_failed") & (F.lit(True) if cut is None else F.col("score") >= cut))
