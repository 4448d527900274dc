"""Katz backoff of order 3 over words, with partitioned n-gram tables that are evaluated where they lie.

    P(w | a b) = kept3(c(a b w)) / c(a b)     if c(a b w) > 0 in training
               = alpha(a b) * P(w | b)        else, if c(a b) > 0
               = P(w | b)                     else
    P(w | b)   the same with c(b w), c(b), alpha(b) and P(w)
    P(w)       = kept1(c(w)) / N              if c(w) > 0
               = what that leaves             for all unknown words together
    alpha(h)   = (1 - sum of P(w | h) over seen w) / (1 - sum of P(w | h without its first word) over seen w)

so that P(. | h) sums to one exactly for every history. At each order, kept(r) = d(r) * r by Katz's Good-Turing
discounts for r up to LARGEST, from the counts of counts of all n-grams of that order, and kept(r) = r above. Where the
counts of counts give no proper discount (0 < d < 1), absolute discounting takes its place for that r. A history
whose n-grams are all above LARGEST leaves nothing to others; its c(h) is raised by one. A document's tokens are its words and
one end; two start marks stand before them.

No text and no table is held in one place. Documents are stored as chunks of word numbers, bucketed so that they stay where they
are, and chunks exchange packed arrays with hash ranges, each distinct entry of a chunk once:

1. words. A range adds up the counts of its words, and numbers them, frequent ones first. Pairs of a common word and
   the next go along with the next, so that no range holds all pairs of a common word.
2. n-grams. A chunk sends each distinct trigram with its training count to the range of its middle word, for common
   middle words to the range of the first two. There all counts that its probability needs lie side by side, with the
   words' counts from 1. These counts go back, whole numbers that do not depend on the discounts: for a trigram seen in
   training its own and its history's, for another also how many words were seen how often after its histories.
3. The counts of counts of all ranges give the discounts, with which a chunk turns counts into probabilities and adds up its
   documents.

The list of common words comes from a sample and only steers where counts are added up. A frequent pair or trigram comes once
from each chunk. A chunk sends no more messages than it has distinct trigrams. Words are known by 64 bits of hash.

Null or empty text has the end token alone. Repeated rows are scored each on their own and count each time.
Without training documents every word is unknown and every score 0. Null ids count as "" for the split. An empty table gives an
empty result. Further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dist import lean, ship, stage, stage_by
from .packed import narrow, pack_typed, unpack_typed
from .text import SPACED, U, Words, blocks, mix

LARGEST = 5
CHUNK_TEXT, RANGE_TEXT = 12 << 20, 8 << 20
#: A word is common when it makes up 1 / COMMON of a sample of SAMPLE_TEXT bytes from each task.
COMMON, SAMPLE_TEXT = 400, 1 << 20
START, END = U(0x53544152545F5F5F), U(0x454E445F5F5F5F5F)

MESSAGE = "range long, chunk long, data binary"
ANSWER = "chunk long, kind int, range long, data binary"
WORDS, GRAMS, STATS, PARTS = range(4)


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's words and end, and how many."""
    words = Words(texts, SPACED, lower=True)
    count = np.diff(words.first) + 1
    out = np.empty(len(words) + len(count), U)
    is_end = np.zeros(len(out), bool)
    is_end[np.cumsum(count) - 1] = True
    out[is_end] = END
    out[~is_end] = words.hashes()
    return out, count


def _new(*sorted_: np.ndarray) -> np.ndarray:
    """Where a run of equal rows begins."""
    out = np.ones(len(sorted_[0]), bool)
    if len(out):
        out[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in sorted_])
    return out


def _sum_by(values: np.ndarray, new: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, np.flatnonzero(new)) if len(values) else values


def _total(index: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Exact sums of whole numbers by index."""
    out = np.zeros(n, np.int64)
    np.add.at(out, index, values)
    return out


def _member(values: np.ndarray, sorted_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether values are among sorted ones, and where."""
    if not len(sorted_):
        return np.zeros(len(values), bool), np.zeros(len(values), np.int64)
    k = np.minimum(np.searchsorted(sorted_, values), len(sorted_) - 1)
    return sorted_[k] == values, k


def _range_of(hash_: np.ndarray, n: int) -> np.ndarray:
    return ((mix(hash_) >> U(32)) * U(n) >> U(32)).astype(np.int64)


def _parts(sorted_: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Value, begin and end of each run of equal values."""
    begin = np.flatnonzero(_new(sorted_)).tolist()
    return zip(sorted_[begin].tolist(), begin, [*begin[1:], len(sorted_)], strict=True)


def _of_counts(counts: np.ndarray) -> np.ndarray:
    """How many are 0, 1 to LARGEST + 1, and more."""
    return np.bincount(np.minimum(counts, LARGEST + 2).astype(np.int64), minlength=LARGEST + 3)


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    size = 0
    for batch in blocks(batches, limit=SAMPLE_TEXT):
        word, n = np.unique(tokens(batch.column("text"))[0], return_counts=True)
        often = (n * COMMON >= n.sum()) & (word != END)
        yield pa.RecordBatch.from_arrays([pa.array(word[often].view(np.int64)), pa.array(n[often])], ["word", "n"])
        size += batch.column("text").nbytes
        if size >= SAMPLE_TEXT:
            return


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size, seq = [], 0, 0

    def done() -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        hashes, count = tokens(rows.column("text").combine_chunks())
        word, token, n = np.unique(hashes, return_inverse=True, return_counts=True)
        by = np.argsort(-n, kind="stable")  # frequent words get small numbers
        rank = np.empty(len(by), np.int64)
        rank[by] = np.arange(len(by))
        ids = np.asarray(pa.compute.fill_null(rows.column("doc_id"), -1)).astype(np.int64)
        data = pack_typed(ids, np.asarray(rows.column("doc_id").is_null()), np.asarray(rows.column("held_out")), narrow(count), word[by], narrow(rank[token]))
        return pa.RecordBatch.from_arrays([pa.array([(TaskContext.get().partitionId() << 24) + seq], pa.int64()), pa.array([size], pa.int64()), pa.array([data], pa.binary())], ["chunk", "bytes", "data"])

    for batch in blocks(batches):
        held.append(batch)
        size += batch.column("text").nbytes
        if size >= CHUNK_TEXT:
            yield done()
            held, size, seq = [], 0, seq + 1
    if held:
        yield done()


class Chunk:
    """Documents as numbers of the chunk's own words; a start mark has the number after the last word's."""

    def __init__(self, data, common: np.ndarray, n: int):
        self.ids, self.null, self.out, count, self.word, token = unpack_typed(data)
        self.n, self.count, self.token = n, count.astype(np.int64), token.astype(np.int32)
        self.first = np.cumsum(self.count) - self.count
        self.train = np.repeat(~self.out, self.count)
        start = len(self.word)
        self.b = np.empty_like(self.token)
        self.b[1:] = self.token[:-1]
        self.b[self.first] = start
        self.a = np.empty_like(self.token)
        self.a[1:] = self.b[:-1]
        self.a[self.first] = start
        self.common, k = _member(np.append(self.word, START), common)
        self.common[-1] = False
        self.k = np.where(self.common, k, 0)
        # words in order of their ranges
        range_ = _range_of(self.word, n)
        self.by = np.argsort(range_, kind="stable")
        self.range = range_[self.by]
        self.place = np.empty(len(self.by), np.int64)
        self.place[self.by] = np.arange(len(self.by))

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Each distinct pair of a common word and the next, as (place of the next) * 2 ** 32 + number of the common word, in order; and its training count."""
        at = np.flatnonzero(self.common[self.b])
        key, inverse = np.unique(self.place[self.token[at]] << 32 | self.k[self.b[at]], return_inverse=True)
        return key, np.bincount(inverse, self.train[at], len(key)).astype(np.int64)

    def grams(self) -> None:
        """Distinct trigrams in order of range, middle, first and last word. which: of each token, its trigram."""
        hashes = np.append(self.word, START)
        range_ = _range_of(hashes, self.n)[self.b]
        often = np.flatnonzero(self.common[self.b])
        range_[often] = _range_of(hashes[self.b[often]] ^ mix(hashes)[self.a[often]], self.n)
        high, low = range_ << 32 | self.b, self.a.astype(np.int64) << 32 | self.token
        order = np.lexsort((low, high))
        new = _new(high[order], low[order])
        self.which = np.empty(len(order), np.int64)
        self.which[order] = np.cumsum(new) - 1
        at = order[new]
        del order, high, low
        self.gram_range, self.gram_b, self.gram_a, self.gram_w = range_[at], self.b[at], self.a[at], self.token[at]
        self.gram_n = np.bincount(self.which, self.train, len(at)).astype(np.int64)


def _rows(rows: list[tuple], schema: tuple[str, ...]) -> pa.RecordBatch:
    kinds = {"range": pa.int64(), "chunk": pa.int64(), "kind": pa.int32(), "data": pa.binary()}
    cols = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[name]) for c, name in zip(cols, schema, strict=True)], list(schema))


_MESSAGE, _ANSWER = ("range", "chunk", "data"), ("chunk", "kind", "range", "data")


def _ask_words(common: np.ndarray, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, data in zip(batch.column("chunk").to_pylist(), batch.column("data"), strict=True):
                own = Chunk(data.as_buffer(), common, n)
                c = np.bincount(own.token, own.train, len(own.word)).astype(np.int64)[own.by]
                key, count = own.pairs()
                word = own.word[own.by]
                for r, x, y in _parts(own.range):
                    i, j = np.searchsorted(key, [x << 32, y << 32])
                    yield _rows([(r, chunk, pack_typed(word[x:y], narrow(c[x:y]), narrow((key[i:j] >> 32) - x), narrow(key[i:j] & 0xFFFFFFFF), narrow(count[i:j])))], _MESSAGE)

    return run


def _answer_words(common: np.ndarray, n: int):
    """Number and count of each word, and the count of each pair with a common word before it."""

    def run(asked: pa.Table) -> pa.Table:
        parts = [unpack_typed(d.as_buffer()) for d in asked.column("data").combine_chunks()]
        range_ = asked.column("range")[0].as_py()
        size, pairs = [len(p[0]) for p in parts], [len(p[2]) for p in parts]
        word, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        c1 = _total(inverse, np.concatenate([p[1] for p in parts]).astype(np.int64), len(word))
        number = np.empty(len(word), np.int64)
        number[np.lexsort((word, -c1))] = np.arange(len(word)) * n + range_ + 1
        of = inverse[np.concatenate([p[2].astype(np.int64) for p in parts]) + np.repeat(np.cumsum(size) - size, pairs)]
        key, which = np.unique(of << 32 | np.concatenate([p[3].astype(np.int64) for p in parts]), return_inverse=True)
        c2 = _total(which, np.concatenate([p[4] for p in parts]).astype(np.int64), len(key))
        # parts of the common words' normalisers: counts of counts after them, and of the counts of the words after them
        k, after = key & 0xFFFFFFFF, c1[key >> 32]
        seen = c2 > 0
        column = lambda test, x=None: _total(k[seen & test], 1 if x is None else x[seen & test], len(common))
        is_common, at = _member(word, common)
        own = _total(at[is_common], c1[is_common], len(common))
        table = [own, *(column(c2 == r) for r in range(1, LARGEST + 1)), *(column(after == r) for r in range(1, LARGEST + 1)), column(after > LARGEST, after)]
        stats = np.concatenate((_of_counts(c1), _of_counts(c2), [c1.sum(), (c1 > 0).sum()])).astype(np.int64)
        rows = [(range_, STATS, -1, pack_typed(stats)), (range_, PARTS, -1, pack_typed(np.concatenate(table)))]
        cut, cut2 = np.cumsum(size)[:-1], np.cumsum(pairs)[:-1]
        answers = zip(asked.column("chunk").to_pylist(), np.split(number[inverse], cut), np.split(c1[inverse], cut), np.split(c2[which], cut2), strict=True)
        return pa.Table.from_batches([_rows(rows + [(chunk, WORDS, range_, pack_typed(*map(narrow, x))) for chunk, *x in answers], _ANSWER)])

    return run


def _heard(answers: pa.Table, kind: int) -> list[list[np.ndarray]]:
    own = answers.filter(pa.compute.equal(answers.column("kind"), kind)).sort_by("range")
    return [unpack_typed(d.as_buffer()) for d in own.column("data").combine_chunks()] if own.num_rows else []


def _open(chunks: pa.Table, answers: pa.Table, common: np.ndarray, n: int) -> tuple[Chunk, np.ndarray, np.ndarray, np.ndarray]:
    """A chunk; number and count of each of its words, the start mark's last; counts of its pairs with common words."""
    own = Chunk(chunks.column("data")[0].as_buffer(), common, n)
    heard = _heard(answers, WORDS)
    number, c1 = np.zeros(len(own.word) + 1, np.int64), np.zeros(len(own.word) + 1, np.int64)
    number[own.by], c1[own.by] = (np.concatenate([h[i] for h in heard]) for i in range(2))
    return own, number, c1, np.concatenate([h[2].astype(np.int64) for h in heard])


def _ask_grams(common: np.ndarray, n: int):
    def run(chunks: pa.Table, answers: pa.Table) -> pa.Table:
        if not chunks.num_rows:
            return pa.Table.from_batches([_rows([], _MESSAGE)])
        chunk = chunks.column("chunk")[0].as_py()
        own, number, c1, pair_n = _open(chunks, answers, common, n)
        own.grams()
        key, _ = own.pairs()
        b, a, w, count = own.gram_b, own.gram_a, own.gram_w, own.gram_n
        c2 = np.zeros(len(b), np.int64)
        often = np.flatnonzero(own.common[b])
        c2[often] = pair_n[np.searchsorted(key, own.place[w[often]] << 32 | own.k[b[often]])]
        rows = []
        for r, x, y in _parts(own.gram_range):
            new_b = _new(b[x:y])
            new_a = new_b | _new(a[x:y])
            at_b, at_a = np.flatnonzero(new_b), np.flatnonzero(new_a)
            words, code = np.unique(w[x:y], return_inverse=True)
            k = np.where(own.common[b[x:y][at_b]], own.k[b[x:y][at_b]] + 1, 0)
            arrays = [number[b[x:y][at_b]], k, np.diff(np.append(at_b, y - x)), number[a[x:y][at_a]], np.diff(np.append(at_a, y - x)), number[words], c1[words], code, count[x:y], c2[x:y]]
            rows.append((r, chunk, pack_typed(*map(narrow, arrays))))
        return pa.Table.from_batches([_rows(rows, _MESSAGE)])

    return run


class Grams:
    """A range's distinct trigrams in order of middle, first and last word, with their pairs of middle and last word."""

    def __init__(self, messages: list):
        parts = []
        for data in messages:
            b, k, n_b, a, n_a, words, c1, code, n, c2 = (x.astype(np.int64) for x in unpack_typed(data))
            parts.append((np.repeat(b, n_b), np.repeat(a, n_a), words[code], np.repeat(k, n_b), c1[code], n, c2))
        self.size = [len(p[0]) for p in parts]
        b, a, w, k, c1, n, c2 = (np.concatenate([p[i] for p in parts]) for i in range(7))
        del parts
        order = np.lexsort((w, a, b))
        new = _new(b[order], a[order], w[order])
        self.which = np.empty(len(order), np.int64)
        self.which[order] = np.cumsum(new) - 1
        at = order[new]
        self.c3 = _sum_by(n[order], new)
        b, a, w, k, c1, c2 = b[at], a[at], w[at], k[at], c1[at], c2[at]
        self.history = np.cumsum(_new(b, a)) - 1
        of_b = np.cumsum(_new(b)) - 1
        order = np.lexsort((w, of_b))
        new = _new(of_b[order], w[order])
        self.pair = np.empty(len(order), np.int64)
        self.pair[order] = np.cumsum(new) - 1
        at = order[new]
        self.pair_b, self.pair_c1, self.pair_k = of_b[at], c1[at], k[at]
        self.c2 = np.where(self.pair_k > 0, c2[at], _sum_by(self.c3[order], new))

    def stats(self) -> np.ndarray:
        """Counts of counts of pairs, but those of common words, and of trigrams."""
        return np.concatenate((_of_counts(self.c2[self.pair_k == 0]), _of_counts(self.c3))).astype(np.int64)

    def counts(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What each trigram's probability is made of: the count of its history and, for trigrams not seen, the columns of FEW and MANY."""
        total, few, many = _seen(self.history, self.c3, self.c2[self.pair])
        total_b, few_b, many_b = _seen(self.pair_b, self.c2, self.pair_c1)
        k = np.zeros(len(total_b), np.int64)
        k[self.pair_b] = self.pair_k
        if parts.shape[1]:  # common words' pairs are not all here
            own = parts[:, k - 1]
            total_b = np.where(k > 0, own[0], total_b)
            few_b, many_b = np.where(k > 0, own[1:-1], few_b), np.where(k > 0, own[-1], many_b)
        raised, raised_b = (t + ((f[:LARGEST].sum(0) == 0) & (t > 0)) for t, f in ((total, few), (total_b, few_b)))
        self.new = np.flatnonzero(self.c3 == 0)
        h, pair = self.history[self.new], self.pair[self.new]
        b, c2, c1 = self.pair_b[pair], self.c2[pair], self.pair_c1[pair]
        below = c2 == 0
        return raised[self.history], np.concatenate((few[:, h], few_b[:, b] * below)), np.stack((many[h], raised_b[b], c2, c1 * below, many_b[b] * below))


#: Columns for a trigram not seen, of its history: words seen 1 to LARGEST times after it, and of the words seen after it those that are
#: seen 1 to LARGEST times after the shorter history; then the same of the shorter history, if the word is not seen after that either.
FEW = 4 * LARGEST
#: Counts above LARGEST of the words seen, of the history; count of the shorter history, of the word after it, of the word; as the first, of the shorter history.
MANY = 5


def _seen(history: np.ndarray, count: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each history: its count; how many of its n-grams are seen r times, and how many of those seen have a shorter one seen r times, for r up to LARGEST; the sum of the larger counts of these."""
    n, seen = int(history[-1]) + 1, count > 0
    column = lambda test: np.bincount(history[seen & test], minlength=n)
    few = np.stack([column(x == r) for x in (count, lower) for r in range(1, LARGEST + 1)])
    return _total(history, count, n), few, _total(history, np.where(seen & (lower > LARGEST), lower, 0), n)


class Model:
    """Discounts of the three orders. of_counts: of each order, how many n-grams are seen 1 to LARGEST + 1 times; n: training tokens."""

    def __init__(self, of_counts: list[list[int]], n: int):
        self.d = [np.array([0.0, *discounts(x), 1.0]) for x in of_counts]
        freed = sum(r * x * (1 - self.d[0][r]) for r, x in enumerate(of_counts[0][:LARGEST], 1))
        self.n, self.unknown = (n, freed / n) if freed > 0 else (n + 1, 1 / (n + 1))

    def kept(self, order: int, count: np.ndarray) -> np.ndarray:
        return count * self.d[order - 1][np.minimum(count, LARGEST + 1)]

    def p1(self, count: np.ndarray) -> np.ndarray:
        return np.where(count > 0, self.kept(1, count) / self.n, self.unknown)

    def alpha(self, order: int, total: np.ndarray, few: np.ndarray, many: np.ndarray, below: np.ndarray | int) -> np.ndarray:
        """Weight of the order below. below: what that order's counts are divided by."""
        r = np.arange(1, LARGEST + 1)
        own, lower = few[:LARGEST], few[LARGEST:]
        freed = np.where(own.sum(0) == 0, 1.0, ((r - self.kept(order, r))[:, None] * own).sum(0))
        seen = ((self.kept(order - 1, r)[:, None] * lower).sum(0) + many) / np.maximum(below, 1)
        return np.where(total > 0, freed / np.maximum(total, 1) / np.maximum(1 - seen, 1e-300), 1.0)

    def log10(self, c3: np.ndarray, total: np.ndarray, few: np.ndarray, many: np.ndarray) -> np.ndarray:
        """log10 P(w | a b) of trigrams from what Grams.counts gives of them; few and many of those with c3 = 0, in order."""
        p = self.kept(3, c3) / np.maximum(total, 1)
        new = np.flatnonzero(c3 == 0)
        larger, total_b, c2, c1, larger_b = many
        p2 = np.where(c2 > 0, self.kept(2, c2) / np.maximum(total_b, 1), self.alpha(2, total_b, few[2 * LARGEST :], larger_b, self.n) * self.p1(c1))
        p[new] = self.alpha(3, total[new], few[: 2 * LARGEST], larger, total_b) * p2
        return np.log10(np.maximum(p, 1e-300))


def discounts(of_counts: list[int]) -> list[float]:
    """d(1) to d(LARGEST) from the numbers of n-grams seen 1 to LARGEST + 1 times, by Katz."""
    n = [0, *of_counts]
    absolute = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
    common = (LARGEST + 1) * n[LARGEST + 1] / n[1] if n[1] else 1.0
    out = []
    for r in range(1, LARGEST + 1):
        d = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) if n[r] and common < 1 else 0.0
        out.append(d if 0 < d < 1 else (r - absolute) / r)
    return out


def _answer_grams(parts: np.ndarray):
    """Of each trigram of a message what Grams.counts gives; and the range's counts of counts."""

    def run(asked: pa.Table) -> pa.Table:
        range_ = asked.column("range")[0].as_py()
        own = Grams([d.as_buffer() for d in asked.column("data").combine_chunks()])
        total, few, many = own.counts(parts)
        place = np.zeros(len(own.c3), np.int64)
        place[own.new] = np.arange(len(own.new))
        rows = [(range_, STATS, -1, pack_typed(own.stats()))]
        for chunk, which in zip(asked.column("chunk").to_pylist(), np.split(own.which, np.cumsum(own.size)[:-1]), strict=True):
            c3 = own.c3[which]
            new = place[which[c3 == 0]]
            rows.append((chunk, GRAMS, range_, pack_typed(*map(narrow, (c3, total[which], few[:, new].ravel(), many[:, new].ravel())))))
        return pa.Table.from_batches([_rows(rows, _ANSWER)])

    return run


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _finish(common: np.ndarray, n: int, model: Model, train_tokens: int, distinct: int):
    unit = math.log10(train_tokens + distinct + 1)

    def run(chunks: pa.Table, answers: pa.Table) -> pa.Table:
        own, _, c1, _ = _open(chunks, answers, common, n)
        own.grams()
        heard = _heard(answers, GRAMS)
        c3, total = (np.concatenate([h[i] for h in heard]).astype(np.int64) for i in range(2))
        few, many = (np.concatenate([h[i].astype(np.int64).reshape(width, -1) if len(h[i]) else np.zeros((width, 0), np.int64) for h in heard], 1) for i, width in ((2, FEW), (3, MANY)))
        value = model.log10(c3, total, few, many)[own.which]
        c = c1[own.token]
        base, score = (np.add.reduceat(x, own.first) for x in (np.log10(c + 1.0) - unit, value))
        known = np.add.reduceat((c > 0).astype(np.int64), own.first)
        cols = [pa.array(own.ids, mask=own.null), pa.array(own.out), pa.array(own.count), pa.array(known), pa.array(np.full(len(own.ids), train_tokens)), pa.array(base), pa.array(score)]
        return pa.table(cols, [x.split()[0] for x in SCORED.split(", ")])

    return run


def _add(rows: pa.Table) -> pa.Table:
    return pa.table({"data": pa.array([pack_typed(reduce(np.add, (unpack_typed(d.as_buffer())[0] for d in rows.column("data").combine_chunks())))], pa.binary())})


def _added(rows: DataFrame) -> np.ndarray | None:
    """The sum of packed arrays, one of each row, in two steps: 64 of them at most reach the driver."""
    own = [unpack_typed(r.data)[0] for r in rows.groupBy(F.pmod("range", F.lit(64)).alias("part")).applyInArrow(lean(_add, 1), "data binary").collect()]
    return reduce(np.add, own) if own else None


def score(docs: DataFrame, held_out=None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs.

    held_out: a boolean column of docs, or crc32 of doc_id as text, modulo 7, is 2.
    """
    spark = docs.sparkSession
    ship(spark)
    if held_out is None:
        held_out = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(7)) == 2
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), held_out.alias("held_out"))
    sampled = own.select("text").mapInArrow(lean(_common), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(4 * COMMON).collect()
    common = np.unique(np.array([r.word for r in sampled], np.int64).view(U))
    chunks = stage_by(own.mapInArrow(lean(_chunks), "chunk long, bytes long, data binary"), "chunks", "chunk")
    n = max(1, -(-chunks.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0] // RANGE_TEXT))
    chunks = chunks.select("chunk", "data")
    sums = lambda answers, kind: _added(answers.where(F.col("kind") == kind).select(F.col("chunk").alias("range"), "data"))

    asked = chunks.mapInArrow(lean(_ask_words(common, n)), MESSAGE)
    words = stage(asked.groupBy("range").applyInArrow(lean(_answer_words(common, n), 1), ANSWER), "words")
    stats, parts = sums(words, STATS), sums(words, PARTS)
    if stats is None:
        return spark.createDataFrame([], SCORED)
    train_tokens, distinct = int(stats[-2]), int(stats[-1])
    words = words.where(F.col("kind") == WORDS)

    asked = chunks.groupBy("chunk").cogroup(words.groupBy("chunk")).applyInArrow(lean(_ask_grams(common, n), 2), MESSAGE)
    grams = stage(asked.groupBy("range").applyInArrow(lean(_answer_grams(parts.reshape(2 * LARGEST + 2, len(common))), 1), ANSWER), "grams")
    more = sums(grams, STATS)
    width = LARGEST + 3
    of = [stats[:width], stats[width : 2 * width] + more[:width], more[width:]]
    model = Model([x[1 : LARGEST + 2].tolist() for x in of], train_tokens)
    answers = words.unionByName(grams.where(F.col("kind") == GRAMS))
    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(lean(_finish(common, n, model, train_tokens, distinct), 2), SCORED)
