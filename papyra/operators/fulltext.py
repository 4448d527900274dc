"""Full-text search: tokenizers, postings, ranked and phrase search as DataFrame plans."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import quoted

MIN_BYTES, MAX_BYTES = 1, 256
#: Of a stored index: their postings take some 150 MB of memory to sort and 15 MB of disk.
WORDS_A_FILE = 2 << 20
#: The range of characters that are written without spaces.
HAN_LOW, HAN_HIGH = 0x4E00, 0x9FFF
_HAN = "[\\u4E01-\\u9FFE]"
#: Letters, digits and all above HAN_LOW; a half of a surrogate pair is none.
_GOOD = "[\\p{L}\\p{N}\\x{4E01}-\\x{D7FF}\\x{E000}-\\x{10FFFF}]"

Tokenizer = Callable[[Column], Column]


def _sized(tokens: Column, low: int, high: int) -> Column:
    return F.filter(tokens, lambda x: (F.octet_length(x) >= low) & (F.octet_length(x) <= high))


def simple(text: Column, low: int = MIN_BYTES, high: int = MAX_BYTES) -> Column:
    """Lower-case words between white space, of low to high bytes."""
    words = F.split(F.lower(F.trim(text)), "\\s+")
    if low > 1 or high < 4:
        return _sized(words, max(low, 1), high)
    # words of a quarter of the bytes are short enough in any script, and no word has to be looked at
    return F.when(text.rlike(f"\\S{{{high // 4 + 1}}}"), _sized(words, 1, high)).otherwise(F.array_remove(words, ""))


def ngrams(text: Column) -> Column:
    """All pairs of neighbouring characters that are letters, digits or above HAN_LOW, then all such characters, in lower case. Time grows with the text's length."""
    pairs, each = (F.regexp_extract_all(text, F.lit(pattern), 1) for pattern in (f"(?=({_GOOD}{_GOOD}))", f"({_GOOD})"))
    return F.transform(F.concat(pairs, each), F.lower)


def mixed(text: Column, low: int = MIN_BYTES, high: int = MAX_BYTES) -> Column:
    """Runs of letters and digits as words; of Han text each character, after the pair it closes. Time grows with the text's length."""
    parts = F.regexp_extract_all(F.lower(text), F.lit(f"({_HAN}+|[\\p{{L}}\\p{{N}}&&[^\\u4E01-\\u9FFE]]+)"), 1)

    def spread(run: Column) -> Column:
        chars = F.filter(F.split(run, ""), lambda x: x != "")
        before = F.slice(F.concat(F.array(F.lit("")), chars), 1, F.size(chars))
        each = F.zip_with(chars, before, lambda c, b: F.when(b != "", F.array(F.concat(b, c), c)).otherwise(F.array(c)))
        return F.when(run.rlike(f"^{_HAN}"), F.flatten(each)).otherwise(F.array(run))

    return _sized(F.flatten(F.transform(parts, spread)), low, high)


class TextIndex:
    """An inverted index over a text column: term, document, frequency, positions, and each document's length.

    A document's words are sorted and grouped inside its own array, one document at a time: no table of all words is
    shuffled, sorted or hashed.
    """

    def __init__(self, df: DataFrame, key: str, text: str, tokenizer: Tokenizer = simple):
        self.tokenizer, self.key = tokenizer, key
        self.raw = df.select(quoted(key).alias("doc"), quoted(text).alias("text"))
        self.docs = df.select(quoted(key).alias("doc"), self._tokens(quoted(text)).alias("tokens")).withColumn("length", F.size("tokens").cast("long"))

    def _tokens(self, text: Column) -> Column:
        return F.coalesce(self.tokenizer(text), F.array().cast("array<string>"))

    def words(self) -> DataFrame:
        """doc and words, each a term and its position: what moves is each text, once; a document that comes several times is one with several texts."""
        texts = self.raw.repartition("doc").groupBy("doc").agg(F.collect_list("text").alias("texts"))
        return texts.select("doc", F.flatten(F.transform("texts", lambda t: _placed(self._tokens(t)))).alias("words"))

    def postings(self) -> DataFrame:
        """term, doc, length, frequency and positions: a row for each document and term that it holds."""
        return _grouped(self.words(), "doc")

    def write(self, path: str) -> None:
        """Documents with their lengths, and postings of each text: each file holds those of WORDS_A_FILE words or so, sorted by term,
        so that a search reads the pages of its terms only, and a task sorts what fits its memory. "row" tells texts of one document apart."""
        self.docs.select("doc", "length").write.mode("overwrite").parquet(f"{path}/docs")
        words = self.docs.sparkSession.read.parquet(f"{path}/docs").agg(F.sum("length")).first()[0] or 0
        texts = self.raw.repartition(words // WORDS_A_FILE + 1, "doc").select("doc", F.monotonically_increasing_id().alias("row"), _placed(self._tokens(F.col("text"))).alias("words"))
        _grouped(texts, "doc", "row").sortWithinPartitions("term", "doc").write.mode("overwrite").parquet(f"{path}/postings")

    def without(self, ids: Sequence) -> TextIndex:
        """The index after documents are deleted."""
        out = TextIndex.__new__(TextIndex)
        out.tokenizer, out.key = self.tokenizer, self.key
        out.docs, out.raw = (x.where(~F.coalesce(F.col("doc").isin(list(ids)), F.lit(False))) for x in (self.docs, self.raw))
        return out

    def terms(self, query: str) -> list[str]:
        spark = self.docs.sparkSession
        return _terms(spark, self.tokenizer, query)

    def search(self, query: str, limit: int | None = None) -> DataFrame:
        """doc and score: over the query's terms, repeated ones each time, frequency / length * (ln(N / documents with it) + 1)."""
        terms = self.terms(query)
        distinct = sorted(set(terms))
        if not distinct:
            return self.docs.select("doc", F.lit(0.0).alias("score")).where(F.lit(False))
        # a row for each document and term that it holds; the words are looked at once, in texts that may hold a term
        docs = self.docs
        if self.tokenizer is simple:
            low = F.lower(F.col("text"))
            may = reduce(lambda a, b: a | b, (F.contains(low, F.lit(w)) for w in distinct))
            docs = self.raw.where(may).select("doc", simple(F.col("text")).alias("tokens")).withColumn("length", F.size("tokens").cast("long"))
        held = F.array(*(F.struct(F.lit(w).alias("term"), F.lit(terms.count(w)).alias("times"), (F.size("tokens") - F.size(F.array_remove("tokens", w))).cast("long").alias("frequency")) for w in distinct))
        return _ranked(docs.select("doc", "length", F.inline(held)).where("frequency > 0"), self.raw, limit)

    def phrase(self, query: str) -> DataFrame:
        """doc of each document in which the query's terms stand next to each other."""
        terms = self.terms(query)
        if not terms:
            return self.docs.select("doc").where(F.lit(False))
        words = F.array(*map(F.lit, terms))
        n, docs = len(terms), self.docs
        if self.tokenizer is simple:  # only texts that hold all terms are tokenized
            low = F.lower(F.col("text"))
            docs = self.raw.where(reduce(lambda a, b: a & b, (F.contains(low, F.lit(w)) for w in sorted(set(terms)))))
            docs = docs.select("doc", simple(F.col("text")).alias("tokens")).withColumn("length", F.size("tokens").cast("long"))
        starts = F.filter(F.sequence(F.lit(1), F.col("length").cast("int") - n + 1), lambda i: F.slice("tokens", i, n) == words)
        near = docs.where((F.col("length") >= n) & F.array_contains("tokens", terms[0]))
        return near.where(F.size(starts) > 0).select("doc")

    def stats(self) -> DataFrame:
        """terms, docs and the average length."""
        terms = self.docs.select(F.explode("tokens").alias("term")).agg(F.count_distinct("term").alias("terms"))
        docs = self.docs.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.avg("length"), F.lit(0.0)).alias("average_length"))
        return terms.crossJoin(docs)  # one row each


def _placed(tokens: Column) -> Column:
    return F.transform(tokens, lambda x, i: F.struct(x.alias("term"), i.alias("position")))


def _runs(docs: DataFrame, *keys: str) -> DataFrame:
    """docs: keys and words. Keys, length, words sorted, and starts, where another term begins."""
    docs = docs.select(*keys, F.sort_array("words").alias("words"))
    at = F.filter(F.transform("words", lambda _, i: i), lambda i: (i == 0) | (F.get("words", i)["term"] != F.get("words", i - 1)["term"]))
    return docs.select(*keys, F.size("words").cast("long").alias("length"), "words", at.alias("starts"))  # length here: rows made of the array must not carry it


def _run(start: Column, k: Column) -> tuple[Column, Column]:
    """Term and frequency of the run that is number k."""
    return F.get("words", start)["term"].alias("term"), F.coalesce(F.get("starts", k + 1), F.size("words")) - start


def _grouped(docs: DataFrame, *keys: str) -> DataFrame:
    """A row for each document and term."""

    def posting(start: Column, k: Column) -> Column:
        term, n = _run(start, k)
        return F.struct(term, n.cast("long").alias("frequency"), F.slice("words", start + 1, n)["position"].alias("positions"))

    return _runs(docs, *keys).select(*keys, "length", F.inline(F.transform("starts", posting))).select("term", *keys, "length", "frequency", "positions")


def _ranked(hits: DataFrame, docs: DataFrame, limit: int | None) -> DataFrame:
    """doc and score of hits: doc, length, term, times (in the query) and frequency (in the document)."""
    of = hits.groupBy(F.col("term").alias("of")).agg(F.count(F.lit(1)).alias("holders"))  # a row for each term of the query
    found = hits.join(F.broadcast(of), F.col("term") == F.col("of")).crossJoin(F.broadcast(docs.agg(F.count(F.lit(1)).alias("n"))))  # one row
    score = F.sum(F.col("times") * F.col("frequency") / F.col("length") * (F.log(F.col("n") / F.col("holders")) + 1))
    out = found.groupBy("doc").agg(score.alias("score")).orderBy(F.desc("score"), "doc")
    return out if limit is None else out.limit(limit)


class StoredText:
    """What TextIndex.write has written: searches read the postings of their terms and tokenize nothing but the query."""

    def __init__(self, spark: SparkSession, path: str, tokenizer: Tokenizer = simple):
        self.spark, self.tokenizer = spark, tokenizer
        postings, self.docs = spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/docs")
        self.postings = postings if "row" in postings.columns else postings.withColumn("row", F.lit(0))  # of an index that was written before texts were told apart

    def _of(self, terms: list[str]) -> DataFrame:
        return self.postings.where(F.col("term").isin(sorted(set(terms))))

    def search(self, query: str, limit: int | None = None) -> DataFrame:
        terms = _terms(self.spark, self.tokenizer, query)
        times = F.lit(0)
        for w in sorted(set(terms)):
            times = F.when(F.col("term") == w, terms.count(w)).otherwise(times)
        return _ranked(self._of(terms).select("doc", "length", "term", "frequency", times.alias("times")), self.docs, limit)

    def phrase(self, query: str) -> DataFrame:
        """Each place of a term, less the term's places in the query, is a start; a phrase stands where all its terms agree."""
        terms = _terms(self.spark, self.tokenizer, query)
        if not terms:
            return self.docs.select("doc").where(F.lit(False))
        at = F.lit(None).cast("array<int>")
        for w in sorted(set(terms)):
            at = F.when(F.col("term") == w, F.array(*(F.lit(k) for k, x in enumerate(terms) if x == w))).otherwise(at)
        starts = self._of(terms).select("doc", "row", F.explode(at).alias("k"), "positions").select("doc", "row", F.explode(F.transform("positions", lambda p: p - F.col("k"))).alias("start"))
        return starts.where("start >= 0").groupBy("doc", "row", "start").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(terms)).select("doc", "row").distinct().select("doc")

    def stats(self) -> DataFrame:
        terms = self.postings.agg(F.count_distinct("term").alias("terms"))
        return terms.crossJoin(self.docs.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.avg("length"), F.lit(0.0)).alias("average_length")))  # one row each


def _terms(spark: SparkSession, tokenizer: Tokenizer, query: str) -> list[str]:
    return list(spark.range(1).select(tokenizer(F.lit(query)).alias("t")).first().t or [])


def top_terms(index: TextIndex, n: int) -> DataFrame:
    """The n most frequent terms of each document: a report. They are chosen inside the document's array; no other term gets a row."""

    def counted(start: Column, k: Column) -> Column:
        term, frequency = _run(start, k)
        return F.struct((-frequency.cast("long")).alias("less"), term)

    most = F.slice(F.sort_array(F.transform("starts", counted)), 1, max(n, 0))
    found = _runs(index.words(), "doc").select("doc", F.posexplode(most).alias("place", "of"))
    return found.select("doc", F.col("of.term").alias("term"), (-F.col("of.less")).alias("frequency"), (F.col("place") + 1).alias("rank"))
