"""Language identification: word-first backoff.

A word known from training scores by its per-language log frequency; an unseen word falls back to its character 5-grams,
then 4-, 3-, 2- and 1-grams: the longest order of which any gram is known scores it. A text's language is the one of
the highest sum over its words; the score is that language's posterior share.

The model is fitted on a bounded sample of labelled rows, about `FIT_DOCS` documents of each language by hash of doc_id;
all their words and grams are counted, in Spark, and kept. Prediction uses the text alone.

Null texts and texts without a letter: `und`, score 0. With nothing to learn from, every text is `und`. Rows with null
doc_id are held out (their id reads as empty, whose CRC is 0). Repeated rows: each is predicted. Other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siglake.llm.common import small_batches, written

FIT_DOCS, ORDERS = 1500, (5, 4, 3, 2, 1)
MEMO_WORDS = 200_000
UND = "und"
_word = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """Runs of letters; numerals such as fractions and Roman ones are none."""
    words = _word.findall(text.lower()) if text else []
    if not words or text.isascii() or all(map(str.isalpha, words)):
        return words
    return "".join(c if c.isalpha() else " " for c in " ".join(words)).split()


def grams(word: str, order: int) -> list[str]:
    padded = f"<{word}>"
    return [padded[i : i + order] for i in range(len(padded) - order + 1)]


class Model:
    """Log frequencies of words and grams, a row of languages each."""

    def __init__(self, words: pa.Table, parts: pa.Table):
        """Counts n by key and lang: of words, and of their grams of all orders."""
        self.own: Scorer | None = None
        self.langs = sorted(set(words["lang"].to_pylist()))
        names, counts = self._counts(words)
        grams_, of_grams = self._counts(parts)
        order = np.fromiter(map(len, grams_), dtype=np.int64, count=len(grams_))
        logs = np.zeros_like(of_grams)
        for k in ORDERS:
            logs[order == k] = self._logs(of_grams[order == k])
        self.word_logs, self.gram_logs = self._logs(counts), logs
        self.words = {w: i for i, w in enumerate(names)}
        self.grams = {g: i for i, g in enumerate(grams_)}

    def _counts(self, t: pa.Table) -> tuple[list[str], np.ndarray]:
        key = t["key"].combine_chunks().dictionary_encode()
        out = np.zeros((len(key.dictionary), len(self.langs)))
        at = np.searchsorted(np.array(self.langs, dtype=object), t["lang"].to_numpy()) if t.num_rows else np.zeros(0, dtype=np.int64)
        np.add.at(out, (key.indices.to_numpy(), at), t["n"].to_numpy())
        return key.dictionary.to_pylist(), out

    @staticmethod
    def _logs(m: np.ndarray) -> np.ndarray:
        return np.log((m + 0.5) / (m.sum(0) + 0.5 * max(1, len(m))))

    def unseen(self, word: str) -> np.ndarray:
        """Log frequencies of a word that isn't known, by its longest known parts."""
        for order in ORDERS:
            if found := [x for g in grams(word, order) if (x := self.grams.get(g)) is not None]:
                return self.gram_logs[found].mean(axis=0)
        return np.zeros(len(self.langs))

    def scorer(self) -> Scorer:
        """The one scorer of this process, which takes over the words: its memo outlives a task."""
        if self.own is None:
            self.own = Scorer(self)
            self.words = self.word_logs = None
        return self.own


class Scorer(dict):
    """Word -> row of a growing matrix: the known words, then a memo of unseen ones, which is emptied when full."""

    def __init__(self, model: Model):
        super().__init__(model.words)
        self.model, self.known, self.unseen = model, len(model.words), []
        self.rows = np.concatenate([model.word_logs, np.zeros((1024, len(model.langs)))])

    def __missing__(self, word: str) -> int:
        k = len(self)
        if k == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros((k // 4, len(self.model.langs)))])
        self.rows[k] = self.model.unseen(word)
        self[word] = k
        self.unseen.append(word)
        return k

    def predict(self, text: str | None) -> tuple[str, float, int, int]:
        """Language, score, number of words, and how many of them are known."""
        words = words_of(text)
        if not words or not self.model.langs:
            return UND, 0.0, len(words), 0
        if len(self.unseen) > MEMO_WORDS:
            for w in self.unseen:
                del self[w]
            self.unseen.clear()
        total, known = np.zeros(len(self.model.langs)), 0
        for i in range(0, len(words), 50_000):
            part = words[i : i + 50_000]
            at = np.fromiter(map(self.__getitem__, part), dtype=np.int64, count=len(part))
            total += self.rows[at].sum(axis=0)
            known += int((at < self.known).sum())
        share = np.exp(total - total.max())
        best = int(np.argmax(total))
        return self.model.langs[best], float(share[best] / share.sum()), len(words), known


COUNTED = "key string, lang string, n long"


def _counted(n: Counter) -> pa.RecordBatch:
    keys = list(n)
    return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(list(n.values()), pa.int64())], ["key", "lang", "n"])


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n: Counter = Counter()
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            n.update((w, lang) for w in words_of(text))
        yield _counted(n)


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n: Counter = Counter()
        for word, lang, k in zip(*(c.to_pylist() for c in b.columns), strict=True):
            for order in ORDERS:
                for g in grams(word, order):
                    n[g, lang] += k
        yield _counted(n)


def fit(train: DataFrame, fit_docs: int = FIT_DOCS) -> Model:
    """train: doc_id, text, lang. Each language gives fit_docs rows or so, those of least hash."""
    train = train.where("text is not null and lang is not null").select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    per_lang = {r["lang"]: r["count"] for r in train.groupBy("lang").count().collect()}
    share = F.create_map(*[F.lit(x) for lang, n in per_lang.items() for x in (lang, min(1.0, fit_docs / n))]) if per_lang else F.create_map(F.lit(""), F.lit(0.0))
    drawn = train.where(F.pmod(F.xxhash64(F.col("doc_id")), F.lit(1_000_003)) < F.element_at(share, F.col("lang")) * 1_000_003)
    added = lambda df: df.groupBy("key", "lang").agg(F.sum("n").alias("n"))
    words = written(added(drawn.select("lang", "text").mapInArrow(_count_words, COUNTED)), "language-words")
    return Model(words.toArrow(), added(words.mapInArrow(_count_grams, COUNTED)).toArrow())


def held_out() -> F.Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def predictions(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shared.value.scorer()
        for b in batches:
            out = [scorer.predict(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(predict, "doc_id long, lang_pred string, score double")


def language_id(docs: DataFrame, fit_docs: int = FIT_DOCS) -> DataFrame:
    """Learns from the rows that are not held out, predicts all."""
    small_batches(docs.sparkSession)
    model = fit(docs.where(~held_out()), fit_docs)
    return predictions(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, min_score: float = 0.5, min_known: float = 0.2, min_words: int = 10) -> DataFrame:
    """Rows of docs whose language is identified, with all their columns; a row keeps its own text as evidence.

    Rejected: texts without a letter, texts whose best language has a posterior below min_score, and texts of min_words
    words or more of which less than min_known are known. The posterior grows with length whatever the language, the
    share of known words doesn't; so it tells texts of a language that wasn't learned.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs.where(~held_out())))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shared.value.scorer()
        for b in batches:
            found = [scorer.predict(t) for t in b.column(b.schema.get_field_index("text")).to_pylist()]
            yield b.filter(pa.array([lang != UND and score >= min_score and (n < min_words or known >= min_known * n) for lang, score, n, known in found], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


