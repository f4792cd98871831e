"""Language identification by word-first backoff.

Words that the model knows are scored by their log frequency in each language; for an unseen word the score backs off to the
longest character n-grams it has in the model, from MAX_GRAM characters down to one.

The model is fitted on labelled texts. Fitting may use a bounded sample: MAX_TRAINING_ROWS rows in equal shares of the languages, as far
as they go, those with the smallest hash of their id, so that the sample is the same on every run. Its vocabulary is bounded by MAX_WORDS
words and MAX_GRAMS n-grams of each length, the most frequent ones, and by MAX_CELLS numbers of all languages together. So the model's
size has a bound whatever the number of languages, and it is sent to the executors as it is.

The words of a batch of texts are found by array operations, and each different word is looked up once.

Cases: texts that are null or have no letter get `und` with score 0; very long texts are scored whole; repeated rows get the
same result; with no labelled rows everything is `und`; an empty table gives an empty table; ties go to the first language
by name. Other columns of the input don't matter.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from simspark.llm.common import give_back, slices, table
from simspark.llm.pretoken import LETTER, character_classes, distinct_spans, gather, span_keys

MAX_TRAINING_ROWS = 6_000
MAX_WORDS, MAX_GRAMS, MAX_GRAM, MAX_CELLS = 60_000, 20_000, 4, 4_000_000
#: Weight of the evidence of an unseen word against a known one, by n-gram.
BACKOFF = 0.4
UNKNOWN = "und"
_WORD = regex.compile(r"\p{L}+")
_BYTES = 1_000_000


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def grams_of(word: str, n: int) -> list[str]:
    padded = f"<{word}>" if n > 1 else word
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


class Model:
    """Log-probability rows, by language, of words and of n-grams; all bounded by the limits above."""

    def __init__(self, languages: list[str], words: dict[str, np.ndarray], grams: list[dict[str, np.ndarray]]):
        self.languages = languages
        tables = [words, *grams]  # tables[n]: n-grams, tables[0]: words
        self.index = [{w: i for i, w in enumerate(t)} for t in tables]
        self.rows = [np.array(list(t.values())).reshape(len(t), len(languages)) for t in tables]
        # n-grams by hash, for many words at once
        self.keys: list[tuple[np.ndarray, np.ndarray]] = []
        for t in tables:
            codes = [np.frombuffer(g.encode("utf-32-le"), np.uint32) for g in t]
            at = np.cumsum([0, *(len(c) for c in codes)])
            key = span_keys(np.concatenate(codes), at[:-1], at[1:]) if codes else np.zeros(0, np.uint64)
            order = np.argsort(key)
            self.keys.append((key[order], order))

    def unseen(self, word: str) -> np.ndarray:
        """Score of a word that isn't known: the mean over the longest n-grams of it that are."""
        for n in range(MAX_GRAM, 0, -1):
            if found := [i for g in grams_of(word, n) if (i := self.index[n].get(g)) is not None]:
                return BACKOFF * self.rows[n][found].sum(axis=0) / len(found)
        return np.zeros(len(self.languages))

    def unseen_words(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """unseen() of each word codes[starts[i]:ends[i]]."""
        out = np.zeros((len(starts), len(self.languages)))
        size = ends - starts
        flat, _ = gather(np.stack([starts, ends], 1).ravel(), codes, np.arange(0, 2 * len(starts), 2))
        begin = np.cumsum(size + 2) - (size + 2)
        padded = np.empty(int((size + 2).sum()), np.uint32)
        inside = np.ones(len(padded), bool)
        inside[begin] = inside[begin + size + 1] = False
        padded[inside], padded[begin], padded[begin + size + 1] = flat, ord("<"), ord(">")
        open_ = np.arange(len(starts))
        for n in range(MAX_GRAM, 0, -1):
            pad = int(n > 1)
            first, count = begin[open_] + 1 - pad, np.maximum(size[open_] + 2 * pad - n + 1, 0)
            word = np.repeat(np.arange(len(open_)), count)
            at = np.arange(len(word)) - np.repeat(np.cumsum(count) - count, count) + first[word]
            keys, order = self.keys[n]
            if len(keys) and len(at):
                h = span_keys(padded, at, at + n)
                place = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                hit = keys[place] == h
                word, row = word[hit], order[place[hit]]
                found = np.bincount(word, minlength=len(open_))
                some = np.flatnonzero(found)
                for k in range(out.shape[1]):
                    total = np.bincount(word, weights=self.rows[n][row, k], minlength=len(open_))
                    out[open_[some], k] = BACKOFF * total[some] / found[some]
                open_ = open_[found == 0]
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """(language, score) of each text."""
        n = len(texts)
        low = [(t or "").lower() for t in texts]
        codes = np.frombuffer("".join(low).encode("utf-32-le"), np.uint32)
        if not self.languages or not len(codes):
            return [UNKNOWN] * n, np.zeros(n)
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in low])])
        letter = character_classes()[codes] == LETTER
        edge = np.zeros(len(codes) + 1, bool)
        edge[offsets] = True
        starts = np.flatnonzero(letter & (np.append(True, ~letter[:-1]) | edge[:-1]))
        ends = np.flatnonzero(letter & (np.append(~letter[1:], True) | edge[1:])) + 1
        if not len(starts):
            return [UNKNOWN] * n, np.zeros(n)
        owner = np.searchsorted(offsets, starts, side="right") - 1
        _, first, back = distinct_spans(codes, starts, ends)
        rows = np.empty((len(first), len(self.languages)))
        a, b = starts[first], ends[first]
        flat, at = gather(np.stack([a, b], 1).ravel(), codes, np.arange(0, 2 * len(a), 2))
        text, at = flat.astype("<u4").tobytes().decode("utf-32-le"), at.tolist()
        index = self.index[0].get
        known = np.array([index(text[x:y], -1) for x, y in zip(at, at[1:])], np.int64)
        new = np.flatnonzero(known < 0)
        rows[known >= 0] = self.rows[0][known[known >= 0]]
        rows[new] = self.unseen_words(codes, a[new], b[new])
        words = np.bincount(owner, minlength=n)
        total = np.stack([np.bincount(owner, weights=rows[back, k], minlength=n) for k in range(len(self.languages))], 1)
        # the evidence of neighbouring words isn't independent: the posterior is taken over the root of their number
        total *= 3.0 / np.sqrt(np.maximum(words, 1))[:, None]
        p = np.exp(total - total.max(axis=1, keepdims=True))
        best = np.argmax(total, axis=1)
        score = p[np.arange(n), best] / p.sum(axis=1)
        return [self.languages[k] if w else UNKNOWN for k, w in zip(best.tolist(), words.tolist())], np.where(words > 0, score, 0.0)


def fit(df: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", max_rows: int = MAX_TRAINING_ROWS) -> Model:
    """Fit on the rows of df with a language. Counting runs on the executors; the driver gets the bounded vocabulary only."""
    labelled = df.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    h = F.xxhash64(F.col(id_col).cast("string"), F.lit(8)).alias("h")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    first = labelled.select(F.col(lang_col).alias("lang"), h).withColumn("rank", rank).where(F.col("rank") <= max_rows)
    bounds = first.orderBy("rank", "h").limit(max_rows).groupBy("lang").agg(F.max("h").alias("bound"))
    # max_rows languages at most, so this goes to the executors
    sample = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), h).join(F.broadcast(bounds), "lang").where("h <= bound").select("text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, str], Counter] = defaultdict(Counter)
        for batch in batches:
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                seen[0, lang].update(words_of(text))
        for (_, lang), counts in list(seen.items()):
            for word, k in counts.items():
                for n in range(1, MAX_GRAM + 1):
                    c = seen[n, lang]
                    for g in grams_of(word, n):
                        c[g] += k
        for (n, lang), counts in seen.items():
            yield pa.RecordBatch.from_pydict({"n": pa.array([n] * len(counts), pa.int32()), "lang": [lang] * len(counts), "item": list(counts), "k": pa.array(list(counts.values()), pa.int64())})

    counts = sample.mapInArrow(count, "n int, lang string, item string, k long").groupBy("n", "item", "lang").agg(F.sum("k").alias("k")).persist()
    try:
        totals = {(r["n"], r["lang"]): (r["k"], r["m"]) for r in counts.groupBy("n", "lang").agg(F.sum("k").alias("k"), F.count("*").alias("m")).collect()}
        languages = sorted({lang for _, lang in totals})
        tables: list[dict[str, np.ndarray]] = []
        share = max(100, MAX_CELLS // ((MAX_GRAM + 1) * max(1, len(languages))))
        for n in range(MAX_GRAM + 1):
            best = counts.where(F.col("n") == n).groupBy("item").agg(F.sum("k").alias("all"), F.collect_list(F.struct("lang", "k")).alias("by")).where(F.col("all") >= (2 if n == 0 else 1)).orderBy(F.desc("all"), "item").limit(min(share, MAX_WORDS if n == 0 else MAX_GRAMS))
            rows = {}
            distinct = max((totals.get((n, x), (0, 0))[1] for x in languages), default=1)
            for r in best.collect():
                by = dict(r["by"])
                # add-half smoothing; only the differences between languages count, so each row is centred
                row = np.log(np.array([(by.get(x, 0) + 0.5) / (totals.get((n, x), (0, 0))[0] + 0.5 * distinct) for x in languages]))
                rows[r["item"]] = row - row.mean()
            tables.append(rows)
    finally:
        counts.unpersist()
    return Model(languages, tables[0], tables[1:])


def predict(df: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None, carry_text: bool = False) -> DataFrame:
    """The columns `keep` of df, and the text if carry_text, with lang_pred and score of each whole text."""
    keep = [c for c in df.columns if c != text_col] if keep is None else keep
    sent = df.sparkSession.sparkContext.broadcast(model)
    # columns go by number, as any name may be taken
    kept = df.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)), F.col(text_col).alias("text"))
    sent_back = [f for f in kept.schema if carry_text or f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for whole in batches:
            for batch in slices(whole, "text", _BYTES):
                found, score = model.predict(batch.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in sent_back), pa.array(found, pa.string()), pa.array(score, pa.float64())], [*(f.name for f in sent_back), "lang_pred", "score"])
        give_back()

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in sent_back)
    out = kept.mapInArrow(run, f"{schema}, lang_pred string, score double" if schema else "lang_pred string, score double")
    names = {f"c{i}": c for i, c in enumerate(keep)} | {"text": text_col}
    return out.select(*(F.col(f.name).alias(names[f.name]) for f in sent_back), "lang_pred", "score")


def held_out(id_col: str = "doc_id") -> Column:
    """Rows kept from training: crc32 of the id as text, modulo 3, is 1. A null id counts as held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(True))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out()))
    found = predict(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
