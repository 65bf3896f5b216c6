"""Language identification: multinomial logistic regression on TF-IDF character n-grams.

Counts of hashed letter n-grams (1 to 3) are weighed by inverse document frequencies over all training documents. The
weights come from FTRL with elastic-net penalties on a bounded sample of labelled rows (``sample_rows``, shared out
evenly between the languages); a fifth of the sample sets the temperature. Every text is read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fennwick.llm.common import bound_batches, spread, table
from fennwick.llm.ftrl import FTRL, Row, scores, softmax, temperature

DIM_BITS = 15
SAMPLE_ROWS = 3000
UNKNOWN = "und"
#: Code points that are turned into n-grams at once; bounds the memory of a very long text.
CHUNK = 1 << 20

_letters: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    """Which code points of the basic plane are letters, by Python's rule."""
    global _letters
    if _letters is None:
        _letters = np.array([chr(c).isalpha() for c in range(1 << 16)])
    return _letters


def ngram_counts(text: str, dim_bits: int = DIM_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of a text (distinct numbers, counts); no letters, no n-grams. Other characters part words."""
    known, total = _letter_table(), np.zeros(1 << dim_bits, np.int64)
    shift, last = np.uint32(32 - dim_bits), np.full(2, 32, np.uint32)
    text, any_letter = text.lower(), False
    for at in range(0, len(text), CHUNK):
        c = np.frombuffer(text[at : at + CHUNK].encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint32)
        letter = known[np.minimum(c, 0xFFFF)]
        for odd in np.unique(c[c > 0xFFFF]):
            letter[c == odd] = chr(odd).isalpha()
        c = np.where(letter, c, np.uint32(32))
        any_letter |= bool(letter.any())
        c = np.concatenate([last, c])
        fresh = np.ones(len(c), bool)
        fresh[2:] = (c[2:] != 32) | (c[1:-1] != 32)
        c = c[fresh]
        a, b, d = c[:-2], c[1:-1], c[2:]
        # Odd multipliers of the multiplicative hash.
        one = d * np.uint32(2654435761)
        two = one + b * np.uint32(2246822519)
        three = two + a * np.uint32(3266489917)
        for h in (one + np.uint32(1), two + np.uint32(668265263), three):
            total += np.bincount((h * np.uint32(2654435761)) >> shift, minlength=len(total))
        last = c[-2:]
    if not any_letter:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    idx = np.flatnonzero(total)
    return idx, total[idx]


def weigh(idx: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> Row:
    x = (1 + np.log(counts)) * idf[idx] if len(idx) else np.zeros(0)
    norm = np.sqrt((x * x).sum())
    return idx, x / norm if norm else x


def training_rows(docs: DataFrame) -> DataFrame:
    """(text, lang, fold, pick) of the rows that may be learned from: id and lang known, crc32 of the id not 0 modulo 5."""
    code = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    known = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & (code % 5 != 0))
    return known.select("text", "lang", code.alias("code"), (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))).alias("pick"))


def document_frequencies(rows: DataFrame, dim_bits: int) -> np.ndarray:
    """Documents that hold each n-gram; a partition sends one row for each n-gram at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << dim_bits, np.int64)
        for batch in batches:
            for text in batch.column(0):
                total[ngram_counts(text.as_py(), dim_bits)[0]] += 1
        idx = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(idx.astype(np.int32)), pa.array(total[idx])], names=["feature", "n"])

    out = np.zeros(1 << dim_bits)
    for r in rows.select("text").mapInArrow(count, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect():
        out[r["feature"]] = r["n"]
    return out


class LanguageModel:
    def __init__(self, langs: list[str], weights: np.ndarray, idf: np.ndarray, heat: float, dim_bits: int):
        self.langs, self.weights, self.idf, self.heat, self.dim_bits = langs, weights, idf, heat, dim_bits

    def predict(self, text: str | None) -> tuple[str, float]:
        idx, counts = ngram_counts(text or "", self.dim_bits)
        if not len(idx) or not self.langs:
            return UNKNOWN, 0.0
        p = softmax(scores([weigh(idx, counts, self.idf)], self.weights)[0] / self.heat)
        return self.langs[int(p.argmax())], float(p.max())


def train(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, dim_bits: int = DIM_BITS) -> LanguageModel:
    """Fit on ``docs`` (doc_id, text, lang). No usable rows give a model that answers ``und``."""
    bound_batches(docs.sparkSession)
    rows = training_rows(docs)
    by_lang = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row for each language
    langs = sorted(by_lang)
    if not langs:
        return LanguageModel([], np.zeros((1, 0)), np.zeros(1 << dim_bits), 1.0, dim_bits)
    quota = max(1, sample_rows // len(langs))
    share = F.create_map(*[x for g in langs for x in (F.lit(g), F.lit(quota / by_lang[g]))])
    total = sum(by_lang.values())
    df = document_frequencies(rows, dim_bits)
    idf = np.where(df > 0, np.log((1 + total) / (1 + df)) + 1, 0.0)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, lang, code in zip(*(batch.column(i).to_pylist() for i in range(3))):
                idx, counts = ngram_counts(text, dim_bits)
                yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([code]), pa.array([idx.astype("<u4").tobytes()]), pa.array([counts.astype("<u4").tobytes()])], names=["lang", "code", "idx", "counts"])

    sample = rows.where(F.col("pick") < share[F.col("lang")]).select("text", "lang", "code").limit(2 * sample_rows)
    got = sorted(sample.mapInArrow(features, "lang string, code long, idx binary, counts binary").collect(), key=lambda r: (r["code"], r["lang"], bytes(r["idx"])))
    read = lambda b: np.frombuffer(bytes(b), "<u4").astype(np.int64)
    x, y = [weigh(read(r["idx"]), read(r["counts"]), idf) for r in got], np.array([langs.index(r["lang"]) for r in got])
    held = np.arange(len(x)) % 5 == 4
    model = FTRL(1 << dim_bits, len(langs), alpha=1.0, l1=0.02, l2=0.1).fit([r for r, h in zip(x, held) if not h], y[~held])
    heat = temperature(scores([r for r, h in zip(x, held) if h], model.weights()), y[held])
    return LanguageModel(langs, model.weights(), idf, heat, dim_bits)


def predict(docs: DataFrame, model: LanguageModel, text: str = "text") -> Column:
    """struct(lang_pred, score) of each row: ``und`` and 0 if the text is null or has no letter."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # 2**dim_bits weights for each language

    @F.pandas_udf("lang_pred string, score double")
    def of(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([held.value.predict(t) for t in texts], columns=["lang_pred", "score"])

    return of(F.col(text))


def op5_langid(spark, sf_dir: str) -> DataFrame:
    """Predicted language of every document, learned from the rows that are not held out."""
    docs = spread(table(spark, sf_dir, "documents")).select("doc_id", "text", "lang")
    model = train(docs)
    code = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    out = docs.select("doc_id", F.coalesce(code % 5 == 0, F.lit(True)).alias("held_out"), predict(docs, model).alias("p"))
    return out.select("doc_id", "held_out", "p.lang_pred", "p.score")
