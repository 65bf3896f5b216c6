"""Quality by co-training: one classifier reads the text, one the page's metadata.

A bounded sample of labelled rows (``sample_rows``) starts both. In each round either classifier scores all unlabelled
documents; those of which it is surest, the same number of each class, teach the other. Each view is then calibrated on
labelled rows kept back, a logistic combination of both is fitted there, and every document is scored. A document is
good if its quality is 1 and it is not toxic.

Documents become features once: they are written to the shared folder, and rounds and scores read them, not the texts.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fennwick.llm.common import bound_batches, materialize, small_table, spread, table
from fennwick.llm.ftrl import FTRL, Row

DIM_BITS = 17
META_BITS = 12
SAMPLE_ROWS = 6000
ROUNDS = 3
SURE = 0.98
#: Documents of each class that a view hands to the other in a round, as a share of the labelled rows.
EXCHANGE = 1 / 60
FIRST_EPOCHS, MORE_EPOCHS = 6, 2
META = ("lang", "source", "n_chars")
_TOKEN = re.compile(r"\w+|[^\w\s]+")


def _hashed(names: list[str], bits: int) -> Row:
    idx = np.unique(np.fromiter((zlib.crc32(n.encode("utf-8", "replace")) for n in names), np.int64, len(names)) & ((1 << bits) - 1))
    return idx, np.ones(len(idx))


def _bucket(name: str, value: float, steps: int = 10) -> str:
    return f"\x00{name}={int(value * steps)}"


def text_features(text: str | None) -> Row:
    """Distinct tokens of the whole text, and buckets of its shape."""
    tokens = _TOKEN.findall(text or "")
    distinct = set(map(str.lower, set(tokens)))
    n = max(1, len(tokens))
    words = [t for t in tokens if t[0].isalnum()]
    upper, marks = sum(map(str.isupper, words)), n - len(words)
    shape = [
        _bucket("tokens", np.log2(n + 1), 1), _bucket("upper", upper / max(1, len(words))), _bucket("marks", marks / n), _bucket("distinct", len(distinct) / n),
        _bucket("length", min(20.0, sum(map(len, words)) / max(1, len(words))), 1),
    ]
    return _hashed([*distinct, *shape], DIM_BITS)


def meta_features(lang: str | None, source: str | None, n_chars: int | None) -> Row:
    size = "none" if n_chars is None else str(int(np.log2(max(0, n_chars) + 1)))
    names = [f"lang={lang}", f"source={source}", f"size={size}", f"{lang}/{size}", f"{source}/{lang}"]
    return _hashed(names, META_BITS)


def pack(idx: np.ndarray) -> bytes:
    """Sorted feature numbers below 2**17 in two bytes each: how many lie below 2**16, then the low halves."""
    return int(np.searchsorted(idx, 1 << 16)).to_bytes(4, "little") + (idx & 0xFFFF).astype("<u2").tobytes()


def unpack(body: bytes) -> np.ndarray:
    idx = np.frombuffer(body, "<u2", offset=4).astype(np.int64)
    idx[int.from_bytes(body[:4], "little") :] += 1 << 16
    return idx


def _row(body: bytes) -> Row:
    idx = unpack(body)
    return idx, np.ones(len(idx))


def _line(weights: np.ndarray) -> np.ndarray:
    """Weights of the margin between good and bad, the intercept last."""
    return weights[:, 1] - weights[:, 0]


def _margin(rows: list[Row], line: np.ndarray) -> np.ndarray:
    return np.array([line[idx].sum() + line[-1] for idx, _ in rows], dtype=float)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Coefficients (intercept last) of a small logistic regression, by Newton's method."""
    a = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w))
        step = np.linalg.solve(h, a.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _prob(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class QualityModel:
    """Margin weights of both views, their calibrations (slope, intercept) and the combination."""

    def __init__(self, lines: dict[str, np.ndarray], cals: dict[str, np.ndarray], joint: np.ndarray | None = None):
        self.lines, self.cals, self.joint = lines, cals, joint

    def margins(self, texts: list[Row], metas: list[Row]) -> tuple[np.ndarray, np.ndarray]:
        """Calibrated log-odds of each view."""
        return tuple(_margin(rows, self.lines[v]) * self.cals[v][0] + self.cals[v][1] for v, rows in (("text", texts), ("meta", metas)))

    def score(self, texts: list[Row], metas: list[Row]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = self.margins(texts, metas)
        return _prob(a), _prob(b), _prob(np.column_stack([a, b, np.ones(len(a))]) @ self.joint)


#: Hands out (view that is sure, label, text row, meta row) for a model and the round's number.
Picker = Callable[[QualityModel, int], list[tuple[str, int, Row, Row]]]


def co_train(texts: list[Row], metas: list[Row], y: np.ndarray, pick: Picker, rounds: int = ROUNDS) -> QualityModel:
    """Rounds of training and exchange; every fourth labelled row is kept back for calibration.

    After the first fit the classifiers go on learning from where they are, over their own rows and those handed to them.
    """
    held = np.arange(len(y)) % 4 == 3
    keep = lambda rows, m: [r for r, k in zip(rows, m) if k]
    sets = {"text": (keep(texts, ~held), y[~held]), "meta": (keep(metas, ~held), y[~held])}
    back = {"text": keep(texts, held), "meta": keep(metas, held)}
    learners = {"text": FTRL(1 << DIM_BITS, 2, alpha=0.5, l1=3.0, l2=0.1), "meta": FTRL(1 << META_BITS, 2, alpha=0.5, l1=3.0, l2=0.1)}
    model = QualityModel({}, {})
    for turn in range(rounds + 1):
        for view, learner in learners.items():
            learner.fit(*sets[view], epochs=MORE_EPOCHS if turn else FIRST_EPOCHS, seed=1 + turn)
            model.lines[view] = _line(learner.weights())
            model.cals[view] = _logistic(_margin(back[view], model.lines[view])[:, None], y[held])
        picked = pick(model, turn) if turn < rounds else []
        if not picked:
            break
        for view, other, place in (("text", "meta", 3), ("meta", "text", 2)):
            mine = [p for p in picked if p[0] == view]
            rows, labels = sets[other]
            sets[other] = rows + [p[place] for p in mine], np.concatenate([labels, np.array([p[1] for p in mine], dtype=int)])
    both = np.column_stack(model.margins(back["text"], back["meta"]))
    model.joint = _logistic(both, y[held], ridge=0.1)
    return model


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, hash, t, m) of every row: the features of both views in bytes, and a hash of them; written once.

    Null text has no tokens, null and missing metadata are values of their own.
    """
    bound_batches(docs.sparkSession)
    kinds = {"lang": "string", "source": "string", "n_chars": "long"}
    rows = docs.select("doc_id", "text", *[(F.col(c) if c in docs.columns else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = [pack(text_features(x.as_py())[0]) for x in batch.column(1)]
            m = [pack(meta_features(*x)[0]) for x in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)))]
            h = np.array([xxhash.xxh64_intdigest(a + b) for a, b in zip(t, m)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(h, pa.int64()), pa.array(t, pa.binary()), pa.array(m, pa.binary())], names=["doc_id", "hash", "t", "m"])

    return materialize(rows.mapInArrow(read, f"doc_id {dict(docs.dtypes)['doc_id']}, hash long, t binary, m binary"), "quality-features")


def _sampled(df: DataFrame, rows: int) -> DataFrame:
    """About ``rows`` rows of a table with distinct doc_ids, by a hash of the id; never more than twice as many."""
    n = max(1, df.count())
    return df.where(F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1 << 30)) < F.lit(int(min(1.0, rows / n) * (1 << 30)))).limit(2 * rows)


def _surest(feats: DataFrame, taken: DataFrame, exchange: int, sure: float) -> Picker:
    """Picks, from all distinct unlabelled documents, those of which a view is surest: ``exchange`` of each class and view.

    ``taken`` holds the hashes of labelled documents. Only what is picked reaches the driver: 4 * ``exchange`` rows a round.
    """
    spark, given = feats.sparkSession, set()

    def pick(model: QualityModel, turn: int) -> list[tuple[str, int, Row, Row]]:
        held = spark.sparkContext.broadcast(model)

        @F.pandas_udf("text double, meta double")
        def margins(t: pd.Series, m: pd.Series) -> pd.DataFrame:
            a, b = held.value.margins([_row(x) for x in t], [_row(x) for x in m])
            return pd.DataFrame({"text": a, "meta": b})

        scored = feats.select("hash", margins("t", "m").alias("z")).groupBy("hash").agg(F.first("z").alias("z"))
        past = small_table(spark, {"hash": sorted(given)}, "hash long")
        free = materialize(scored.join(taken, "hash", "left_anti").join(F.broadcast(past), "hash", "left_anti").select("hash", "z.*"), "quality-margins")  # past: what was picked before
        bar = float(np.log(sure / (1 - sure)))
        chosen = None
        for view in ("text", "meta"):
            for good in (1, 0):
                z = F.col(view) if good else -F.col(view)
                top = free.where(z >= bar).orderBy(z.desc(), "hash").limit(exchange).select("hash", F.lit(view).alias("view"), F.lit(good).alias("good"))
                chosen = top if chosen is None else chosen.unionAll(top)
        chosen = materialize(chosen, "quality-chosen")
        found = feats.join(F.broadcast(chosen), "hash").groupBy("hash", "view", "good").agg(F.first("t").alias("t"), F.first("m").alias("m")).collect()  # 4 * exchange rows
        given.update(r["hash"] for r in found)
        return [(r["view"], r["good"], _row(bytes(r["t"])), _row(bytes(r["m"]))) for r in sorted(found, key=lambda r: (r["hash"], r["view"], r["good"]))]

    return pick


def train_on(feats: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, rounds: int = ROUNDS, exchange: float = EXCHANGE, sure: float = SURE) -> QualityModel | None:
    """Fit on the features of documents and their labels (doc_id, quality, toxic).

    In a round a view hands over ``exchange`` documents of each class for each labelled row, one at least. Null ids or labels are passed over; of a repeated id its worst label and its least row count once. None if either
    class is missing among the rows learned from or those kept back.
    """
    fine = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & F.col("toxic").isNotNull())
    known = fine.groupBy("doc_id").agg(F.min(((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int")).alias("good"))
    chosen = _sampled(known, sample_rows)
    # At most twice sample_rows ids, and one row of each.
    rows = feats.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min(F.struct("t", "m", "good")).alias("r")).select("doc_id", "r.*").collect()
    rows = sorted(rows, key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), r["doc_id"]))
    y = np.array([r["good"] for r in rows], dtype=int)
    if any(len(set(part.tolist())) < 2 for part in (y[np.arange(len(y)) % 4 != 3], y[np.arange(len(y)) % 4 == 3])):
        return None
    taken = materialize(feats.select("doc_id", "hash").join(known.select("doc_id"), "doc_id").select("hash").distinct(), "quality-labelled")
    return co_train([_row(bytes(r["t"])) for r in rows], [_row(bytes(r["m"])) for r in rows], y, _surest(feats, taken, max(1, round(exchange * len(rows))), sure), rounds)


def train(docs: DataFrame, labels: DataFrame, **options) -> QualityModel | None:
    """``train_on`` the features of ``docs``.

    Null texts and metadata are values of their own, very long texts are read whole, of equal documents one is handed over, ties
    go to the smaller hash; an empty table gives no model; other columns are not read.
    """
    return train_on(features(docs), labels, **options)


def _scores(model: QualityModel | None, texts: list[Row], metas: list[Row], threshold: float) -> pd.DataFrame:
    a, b, s = model.score(texts, metas) if model is not None else (np.full(len(texts), 0.5),) * 3
    return pd.DataFrame({"p_text": a, "p_meta": b, "score": s, "keep": s >= threshold})


def judge(docs: DataFrame, model: QualityModel | None, threshold: float = 0.5) -> Column:
    """struct(p_text, p_meta, score, keep) of each row of ``docs``, from its whole text and its metadata.

    Null text has no tokens, null metadata are values of their own. Without a model every score is 0.5 and all stay.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("p_text double, p_meta double, score double, keep boolean")
    def of(text: pd.Series, lang: pd.Series, source: pd.Series, n_chars: pd.Series) -> pd.DataFrame:
        none = lambda s: [None if v is None or v != v else v for v in s]
        return _scores(held.value, [text_features(t) for t in text], [meta_features(*m) for m in zip(none(lang), none(source), none(n_chars))], threshold)

    kinds = {"lang": "string", "source": "string", "n_chars": "double"}
    return of(F.col("text"), *[(F.col(c) if c in docs.columns else F.lit(None)).cast(t) for c, t in kinds.items()])


def judge_features(feats: DataFrame, model: QualityModel | None, threshold: float = 0.5) -> DataFrame:
    """(doc_id, p_text, p_meta, score, keep) of each row of ``feats``; the same as ``judge`` gives for its document.

    Repeated rows are judged alike and come back as often as they are there, null ids too; an empty table gives no rows.
    """
    held = feats.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("p_text double, p_meta double, score double, keep boolean")
    def of(t: pd.Series, m: pd.Series) -> pd.DataFrame:
        return _scores(held.value, [_row(x) for x in t], [_row(x) for x in m], threshold)

    return feats.select("doc_id", of("t", "m").alias("q")).select("doc_id", "q.*")


def op9_quality(spark, sf_dir: str) -> DataFrame:
    """Both views' probabilities, the combined score and the decision for every document."""
    feats = features(spread(table(spark, sf_dir, "documents")))
    return judge_features(feats, train_on(feats, table(spark, sf_dir, "labels")))
