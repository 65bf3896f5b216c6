"""The learners against plain statements, and accuracy on rows that nothing was learned from."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from fennwick.llm import ftrl, langid, quality


def plain_ftrl(rows, labels, dim, classes, alpha, beta, l1, l2, epochs, seed):
    """One coordinate at a time, as the update rule is written down."""
    z = [[0.0] * classes for _ in range(dim + 1)]
    n = [[0.0] * classes for _ in range(dim + 1)]

    def weight(i, k):
        if abs(z[i][k]) <= l1:
            return 0.0
        return -(z[i][k] - math.copysign(l1, z[i][k])) / ((beta + math.sqrt(n[i][k])) / alpha + l2)

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for r in order.permutation(len(rows)):
            x = [*zip(rows[r][0].tolist(), rows[r][1].tolist()), (dim, 1.0)]
            w = {(i, k): weight(i, k) for i, _ in x for k in range(classes)}
            raw = [sum(v * w[i, k] for i, v in x) for k in range(classes)]
            top = max(raw)
            e = [math.exp(s - top) for s in raw]
            for i, v in x:
                for k in range(classes):
                    g = v * (e[k] / sum(e) - (k == labels[r]))
                    sigma = (math.sqrt(n[i][k] + g * g) - math.sqrt(n[i][k])) / alpha
                    z[i][k] += g - sigma * w[i, k]
                    n[i][k] += g * g
    return np.array([[weight(i, k) for k in range(classes)] for i in range(dim + 1)])


def test_ftrl_against_one_coordinate_at_a_time():
    rnd = random.Random(2)
    for classes, l1, l2 in ((2, 0.0, 0.0), (3, 0.3, 0.5), (4, 1.0, 0.1)):
        rows, labels = [], np.array([rnd.randrange(classes) for _ in range(60)])
        for _ in labels:
            idx = np.array(sorted(rnd.sample(range(20), rnd.randint(0, 8))), dtype=np.int64)
            rows.append((idx, np.array([rnd.uniform(0.1, 2) for _ in idx])))
        got = ftrl.FTRL(20, classes, 0.4, 0.8, l1, l2).fit(rows, labels, epochs=3, seed=5).weights()
        want = plain_ftrl(rows, labels, 20, classes, 0.4, 0.8, l1, l2, 3, 5)
        assert np.allclose(got, want, atol=1e-9) and (l1 == 0 or (got == 0).any())
        raw = ftrl.scores(rows, got)
        assert np.allclose(raw, [[sum(v * got[i, k] for i, v in zip(*r)) + got[20, k] for k in range(classes)] for r in rows])


def test_temperature_against_a_grid():
    rng = np.random.default_rng(3)
    labels = rng.integers(0, 3, 400)
    for heat in (0.3, 1.0, 4.0):
        sure = np.eye(3)[np.where(rng.random(400) < 0.8, labels, rng.integers(0, 3, 400))] * 3 + rng.standard_normal((400, 3))
        raw = sure * heat
        loss = lambda t: -np.log(ftrl.softmax(raw / t)[np.arange(400), labels]).mean()  # noqa: E731, B023
        grid = min(np.exp(np.linspace(np.log(0.05), np.log(20), 4000)), key=loss)
        assert loss(ftrl.temperature(raw, labels)) <= loss(grid) + 1e-9
    assert ftrl.temperature(np.zeros((0, 3)), np.zeros(0, int)) == 1.0


def test_packed_features_round_trip():
    rng = np.random.default_rng(4)
    for n in (0, 1, 50, 5000):
        idx = np.unique(rng.integers(0, 1 << quality.DIM_BITS, n))
        assert (quality.unpack(quality.pack(idx)) == idx).all()


def test_co_training_hands_over_what_it_is_sure_of():
    """Text tells all classes, metadata only some; what the text is sure of teaches the metadata."""
    rnd = random.Random(6)
    row = lambda *names: (np.array(sorted(names), dtype=np.int64), np.ones(len(names)))
    y = np.array([rnd.randrange(2) for _ in range(200)])
    texts, metas = [row(10 + int(g)) for g in y], [row(1 + int(g)) if i % 2 else row(7) for i, g in enumerate(y)]
    seen = []

    def pick(model, turn):
        seen.append(model.margins([row(10), row(11)], [row(30), row(31)]))
        return [("text", 0, row(10), row(30))] * 30 + [("text", 1, row(11), row(31))] * 30

    model = quality.co_train(texts, metas, y, pick, rounds=2)
    assert len(seen) == 2 and seen[0][0][0] < 0 < seen[0][0][1] and abs(seen[0][1][0] - seen[0][1][1]) < 1e-9
    a, b, s = model.score([row(10), row(11)], [row(30), row(31)])
    assert b[0] < b[1] and s[0] < 0.5 < s[1]


def test_the_surest_are_picked_from_all_unlabelled(spark):
    """Against a plain ranking of all distinct documents by either view, over two rounds."""
    rnd = random.Random(12)
    rows = [(i, " ".join(rnd.choices([f"w{k}" for k in range(40)], k=12)), rnd.choice(("en", "de", None)), rnd.choice("abc"), rnd.randint(1, 900)) for i in range(400)]
    docs = spark.createDataFrame(rows + rows[:50], "doc_id long, text string, lang string, source string, n_chars long")
    feats = quality.features(docs)
    held = [(r["doc_id"], r["hash"], quality._row(bytes(r["t"])), quality._row(bytes(r["m"]))) for r in feats.collect()]
    rng, lines = np.random.default_rng(1), {}
    for view, bits in (("text", quality.DIM_BITS), ("meta", quality.META_BITS)):
        lines[view] = rng.standard_normal((1 << bits) + 1)
    model = quality.QualityModel(lines, {v: np.array([1.0, 0.0]) for v in lines})
    labelled = {h for d, h, _, _ in held if d % 7 == 0}
    pick = quality._surest(feats, spark.createDataFrame([(h,) for h in labelled], "hash long"), 9, 0.6)
    free, bar = {h: (t, m) for _, h, t, m in held if h not in labelled}, np.log(0.6 / 0.4)
    for turn in range(2):
        want = []
        for k, view in enumerate(("text", "meta")):
            z = {h: model.margins([x[0]], [x[1]])[k][0] for h, x in free.items()}
            for good in (1, 0):
                sign = 1 if good else -1
                want += [(view, good, h) for h in sorted((h for h in free if sign * z[h] >= bar), key=lambda h: (-sign * z[h], h))[:9]]
        got = pick(model, turn)
        key = lambda view, good, t, m: (view, good, tuple(t[0]), tuple(m[0]))
        assert len(want) == 36 and sorted(key(*g) for g in got) == sorted(key(v, g, *free[h]) for v, g, h in want)
        free = {h: x for h, x in free.items() if h not in {h for _, _, h in want}}


def test_one_view_teaches_the_other_what_labels_do_not(spark):
    """Texts draw on many words of which 60 labelled rows hold few; sources tell the classes, but new ones say nothing."""
    rnd = random.Random(5)
    vocabulary = {g: [f"{'good' if g else 'bad'}{k}" for k in range(300)] for g in (0, 1)}
    shared = [f"common{k}" for k in range(50)]
    made = lambda g, source: (" ".join(rnd.choices(vocabulary[g], k=4) + rnd.choices(shared, k=12)), "en", source, 100)
    known = [(i, *made(i % 2, f"site{i % 2}-{rnd.randrange(3)}")) for i in range(2000)]
    new = [(10_000 + i, *made(i % 2, f"new{rnd.randrange(40)}")) for i in range(600)]
    docs = spark.createDataFrame(known + new, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    feats, right = quality.features(docs), {}
    for rounds in (0, 3):
        model = quality.train_on(feats, labels, rounds=rounds, exchange=2.0, sure=0.7)
        rows = quality.judge_features(feats.where("doc_id >= 10000"), model).collect()
        right[rounds] = {v: np.mean([(r[v] >= 0.5) == (r["doc_id"] % 2 == 1) for r in rows]) for v in ("p_text", "p_meta", "score")}
    print("accuracy on new sources without and with exchange", right)
    assert right[0]["p_meta"] < 0.6 and right[3]["p_text"] > right[0]["p_text"] + 0.08 and right[3]["score"] > right[0]["score"] + 0.08


def test_quality_on_held_out_labels(spark):
    big = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{big}/{t}.parquet") for t in ("documents", "labels"))
    feats = quality.features(docs)
    apart = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = quality.train_on(feats, labels.where(~apart))
    rows = quality.judge_features(feats, model).join(labels.where(apart), "doc_id").collect()
    right = np.mean([r["keep"] == (r["quality"] == 1 and r["toxic"] == 0) for r in rows])
    print("held-out accuracy", len(rows), right)
    assert len(rows) > 500 and right >= 0.9
    some = docs.limit(300)
    a = {r["doc_id"]: r["q"]["score"] for r in some.select("doc_id", quality.judge(some, model).alias("q")).collect()}
    b = {r["doc_id"]: r["score"] for r in quality.judge_features(quality.features(some), model).collect()}
    assert all(abs(a[k] - b[k]) < 1e-9 for k in a)


def test_a_repeated_id_counts_once(spark):
    rows = [(1, "good fine words", "en", "s", 1)] * 3000 + [(i, "fine words here" if i % 2 else "bad!!! BAD!!! bad!!!", "en", "s", 1) for i in range(2, 200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    read = []
    original = quality.co_train
    quality.co_train = lambda texts, *rest: read.append(len(texts)) or original(texts, *rest)
    try:
        assert quality.train(docs, labels) is not None
    finally:
        quality.co_train = original
    assert read == [199]


def test_language_model_on_awkward_rows(spark, awkward, none):
    """Nulls, empty and blank texts, repeats, an empty table and columns of other names: no crash, defined results."""
    few = awkward.unionByName(awkward)
    model = langid.train(few)
    got = few.select("doc_id", langid.predict(few, model).alias("p")).collect()
    assert len(got) == 20 and all(r["p"]["score"] == 0 for r in got if r["p"]["lang_pred"] == "und")
    assert langid.train(none).langs == [] and none.select(langid.predict(none, langid.train(none)).alias("p")).collect() == []
