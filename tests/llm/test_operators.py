"""Each operator against brute force, a round trip or held-out rows, and on awkward input."""

import hashlib
import html
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from fennwick.llm import ann, decontam, elias_fano, html_extract, langid, packing, pii, quality, sharding, simhash, token_files
from fennwick.llm.tokens import Encoder, default_vocabulary


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_vocabulary())


# 1 sharding


def test_shards_are_even_and_gapless(spark, data, awkward, none):
    rows = sharding.op1_sharding(spark, data).collect()
    n = Counter(r["shard"] for r in rows)
    assert set(n) == set(range(40)) and max(n.values()) - min(n.values()) <= 1
    for s in range(40):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(n[s]))
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    assert all(r["size"] == len(texts[r["doc_id"]]) + 16 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]]) for r in rows)
    odd = sharding.assign_shards(awkward, 4).collect()
    assert Counter(r["doc_id"] for r in odd) == Counter(r["doc_id"] for r in awkward.collect()) and max(Counter(r["shard"] for r in odd).values()) <= 3
    assert sharding.assign_shards(none, 4).collect() == []


def test_ring_against_one_row_at_a_time():
    rnd = random.Random(2)
    for eps in (0.0, 0.1):
        counts = {s: rnd.randint(1, 30) for s in rnd.sample(range(1 << 8), 60)}
        points, total = sharding.ring_points(5, 8, 8), sum(counts.values())
        room = sharding.capacities(total, 5, eps)
        load = Counter()
        for slot, a, b, shard, first in sharding.walk_ring(counts, points, room):
            assert load[shard] == first and b > a
            load[shard] += b - a
        assert sum(load.values()) == total and all(load[s] <= room[s] for s in range(5))
        covered = Counter()
        for slot, a, b, _, _ in sharding.walk_ring(counts, points, room):
            covered[slot] += b - a
        assert covered == Counter(counts)


def test_a_new_shard_moves_little():
    counts = {s: 10 for s in range(1 << 10)}
    where = lambda n: {(s, r): sh for s, a, b, sh, _ in sharding.walk_ring(counts, sharding.ring_points(n, 64, 10), sharding.capacities(10240, n, 0.25)) for r in range(a, b)}
    a, b = where(10), where(11)
    assert sum(a[k] != b[k] for k in a) < 0.35 * len(a)


# 2 SimHash


def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints, bits=2):
    """Smallest id reachable, by all pairs."""
    keys = sorted(set(prints.values()))
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[:i]:
            if (a ^ b).bit_count() <= bits:
                root[find(a)] = find(b)
    least = {}
    for d, k in prints.items():
        least[find(k)] = min(least.get(find(k), d), d)
    return {d: least[find(k)] for d, k in prints.items()}


def test_fingerprints_and_components(spark, data, docs):
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = simhash.op2_simhash(spark, data).collect()
    prints = {d: plain_fingerprint(t) for d, t in texts.items()}
    assert {r["doc_id"]: int(r["fingerprint"], 16) for r in rows} == prints
    assert {r["doc_id"]: r["component_id"] for r in rows} == plain_components(prints)
    native = spark.range(1).select(F.xxhash64(F.lit("a b c")).alias("h")).first()["h"]
    assert native & (1 << 64) - 1 == xxhash.xxh64_intdigest(b"a b c", 42)


@pytest.mark.parametrize("dense", [2, 64])
def test_links_of_crowded_cells(spark, dense):
    rnd = random.Random(5)
    base = [rnd.getrandbits(64) for _ in range(6)]
    keys = set(base)
    for _ in range(500):
        k = rnd.choice(sorted(keys))
        for _ in range(rnd.randint(1, 3)):
            k ^= 1 << rnd.randrange(64)
        keys.add(k)
    prints = dict(enumerate(sorted(keys)))
    sign = lambda k: k - (1 << 64) if k >> 63 else k
    nodes = spark.createDataFrame([(sign(k),) for k in prints.values()], "fp long")
    from fennwick.llm.components import connected_components

    got = {r["node"]: r["root"] for r in connected_components(simhash.links(nodes, dense=dense)).collect()}
    groups, want = {}, {}
    for d, c in plain_components(prints).items():
        want.setdefault(c, set()).add(sign(prints[d]))
    for d, k in prints.items():
        groups.setdefault(got.get(sign(k), sign(k)), set()).add(sign(k))
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_simhash_awkward(awkward, none):
    rows = simhash.near_duplicates(awkward).collect()
    assert len(rows) == 10 and {r["component_id"] for r in rows if r["doc_id"] in (1, 5)} == {1}
    assert {r["component_id"] for r in rows if r["fp"] == 0} == {2}
    kept = simhash.keep_one(awkward)
    assert kept.columns == awkward.columns and Counter(r["doc_id"] for r in kept.collect()) == Counter([1, 2, None, 6, 7])
    assert simhash.near_duplicates(none).collect() == [] and simhash.keep_one(none).collect() == []


# 3 personal data

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(s):
    return sum((d if i % 2 == 0 else d * 2 - 9 * (d > 4)) for i, d in enumerate(map(int, reversed(s)))) % 10 == 0


def plain_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True, "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), k, kind, m.end()))
    return [f"{kind}:{a}:{b}" for a, _, kind, b in sorted(out)]


def test_base_spans(spark, data, docs):
    rnd = random.Random(8)
    alphabet = list("0123456789") * 2 + list("aZ.@@-+ ()_%é日") + ["a@b.co", "10.0.0.1", "4111 1111 1111 1111", "+1 (743) 555-3824", "...", "256"]
    texts = ["".join(rnd.choices(alphabet, k=rnd.randint(0, 40))) for _ in range(1500)] + ["a@b.com_x@c.de", "a" * 5000 + "@", "1" * 5000, "1 " * 4000, "+1" + " " * 4000, "1.2.3.4.5.6.7.8", "00001.2.3.4"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", pii.joined(pii.base_spans(F.col("t"))).alias("s")).collect()
    assert {r["i"]: r["s"] for r in rows} == {i: ",".join(plain_spans(t)) for i, t in enumerate(texts)}
    whole = {r["doc_id"]: plain_spans(r["text"]) for r in docs.collect()}
    for r in pii.op3_pii(spark, data).collect():
        want = whole[r["doc_id"]]
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert set(want) <= set(filter(None, r["spans"].split(","))) and r["n_email"] == sum(s.startswith("email") for s in want)


def test_disclosing_terms(spark):
    rows = [(i, f"the secret zorblax mail x@y.org of the case number {i} more words") for i in range(5)] + [(i, f"the case of more words with number {i}") for i in range(5, 200)] + [(200, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["term"]: r["disclosure"] for r in pii.disclosures(docs).collect()}
    n = 201
    for term, n_t in (("zorblax", 5), ("secret", 5), ("mail", 5)):
        given = (5 + pii.PRIOR * 5 / n) / (n_t + pii.PRIOR)
        assert abs(found[term] - np.log(given * n / 5) / np.log(n / 5)) < 1e-9
    assert not {"the", "case", "more", "words"} & set(found)
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    assert "zorblax" not in clean[0] and "[EMAIL]" in clean[0] and clean[0].startswith("the ") and clean[0].endswith("case number 0 more words")
    assert all(clean[i] == t for i, t in rows[5:])


def test_sanitise_awkward(awkward, none):
    out = pii.sanitise(awkward)
    assert out.columns == awkward.columns and out.count() == 10
    six = out.where("doc_id = 6").first()
    assert six["text"].startswith("mail [EMAIL] now") and six["n_chars"] == len(six["text"])
    assert pii.sanitise(none).collect() == []


# 4 token files


def test_elias_fano_round_trip():
    rnd = random.Random(3)
    for n, top in [(0, 1), (1, 0), (5, 3), (1000, 10**6), (3000, 2), (700, 2**62)]:
        v = np.sort(np.array([rnd.randint(0, top) for _ in range(n)], dtype=np.uint64))
        e = elias_fano.EliasFano(b"abc" + elias_fano.encode(v), 3)
        assert (e.all() == v).all() and [e.select(i) for i in range(n)] == v.tolist()
    assert len(elias_fano.encode(np.arange(0, 10**6, 100))) < 1.4 * 10**4


def test_encoder_is_exact(tokenizer, docs):
    own, rnd = Encoder(default_vocabulary(), limit=50), random.Random(1)
    letters = [*"abCDé's tlmrev'd12½Ǆß,.!?<|>́  中文Σσς\x1c\x85İ", "<|endoftext|>", "'s", "don't", "naïve", "ÉCOLE", "ñ.", "ﬁ"]
    for s in ["".join(rnd.choices(letters, k=rnd.randint(1, 14))) for _ in range(5000)] + [r["text"] for r in docs.limit(30).collect()]:
        assert np.frombuffer(own.encode(s.encode()), "<u4").tolist() == tokenizer.encode(s, add_special_tokens=False).ids


def test_token_files(spark, data, docs, tokenizer, awkward, none, tmp_path):
    at = 0
    rows = sorted(token_files.op4_tokens(spark, data).collect(), key=lambda r: r["start"])
    for r, d in zip(rows, docs.orderBy("doc_id").collect(), strict=True):
        ids = [*tokenizer.encode(d["text"] or "", add_special_tokens=False).ids, 2]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (d["doc_id"], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    segments = token_files.write_segments(awkward, default_vocabulary(), segment_ids=8)
    assert [r["doc_id"] for r in sorted(token_files.read_documents(segments).collect(), key=lambda r: r["start"])] == [None, None, 1, 2, 3, 4, 5, 5, 6, 7]
    paths = token_files.export(segments, str(tmp_path))
    one = token_files.Segment(open(paths[0], "rb").read())
    assert one.document(0)[-1] == 2 and token_files.read_documents(token_files.write_segments(none, default_vocabulary())).collect() == []


# 5 languages


def test_language_identification(spark, data, awkward, none):
    big = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{big}/documents.parquet").select("doc_id", "lang")
    out = langid.op5_langid(spark, big).join(docs, "doc_id").collect()
    held = [r for r in out if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out)
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held) and all(0 <= r["score"] <= 1 for r in out)
    model = langid.train(awkward)
    got = awkward.select("doc_id", langid.predict(awkward, model).alias("p")).collect()
    assert len(got) == 10 and {r["p"]["lang_pred"] for r in got if r["doc_id"] in (2, 3, 4)} == {"und"}
    assert langid.train(none).predict("words") == ("und", 0.0)
    long = "ab cd " * 400_000
    idx, n = langid.ngram_counts(long)
    assert n.sum() > 0 and (idx == langid.ngram_counts("ab cd " * 100)[0]).all()


# 6 pages


def test_main_text_of_pages(spark, data):
    for r in spark.read.parquet(f"{data}/pages.parquet").join(html_extract.op6_html(spark, data).drop("url"), "page_id").collect():
        body = re.search("<article>(.*?)</article>", r["html"], re.S)[1]
        want = " ".join(html.unescape(re.sub("<[^>]*>", " ", body)).split())
        assert r["text"] == want and r["n_chars"] == len(want)


def test_page_shapes(spark):
    page = '<body><header>Site</header><div class="cookie-notice">c</div><main><h2>T &amp; x</h2><p>Hello <b>wor</b>ld<br>next<p>two<ul><li>a<li>b</ul><form>f<input></form><div id="comments">no</div></main><aside>q</aside><script>if(a<b){"</p>"}</script>'
    assert html_extract.main_text(page) == "T & x Hello world next two a b"
    for odd in ("", None, "<", "<a b='", "&lt;p&gt;", "<p>x", "</p></p>x"):
        assert isinstance(html_extract.main_text(odd), str)
    assert html_extract.main_text("<p>a&nbsp;b\n c</p>") == "a b c"
    wrap = '<html><body><div class="top"><span>My site</span></div><div class="x1"><p>{}</p><p>Follow us on the net every day</p></div><div class="low">Contact us here</div></body></html>'
    rows = [(i, f"http://h.example/{i}", wrap.format(f"Story {i} " + "word " * (20 + i) + f"end {i}")) for i in range(12)] + [(20, None, None), (21, "junk", ""), (22, "http://o.example/", wrap.format("lone " * 30))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("x")).withColumn("template", F.lit("x"))
    got = {r["page_id"]: r["text"] for r in html_extract.extract(pages).collect()}
    assert len(got) == 15 and all(got[i].startswith(f"Story {i} word") and got[i].endswith(f"end {i}") for i in range(12))
    assert got[20] == got[21] == "" and got[22].startswith("lone")
    assert html_extract.extract(pages.limit(0)).collect() == []


# 7 benchmark leaks


def edit(p, t):
    prev = [0] * (len(t) + 1)
    for i, c in enumerate(p, 1):
        cur = [i]
        for j, x in enumerate(t, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (c != x)))
        prev = cur
    return min(prev)


def test_myers_and_pigeonhole():
    rnd = random.Random(6)
    for _ in range(300):
        p, t = ("".join(rnd.choices("abc", k=rnd.randint(a, b))) for a, b in ((1, 30), (0, 60)))
        assert decontam.myers(decontam.masks_of(p), len(p), t)[0] == edit(p, t)
    items = [(k, " ".join("".join(rnd.choices("abcde", k=rnd.randint(2, 6))) for _ in range(14))) for k in range(12)]
    matcher = decontam.Matcher(items, rate=0.08, whole_words=False)
    for _ in range(150):
        k, item = rnd.choice(items)
        s = list(item)
        for _ in range(rnd.randint(0, 8)):
            at = rnd.randrange(len(s))
            s[at : at + rnd.randint(0, 1)] = rnd.choices("abcde", k=rnd.randint(0, 1))
        text = "pre fix " + "".join(s).upper() + "  post fix"
        clean = decontam.normalise(text)
        want = sorted((i, e) for i, t in items if (e := edit(t, clean)) <= int(0.08 * len(t)))
        assert [(i, d) for i, d, _ in matcher.find(text)] == want


def test_whole_words_by_all_stretches():
    """The least distance over all stretches that begin and end between words, for items from one character on."""

    def far(p, t):
        prev = list(range(len(t) + 1))
        for i, c in enumerate(p, 1):
            cur = [i]
            for j, x in enumerate(t, 1):
                cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (c != x)))
            prev = cur
        return prev[-1]

    rnd, rate = random.Random(9), 0.12
    for _ in range(250):
        items = [(k, " ".join("".join(rnd.choices("abc", k=rnd.randint(1, 4))) for _ in range(rnd.randint(1, 6)))) for k in range(3)]
        s = list(rnd.choice(items)[1])
        for _ in range(rnd.randint(0, 3)):
            at = rnd.randrange(len(s) + 1)
            s[at : at + rnd.randint(0, 1)] = rnd.choices("ab c", k=rnd.randint(0, 1))
        clean = decontam.normalise(rnd.choice(["", "a", "ab ", "(", "c c "]) + "".join(s) + rnd.choice(["", "b", " ca", ")", "1"]))
        places = [k for k in range(len(clean) + 1) if decontam.between_words(clean, k)]
        want = {}
        for k, item in items:
            least = min((far(item, clean[a:b]) for a in places for b in places if a < b), default=99)
            if least <= int(rate * len(item)):
                want[k] = least
        assert {k: d for k, d, _ in decontam.Matcher(items, rate).find(clean)} == want


def test_one_rule_for_items_of_all_lengths(spark):
    """Within longer words neither an item of 19 characters is held nor one of 20, nor a long one beyond its budget."""
    texts = ["abcdefghij klmnopqr", "abcdefghij klmnopqrs", "abcdefghij klmnopqrs tuvw xyzab cdefghi"]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    docs = spark.createDataFrame([(10 * i + j, t) for i, x in enumerate(texts) for j, t in enumerate((f"so {x} so", f"soso{x}soso"))], "doc_id long, text string")
    whole = {(r["doc_id"], r["item_id"]) for r in decontam.find_contamination(docs, items.where("item_id = 0")).collect()}
    assert whole == {(0, 0)}
    assert {(10 * i, i) for i in range(3)} <= {(r["doc_id"], r["item_id"]) for r in decontam.find_contamination(docs, items).collect()} and {(1, 0), (11, 1), (21, 2)} & {(r["doc_id"], r["item_id"]) for r in decontam.find_contamination(docs, items).collect()} == set()
    assert {(1, 0), (11, 1), (21, 2)} <= {(r["doc_id"], r["item_id"]) for r in decontam.find_contamination(docs, items, whole_words=False).collect()}


def test_decontamination(spark, data, docs, awkward, none):
    items = spark.read.parquet(f"{data}/benchmark.parquet")
    found = {(r["doc_id"], r["item_id"]) for r in decontam.op7_decontam(spark, data).collect()}
    exact = {(d["doc_id"], i["item_id"]) for d in docs.collect() for i in items.collect() if decontam.normalise(i["text"]) in decontam.normalise(d["text"])}
    assert exact <= found and {r["doc_id"] for r in decontam.drop_contaminated(docs, items).collect()} == {r["doc_id"] for r in docs.collect()} - {d for d, _ in found}
    odd = spark.createDataFrame([(1, "alpha beta gamma delta epsilon"), (1, "alpha beta gamma delta epsilon"), (2, None), (None, "x"), (3, ""), (4, "日本語")], "item_id long, text string")
    assert Counter(r["doc_id"] for r in decontam.find_contamination(awkward, odd).collect()) == Counter([1, 5, 5, 7])
    assert decontam.drop_contaminated(awkward, odd).columns == awkward.columns and decontam.find_contamination(none, odd).collect() == []
    assert decontam.find_contamination(awkward, odd.limit(0)).collect() == []


# 8 neighbours


def plain_nearest(ids, x, q, k=20):
    s = x @ x[q]
    keep = ids != ids[q]
    order = np.lexsort((ids[keep], -s[keep]))[:k]
    return ids[keep][order].tolist(), s[keep][order]


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.standard_normal((2500, 24)) * rng.uniform(0.5, 2, (2500, 1)), np.tile(rng.standard_normal(24), (1200, 1))]).astype("f4").astype("f8")
    ids = rng.permutation(np.arange(len(x)))
    bad = [(9000, None), (9020, [0.0] * 24), (9040, [float("nan")] * 24), (9060, [1.0] * 23), (None, [1.0] * 24), (9080, [float("inf")] + [0.0] * 23), (9100, [None] * 24)]
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)] + bad, "vec_id long, embedding array<float>")
    rows = ann.nearest(df).toPandas()
    assert set(rows.query_id) == {int(i) for i in ids if i % 20 == 0} and rows.groupby("query_id").size().eq(20).all()
    hit = total = 0
    for qid, part in rows.groupby("query_id"):
        part, q = part.sort_values("rank"), int(np.flatnonzero(ids == qid)[0])
        want, _ = plain_nearest(ids, x, q)
        hit, total = hit + len(set(want) & set(part.vec_id)), total + 20
        at = {int(v): k for k, v in enumerate(ids)}
        assert np.allclose(part.score, [x[at[v]] @ x[q] for v in part.vec_id], rtol=1e-12)
        assert list(part["rank"]) == list(range(1, 21)) and all((a, -v) >= (b, -w) for a, v, b, w in zip(part.score, part.vec_id, part.score[1:], part.vec_id[1:]))
    assert hit >= 0.9 * total
    assert ann.nearest(df.where("vec_id in (20, 21, 22)")).count() == 2 and ann.nearest(df.limit(0)).collect() == []


# 9 quality


def test_quality(spark, awkward, none):
    big = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{big}/labels.parquet")
    rows = quality.op9_quality(spark, big).join(labels, "doc_id").collect()
    right = [r["keep"] == (r["quality"] == 1 and r["toxic"] == 0) for r in rows]
    assert np.mean(right) >= 0.93
    model = quality.train(awkward, spark.createDataFrame([(1, 1, 0), (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int"))
    assert model is None and {r["q"]["keep"] for r in awkward.select(quality.judge(awkward, model).alias("q")).collect()} == {True}
    many = spark.createDataFrame([(i, "fine words here" if i % 2 else "bad!!! BAD!!! bad!!!", "en", "s", 1) for i in range(200)], "doc_id long, text string, lang string, source string, n_chars long")
    taught = quality.train(many, many.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"), F.lit(0).alias("toxic")))
    assert {(r["doc_id"] % 2 == 1, r["q"]["keep"]) for r in many.select("doc_id", quality.judge(many, taught).alias("q")).collect()} == {(True, True), (False, False)}
    assert awkward.select(quality.judge(awkward, taught).alias("q")).count() == 10 and none.where(quality.judge(none, taught)["keep"]).collect() == []


# 10 packing


def test_pack_covers_every_token():
    rnd = random.Random(7)
    for _ in range(200):
        lengths = [rnd.choice([rnd.randint(1, 300), rnd.randint(1, 9000), 1]) for _ in range(rnd.randint(0, 150))]
        windows, seen = packing.pack(lengths), {}
        for k, (tier, pieces) in enumerate(windows):
            used = sum(n for _, _, n in pieces)
            assert used == tier or (k == len(windows) - 1 and used < tier == 2048)
            for doc, start, n in pieces:
                seen.setdefault(doc, []).append((start, n))
        for doc, length in enumerate(lengths):
            at = 0
            for start, n in sorted(seen[doc]):
                assert start == at and n > 0
                at += n
            assert at == length


def test_packing(spark, data, docs, tokenizer, awkward, none):
    want = {d["doc_id"]: [*tokenizer.encode(d["text"] or "", add_special_tokens=False).ids, 1] for d in docs.collect()}
    rows = packing.op10_packing(spark, data).collect()
    windows = {}
    for r in rows:
        ids = want[r["doc_id"]]
        assert r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sorted(windows) == list(range(len(windows))) and sum(r["length"] for r in rows) == sum(map(len, want.values()))
    padding = 0
    for parts in windows.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        padding += 0 if at.bit_count() == 1 else 2048 - at
    assert padding < 2048 * docs.rdd.getNumPartitions() + 1
    steps = Counter()
    for r in rows:
        steps[r["step_group"]] += r["length"]
    assert max(steps.values()) <= packing.STEP_TOKENS
    odd = packing.pack_documents(awkward, default_vocabulary(), with_ids=True).collect()
    assert Counter(r["doc_id"] for r in odd if r["start"] == 0) == Counter(r["doc_id"] for r in awkward.collect()) and all(len(r["ids"]) == 4 * r["length"] for r in odd)
    assert packing.pack_documents(none, default_vocabulary()).collect() == []


def test_tails_share_windows_at_any_partition_count(spark, docs, tokenizer):
    want = {d["doc_id"]: [*tokenizer.encode(d["text"] or "", add_special_tokens=False).ids, 1] for d in docs.collect()}
    for parts, group in ((1, 4_000_000), (7, 3000), (64, 4_000_000)):
        rows = packing.pack_documents(docs.select("doc_id", "text").repartition(parts), default_vocabulary(), group_tokens=group, with_ids=True).collect()
        windows, pieces, steps = {}, {}, Counter()
        for r in rows:
            assert r["ids"] == np.array(want[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4").tobytes() and r["ids_crc32"] == zlib.crc32(r["ids"])
            windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], r["tier"]))
            pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
            steps[r["step_group"]] += r["length"]
        assert sorted(windows) == list(range(len(windows))) and sorted(steps) == list(range(len(steps))) and max(steps.values()) <= packing.STEP_TOKENS
        for cut, size in ((windows.values(), None), (pieces.items(), want)):
            for parts_of in cut:
                doc, parts_of = parts_of if size else (None, parts_of)
                at = 0
                for offset, n, *_ in sorted(parts_of):
                    assert offset == at
                    at += n
                assert at == (len(want[doc]) if size else min(at, parts_of[0][2]))
        assert sum(max(t for _, _, t in w) - sum(n for _, n, _ in w) for w in windows.values()) < 2048


@pytest.mark.parametrize("tokens", [4096, 32_768])
def test_step_groups_are_even(tokens):
    rnd = random.Random(8)
    for _ in range(30):
        tiers = [tier for tier, _ in packing.pack([rnd.choice([rnd.randint(1, 300), rnd.randint(1, 6000)]) for _ in range(rnd.randint(1, 600))])]
        groups = packing.balance(tiers, tokens)
        load, work, each = Counter(), Counter(), {t: Counter() for t in packing.TIERS}
        for tier, g in zip(tiers, groups):
            load[g] += tier
            work[g] += tier * tier
            each[tier][g] += 1
        n = -(-sum(tiers) // tokens)
        assert set(load) <= set(range(n)) and max(load.values()) <= tokens
        if len(load) == n and n > 1:
            assert max(load.values()) - min(load.values()) <= 2048
            assert max(each[2048][g] for g in range(n)) - min(each[2048][g] for g in range(n)) <= 1 and max(work.values()) - min(work.values()) <= 2 * 2048**2


def test_short_items_are_met_as_whole_words(spark):
    items = spark.createDataFrame([(1, "Yes no"), (2, "日本語"), (3, "x")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "they say YES  no to it"), (2, "yes nothing"), (3, "eyes no"), (4, "(日本語)"), (5, "xx x"), (6, "xyz"), (7, "yes no"), (8, None)], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["distance"], r["end"]) for r in decontam.find_contamination(docs, items).collect()}
    assert got == {(1, 1, 0, 15), (4, 2, 0, 4), (5, 3, 0, 4), (7, 1, 0, 6)}


def test_items_from_one_edit_on_and_blocks_of_items(spark):
    items = spark.createDataFrame([(1, "abcdefghij klmnopqrs"), (2, "abcdefghij klmnopqr"), (3, "another item, of which much is left")] * 3, "item_id long, text string")
    docs = spark.createDataFrame([(1, "so abcdefghij kXmnopqrs"), (2, "abcdefghij kXmnopqr so"), (3, "an other item, of which much is left"), (4, None), (5, "")], "doc_id long, text string")
    assert {(r["doc_id"], r["item_id"], r["distance"]) for r in decontam.find_contamination(docs, items).collect()} == {(1, 1, 1), (3, 3, 1)}
    blocks = list(decontam.blocks_of(items, "item_id", "text", 20))
    assert len(blocks) > 1 and sorted(i for b in blocks for i, _ in b) == [1, 2, 3]
    for size in (1, 20, 40, 10**6):
        assert {r["doc_id"] for r in decontam.drop_contaminated(docs, items, block_chars=size).collect()} == {2, 4, 5}


def test_equal_vectors_score_alike_in_any_block():
    rng = np.random.default_rng(2)
    for d in (3, 17, 64, 129, 768):
        v, q = rng.standard_normal(d).astype("f4").astype("f8"), rng.standard_normal((5, d)).astype("f4").astype("f8")
        scores = set()
        for n in (1, 2, 3, 7, 8, 9, 31, 64, 100, 257):
            x = rng.standard_normal((n, d)).astype("f4").astype("f8")
            at = rng.integers(0, n)
            x[at] = v
            found = ann.search_block(np.arange(5) * 20 + 10**6, q, np.full(5, -np.inf), np.arange(n), x, ann.rotation(d), k=n)
            scores.add(tuple(found[2][found[1] == at].tolist()))
        assert len(scores) == 1


def test_lists_of_two_levels(spark, monkeypatch):
    """Many lists from few centres: clustered vectors need few probes, and every row lies in one list."""
    monkeypatch.setattr(ann, "MAX_CENTRES", 12)
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((60, 16)) * 3
    x = (centres[rng.integers(0, 60, 4000)] + 0.3 * rng.standard_normal((4000, 16))).astype("f4").astype("f8")
    index = ann.fit_lists(x, len(x), 20, list_rows=40)
    assert len(index) > 90 and len(index.first) <= 12 and len(index.second) <= 12 and index.probes < len(index) / 3
    assert ((0 <= index.of(x)) & (index.of(x) < len(index))).all()
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    rows = ann.nearest(df, list_rows=40).toPandas()
    hit = sum(len(set(plain_nearest(np.arange(4000), x, q)[0]) & set(part.vec_id)) for q, part in rows.groupby("query_id"))
    assert rows.groupby("query_id").size().eq(20).all() and hit >= 0.9 * 20 * 200
