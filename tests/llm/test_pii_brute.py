"""Disclosures and term spans against a plain statement of the method, and texts with very many spans."""

import math
import random
import re
import time

import regex
from pyspark.sql import functions as F

from fennwick.llm import pii
from tests.llm.test_operators import plain_spans

WORD = regex.compile(r"[\p{L}\p{N}]+")


def is_term(w):
    return len(w) >= 3 or regex.search(r"\p{L}", w)


def entity(kind, value):
    return f"{kind}:" + (re.sub("[^0-9]", "", value) if kind in ("card", "phone") else value.lower())


def classes(e):
    kind, value = e.split(":", 1)
    group = {"email": "*@" + value.rsplit("@", 1)[-1], "ip": ".".join(value.split(".")[:3]) + ".*", "card": value[:6] + "*", "phone": value[:4] + "*"}[kind]
    return {e, f"{kind}:{group}"}


def ancestors(w):
    return [w[:k] + "*" * (len(w) - k) for k in range(min(len(w) - 1, pii.LEADING), 0, -1)] if re.fullmatch("[0-9]{2,}", w) else []


def counted(texts, words, sentence=True):
    """The texts of each class, the number of texts of each term, and the texts that hold a term beside a class."""
    distinct = set(texts.values())
    held, both, seen = {}, {}, {}
    for t in distinct:
        spans = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in plain_spans(t))]
        for w in {x for w in set(WORD.findall(t)) if is_term(w) for x in [w.lower(), *ancestors(w)]}:
            seen[w] = seen.get(w, 0) + 1
        own = {c for k, a, b in spans for c in classes(entity(k, t[a:b]))}
        for c in own:
            held.setdefault(c, set()).add(t)
        # Each span becomes one word that names its entity; the text is then cut into sentences.
        marked, at = "", 0
        for k, a, b in spans:
            marked += t[at:a] if a > at else ""
            marked, at = marked + f"{entity(k, t[a:b]).encode().hex().upper()}", max(at, b)
        marked += t[at:]
        for part in regex.split(r"[\n\r]++|(?<=[.!?])\s++|(?<=[。！？])", marked) if sentence else [marked]:
            w = regex.findall(r"[\p{L}\p{N}]+", part)
            for i, x in enumerate(w):
                for c in re.findall("([0-9A-F]+)", x):
                    for y in w[max(0, i - words) : i + words + 1]:
                        if not re.search("[]", y) and is_term(y):
                            for z in [y.lower(), *ancestors(y)]:
                                for cc in classes(bytes.fromhex(c).decode()):
                                    both.setdefault((cc, z), set()).add(t)
    return held, seen, both


def brute(texts, words, generalise, remove, sentence=True):
    """{(class, term): disclosure}, and {doc: sorted (start, end, mask)} of the terms' places."""
    n, (held, seen, both) = len(set(texts.values())), counted(texts, words, sentence)
    score = {}
    for (c, y), where in both.items():
        n_b, n_c, n_t = len(where), len(held[c]), seen[y]
        if n_c < n:
            p = (n_b + pii.PRIOR * n_c / n) / (n_t + pii.PRIOR)
            score[c, y] = min(1.0, math.log(p * n / n_c) / math.log(n / n_c))
    score = {k: v for k, v in score.items() if v >= generalise}
    alone = {y for (c, y), v in score.items() if v >= remove and "*" not in y and seen[y] > len(both[c, y])}
    places = {}
    for d, t in texts.items():
        spans = [(int(a), int(b)) for _, a, b in (s.split(":") for s in plain_spans(t))]
        hidden = list(t)
        for a, b in spans:
            hidden[a:b] = "" * (b - a)
        own = {c for k, a, b in (s.split(":") for s in plain_spans(t)) for c in classes(entity(k, t[int(a) : int(b)]))}
        worst = {y: 1.0 for y in alone}
        for (c, y), v in score.items():
            if c in own:
                worst[y] = max(v, worst.get(y, 0.0))

        def mask(w):
            if worst[w.lower()] >= remove:
                return ""
            if re.fullmatch("[0-9]+", w):
                # What a number generalises to is a hit of the text only if a number of it stands there, as w does.
                return next((x for x in ancestors(w) if x not in worst), "[NUMBER]")
            return "[NAME]" if regex.match(r"\p{Lu}", w) else "[TERM]"

        found = [m for m in regex.finditer(r"[\p{L}\p{N}\ue000]+", "".join(hidden)) if "\ue000" not in m[0] and m[0].lower() in worst]
        places[d] = [(m.start(), m.end(), mask(m[0])) for m in found]
    return score, places


def made(seed, n):
    rnd = random.Random(seed)
    common, people = [f"w{i}" for i in range(40)], [(f"Name{i}", f"user{i}@mail.example") for i in range(12)]
    texts = {}
    for d in range(n):
        words = rnd.choices(common, k=rnd.randint(5, 60))
        for name, mail in rnd.sample(people, rnd.choice([0, 0, 0, 1, 2])):
            at = rnd.randrange(len(words))
            if rnd.random() < 0.5:
                words[at:at] = [f"203{10 + int(name[4:])}"]
            words[at:at] = [name, rnd.choice(["at", "é" + mail, "10.0.0.7"]), mail, rnd.choice([".", "x.", "!"])]
            words.append(rnd.choice([name, "the"]))
        if rnd.random() < 0.3:
            words.append(f"203{rnd.randrange(10, 22)}")
        texts[d] = rnd.choice([" ", " ", "\n"]).join(words)
    texts[n], texts[n + 1] = texts[0], "Name3 once more, 日本 Name3."
    return texts


def test_disclosures_and_places_against_brute_force(spark):
    masks = set()
    for words, sentence in ((2, True), (32, True), (32, False)):
        texts = made(words, 150)
        docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
        score, places = brute(texts, words, 0.6, 0.8, sentence)
        got = {(r["entity"], r["term"]): r["disclosure"] for r in pii.disclosures(docs, words=words, generalise=0.6, sentence=sentence).collect()}
        assert got.keys() == score.keys() and score and all(abs(got[k] - v) < 1e-9 for k, v in score.items())
        rows = pii.detect(docs, words=words, generalise=0.6, remove=0.8, sentence=sentence).select("row.doc_id", "terms").collect()
        assert {r["doc_id"]: [(t["start"], t["end"], t["mask"]) for t in r["terms"]] for r in rows} == places
        masks |= {m for found in places.values() for *_, m in found}
    assert {"[NAME]", ""} <= masks and any("*" in m for m in masks), masks


def test_groups_numbers_and_evidence(spark):
    """A group is weighed on all its entities, a number keeps the digits that tell nothing, a frequent word stays."""
    rows = [(i, f"write to Acme at user{i}@acme.example in 1987{i:02d} river") for i in range(20)]
    rows += [(i, f"plain words by the river in 1987{i % 100:02d} or 12{i % 83:02d}") for i in range(20, 400)]
    rows += [(400, "one zorblax mail solo@other.example")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r["entity"], r["term"]): r["disclosure"] for r in pii.disclosures(docs).collect()}
    # No address stands twice; its domain does, and the company's name tells it more surely than a word seen once.
    assert found["email:*@acme.example", "acme"] > found["email:*@other.example", "zorblax"] > pii.GENERALISE
    assert not [t for _, t in found if t in ("river", "in", "1987**")]
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    assert "Acme" not in clean[3] and clean[3].endswith("river") and all(clean[i] == t for i, t in rows[20:400])


def test_found_in_tables_of_any_size(spark):
    for n in (15, 30, 300):
        rows = [(0, "ask zorblax at x@y.org about it")] + [(i, f"ask at about it {i}") for i in range(1, n)]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        assert "zorblax" in {r["term"] for r in pii.disclosures(docs, generalise=0.8).collect()}


def test_long_sentences_are_read_in_rows(spark):
    text = " ".join(f"v{i} u{i}@h.example" if i % 7 == 0 else f"v{i}" for i in range(3000))
    docs = spark.createDataFrame([(0, text)] + [(i, f"plain {i}") for i in range(1, 40)], "doc_id long, text string")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {(r["entity"], r["term"]) for r in pii.contexts(pii.holders_of(docs), 5).select("entity", "term").collect()}
    _, _, both = counted(texts, 5)
    assert got == set(both)


def test_running_sums(spark):
    rnd = random.Random(1)
    for n in (0, 1, 2, 3, 10, 101):
        v = [rnd.randint(0, 9) for _ in range(n)]
        row = spark.createDataFrame([(v,)], "v array<int>").select(pii.running(F.col("v")).alias("s"), pii.running(F.col("v"), True).alias("m")).first()
        assert row["s"] == [sum(v[:i]) for i in range(n)] and row["m"] == [max(v[:i], default=0) for i in range(n)]


def test_a_text_with_very_many_spans(spark):
    text = " ".join(f"write person{i} at user{i}@host{i % 97}.example.com now" for i in range(20_000))
    docs = spark.createDataFrame([(0, text)] + [(i, f"plain words number {i} write at now") for i in range(1, 60)], "doc_id long, text string")
    began = time.time()
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    assert time.time() - began < 120
    assert clean[0].count("[EMAIL]") == 20_000 and "person" not in clean[0] and all(clean[i] == f"plain words number {i} write at now" for i in range(1, 60))
