"""Disclosing terms of rare entities."""

from fennwick.llm import pii

FILLER = "the case of more words with number"


def test_entities_of_one_document_are_protected(spark):
    rows = [(0, "the case of zorblax mail x@y.org of the case"), (1, "the case of quimby at +44 20 7946 0958 of more words"), (2, "the case of quimby at +44 20 7946 0958 of more words")]
    rows += [(i, f"{FILLER} {i} at mail") for i in range(3, 100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r["entity"], r["term"]) for r in pii.disclosures(docs).collect()}
    # The copy of a text is no second document: quimby stands in one, like zorblax. Each tells the value and its group.
    assert found == {("email:x@y.org", "zorblax"), ("email:*@y.org", "zorblax"), ("phone:442079460958", "quimby"), ("phone:4420*", "quimby")}
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    assert not any(name in t for t in clean.values() for name in ("zorblax", "quimby"))
    assert all(clean[i] == t for i, t in rows[3:])


def test_terms_are_sanitised_wherever_they_stand(spark):
    far = "the case of more words with number " * 4
    rows = [(i, f"The zorblax {far} mail x@y.org of the case {i} at. {far} of Zorblax, the case of 王 and li") for i in range(20)]
    rows += [(20, f"the case of Zorblax {far}")]
    rows += [(i, f"{FILLER} {i} at mail") for i in range(21, 20_000)]
    rows += [(20_000, f"the case of more {far}\nLi 王 x@z.org at {far}"), (20_001, "éx@q.org wu: Wu")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    # Far before the address but in its sentence, far after it, and in a document without the address.
    assert not any("zorblax" in clean[i].lower() for i in range(21))
    assert all(clean[i] == t for i, t in rows[21:20_000])
    assert "Wu" not in clean[20_001] and clean[20_001].startswith("é[EMAIL]")
