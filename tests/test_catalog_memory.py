"""Catalogs are built and written by tasks that hold their own split, not the whole table's postings or lists."""

import re
from collections import Counter
from pathlib import Path

import pytest

from fennwick import tables as T
from fennwick.operators import catalog as Q
from fennwick.plans import catalog_build as E
from fennwick.plans import source_queries as S
from fennwick.sources.store import Store

DOCS = [(1, "red red Fox", "fox and red"), (2, None, "z z z"), (3, "", ""), (4, "one", None), (5, "b a b", "a c a")]


def _counted(docs):
    words = lambda text: re.findall(r"\w+", (text or "").lower())
    names, bodies = Counter(), Counter()
    for doc, name, body in docs:
        names.update((t, doc) for t in words(name))
        bodies.update((t, doc) for t in words(body))
    return {k: (names[k], bodies[k]) for k in names | bodies}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("repeated", [[], [(1, "red hen", "owl"), (2, "z", "")]])
def test_postings_are_counted_by_row(spark, repeated):
    rows = DOCS + repeated
    postings, _ = Q.build_postings(spark.createDataFrame(rows, "doc_id long, name string, body string"))
    found = postings.select("term", "doc_id", "name_tf", "body_tf").collect()
    got = {(r["term"], r["doc_id"]): (r["name_tf"], r["body_tf"]) for r in found}
    assert len(found) == len(got) and got == _counted(rows)
    assert dict(postings.dtypes) == {"term": "string", "doc_id": "bigint", "name_tf": "bigint", "body_tf": "bigint", "size": "int"}
    assert repeated or "Aggregate" not in _plan(postings)


def test_lists_are_not_joined_in_one_task(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(k, "subject", k) for k in range(40)], "rowid long, kind string, source_id long").repartition(8)
    postings, lengths = Q.build_postings(docs.selectExpr("rowid as doc_id", "'a' as name", "'b' as body"))
    tables = {"docs": docs, "postings": postings, "lengths": lengths, "meta": spark.createDataFrame([("source_date", "x")], "key string, value string")}
    stored, plans = Q.store_tables(spark, str(tmp_path / "store"), tables, 0), {}

    def write(self, name, rows, made=Store.write, **options):
        plans[name] = _plan(rows)
        return made(self, name, rows, **options)

    monkeypatch.setattr(Store, "write", write)
    less, missing = stored.delete("subject:3, subject:99", write=True)
    small = less.compact(1)
    assert missing == ["subject:99"] and small.docs.count() == 39 and small.postings.count() == 78 and len(small.docs.inputFiles()) == 1
    assert set(plans) == {"deleted", *tables} and not any("Coalesce " in p for p in plans.values())


def test_a_build_keeps_no_table_that_it_has_used(spark, tmp_path, monkeypatch):
    """No two lists lie on disk unwritten, edges are gone before documents are numbered, and in the end only the store is left."""
    seen, cleaned = {}, []
    monkeypatch.setattr(T, "shared_dir", lambda _: f"file://{tmp_path}/shared")
    names = lambda: sorted(p.name.rsplit("-", 1)[0] for p in Path(f"{tmp_path}/shared/stages").iterdir())
    key, numbered, dumped, write = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", E.number_rows, E.read_dumps, Store.write
    monkeypatch.setattr(E, "number_rows", lambda docs: seen.update(numbered=names()) or numbered(docs))
    monkeypatch.setattr(E, "read_dumps", lambda s, folder: seen.update(files=[p.suffix for p in Path(folder.removeprefix("file://")).glob("*/part-*")]) or dumped(s, folder))
    monkeypatch.setattr(Store, "write", lambda *a, **k: cleaned.append(spark.conf.get(key)) or write(*a, **k))
    found = S.catalog_build(spark, "/root/testdata/sf0.001")
    left = names()
    assert {r["kind"] for r in found.select("kind").distinct().collect()} == {"subject", "character", "person"}
    lists = ["catalog-actors", "catalog-cast", "catalog-jobs", "catalog-related", "catalog-staff", "catalog-ties", "catalog-works"]
    assert set(seen["files"]) == {".gz"} and left == ["catalog"] and set(cleaned) == {"true"} and spark.conf.get(key) == "false"
    assert seen["numbered"] == sorted([*lists, "dump-character", "dump-person", "dump-subject", *["catalog-kept"] * 3])


def test_only_stage_tables_are_discarded(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "own"))
    own, staged = spark.read.parquet(str(tmp_path / "own")), T.materialize(spark.range(4), "some")
    other = T.materialize(spark.range(5), "some")
    T.discard(own.join(staged, "id"))
    assert own.count() == 3 and other.count() == 5 and not any(Path(f.removeprefix("file://")).exists() for f in staged.inputFiles())
