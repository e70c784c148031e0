"""The pipeline's stages, each on its own input, and the registered queries."""

import collections
import os

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from scorelark.llm import entries, language, lines, token_counts

from . import brute

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def pipeline():
    return pytest.importorskip("corpus_pipeline")


def test_stages(spark, make, edge, pipeline, tmp_path):
    spark.createDataFrame([(1, " ".join(edge[12][1].split()[:15]))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(d, t, lang, s) for d, t, lang, s in edge]
    stage = dict(pipeline.STAGES)
    docs = make(rows)
    kept = stage["language"](spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and kept.count() < docs.count()
    assert {r.doc_id for r in docs.collect() if r.text and any(c.isalpha() for c in r.text)} - {r.doc_id for r in kept.collect()} <= {14, 300, 301, 302, 303}
    deduped = stage["line_dedup"](spark, docs, str(tmp_path))
    assert deduped.columns == docs.columns and deduped.count() == docs.count()
    single = stage["near_duplicates"](spark, docs, str(tmp_path))
    assert single.columns == docs.columns and not {6, 7} & {r.doc_id for r in single.collect()}
    clean = stage["decontamination"](spark, docs, str(tmp_path))
    assert clean.columns == docs.columns and {r.doc_id for r in docs.collect()} - {r.doc_id for r in clean.collect()} == {9, 8}
    packed = stage["packing"](spark, docs, str(tmp_path))
    assert packed.where("offset = 0").count() == packed.select("sequence_id").distinct().count()
    for name in ("language", "line_dedup", "near_duplicates", "decontamination", "packing"):
        assert stage[name](spark, docs.limit(0), str(tmp_path)).count() == 0


def test_run_against_a_plain_version(spark, make, edge, pipeline, tmp_path):
    """All stages in a row, each plain; what language identification accepts is taken from the operator."""
    items = [(1, " ".join(edge[11][1].split()[-20:])), (2, " ".join(edge[12][1].split()[:15]))]
    rows = [(i, *r[1:]) for i, r in enumerate(edge)]
    make(rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    taken = {r.doc_id for r in language.accept(spark, docs, "").collect()}
    assert {i for i, t, *_ in rows if not t or not any(c.isalpha() for c in t)}.isdisjoint(taken)
    texts = {i: t for i, t, *_ in rows if i in taken}
    site = {i: s or "" for i, _, _, s in rows}
    places = collections.defaultdict(list)
    for i in sorted(texts):
        for k, line in enumerate(texts[i].split("\n")):
            if line.strip():
                places[line.strip(" ")].append((i, k))
    gone = {at for found in places.values() if len({site[i] for i, _ in found}) >= lines.MIN_SITES for at in found[1:]}
    for i, t in list(texts.items()):
        left = "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone)
        if left != t:
            texts[i] = left
        if left != t and not left.strip(" "):
            del texts[i]
    ids = sorted(texts)
    linked = brute.links([texts[i] for i in ids])
    texts = {d: texts[d] for k, d in enumerate(ids) if d == min(ids[j] for j in brute.component(linked, k))}
    texts = {d: t for d, t in texts.items() if not brute.hit_words(t, items)[0]}
    tokenizer = Tokenizer.from_file(public_tokenizers.path(token_counts.TOKENIZER))
    expected = {d: np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes() for d, t in texts.items()}
    got = collections.defaultdict(bytes)
    for r in sorted(pipeline.run(spark, str(tmp_path)).collect(), key=lambda r: (r.doc_id, r.piece)):
        got[r.doc_id] += r.ids
    assert dict(got) == expected and len(gone) >= 13


def test_short_lines_go_in_the_pipeline(spark, make, pipeline):
    rows = [(i, f"line number {i} of its own\nLes.\n\n\t\r\nEnd {i}", "fr", f"s{i}") for i in range(12)]
    got = {r.doc_id: r.text for r in dict(pipeline.STAGES)["line_dedup"](spark, make(rows), "").collect()}
    assert got == {i: t if i == 0 else t.replace("Les.\n", "") for i, t, *_ in rows}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
def test_run(spark, pipeline):
    out = pipeline.run(spark, DATA)
    assert out.count() > 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(entries.QUERIES))
def test_queries_return_a_row_per_document(spark, name):
    """Or per vector, for those that read embeddings."""
    got = entries.QUERIES[name](spark, DATA)
    table, key = ("documents", "doc_id") if "doc_id" in got.columns else ("embeddings", "vec_id")
    assert got.select(key).distinct().count() == spark.read.parquet(f"{DATA}/{table}.parquet").count()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(entries.ORACLE))
def test_oracles(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    r = con.sql(entries.ORACLE[name])
    got = entries.QUERIES[name](spark, DATA)
    assert sorted(r.columns) == sorted(got.columns)
    assert sorted(map(tuple, got.select(*r.columns).collect()), key=repr) == sorted(r.fetchall(), key=repr)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    got = entries.QUERIES["op2_language_id"](spark, "/root/testdata/sf0.01").join(docs, "doc_id").where("held_out")
    assert got.where("lang_pred = lang").count() >= 0.97 * got.count()
