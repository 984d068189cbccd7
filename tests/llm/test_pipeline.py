"""The pipeline against a brute-force version of its stages."""

from __future__ import annotations

import collections
import random

from test_llm import TOKENIZER, groups_by_force
from tokenizers import Tokenizer

import corpus_pipeline
from casebook.llm import decontam, quality, secrets
from casebook.llm.common import flat  # noqa: F401

FOLDER = "/root/testdata/sf0.001"


def by_force(spark):
    import duckdb

    from casebook.llm.oracles import OP6, OP9

    def tables(rows):
        con = duckdb.connect()
        con.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
        con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
        con.sql(f"CREATE VIEW benchmark AS SELECT * FROM '{FOLDER}/benchmark.parquet'")
        return con

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    kept = {x for x, k in tables(rows).sql(f"SELECT doc_id, kept FROM ({OP9})").fetchall() if k}
    rows = [r for r in rows if r[0] in kept]
    kept = {d for d, _, _, k in groups_by_force(rows, 5, 80) if k}
    rows = [r for r in rows if r[0] in kept]
    bad = {x for (x,) in tables(rows).sql(f"SELECT DISTINCT doc_id FROM ({OP6})").fetchall()}
    rows = [(d, secrets.redacted(t, secrets.spans(t))) for d, t in rows if d not in bad]
    library = Tokenizer.from_file(TOKENIZER)
    return {d: library.encode(t, add_special_tokens=False).ids for d, t in rows}


def test_pipeline_equals_brute_force(spark):
    found = {r.doc_id: (r.n_tokens, r.ids) for r in corpus_pipeline.run(spark, FOLDER).collect()}
    true = by_force(spark)
    assert found == {d: (len(ids), ids) for d, ids in true.items()} and 0 < len(true)


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, FOLDER).columns == docs.columns
        assert stage(spark, docs.limit(0), FOLDER).count() == 0
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "decontamination", "secret_scan", "encoding"]
    assert quality.POLICIES and decontam.MASKS and collections


def test_pipeline_takes_odd_rows(spark, tmp_path):
    """Nulls, empty and very long texts, repeated rows, null ids, clashing columns, and an empty table."""
    r = random.Random(3)
    prose = lambda n: " ".join("".join(r.choices("abcdefghij", k=r.randint(3, 8))) for _ in range(n))
    copied, key = prose(120), "password=" + "a1" * 8
    texts = {1: None, 2: "", 3: " \n ", 4: copied, 5: copied, 6: prose(90) + f" {key} " + prose(20), 7: prose(60_000), 8: "short text", 9: prose(80)}
    extra = dict(kept=True, row="x", r1=1, __r1=2, node="n", ids="i", fail_bits=None, n=5)
    rows = [dict(doc_id=i, text=t, lang=None, n_chars=None, **extra) for i, t in texts.items()]
    rows += [rows[8], dict(rows[8], doc_id=None, text=prose(70)), dict(rows[8], doc_id=None, text=prose(70))]
    schema = "doc_id long, text string, lang string, n_chars long, kept boolean, row string, r1 int, __r1 int, node string, ids string, fail_bits string, n int"
    items = [(1, "a benchmark item of which no document has any word at all")]
    for name, docs in (("odd", rows), ("empty", [])):
        spark.createDataFrame(docs, schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    found = corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()
    # one of two copies and of two equal rows stays, and so do both rows without an id
    assert sorted((x.doc_id for x in found), key=str) == [4, 6, 7, 9, None, None]
    library = Tokenizer.from_file(TOKENIZER)
    true = {i: library.encode(texts[i], add_special_tokens=False).ids for i in (4, 7, 9)}
    assert true == {x.doc_id: x.ids for x in found if x.doc_id in true}
    assert key not in library.decode(next(x.ids for x in found if x.doc_id == 6))
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0
    docs = spark.read.parquet(f"{tmp_path}/odd/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, f"{tmp_path}/odd")
        assert kept.columns == docs.columns
        assert {tuple(x[c] for c in extra) for x in kept.collect()} == {tuple(extra.values())}
