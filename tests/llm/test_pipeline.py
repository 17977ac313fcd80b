"""The corpus pipeline on whole small tables."""

import corpus_pipeline as P
from chatlake.llm import queries as Q

TINY = "/root/testdata/sf0.001"


def test_stages_by_other_means(spark, duck):
    """Quality and decontamination by SQL, near copies by all pairs, tokens by the tokenizer."""
    import duckdb
    import numpy as np
    from tokenizers import Tokenizer

    from chatlake.llm.oracles import OP8, OP10, line_dedup_sql
    from chatlake.llm.tokens import tokenizer_path
    from .test_queries import groups, simhash

    con = duckdb.connect()
    con.execute(f"CREATE TABLE documents AS SELECT * FROM '{TINY}/documents.parquet'")
    con.execute(f"CREATE TABLE benchmark AS SELECT * FROM '{TINY}/benchmark.parquet'")
    con.execute(f"CREATE OR REPLACE TABLE documents AS SELECT * FROM documents WHERE doc_id IN (SELECT doc_id FROM ({OP10}) WHERE kept)")
    con.execute(f"CREATE OR REPLACE TABLE documents AS WITH {line_dedup_sql('documents', 'doc_id, text')} SELECT doc_id, left_text AS text FROM kept")
    text = dict(con.execute("SELECT doc_id, text FROM documents").fetchall())
    least = set(groups({k: simhash(t) for k, t in text.items()}).values())
    con.execute(f"DELETE FROM documents WHERE doc_id NOT IN ({', '.join(map(str, least))})")
    hit = {d for d, h in con.execute(f"SELECT doc_id, contaminated FROM ({OP8})").fetchall() if h}
    t = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    size = {k: len(t.encode(text[k], add_special_tokens=False).ids) + 1 for k in least - hit}
    rows = P.run(spark, TINY).collect()
    got = {}
    for r in rows:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == size
    assert len({r.sequence_id for r in rows}) >= np.ceil(sum(size.values()) / 4096)


def test_columns_and_empty_table(spark):
    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, docs, TINY).columns == docs.columns
        assert stage(spark, docs.limit(0), TINY).count() == 0
    assert P.STAGES[-1][1](spark, docs.limit(0), TINY).count() == 0


def test_registered():
    import __spark_entry__ as e

    names = e.queries()
    assert "pipeline" in names and set(Q.QUERIES) <= set(names) and set(Q.ORACLE) <= set(e.oracle_sql())
