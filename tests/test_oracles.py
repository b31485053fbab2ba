"""Every registered query against its SQL in DuckDB, on the small tables."""

import duckdb
import pytest

from quillstone.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return db


def rows(records, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted("|".join(repr(r[i]) for i in order) for r in records), [columns[i] for i in order]


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_sql(spark, small, duck, name):
    found = catalog.QUERIES[name](spark, small)
    got = rows([tuple(r) for r in found.collect()], found.columns)
    assert got[0] or name == "hamming_knn", "no rows"  # the small documents hold no digests that are near
    if name in catalog.ORACLES:
        want = duck.sql(catalog.ORACLES[name])
        assert got == rows(want.fetchall(), want.columns)


def test_every_oracle_has_a_query():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)


def test_no_llm_import_outside():
    from pathlib import Path

    root = Path(catalog.__file__).resolve().parents[1]
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "quillstone.llm" not in p.read_text(), p


def odd(spark, tmp_path, name, given, schema, table):
    """Rows of a query and of its SQL over one table of odd rows."""
    spark.createDataFrame(given, schema).coalesce(1).write.parquet(str(tmp_path / f"{table}.parquet"))
    db = duckdb.connect()
    db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    found, want = catalog.QUERIES[name](spark, str(tmp_path)), db.sql(catalog.ORACLES[name])
    return rows_of(found), rows(want.fetchall(), want.columns)


def rows_of(found):
    return rows([tuple(r) for r in found.collect()], found.columns)


def test_compressibility_of_odd_texts(spark, tmp_path):
    texts = ["a | b\nc | d", "| a |", "|\r|", "|\x85|", "| |", "\x0b[1]", "[1]\x0b", "[1]\n", "[1]\x85", " \t{\n}\r\n", "{} ", "[1]\nx", "x\n[1]", "", "\n", "a\n\na\n", "|\n|", "{|\n}", "\U0001f600é |x|", None]
    got, want = odd(spark, tmp_path, "compressibility_features", list(enumerate(texts)), "doc_id long, text string", "documents")
    assert got == want


def test_gravity_halfway_between_millionths(spark, tmp_path):
    keys = [0, 80907, 250185, 289824, 331954, 355889, 395528]
    got, want = odd(spark, tmp_path, "model_gravity", [(k,) for k in keys], "p_partkey long", "part")
    assert got == want


def test_lexical_topk_asks_for_every_document(spark, small):
    assert any(r["query_id"] % 50 for r in catalog.QUERIES["lexical_topk"](spark, small).collect())


def test_lexical_verdict_has_every_document(spark, small, duck):
    found = catalog.QUERIES["lexical_verdict"](spark, small)
    assert sorted(r["query_id"] for r in found.collect()) == [x for (x,) in duck.sql("SELECT doc_id FROM documents ORDER BY 1").fetchall()]
