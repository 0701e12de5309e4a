"""The pipeline: each stage acts on what its predecessor kept, and the SQL queries equal theirs."""

from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline as cp
from barloom.llm import oracles
from barloom.llm.common import stage

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    first = Counter(r.doc_id for r in docs.collect())
    for i, (name, f) in enumerate(cp.STAGES):
        docs = stage(f(spark, docs, SF), name)
        counts.append(docs.count())
        assert docs.columns == columns if i < 4 else docs.columns == [*columns, "shard", "slot"]
        assert set(r.doc_id for r in docs.collect()) <= set(first)
    assert counts[0] >= counts[1] >= counts[2] >= counts[3] > 0 and counts[4] == counts[5] > 0
    assert entry.queries()["pipeline"](spark, SF).count() == counts[5]


def cases(spark, n=60):
    """Rows with nulls, empty and very long texts, ties, repeats, repeated ids, and extra columns whose names clash."""
    base = spark.read.parquet(f"{SF}/documents.parquet").limit(n).collect()
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in base]
    t = rows[0][1]
    rows += [(900, None, "en", "s", None), (901, "", None, None, 0), (None, t, "en", "s", 1), (None, None, None, None, None), (902, t, "en", "s", 1), (902, t, "en", "s", 1), (902, rows[1][1], "en", None, 1), (903, (t + " ") * 400, "en", "s", 1), (904, "123 456 --", None, "", 1), (905, "x" * 200_000, None, "s", 1)]
    names = ["row", "Score", "LANG_PRED", "_copy", "copies", "n_words", "Items", "bucket", "at", "id"]
    return spark.createDataFrame([(*r, *(f"{n}-{r[0]}" for n in names)) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names)).repartition(3), names


@pytest.mark.parametrize("at", range(5))
def test_stage_takes_any_rows(spark, at):
    docs, names = cases(spark)
    name, f = cp.STAGES[at]
    got = f(spark, docs, SF)
    assert got.columns == (docs.columns if at < 4 else [*docs.columns, "shard", "slot"])
    before = Counter((r.doc_id, r.text) for r in docs.collect())
    rows = got.collect()
    assert all(r[n] == f"{n}-{r.doc_id}" for r in rows for n in names)
    after = Counter((r.doc_id, r.text) for r in rows)
    assert set(after) <= set(before)
    if name == "language_id":
        assert not any(t is None or not any(map(str.isalpha, t)) for _, t in after)
    elif name == "near_dedup":
        assert all(n == 1 for (i, t), n in after.items() if i is not None) and after[(900, None)] == 1
    elif name == "decontamination":
        assert after[(900, None)] == 1 and after[(None, None)] == 1
    elif name == "mixing":
        assert all(n <= 3 * before[k] for k, n in after.items())
    else:
        assert after == before
    empty = f(spark, docs.limit(0), SF)
    assert empty.columns == got.columns and empty.count() == 0


def text(v):
    return None if v is None or v != v else f"{v:.6f}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = entry.queries()[name](spark, SF)
    columns = sorted(got.columns)
    want = con.sql(oracles.SQL[name])
    assert columns == sorted(want.columns)
    order = [want.columns.index(c) for c in columns]
    assert Counter(tuple(text(v) for v in r) for r in got.select(*columns).collect()) == Counter(tuple(text(r[i]) for i in order) for r in want.fetchall())
