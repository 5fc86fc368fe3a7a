"""The pipeline against a brute-force version, and the queries that have SQL against it."""

import os
import random

import duckdb
import pytest

import corpus_pipeline
from docweave.llm import quality, secrets
from docweave.llm.queries import ORACLES, QUERIES
from tests.llm.conftest import SCHEMA, prose
from tests.llm.test_dedup import brute_components, norm, shingle_sets
from tests.llm.test_tokens import JSON, check_packing

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(4)
    rows = []
    for i in range(120):
        t = prose(rng, rng.randint(40, 120))
        if i % 6 == 0:
            t = " ".join(w + "$$$" for w in t.split(" "))
        if i % 5 == 1:
            t += ' token = "abcdef0123456789" end'
        rows.append((i, t, "en", "s", len(t)))
    rows += [(200 + i, rows[i][1].upper() if i % 2 else rows[i][1], "en", "s", 1) for i in range(1, 30)]
    rows += [(300 + i, rows[i][1] + " " + rng.choice(["kan", "mil"]), "fr", "s", 1) for i in range(1, 20)]
    rows += [(900, None, None, None, None), (901, "", "", "", 0)]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 6 != 0), 0) for i in range(100)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), rows


def test_stages_and_run(spark, sf_dir):
    from tokenizers import Tokenizer

    path, rows = sf_dir
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, path).columns == docs.columns
    verdict = {r.doc_id: r.kept for r in quality.quality_report(docs, spark.read.parquet(f"{path}/labels.parquet")).collect()}
    left = [(i, t) for i, t, *_ in rows if verdict[i]]
    assert any(not verdict[i] for i, *_ in rows) and len(left) > 80
    last = {}
    for i, t in left:
        last[norm(t)] = max(last.get(norm(t), i), i)
    left = [(i, t) for i, t in left if last[norm(t)] == i]
    root = brute_components(shingle_sets(left))
    left = [(i, secrets.redacted(t, secrets.scan(t)[1])) for i, t in left if root[i] == i]
    assert any(secrets.REDACTED in t for _, t in left)
    got = corpus_pipeline.run(spark, path).collect()
    assert {r.doc_id for r in got} == {i for i, _ in left}
    check_packing(got, left, 2048, Tokenizer.from_file(JSON))


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for name_of in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {name_of} AS SELECT * FROM '{SF}/{name_of}.parquet'")
    got, want = QUERIES[name](spark, SF), con.execute(ORACLES[name])
    columns = sorted(c[0] for c in want.description)
    assert sorted(got.columns) == columns
    at = [[c[0] for c in want.description].index(c) for c in columns]
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=repr)


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "near_dedup", "secret_scan", "packing"]
