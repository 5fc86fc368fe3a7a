"""Search by an index against a scan."""

import random

import pytest
from pyspark.sql import functions as F

from docweave.operators import search, substring_index

FIELDS = ["n", "g", "t"]


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(5)
    words = ["alpha", "beta", "gam ma", "日本語", "é", "x", "", "alphabet", "%_", "\\\\"]
    rows = [(i % 50, rng.choice(words), rng.choice([None, *words]), " ".join(rng.choices(words, k=rng.randint(0, 9)))) for i in range(900)]
    return spark.createDataFrame([(*r, "other") for r in rows], "id long, n string, g string, t string, number string".replace("number", "extra")).repartition(7)


@pytest.fixture(scope="module")
def index(spark, table, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index") / "own")
    substring_index.build(table, path, FIELDS, ["id"], block=64)
    return path


def scanned(table, words, cap):
    own = table.withColumns({f: F.coalesce(f, F.lit("")) for f in FIELDS})
    return search.search_names(own, FIELDS, words, ["id"], cap)


@pytest.mark.parametrize("words", [["alpha"], ["alphabet", "beta"], ["日本"], ["é"], ["x"], ["a", "日本語"], ["gam ma"], ["m m"], ["%_"], ["\\\\"], ["no such"], ["beta alpha"], ["a a"], [" "], [], ["zz", "a"]])
def test_same_rows_and_totals_as_a_scan(spark, table, index, words):
    want = scanned(table, words, None)
    got = substring_index.search(spark, index, words, FIELDS, FIELDS[:2], None, 64)
    row = lambda r: (r.id, r.n, r.g, r.t, r.score, r.total)
    assert sorted(map(row, got.collect())) == sorted(map(row, want.collect()))
    # of a cap the best by score and id are taken; rows that tie may be any
    place = lambda r: (r.score, r.id, r.total)
    assert list(map(place, substring_index.search(spark, index, words, FIELDS, FIELDS[:2], 20, 64).collect())) == list(map(place, scanned(table, words, 20).collect()))


def files(df):
    return df.select(F.input_file_name().alias("f")).distinct().count()


def test_what_is_read_falls_with_selectivity(spark, tmp_path):
    rows = spark.range(20_000, numPartitions=4).selectExpr("id", "concat('w', id % 97, ' ', sha(cast(id AS string))) AS n", "'' AS g", "'' AS t")
    path = str(tmp_path / "own")
    substring_index.build(rows, path, FIELDS, ["id"], block=64)
    every = spark.read.parquet(f"{path}/grams")
    needs = substring_index.wanted(["w5 "])
    read = substring_index.postings(spark, path, needs)
    assert files(read) < files(every) / 4 and read.count() < every.count() / 10
    # a rare word leaves few rows, in few folders of rows
    rare = rows.where("id = 12345").first().n[-12:]
    left = substring_index.candidates(spark, path, [rare], 64)
    assert left.count() < 20 and left.select("part").distinct().count() <= left.count()
    got = substring_index.search(spark, path, [rare], FIELDS, FIELDS[:2], 5, 64).collect()
    assert [(r.id, r.total) for r in got] == [(12345, 1)]
    plan = substring_index.postings(spark, path, needs)._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "EqualTo(gram,w5 )" in plan


def test_index_of_nothing(spark, tmp_path):
    empty = spark.createDataFrame([], "id long, n string, g string, t string")
    substring_index.build(empty, str(tmp_path / "own"), FIELDS, ["id"])
    assert substring_index.search(spark, str(tmp_path / "own"), ["abc"], FIELDS, FIELDS[:2]).count() == 0


def test_trigrams_meet_as_lines_of_blocks(spark, tmp_path):
    """F8: what is shuffled for the index is a line for each trigram, block and stretch of rows, not one for each row."""
    rows = spark.range(5000, numPartitions=1).selectExpr("id", "'abcdefghij' AS n", "'' AS g", "if(id % 2 = 0, 'klmnopqrst', null) AS t")
    seen = []
    plain = type(rows).mapInArrow
    type(rows).mapInArrow = lambda self, *a, **b: seen.append(plain(self, *a, **b)) or seen[-1]
    try:
        substring_index.build(rows, str(tmp_path / "own"), FIELDS, ["id"], block=500)
    finally:
        type(rows).mapInArrow = plain
    assert seen[-1].count() < 5000
    assert spark.read.parquet(f"{tmp_path}/own/grams").where("gram = 'abc'").selectExpr("sum(size(places))").first()[0] == 5000
    assert substring_index.search(spark, str(tmp_path / "own"), ["cde", "lmn"], FIELDS, FIELDS[:2], 5, 500).first().total == 2500
