"""Keyed stores of small batches against a plain merge."""

import random

import pytest
from pyspark.sql import functions as F

from docweave.operators import views
from docweave.sources.deltas import Conflict, Store, Stores, merged_before, with_number

FEED = Store("updates", ("day", "k"), "day string, k long, v string, error string")
LATEST = Store("prices", ("k",), "k long, v string, gone boolean", "latest")


def plain_feed(batches):
    """The merge row by row."""
    state, order = {}, []
    for number, rows in batches:
        for pos, (day, k, v, error) in enumerate(rows):
            if error and error.startswith("GET failed"):
                continue
            old = state.get((day, k))
            if old is None:
                order.append((day, k))
            if old is None or old[1] is not None:
                state[day, k] = (v, error)
    return [(day, k, *state[day, k]) for day, k in order]


def frame(spark, store, rows):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], store.schema + ", at long").repartition(3), "at"


def ordered(stores, name):
    return [tuple(r)[:-2] for r in stores.read(name).orderBy("first_batch", "first_pos").collect()]


def test_feed_equals_the_plain_merge(spark, tmp_path):
    rng = random.Random(1)
    stores = Stores(spark, str(tmp_path), [FEED, LATEST], fan=3)
    batches, latest = [], {}
    for number in range(8):
        rows = [(rng.choice("ab"), rng.randrange(12), f"v{number}.{i}", rng.choice([None, None, "parse", "GET failed: 500"])) for i in range(rng.choice([0, 3, 9]))]
        prices = list({k: (k, f"p{number}", rng.random() < 0.3) for k in rng.choices(range(9), k=4)}.values())
        batches.append((number, rows))
        latest |= {k: (v, gone) for k, v, gone in prices}
        both = {"updates": frame(spark, FEED, rows), "prices": frame(spark, LATEST, prices)}
        assert stores.merge(number, both) and not stores.merge(number, both)
        if number % 2:
            before = [ordered(stores, n) for n in stores.stores]
            stores.compact()
            assert [ordered(stores, n) for n in stores.stores] == before
    assert ordered(stores, "updates") == plain_feed(batches)
    assert {(r.k, r.v) for r in stores.read("prices").collect()} == {(k, v) for k, (v, gone) in latest.items() if not gone}
    assert stores.manifest()["batches"] == {"updates": [7], "prices": [7]}
    # every level has fewer folders than would be merged
    for own in stores.manifest()["folders"].values():
        levels = [f["level"] for f in own]
        assert max(map(levels.count, set(levels))) <= 3 and len(own) < 8


def test_what_is_written_follows_the_batch(spark, tmp_path):
    stores = Stores(spark, str(tmp_path), [FEED])
    size = lambda: sum(p.stat().st_size for p in tmp_path.rglob("*.parquet"))
    stores.merge(0, {"updates": (spark.range(60_000).selectExpr("'d' AS day", "id AS k", "sha(cast(id AS string)) AS v", "cast(null AS string) AS error"), "k")})
    large = size()
    stores.merge(1, {"updates": frame(spark, FEED, [("d", 3, "again", None), ("d", 60_001, "new", None)])})
    stores.compact()
    assert size() - large < large / 50
    assert stores.read("updates").count() == 60_001
    # keys go to the scan
    some = stores.read("updates", where=F.col("k") == 60_001)
    assert [r.v for r in some.collect()] == ["new"] and "PushedFilters: [IsNotNull(k), EqualTo(k,60001)]" in some._jdf.queryExecution().toString()


def test_all_stores_or_none(spark, tmp_path, monkeypatch):
    stores = Stores(spark, str(tmp_path), [FEED, LATEST])
    stores.merge(0, {"updates": frame(spark, FEED, [("d", 1, "a", None)]), "prices": frame(spark, LATEST, [(1, "p", False)])})
    pinned = stores.manifest()["number"]
    plain = Stores._write

    def fails_at_prices(self, store, rows):
        if store.name == "prices":
            raise OSError("between two stores")
        return plain(self, store, rows)

    both = {"updates": frame(spark, FEED, [("d", 2, "b", None)]), "prices": frame(spark, LATEST, [(1, "q", True)])}
    monkeypatch.setattr(Stores, "_write", fails_at_prices)
    with pytest.raises(OSError, match="between"):
        stores.merge(1, both)
    assert stores.manifest()["number"] == pinned and stores.read("updates").count() == 1
    monkeypatch.setattr(Stores, "_write", plain)
    assert stores.merge(1, both)
    # one who has pinned the old manifest sees the old state of both, whatever comes
    assert (stores.read("updates").count(), stores.read("prices").count()) == (2, 0)
    assert (stores.read("updates", pinned).count(), stores.read("prices", pinned).count()) == (1, 1)


def test_two_writers_and_collection(spark, tmp_path, monkeypatch):
    one, two = (Stores(spark, str(tmp_path), [FEED], fan=2) for _ in range(2))
    one.merge(0, {"updates": frame(spark, FEED, [("d", 1, "a", None)])})
    plain = Stores._write

    def other_comes_first(self, store, rows):
        name = plain(self, store, rows)
        monkeypatch.setattr(Stores, "_write", plain)
        two.merge(5, {"updates": frame(spark, FEED, [("d", 5, "e", None)])})
        return name

    monkeypatch.setattr(Stores, "_write", other_comes_first)
    with pytest.raises(Conflict):
        one.merge(1, {"updates": frame(spark, FEED, [("d", 2, "b", None)])})
    assert one.merge(1, {"updates": frame(spark, FEED, [("d", 2, "b", None)])}) and one.manifest()["batches"] == {"updates": [1, 5]}
    assert {r.k for r in one.read("updates").collect()} == {1, 2, 5}
    one.compact()

    # a folder that is written between the listing and the sweep is named by then, and stays
    def named_meanwhile(self, number=None, plain=Stores.manifest):
        if number is not None:
            monkeypatch.setattr(Stores, "manifest", plain)
            two.merge(2, {"updates": frame(spark, FEED, [("d", 9, "z", None)])})
        return plain(self, number)

    monkeypatch.setattr(Stores, "manifest", named_meanwhile)
    gone = one.vacuum(keep=1)
    assert gone and {r.k for r in one.read("updates").collect()} == {1, 2, 5, 9}
    assert len(one.manifests()) == 2 and one.vacuum(keep=1) == []


def test_stores_of_nothing(spark, tmp_path):
    stores = Stores(spark, str(tmp_path / "none"), [FEED])
    assert stores.read("updates").count() == 0 and stores.vacuum() == [] and stores.compact() == 0
    assert stores.merge(3, {"updates": frame(spark, FEED, [])}) and stores.read("updates").count() == 0
    assert with_number([2, 4], 3) == [4] and merged_before([4, 7], 7) and not merged_before([], 0)


def test_statistics_follow_random_changes(spark, tmp_path):
    """Counts, sums, distinct values, mode and extremes after inserts, replacements and deletions equal a recount; unchanged days aren't read."""
    rng = random.Random(4)
    stores = Stores(spark, str(tmp_path), [Store("counts", ("day",), "day string, n long, n_x long, total long", "sum"), Store("values", ("day", "v"), "day string, v string, n long", "sum")], fan=3)
    row = lambda: (rng.choice("abc"), rng.choice(["x", "y", "z", None]), rng.choice([None, *range(9)]))
    schema = "day string, v string, w long"
    state = []
    for number in range(7):
        old = rng.sample(state, min(len(state), rng.randint(0, 9)))
        new = [row() for _ in range(rng.choice([0, 5, 12]))]
        for r in old:
            state.remove(r)
        state += new
        changes = views.change_set(spark.createDataFrame(old, schema), spark.createDataFrame(new, schema))
        batch = {"counts": (views.count_changes(changes, ["day"], {"n_x": F.col("v") == "x"}, {"total": F.col("w")}), F.lit(0)), "values": (views.value_changes(changes, ["day"], "v"), F.lit(0))}
        assert stores.merge(number, batch) and not stores.merge(number, batch)
        stores.compact()
        days = {d: [r for r in state if r[0] == d] for d in {r[0] for r in state}}
        assert {r.day: (r.n, r.n_x, r.total) for r in stores.read("counts").collect()} == {d: (len(own), sum(v == "x" for _, v, _ in own), sum(w or 0 for _, _, w in own)) for d, own in days.items()}
        want = {}
        for d, own in days.items():
            values = [v for _, v, _ in own if v is not None]
            if values:
                want[d] = (len(set(values)), min(values), max(values), min(set(values), key=lambda v: (-values.count(v), v)))
        assert {r.day: tuple(r)[1:] for r in views.value_statistics(stores.read("values"), ["day"], "v").collect()} == want
