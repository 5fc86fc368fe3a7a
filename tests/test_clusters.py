"""Greedy clusters in parallel against the serial pass."""

import difflib
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from docweave.operators import clusters, diffs
from docweave.operators.clusters import Grams, Ratio
from docweave.plans import texts as plans


def dice_least(new, old, measure):
    def grams(s):
        runs = [s[i : i + measure.width] for i in range(max(len(s) - measure.width + 1, min(len(s), 1)))]
        return {(r, runs[:k].count(r)) for k, r in enumerate(runs)}

    x, y = grams(new), grams(old)
    return bool(x or y) and 2 * len(x & y) >= measure.least * (len(x) + len(y)) - 1e-9


def serial(rows, similar):
    """For (kind, order, key) the order of the row that opened each row's cluster: a plain pass over all rows."""
    opened, out = {}, {}
    for kind, at, key in sorted(rows, key=lambda r: r[1]):
        for first, keys in opened.setdefault(kind, []):
            if key in keys or similar(key, keys[0]):
                keys.append(key)
                out[at] = first
                break
        else:
            opened[kind].append((at, [key]))
            out[at] = at
    return out


def near_copies(rng, n, alphabet, longest):
    """Keys around a few bases, with copies, ties and keys of a few characters."""
    bases = ["".join(rng.choices(alphabet, k=rng.randint(0, longest))) for _ in range(max(n // 12, 2))]
    for _ in range(n):
        key = list(rng.choice(bases))
        for _ in range(rng.randint(0, max(len(key) // 6, 1))):
            at = rng.randint(0, len(key))
            key[at : at + rng.choice([0, 1, 3])] = rng.choice(["", "x", "yz"])
        yield "".join(key)


@pytest.mark.parametrize("measure, alphabet, longest", [(Ratio(), "abc", 14), (Ratio(), "abcdefghij 日本", 40), (Ratio(0.9), "ab", 300), (Grams(3), "abcd", 30), (Grams(8), "abc de", 200), (Grams(2, 0.5), "ab", 9)])
def test_equal_to_the_serial_pass(spark, measure, alphabet, longest):
    rng = random.Random(longest)
    rows = [(rng.choice("st"), i, k) for i, k in enumerate(near_copies(rng, 260, alphabet, longest))]
    similar = (lambda x, y: difflib.SequenceMatcher(None, x, y).ratio() >= measure.least) if isinstance(measure, Ratio) else (lambda x, y: dice_least(x, y, measure))
    want = serial(rows, similar)
    frame = spark.createDataFrame([(*r, "other") for r in rows], "kind string, at int, key string, rank string").repartition(5)
    # short stretches and rounds instead of one task give the same
    for first, one_task in ((1024, 200_000), (8, 0)):
        got = clusters.clustered(frame, ["kind"], [], "key", ["at"], measure, first, one_task).collect()
        assert {r["at"]: r.cluster for r in got} == want
    assert 2 < len(set(want.values())) < len(rows)
    for opened in set(want.values()):
        own = [r for r in got if r.cluster == opened]
        keys = [r.key for r in sorted(own, key=lambda r: r["at"])]
        often = max(keys, key=lambda k: (keys.count(k), -keys.index(k)))
        assert [r["at"] for r in own if r.representative] == [min(r["at"] for r in own if r.key == often)] and {r["size"] for r in own} == {len(own)}


def test_similar_keys_share_a_first_gram():
    """The bounds that pairs are found by, on pairs of all lengths."""
    rng = random.Random(7)
    order = np.zeros(clusters.CLASSES, np.int64)
    met = 0
    for measure in (Ratio(), Ratio(0.7), Grams(3), Grams(2, 0.6)):
        for _ in range(4000):
            old, new = near_copies(rng, 2, "abc" if rng.random() < 0.5 else "abcdefgh", rng.choice([3, 6, 20, 60]))
            ok = clusters.ratio(new, old) >= measure.least if isinstance(measure, Ratio) else dice_least(new, old, measure)
            if not ok or new == old:
                continue
            met += 1
            (a, _, x), (b, _, y) = (clusters.first_grams(measure, k, order) for k in (new, old))
            assert set(x.tolist()) & set(y.tolist()), (measure, new, old)
            grams = [set(clusters.numbered(clusters.runs_of(k, measure.width)).tolist()) for k in (new, old)]
            assert len(grams[0] & grams[1]) >= measure.shared(a, b)
    assert met > 1000
    with pytest.raises(ValueError, match="two thirds"):
        Ratio(0.6)


def test_edges_of_clusters(spark):
    schema = "source string, n int, m int, key string"
    assert clusters.clustered(spark.createDataFrame([], schema), ["source"], [], "key", ["n"]).count() == 0
    rows = [("a", 1, 2, None), ("a", 2, 1, ""), (None, 3, 1, ""), (None, 3, 1, ""), ("", 4, 1, "x"), ("b", 5, 1, "long key one"), ("b", 5, 0, "long key two")]
    got = {(r.source, r.n, r.m): (r.cluster.asDict(), r.representative, r["size"]) for r in clusters.clustered(spark.createDataFrame(rows, schema), ["source"], [], "key", ["n", "m"]).collect()}
    assert got[("a", 2, 1)] == ({"n": 1, "m": 2}, False, 2) and got[("a", 1, 2)][1] and got[(None, 3, 1)] == ({"n": 3, "m": 1}, True, 2)
    assert got[("b", 5, 1)][0] == {"n": 5, "m": 0} if clusters.ratio("long key one", "long key two") >= 0.8 else got[("b", 5, 1)][0] == {"n": 5, "m": 1}


def test_hot_source_is_in_no_single_task(spark):
    """A third of all rows in one source, of which most are near copies of one another: rows of a task stay few."""
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefghijkl", k=6)) for _ in range(400)]
    base = rng.choices(words, k=60)
    rows = []
    for i in range(3000):
        if i % 3 == 0:
            copy = list(base)
            copy[rng.randrange(60)] = rng.choice(words)
            rows.append(("hot", i, " ".join(copy)))
        else:
            rows.append((f"s{i % 50}", i, " ".join(rng.choices(words, k=60))))
    keys, n = clusters.ranked_keys(spark.createDataFrame(rows, "source string, i int, key string"), ["source"], "key", ["i"])
    grams = clusters.gram_table(keys, Grams(), clusters.gram_order(keys, Grams(), n))
    # all edges of the hot group would be half a million; only the first stretch has any
    found = clusters.greedy_first_keys(keys, n, Grams(), first=64)
    assert found.groupBy("opened").count().where("count > 900").count() == 1
    per_task = grams.repartition(64, "gram").groupBy(F.spark_partition_id()).count().toPandas()["count"]
    assert per_task.max() < 3 * per_task.mean()


SF = "/root/testdata/sf0.01"


def test_ratio_is_the_matchers():
    assert clusters.ratio("tide", "diet") == difflib.SequenceMatcher(None, "tide", "diet").ratio()


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
def test_char_diff_over_the_whole_corpus(spark):
    """Each different text against the one that opened its cluster, over all sources; near pairs by shingles of words are all met."""
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    grams = {t: clusters.numbered(clusters.runs_of(t, 16)) for _, t in docs}
    opened, want = [], {}
    seen = {}
    for i, t in docs:
        if t in seen:
            continue
        n = len(grams[t])
        # sizes that can't be similar are passed by, all others are compared whole
        first = next((f for f, o in opened if 2 * min(len(grams[o]), n) >= 0.8 * (len(grams[o]) + n) - 1e-9 and n and 2 * len(np.intersect1d(grams[o], grams[t], assume_unique=True)) >= 0.8 * (len(grams[o]) + n) - 1e-9), None)
        seen[t] = i if first is None else first
        if first is None:
            opened.append((i, t))
        else:
            want[first, i] = diffs.marked_changes(dict(docs)[first], t)
    got = {(r["first"], r["last"]): (r.before, r.after) for r in plans.char_diff(spark, SF).collect()}
    assert got == want and want

    words = {t: re.findall(r"[^ \t-\r]+", t) for _, t in docs}
    sets = {t: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for t, w in words.items()}
    by_shingle = {}
    for t, own in sets.items():
        for x in own:
            by_shingle.setdefault(x, []).append(t)
    near = {tuple(sorted((a, b))) for own in by_shingle.values() if len(own) < 60 for a in own for b in own if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    assert near and all(seen[a] == seen[b] for a, b in near)


def test_fuzzy_cluster_meets_copies_after_a_long_beginning(spark, tmp_path):
    """Texts that are equal at first and differ after it, within sources and languages, hot ones included."""
    rng = random.Random(6)
    words = [a + b + c for a in "kmst" for b in "aeio" for c in "nrlx"]
    start = " ".join(rng.choices(words, k=60))
    rows = []
    for i in range(120):
        base = random.Random(i % 9).choices(words, k=150)
        base[rng.randrange(150)] = "changed"
        rows.append((i, rng.choice(["hot", "hot", f"s{i % 3}"]), rng.choice(["en", None]), rng.choice([start + " " + " ".join(base), " ".join(base), None, "short"])))
    spark.createDataFrame(rows, "doc_id long, source string, lang string, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    want = serial([((s, g), i, t or "") for i, s, g, t in rows], lambda x, y: dice_least(x, y, Grams()))
    got = plans.fuzzy_cluster(spark, str(tmp_path)).collect()
    assert {r.doc_id: r.cluster for r in got} == want and len(set(want.values())) < 100


def test_only_grams_of_several_keys_become_lines(spark):
    """a text has a third of its characters as first grams; those that no other text has aren't written or joined."""
    rng = random.Random(12)
    rows = [(i, "".join(rng.choices("abcdefghijklmnop ", k=900))) for i in range(60)]
    copy = [(100, rows[7][1][:450] + "changed" + rows[7][1][450:])]
    keys, n = clusters.ranked_keys(spark.createDataFrame([("g", *r) for r in rows + copy], "source string, i int, key string"), ["source"], "key", ["i"])
    grams = clusters.gram_table(keys, Grams(), clusters.gram_order(keys, Grams(), n)).toPandas()
    assert set(grams["rank"]) == {7, 60} and 0 < len(grams) < 2 * 320
    opened = {r["rank"]: r.opened for r in clusters.greedy_first_keys(keys, n, Grams()).collect()}
    assert opened == {i: i for i in range(60)} | {60: 7}


def test_parts_of_grams_leave_the_disk(spark, monkeypatch):
    """lines of grams go part by part, give what one part gives, and neither they nor their shuffle files stay."""
    from docweave.sources import tables

    rng = random.Random(21)
    rows = [("s", i, k) for i, k in enumerate(near_copies(rng, 150, "abc de", 200))]
    want = serial(rows, lambda x, y: dice_least(x, y, Grams(8)))
    frame = spark.createDataFrame(rows, "kind string, at int, key string").repartition(4)
    made, keep = [], tables.fresh_path
    monkeypatch.setattr(tables, "fresh_path", lambda s, name: made.append(keep(s, name)) or made[-1])
    monkeypatch.setattr(clusters, "PART", 1000, raising=False)
    monkeypatch.setattr(clusters, "LINES", 1000, raising=False)
    got = clusters.clustered(frame, ["kind"], [], "key", ["at"], Grams(8), first=16).collect()
    assert {r["at"]: r.cluster for r in got} == want and 2 < len(set(want.values())) < len(rows)
    left = [re.sub(r"-\w+$", "", os.path.basename(p)) for p in made if os.path.isdir(p.removeprefix("file:"))]
    assert {"keys", "clusters", "marks"} <= set(left) and not {"lines", "grams", "met"} & set(left)
