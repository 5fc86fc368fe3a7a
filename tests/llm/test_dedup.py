"""Exact, near and substring dedup against brute force."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from docweave.llm import components as components_module
from docweave.llm import exact_dedup, near_dedup, substring_dedup
from docweave.llm.components import components
from docweave.llm.storage import beside

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def norm(t):
    return (t or "").translate(LOWER)


def as_counter(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


def test_exact(docs, corpus):
    groups = defaultdict(list)
    for i, t in corpus:
        groups[norm(t)].append(i)
    want = Counter()
    for i, t in corpus:
        ids = groups[norm(t)]
        keep = max((x for x in ids if x is not None), default=None)
        want[i, keep, len(ids), i == keep, hashlib.sha256(norm(t).encode()).hexdigest()] += 1
    assert as_counter(exact_dedup.exact_duplicates(docs), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == want


def test_exact_drop_keeps_columns_and_one_of_each(docs, corpus, spark):
    kept = exact_dedup.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns
    assert Counter(norm(r.text) for r in kept.collect()) == Counter({norm(t): 1 for _, t in corpus})
    unique = docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    assert {r.doc_id for r in exact_dedup.drop_exact_duplicates(unique).collect()} == {max(i for i, u in corpus if i is not None and norm(u) == norm(t)) for i, t in corpus if i is not None}


def test_tree_merge_with_many_rounds(spark):
    keys = spark.sql("SELECT id, unhex(sha1(string(id % 40))) AS key FROM range(500)").repartition(23)
    got = exact_dedup.tree_merge(keys, "min", partitions=300).collect()
    assert sorted((r.keep_id, r.group_size) for r in got) == [(i, 13 if i < 20 else 12) for i in range(40)]


def shingle_sets(corpus):
    out = {}
    for i, t in corpus:
        w = WORD.findall(norm(t))
        out.setdefault(i, set()).update({tuple(w)} if 0 < len(w) < 5 else zip(*(w[k:] for k in range(5)), strict=False) if w else ())
    return out


def brute_components(sets):
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations([i for i in sets if i is not None and sets[i]], 2):
        common = len(sets[a] & sets[b])
        if 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in sets}


def test_near(docs, corpus):
    sets = shingle_sets([(i, t) for i, t in corpus if i is not None])
    want = brute_components(sets)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs).collect() if r.doc_id is not None}
    assert got == {i: (len(sets[i]), want[i], want[i] == i) for i in sets}
    alone = [r for r in near_dedup.near_duplicates(docs).collect() if r.doc_id is None]
    assert len(alone) == 2 and all(r.component_id is None and r.kept for r in alone)


def test_near_in_small_tiles(docs, corpus, monkeypatch):
    monkeypatch.setattr(near_dedup, "TILE", 3)
    monkeypatch.setattr(near_dedup, "LUMP", 1)
    monkeypatch.setattr(near_dedup, "DEALT", 2)
    want = brute_components(shingle_sets([(i, t) for i, t in corpus if i is not None]))
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs).collect() if r.doc_id is not None}
    assert got == want


def test_near_group_of_all_similarities(spark, monkeypatch):
    """A group of copies with 0 to 9 words changed, of which many are just not similar enough, against brute force: full recall."""
    monkeypatch.setattr(near_dedup, "TILE", 16)
    monkeypatch.setattr(near_dedup, "LUMP", 4)
    monkeypatch.setattr(near_dedup, "HOT", 7)
    rng = random.Random(8)
    base = [rng.choice("kmstr") + str(rng.randrange(900)) for _ in range(100)]
    rows = []
    for i in range(160):
        words = list(base)
        for _ in range(i % 10):
            words[rng.randrange(100)] = f"new{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    rng.shuffle(rows)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    want = brute_components(shingle_sets(rows))
    assert got == want and 20 < len(set(want.values())) < 160


def morse(n, a="a", b="b"):
    out = [a, b]
    while len(out) < n:
        out += [b if x == a else a for x in out]
    return "".join(out)


def test_words_of_equal_sums_are_told_apart(spark):
    """Words that collide under any polynomial hash modulo 2 ** 64."""
    rows = [(k + 2 * i, morse(n, *"ab"[:: 1 - 2 * k])) for i, n in enumerate((1024, 4096)) for k in (0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dedup.near_duplicates(docs).collect()
    assert all(r.kept and r.component_id == r.doc_id for r in got) and len(got) == 4
    long = spark.createDataFrame([(i, " ".join([t, *(f"w{k}" for k in range(60))][: 61 if i < 9 else 60])) for i, t in rows], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substring_dedup.remove_repeats(long).collect()} == {0: 0, 1: 60, 2: 60, 3: 60}


def test_near_drop(docs):
    unique = docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    kept = near_dedup.drop_near_duplicates(unique)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in near_dedup.near_duplicates(unique).where("kept").collect()}


@pytest.mark.parametrize("one_task", [0, 1_000_000])
def test_components(spark, monkeypatch, one_task):
    monkeypatch.setattr(components_module, "ONE_TASK", one_task)
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (300, 200), (7, 7), (2, 1)]
    got = {r.id: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {200: 100, 300: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_few_links_need_few_tasks(spark):
    """What the driver keeps of a round doesn't go with the number of shuffle partitions; without adaptive coalescing, as on check_h."""
    links = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    held = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    spark.sparkContext.setJobGroup("few-links", "")
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        got = {r.id: r.root for r in components(links, 40).collect()}
    finally:
        spark.sparkContext._jsc.clearJobGroup()
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {i: 0 for i in range(1, 41)}
    seen = spark.sparkContext.statusTracker()
    stages = {s for j in seen.getJobIdsForGroup("few-links") for s in seen.getJobInfo(j).stageIds}
    ran = [i for i in map(seen.getStageInfo, stages) if i is not None]
    assert len(ran) > 4 and sum(i.numCompletedTasks for i in ran) < 4 * len(ran)


def test_aggregates_beside_rows(spark):
    """By a window and by a join, with one group that has most rows."""
    rows = spark.range(4000).selectExpr("id", "IF(id % 5 < 4, 0, id % 7) AS k", "id % 3 AS count")
    ways = [beside(rows, ["k", "count"], {"n": F.count("*"), "least": F.min("id")}, 4000, one_task) for one_task in (0, 4000)]
    assert ways[0].columns == ways[1].columns == ["id", "k", "count", "n", "least"]
    one, other = (sorted(map(tuple, w.collect())) for w in ways)
    assert one == other and len(one) == 4000 and max(r[3] for r in one) > 1000


def brute_repeats(corpus):
    first = {}
    parsed = [(i, WORD.findall(t or "")) for i, t in corpus]
    for i, w in parsed:
        if i is not None:
            for p in range(len(w) - 49):
                k = tuple(w[p : p + 50])
                first[k] = min(first.get(k, i), i)
    out = Counter()
    for i, w in parsed:
        gone = set()
        for p in range(len(w) - 49) if i is not None else ():
            if first[tuple(w[p : p + 50])] < i:
                gone.update(range(p, p + 50))
        kept = " ".join(x for q, x in enumerate(w) if q not in gone)
        out[i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    return out


def test_repeats(docs, corpus):
    got = substring_dedup.remove_repeats(docs)
    assert as_counter(got, "doc_id", "n_words", "n_removed", "kept_sha256") == brute_repeats(corpus)
    assert sum(n for (_, _, gone, _), n in brute_repeats(corpus).items() if gone) > 50
    texts = substring_dedup.remove_repeats(docs, with_text=True).where("kept_text IS NOT NULL AND doc_id IS NOT NULL")
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in texts.collect())


def test_factors():
    import numpy as np

    parse = lambda *rows: substring_dedup.factors(*np.array(rows, np.int64).reshape(-1, 3).T)
    assert parse((1, 9, 5), (2, 9, 6), (4, 9, 8)) == [(1, 51, 9, 5), (4, 50, 9, 8)]
    assert parse((1, 9, 5), (2, 3, 6), (3, 3, 7), (4, 3, 9)) == [(1, 50, 9, 5), (2, 51, 3, 6), (4, 50, 3, 9)]
    assert parse() == []


def test_texts_of_one_id_are_parsed_apart(spark):
    shared = " ".join(f"w{i}" for i in range(60))
    rows = [(1, shared), (5, f"x y z {shared}"), (5, f"{shared} end"), (5, f"{shared} end"), (7, shared + " w" * 80)]
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    assert as_counter(got, "doc_id", "n_words", "n_removed", "kept_sha256") == brute_repeats(rows)


def test_factors_stand_in_their_references(spark):
    """On random texts made of shared pieces: each factor's words are the reference's, and factors cover what brute force covers."""
    rng = random.Random(21)
    pieces = [[f"p{k}w{i}" for i in range(rng.randint(30, 90))] for k in range(12)]
    rows = [(i, " ".join(w for _ in range(rng.randint(1, 6)) for w in (rng.choice(pieces) if rng.random() < 0.7 else [f"own{rng.randrange(10**6)}"] * rng.randint(1, 60)))) for i in range(60)]
    words = {i: t.split(" ") for i, t in rows}
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), with_factors=True)
    found = got.collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in found) == brute_repeats(rows)
    spans = [(r.doc_id, f) for r in found for f in r.factors]
    assert len(spans) > 30
    for doc, f in spans:
        assert f.ref_id < doc and f.length >= 50
        assert words[doc][f.start : f.start + f.length] == words[f.ref_id][f.ref_start : f.ref_start + f.length]


def test_empty_tables(empty):
    assert exact_dedup.exact_duplicates(empty).count() == 0 and exact_dedup.drop_exact_duplicates(empty).count() == 0
    assert near_dedup.near_duplicates(empty).count() == 0 and near_dedup.drop_near_duplicates(empty).count() == 0
    assert substring_dedup.remove_repeats(empty).count() == 0
