import difflib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docweave.functions.names import candidate_prefixes
from docweave.operators import classify, diffs, incremental, keyed, lookups, search

LINES = st.lists(st.tuples(st.sampled_from("pq"), st.sampled_from("abcd")), max_size=8)


@settings(max_examples=300, deadline=None)
@given(LINES, LINES)
def test_line_changes_account_for_every_line(old, new):
    changes = diffs.line_changes(old, new)
    gone = [(p, b) for _, p, b, _ in changes if b is not None]
    come = [(p, a) for _, p, _, a in changes if a is not None]
    rest = list(old)
    for x in gone:
        rest.remove(x)
    assert sorted(rest + come) == sorted(new)
    assert not changes or old != new


def test_line_changes_pair_by_path():
    assert diffs.line_changes([("p", "a"), ("q", "b")], [("q", "c"), ("r", "d")]) == [("removed", "p", "a", None), ("changed", "q", "b", "c"), ("added", "r", None, "d")]


def test_marked_changes():
    assert diffs.marked_changes("a<b", "a<c") == ("a&lt;<del>b</del>", "a&lt;<ins>c</ins>")
    assert "<del>" not in diffs.marked_changes("x" * 4000, "y" * 4000)[0]


def test_first_and_last_rows(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), (None, 1, "z")], "k string, i int, v string")
    assert {(r.k, r.v) for r in keyed.first_per_key(df, ["k"], "i").collect()} == {("a", "x"), (None, "z")}
    assert {(r.k, r.v) for r in keyed.last_per_key(df, ["k"], "i").collect()} == {("a", "y"), (None, "z")}
    assert keyed.fingerprint(df) == keyed.fingerprint(df.orderBy("i").repartition(3))
    assert keyed.fingerprint(df) != keyed.fingerprint(df.union(df.limit(1)))


def test_exact_then_prefix(spark):
    rows = spark.createDataFrame([("AAAAAAAAAB01",), ("AAAAAAAAAC01",), ("BBBBBBBBBB01",), ("",)], "code string")
    exact = spark.createDataFrame([("AAAAAAAAAB01", 5)], "code string, price int")
    fallback = spark.createDataFrame([("AAAAAAAAA", 7), ("AAAAAAAAA", 7), ("BBBBBBBBB", 1), ("BBBBBBBBB", 2)], "prefix string, price int")
    got = lookups.exact_then_prefix(rows, "code", F.substring("code", 1, 9), exact, fallback, "price", F.length("code") == 12)
    assert {r.code: (r.price, r.how) for r in got.collect()} == {"AAAAAAAAAB01": (5, "exact"), "AAAAAAAAAC01": (7, "prefix"), "BBBBBBBBBB01": (None, "ambiguous"), "": (None, "none")}


def test_longest_prefix(spark):
    names = spark.createDataFrame([("アクテムラ皮下注", "g1"), ("アクテムラ点滴", "g1"), ("ベタ錠剤甲", "x"), ("ベタ錠剤乙", "y"), ("ベタ錠剤丙", "z")], "name string, g string")
    products = spark.createDataFrame([(1, "アクテムラ皮下注シリンジ"), (2, "ベタ錠剤"), (3, "ない薬剤名"), (4, "点滴静注用")], "id int, p string").withColumn("c", candidate_prefixes("p"))
    got = {r.id: (r.prefix, r.found) for r in lookups.longest_prefix(products, "id", "c", names, "name", "g", 4).collect()}
    assert got == {1: ("アクテムラ皮下注", ["g1"]), 2: ("ベタ錠剤", [])}


def test_first_match_and_attach(spark):
    items = spark.sql("SELECT 1 AS id, array(named_struct('u', 'a', 't', '1'), named_struct('u', 'b', 't', '2')) AS f UNION ALL SELECT 2, array(named_struct('u', 'z', 't', '1'))")
    store = spark.createDataFrame([("b", ""), ("c", "h")], "u string, h string")
    assert [(r.id, r.u, r.pos, r.h) for r in lookups.first_match(items, "f", "u", store, "u", "id").collect()] == [(1, "b", 1, "")]
    rows = spark.createDataFrame([(1, 2, "y"), (1, 1, "x")], "id int, pos int, v string")
    assert {r.id: r.p and [x.v for x in r.p] for r in lookups.attach_rows(items.select("id"), "id", rows, "pos", ["v"], "p").collect()} == {1: ["x", "y"], 2: None}


def test_seq_diff_against_a_plain_pass(spark, tmp_path):
    """The registered query on odd and even conversations, against blocks found by difflib and lines paired one by one."""
    import random

    from docweave.plans.texts import seq_diff

    rng = random.Random(9)
    rows = [(c, t, rng.choice(["user", "bot"]), "\n".join(rng.choices(["a", "b", "c d", ""], k=rng.randint(1, 4)))) for c in range(40) for t in range(rng.randint(0, 5))]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    want = []
    for pair in range(0, 40, 2):
        old, new = ([(r, line) for c, _, r, t in sorted(rows) if c == conv for line in t.split("\n")] for conv in (pair, pair + 1))
        out = []
        for kind, a, b, c, d in difflib.SequenceMatcher(None, [f"{p}\t{t}" for p, t in old], [f"{p}\t{t}" for p, t in new], autojunk=False).get_opcodes():
            if kind == "equal":
                continue
            free = list(range(c, d))
            for p, t in old[a:b]:
                k = next((k for k in free if new[k][0] == p), None) if kind == "replace" else None
                out.append(("removed", p, t, None) if k is None else ("changed", p, t, new[k][1]))
                if k is not None:
                    free.remove(k)
            out += [("added", new[k][0], None, new[k][1]) for k in free]
        want += [(pair, i, *x) for i, x in enumerate(out)]
    got = [(r.pair, r.pos, r.kind, r.path, r.before, r.after) for r in seq_diff(spark, str(tmp_path)).collect()]
    assert len(want) > 60 and sorted(got, key=str) == sorted(want, key=str)


def test_every_row_is_in_a_part(spark):
    from docweave.operators.partitions import capped_partitions

    rows = spark.sql("SELECT 'a' AS c, date_add(DATE '1999-11-30', CAST(pow(id, 2) % 1500 AS int)) AS d FROM range(400) UNION ALL SELECT 'b', DATE '2001-05-05' FROM range(30) UNION ALL SELECT 'b', NULL")
    got = capped_partitions(rows, "c", "d", 2000, 2002, 10).collect()
    assert {k: sum(r.n for r in got if r["class"] == k) for k in "ab"} == {"a": 400, "b": 30}
    assert all(r.n <= 10 or r.low == r.high for r in got) and min(r.low.year for r in got) == 1999
    for k in "ab":
        own = sorted((r.low, r.high) for r in got if r["class"] == k)
        assert all((b[0] - a[1]).days == 1 for a, b in zip(own, own[1:], strict=False))


def test_update_search(spark):
    df = spark.createDataFrame([(1, "Ａspirin", "x"), (2, "aspirin", None), (3, "b", "ASPIRIN 錠")], "i int, t string, c string")
    found = lambda *w: [(r.i, r.total) for r in search.search_updates(df, ["t", "c"], list(w), [F.desc("i")], 2).collect()]
    assert found("ａspirin") == [(3, 3), (2, 3)] and found("aspirin", "錠") == [(3, 1)] and found() == [(3, 3), (2, 3)]


def test_stale_and_due(spark):
    targets = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("d", "4"), ("e", "5")], "u string, t string")
    state = spark.createDataFrame([("a", "1", 2, None), ("b", "1", 2, None), ("c", "3", 1, None), ("e", "4", 2, "5")], "u string, t string, v int, err_t string")
    assert {r.u: r.why for r in lookups.stale(targets, state, "u", "t", "v", 2).collect()} == {"b": "changed", "c": "version", "d": "missing", "e": "changed"}
    assert {r.u: r.turn for r in incremental.due(targets, state, "u", "t", 2).collect()} == {"b": 0, "c": 1, "d": 0}
    assert incremental.due(targets, state, "u", "t", 2, retry_errors=True).count() == 4


def test_merge_feed(spark):
    schema = "k int, v string, error string"
    first = spark.createDataFrame([(1, "a", None), (2, "b", "parse"), (3, "c", "GET failed: x")], schema)
    second = spark.createDataFrame([(1, "A", None), (2, "B", None), (3, "C", "parse")], schema)
    one = incremental.merge_feed(None, first, ["k"])
    two = incremental.merge_feed(one, second, ["k"])
    assert {(r.k, r.v, r.error) for r in one.collect()} == {(1, "a", None), (2, "b", "parse")}
    assert {(r.k, r.v, r.error) for r in two.collect()} == {(1, "a", None), (2, "B", None), (3, "C", "parse")}
    assert keyed.fingerprint(incremental.merge_feed(two, second, ["k"])) == keyed.fingerprint(two)


def test_guards(spark):
    import pytest

    new, old = spark.range(70), spark.range(100)
    assert incremental.plausible(new, None, 50).count() == 70
    with pytest.raises(Exception, match="fewer than 80 rows"):
        incremental.plausible(new, old, 50)
    assert incremental.needs_refresh(["a"], ["a"], 28) and not incremental.needs_refresh(["a"], ["a"], 3)
    state = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    read = spark.createDataFrame([(2, "B"), (3, "C")], "k int, v string")
    assert {(r.k, r.v) for r in incremental.refreshed(state, read, "k").collect()} == {(1, "a"), (2, "B"), (3, "C")}
    assert lookups.referenced(state, read, "k").count() == 2 and lookups.referenced(state, read, "k", guard=0).count() == 1


def test_search_without_words_finds_nothing(spark):
    df = spark.createDataFrame([("ab", "cd")], "n string, g string")
    assert search.search_names(df, ["n", "g"], [], ["n"]).count() == 0
    assert search.search_names(df, ["n", "g"], ["b", "c"], ["n"]).first().score == 1
    assert search.search_grouped(df.withColumn("h", F.lit("")), ["n", "g"], ["zz"], "h", "n").count() == 0


def test_important(spark):
    df = spark.createDataFrame([(["1. 警告", "x"],), ([],), (None,)], "p array<string>")
    assert [r[0] for r in df.select(classify.important(F.try_element_at("p", F.lit(1)), ["警告"])).collect()] == [True, False, False]
