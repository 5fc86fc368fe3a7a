"""Fill-in-the-middle, vector codes and chat windows."""

import hashlib
import math
import random
import re
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from docweave.llm import chat_windows, fill_middle, vector_codes


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_fim(doc_id, text, seed=7, rate=100, spm=50):
    """The contract by lists."""
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(lines)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    out = f"<S>{s}<P>{p}<M>{m}" if h[3] % 100 < spm else f"<P>{p}<S>{s}<M>{m}"
    return doc_id, n, "spm" if h[3] % 100 < spm else "psm", len(p), len(m), sha(out), sha(text)


def by_id(rows):
    return sorted(map(repr, rows))


def test_fill_in_middle(spark, docs, corpus, empty):
    odd = [(1000, "\n"), (1001, "\n\n\n"), (1002, "a\r\nb\rc\n"), (1003, "x<P>y"), (1004, "x<\nM>y<"), (1005, "é" * 9 + "\n日本\n"), (1006, "\n" * 3_000_000), (1007, "no end " * 400_000), (1008, "<P\n<S\n>M>\n" * 5), (-5, "a\nb\nc")]
    every = docs.select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    got = [tuple(r) for r in fill_middle.fill_in_middle_report(every).collect()]
    want = [plain_fim(*r) for r in [*corpus, *odd]]
    assert by_id(got) == by_id(want) and {r[2] for r in want} == {"plain", "psm", "spm"}
    assert fill_middle.fill_in_middle(empty).count() == 0 and fill_middle.fill_in_middle_report(docs).columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]


def test_rates_and_units(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["one", "two\n", "\t3"]) for _ in range(rng.randint(0, 30)))) for i in range(400)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in fill_middle.fill_in_middle_report(frame, seed=9, rate=60, spm=20).collect()]
    assert by_id(got) == by_id(plain_fim(i, t, 9, 60, 20) for i, t in rows)
    words = fill_middle.fill_in_middle(frame, units=r"\s*\S+|\s+", marks=("{a", "{b", "{c")).withColumn("text", fill_middle.restored(F.col("output"), F.col("form"), ("{a", "{b", "{c")))
    assert {r.doc_id: (r.n, r.text) for r in words.collect()} == {i: (len(re.findall(r"\s*\S+|\s+", t)), t) for i, t in rows}
    for bad in (("<P>", "<P>", "<M>"), ("", "a", "b"), ("ab", "b", "c")):
        with pytest.raises(ValueError, match="told apart"):
            fill_middle.fill_in_middle(frame, marks=bad)


def test_no_unit_is_kept():
    """What counting and cutting need doesn't grow with the units."""
    import tracemalloc

    text = "ab\n" * 2_000_000
    pattern = re.compile(fill_middle.LINES)
    tracemalloc.start()
    n = fill_middle.counted(pattern.finditer(text))
    places = fill_middle.cut_places(pattern.finditer(text), 500_000, 1_500_000)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (n, places) == (2_000_000, (1_500_000, 4_500_000)) and most < 100_000


def plain_codes(rows, parts=16, entries=64, rounds=2):
    """The contract by Python integers: rows of (vec_id, vector, label)."""
    kept = [(i, [math.floor(256 * Fraction(x)) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max((len(q) for _, q, _ in kept), default=0) // parts)
    kept = [(i, q + [0] * (parts * width - len(q)), label) for i, q, label in kept]
    first = {}
    for i, q, _ in kept:
        key = (i is None, i or 0)
        first[key] = min(first.get(key, q), q)
    opening = [first[k] for k in sorted(first)[:entries]]
    books = [[q[p * width : (p + 1) * width] for q in opening] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for p, book in enumerate(books):
            met = {}
            for _, q, _ in kept:
                x = q[p * width : (p + 1) * width]
                met.setdefault(nearest(x, book)[1], []).append(x)
            books[p] = [[sum(c) // len(met[e]) for c in zip(*met[e], strict=True)] if e in met else old for e, old in enumerate(book)]
    out, by_label = [], {}
    for i, q, label in kept:
        got = [nearest(q[p * width : (p + 1) * width], books[p]) for p in range(parts)]
        out.append((i, "".join(f"{e:02x}" for _, e in got), sum(d for d, _ in got), label))
        by_label.setdefault(label, []).append(out[-1][2])
    fits = lambda x: x if x < 1 << 63 else None
    digest = sha(",".join(str(x) for b in books for c in b for x in c))
    return [(i, code, fits(e), None if any(fits(x) is None for x in by_label[label]) else fits(sum(by_label[label])), digest) for i, code, e, label in out]


VECTORS = "vec_id long, embedding array<double>, label int, code string, q int, of_label int"


@pytest.mark.parametrize("case", ["many", "few", "ragged", "large", "ties", "no ids"])
def test_vector_codes(spark, case):
    rng = random.Random(case)
    vector = lambda n=32: [rng.gauss(0, 1) for _ in range(n)]
    if case == "many":
        centres = [vector() for _ in range(7)]
        rows = [(i, [c + rng.gauss(0, 0.05) for c in rng.choice(centres)], rng.choice([None, 1, 2])) for i in range(300)]
        rows += [(3, vector(), 1), (3, vector(), 1), (None, vector(), None), (900, None, 1), (901, [None] + vector(31), 1), (902, [math.nan] + vector(31), 1), (903, [-math.inf] + vector(31), 1)]
        rows += rows[:5]
    elif case == "few":
        rows = [(i, vector(16), i) for i in range(5)]
    elif case == "ragged":
        rows = [(i, vector(rng.choice([0, 3, 16, 33])), 0) for i in range(90)]
    elif case == "large":
        rows = [(i, [x * 10.0 ** rng.choice([0, 5, 9, 15]) for x in vector(16)], i % 3) for i in range(80)]
    elif case == "ties":
        rows = [(i, [rng.choice([-0.5, 0.0, 0.5, -1 / 512]) for _ in range(32)], 1) for i in range(200)]
    else:
        rows = [(None, vector(16), 1) for _ in range(9)]
    frame = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], VECTORS).repartition(4)
    report = vector_codes.vector_code_report(frame)
    assert report.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert by_id(tuple(r) for r in report.collect()) == by_id(plain_codes(rows))


def test_vector_codes_of_nothing(spark):
    for rows in ([], [(1, None, 1, "x", 1, 2), (2, [math.nan], 1, "x", 1, 2)]):
        assert vector_codes.vector_code_report(spark.createDataFrame(rows, VECTORS)).count() == 0
    with pytest.raises(Exception, match="too large"):
        vector_codes.vector_code_report(spark.createDataFrame([(1, [1e300], 1, "x", 1, 2)], VECTORS))


def test_decoded_vectors(spark):
    rng = random.Random(1)
    frame = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(8)], 0, "", 0, 0) for i in range(50)], VECTORS)
    coded, books = vector_codes.encode_vectors(frame, parts=4, entries=8)
    given = {r.vec_id: [math.floor(256 * x) for x in r.embedding] for r in frame.collect()}
    error = {r.vec_id: r.error for r in coded.collect()}
    for r in vector_codes.decode_codes(coded, books).collect():
        assert sum((a - b) ** 2 for a, b in zip(r.q, given[r.vec_id], strict=True)) == error[r.vec_id]


def test_exponion_scans_a_part_and_misses_nothing():
    rng = np.random.default_rng(3)
    entries = rng.integers(-300, 300, (64, 4))
    book = vector_codes.Codebook(entries, 64)
    x = entries[rng.integers(0, 64, 5000)] + rng.integers(-20, 20, (5000, 4))
    far = ((x[:, None] - entries[None]) ** 2).sum(axis=2)
    for start, most in ((np.zeros(5000, np.int64), 64), (far.argmin(axis=1), 16)):
        found, best, taken = book.nearest(x, start)
        assert (found == far.argmin(axis=1)).all() and (best == far.min(axis=1)).all() and taken < most * 5000


TOKENIZER = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN
TURNS = "conv_id long, turn long, role string, text string, at long, window long, part int, h string"
CONTROL = ["[INST]", "[/INST]", "</s>", "<s>", "[SYS]", "[/SYS] ", "[ROLE]", "[NAME]", "[/ROLE]", "[", "<", "\\", " ", "/", "s>", "INST]", "ok", "\n", "é"]


def told_turns(rows):
    """n_turns, turns_sha256, loss_chars, loss_sha256 by conversation, from the rows alone."""
    out = {}
    by_conv = {}
    for conv, turn, role, text in rows:
        by_conv.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    for conv, turns in by_conv.items():
        turns.sort()
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        out[conv] = len(turns), sha("".join(f"{r}\n{t}\n" for _, _, r, t in turns)), len(loss), sha(loss)
    return out


@pytest.fixture(scope="module")
def chats():
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice(CONTROL) if rng.random() < 0.4 else rng.choice(["word ", "more "]) for _ in range(n))
    rows = [(i, k, rng.choice(["user", "assistant", "assistant", "tool", "system", "[NAME] x", ""]), text(rng.choice([0, 3, 40, 200, 900]))) for i in range(25) for k in range(rng.randint(1, 12))]
    rows += [(30, k, "system" if k == 0 else "user" if k % 2 else "assistant", text(30)) for k in range(400)]
    rows += [(31, None, None, None), (31, 1, "assistant", None), (32, 0, "system", text(2000)), (33, 0, "system", text(5000)), (33, 1, "assistant", text(4000)), (33, 2, "user", ""), (34, 0, "assistant", "x" * 3_000_000), (None, 0, "user", "a"), (None, 1, "assistant", "b")]
    rows += [(35, 5, "assistant", "same")] * 60 + [(36, k % 3, "user" if k % 2 else "assistant", "t") for k in range(30)]
    rng.shuffle(rows)
    return rows


def chat_frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, "x") for r in rows], TURNS).repartition(5)


def test_escapes_are_reversible():
    rng = random.Random(4)
    for _ in range(20_000):
        text = "".join(rng.choice(CONTROL) for _ in range(rng.randint(0, 8)))
        out = chat_windows.escaped(text)
        assert chat_windows.unescaped(out) == text and not any(m in out for m in CONTROL[:9] if m != "[/SYS] ") and "[/SYS]" not in out
        turns = [(rng.choice(["system", "user", "assistant", "tool", "", text]), "".join(rng.choice(CONTROL) for _ in range(rng.randint(0, 5)))) for _ in range(3)]
        assert list(chat_windows.turns_of(chat_windows.BEGIN + "".join(chat_windows.formatted(r, t)[0] for r, t in turns))) == turns


def test_chat_report(spark, chats):
    frame = chat_frame(spark, chats)
    want = told_turns(chats)
    for options in ({}, {"budget": 300, "history": 50}, {"budget": 300, "history": 0, "hot_turns": 20}):
        got = {r.conv_id: r for r in chat_windows.chat_report(frame, *TOKENIZER, **options).collect()}
        assert {k: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for k, r in got.items()} == want


def test_windows_keep_the_budget_and_hot_ones_are_the_same(spark, chats, monkeypatch):
    monkeypatch.setattr(chat_windows, "HEAVY", 1 << 40)
    frame = chat_frame(spark, chats)
    cold, hot = ({(r.conv_id, r.window): r.asDict(True) for r in chat_windows.format_conversations(frame, *TOKENIZER, budget=300, history=60, hot_turns=n).collect()} for n in (10_000, 1))
    assert cold == hot and len(cold) > 150
    for r in cold.values():
        turns = list(chat_windows.turns_of(r["formatted"]))
        led = turns[0][0] == "system" and len(turns) > 1
        assert r["n_own"] >= 1 and r["over"] == (r["n_tokens"] > 300)
        assert not r["over"] or r["n_own"] - (led and r["n_repeated"] == 0) <= 1 or led and len(turns[0][1]) > 300
        own = turns[r["n_repeated"] :]
        assert [chat_windows.unescaped(r["formatted"][m["start"] : m["end"]]) for m in r["loss"]] == [t for role, t in own if role == "assistant"]
    long = [r for (c, _), r in sorted(cold.items(), key=lambda x: (x[0][0] is not None, x[0])) if c == 30]
    assert all(r["formatted"].startswith("<s>[SYS]") for r in long) and all(r["n_repeated"] for r in long[1:]) and sum(r["n_repeated"] > 1 for r in long) > len(long) // 4 and not any(r["over"] for r in long)


def test_chats_of_nothing(spark):
    assert chat_windows.chat_report(chat_frame(spark, []), *TOKENIZER).count() == 0


def test_chat_query_against_plain_turns(spark):
    from docweave.llm.queries import op13_chat_windows

    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in op13_chat_windows(spark, "/root/testdata/sf0.001").collect()}
    assert got == told_turns(rows)
