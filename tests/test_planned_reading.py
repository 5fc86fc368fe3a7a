"""Reading of capped results by counts, and runs with a budget that go on where they stopped, against a server of the test's own."""

import json
import threading
import urllib.parse
from collections import Counter
from datetime import date, timedelta
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from docweave.operators.incremental import admitted
from docweave.sources import landed
from docweave.sources.deltas import Store, Stores, read_in_steps

CAP, PAGE = 40, 7
DAY = date(2024, 5, 5)


@pytest.fixture(scope="module")
def rows():
    """(class, child, day, name): a class under the cap, one that its children bring under it, one that needs days, one day over it."""
    out = [("10", "101", DAY, f"a{i}") for i in range(CAP)]
    out += [("20", f"20{1 + i % 2}", DAY + timedelta(days=i), f"b{i}") for i in range(CAP + 20)]
    out += [("30", "301", date(2022, 1, 1) + timedelta(days=i % 900), f"c{i}") for i in range(300)]
    return out + [("40", "", DAY, f"d{i}") for i in range(CAP + 1)] + [("40", "", DAY + timedelta(days=1), "d-last")]


@pytest.fixture
def server(rows):
    asked = Counter()

    class Answers(BaseHTTPRequestHandler):
        def answer(self, status, text, **headers):
            self.send_response(status)
            for k, v in headers.items():
                self.send_header(k.replace("_", "-"), v)
            self.end_headers()
            self.wfile.write(text.encode())

        def do_GET(self):
            asked[self.path] += 1
            self.answer(200, self.path, Set_Cookie="s=1")

        def do_POST(self):
            form = dict(urllib.parse.parse_qsl(self.rfile.read(int(self.headers["Content-Length"])).decode()))
            asked["search"] += 1
            name, low, high = form["effect"], form.get("updateFrom", "00000000"), form.get("updateTo", "99999999")
            own = [r for r in rows if name in r[:2] and low <= f"{r[2]:%Y%m%d}" <= high]
            if self.headers.get("Cookie") != "s=1":
                self.answer(403, "no session")
            elif len(own) > CAP:
                self.answer(200, f"検索結果 <b>{len(own)}</b> 件見つかりました")
            elif not own:
                self.answer(200, "条件に該当する添付文書はありませんでした")
            else:
                at = PAGE * (int(form["page"]) - 1)
                self.answer(200, f"検索結果{len(own)}件／全{-(-len(own) // PAGE)}ページ " + " ".join(r[3] for r in own[at : at + PAGE]))

        def log_message(self, *_):
            pass

    http = ThreadingHTTPServer(("127.0.0.1", 0), Answers)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{http.server_port}", asked
    http.shutdown()


def test_every_row_once_and_a_day_over_the_cap_told(spark, server, rows):
    at, _ = server
    landed.register(spark)
    classes = {"10": ["101"], "20": ["201", "202"], "30": [], "40": []}
    options = {"start": f"{at}/form", "search": f"{at}/search", "classes": json.dumps(classes), "first_day": "20200101", "last_day": "20251231", "wait": "0.01", "pause": "0"}
    got = spark.read.format("docweave_planned_results").options(**options).load().collect()
    names = Counter(n for r in got if r.html for n in r.html.split("ページ ")[1].split(" "))
    lost = {r[3] for r in rows if r[0] == "40" and r[2] == DAY}
    assert names == Counter(r[3] for r in rows if r[3] not in lost)
    told = [r for r in got if r.error]
    assert [(r["class"], r.low, r.high, r.page) for r in told] == [("40", "20240505", "20240505", 0)] and f"{CAP + 1} rows" in told[0].error
    # a class is read by the coarsest parts that are under the cap
    assert {r["class"] for r in got} == {"10", "201", "202", "30", "40"} and {(r.low, r.high) for r in got if r["class"] in ("10", "201", "202")} == {("", "")}


PAGES = Store("pages", ("address",), "address string, body string, error string")


def test_a_run_that_is_killed_goes_on(spark, server, tmp_path):
    """A budget of 10 fetches a run, 4 a step: killed within the second step, resumed without loss or repeat; cached ones are free."""
    at, asked = server
    landed.register(spark)
    stores = Stores(spark, str(tmp_path), [PAGES])
    targets = spark.createDataFrame([(f"{at}/doc/{i:02d}", i % 3) for i in range(30)], "address string, turn int")
    cached = targets.where("address LIKE '%5'").select("address")
    steps = []

    def read(own):
        fetched = [r.address for r in own.where("NOT is_cached").collect()]  # as many as a step has
        steps.append(len(fetched))
        if len(steps) == 2:
            raise KeyboardInterrupt
        got = spark.read.format("docweave_addresses").option("addresses", json.dumps(fetched)).option("wait", "0.01").load() if fetched else None
        kept = own.where("is_cached").select("address", F.lit("cached").alias("body"), F.lit(None).cast("string").alias("error"), F.lit(0).alias("at"))
        return kept if got is None else kept.unionByName(got.select("address", F.decode("content", "utf-8").alias("body"), "error", F.lit(0).alias("at")))

    def run():
        due = targets.join(stores.read("pages").select("address"), "address", "left_anti")
        return read_in_steps(stores, "pages", admitted(due, cached, "address", ["turn"], 10, 4), read, "at", 3)

    with pytest.raises(KeyboardInterrupt):
        run()
    assert stores.read("pages").count() == 4 + 3
    for _ in range(4):
        run()
    pages = {r.address: r.body for r in stores.read("pages").collect()}
    assert len(pages) == 30 and Counter(pages.values())["cached"] == 3
    fetched = {p: n for p, n in asked.items() if p.startswith("/doc/")}
    assert len(fetched) == 27 and set(fetched.values()) == {1} and max(steps) == 4
    # those whose turn is first were read first
    first = {f"{at}/doc/{i:02d}" for i in range(0, 30, 3)}
    order = [p for p in asked if p.startswith("/doc/")]
    assert {f"{at}{p}" for p in order[:8]} <= first


def test_admission(spark):
    due = spark.range(50).selectExpr("cast(id AS string) AS u", "id % 2 AS turn")
    out = admitted(due, spark.createDataFrame([("3",), ("3",), ("77",)], "u string"), "u", ["turn"], 7, 3).collect()
    assert len(out) == 8 and sorted(r.step for r in out if not r.is_cached) == [0, 0, 0, 1, 1, 1, 2] and [r.u for r in out if r.is_cached] == ["3"]
    assert admitted(due.where("false"), due, "u", ["turn"], 7, 3).count() == 0
