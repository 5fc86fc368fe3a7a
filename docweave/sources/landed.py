"""Reading from servers: addresses with retries, and result lists page by page in one session.

Both are Python data sources with a partition for each address or class, so a lost executor
fetches only its own again. They are polite: a partition asks for one thing at a time and pauses.
"""

from __future__ import annotations

import http.cookiejar
import json
import re
import time
import urllib.error
import urllib.parse
import urllib.request
from collections import deque
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Tries, and seconds that the wait grows by after each.
TRIES, WAIT = 3, 3.0


def fetched(address: str, opener: urllib.request.OpenerDirector, form: dict | None = None, tries: int = TRIES, wait: float = WAIT, sleep: Callable[[float], None] = time.sleep) -> tuple[int, bytes | None, str | None]:
    """(status, content, error). What isn't found isn't asked for again; other failures are, after longer and longer waits."""
    error: str | None = None
    status = 0
    data = urllib.parse.urlencode(form).encode() if form is not None else None
    for nth in range(tries):
        try:
            with opener.open(urllib.request.Request(address, data), timeout=60) as answer:
                return answer.status, answer.read(), None
        except urllib.error.HTTPError as e:
            status, error = e.code, f"{e.code} {e.reason}"
            if e.code == 404:
                break
        except OSError as e:
            status, error = 0, f"{type(e).__name__}: {e}"
        if nth + 1 < tries:
            sleep(wait * (nth + 1))
    return status, None, error


def session() -> urllib.request.OpenerDirector:
    return urllib.request.build_opener(urllib.request.HTTPCookieProcessor(http.cookiejar.CookieJar()))


class One(InputPartition):
    def __init__(self, name: str):
        self.name = name


class AddressReader(DataSourceReader):
    def __init__(self, options: dict):
        self.addresses = json.loads(options["addresses"])
        self.tries, self.wait = int(options.get("tries", TRIES)), float(options.get("wait", WAIT))

    def partitions(self) -> list[InputPartition]:
        return [One(a) for a in self.addresses]

    def read(self, partition: One) -> Iterator[tuple]:
        yield (partition.name, *fetched(partition.name, session(), None, self.tries, self.wait))


class Addresses(DataSource):
    """Rows (address, status, content, error) of a JSON list of addresses."""

    @classmethod
    def name(cls) -> str:
        return "docweave_addresses"

    def schema(self) -> str:
        return "address string, status int, content binary, error string"

    def reader(self, schema) -> AddressReader:
        return AddressReader(dict(self.options))


class ResultReader(DataSourceReader):
    """A class's result pages, from the form's answer on, in one session."""

    def __init__(self, options: dict):
        self.start, self.search = options["start"], options["search"]
        self.classes, self.form = json.loads(options["classes"]), json.loads(options.get("form", "{}"))
        self.field, self.page = options.get("class_field", "effect"), options.get("page_field", "page")
        self.tries, self.wait, self.pause = int(options.get("tries", TRIES)), float(options.get("wait", WAIT)), float(options.get("pause", 1.0))
        self.last = options.get("last_page", r"／全(\d+)ページ")

    def partitions(self) -> list[InputPartition]:
        return [One(c) for c in self.classes]

    def read(self, partition: One) -> Iterator[tuple]:
        opener = session()
        _, opened, error = fetched(self.start, opener, None, self.tries, self.wait)
        if opened is None:
            yield partition.name, 0, None, error
            return
        page, pages = 1, 1
        while page <= pages:
            _, raw, error = fetched(self.search, opener, {**self.form, self.field: partition.name, self.page: str(page)}, self.tries, self.wait)
            html = None if raw is None else raw.decode("utf-8", "replace")
            yield partition.name, page, html, error
            if html is None:
                return
            if page == 1 and (said := re.search(self.last, html)):
                pages = int(said[1])
            page += 1
            if page <= pages:
                time.sleep(self.pause)


class Results(DataSource):
    """Rows (class, page, html, error) of a JSON list of classes."""

    @classmethod
    def name(cls) -> str:
        return "docweave_results"

    def schema(self) -> str:
        return "class string, page int, html string, error string"

    def reader(self, schema) -> ResultReader:
        return ResultReader(dict(self.options))


#: What a result page says of its size, of a size over the cap, of no results.
FOUND, OVER, NONE = r"検索結果(\d+)件／全(\d+)ページ", r"検索結果(?:\s|<[^>]+>)*(\d+)(?:\s|<[^>]+>)*件見つかりました", "条件に該当する添付文書はありませんでした"


class Stretch(InputPartition):
    """A class and a range of days that the source gives whole; or, with pages 0, a single day of which it gives nothing."""

    def __init__(self, name: str, low: str, high: str, n: int, pages: int):
        self.name, self.low, self.high, self.n, self.pages = name, low, high, n, pages


class PlannedReader(DataSourceReader):
    """Asks the source for counts and splits what is over its cap, until every part is under it; then parts are read."""

    def __init__(self, options: dict):
        self.start, self.search = options["start"], options["search"]
        self.children: dict[str, list[str]] = json.loads(options["classes"])
        self.form, self.first, self.last = json.loads(options.get("form", "{}")), options.get("first_day", "19000101"), options["last_day"]
        self.field, self.page = options.get("class_field", "effect"), options.get("page_field", "page")
        self.low, self.high = options.get("from_field", "updateFrom"), options.get("to_field", "updateTo")
        self.tries, self.wait, self.pause = int(options.get("tries", TRIES)), float(options.get("wait", WAIT)), float(options.get("pause", 1.0))

    def asked(self, opener: urllib.request.OpenerDirector, name: str, low: str, high: str, page: int) -> str:
        dates = {self.low: low, self.high: high} if low else {}
        _, raw, error = fetched(self.search, opener, {**self.form, **dates, self.field: name, self.page: str(page)}, self.tries, self.wait)
        if raw is None:
            raise OSError(f"{name} [{low}, {high}] page {page}: {error}")
        return raw.decode("utf-8", "replace")

    def split(self, name: str, low: str, high: str) -> list[tuple[str, str, str]]:
        """A class by its children, else by years, a year and less by halves; a single day not at all."""
        if not low:
            if self.children.get(name):
                return [(c, "", "") for c in self.children[name]]
            return self.split(name, self.first, self.last)
        a, b = (datetime.strptime(d, "%Y%m%d").date() for d in (low, high))
        if a.year < b.year:
            return [(name, max(low, f"{y}0101"), min(high, f"{y}1231")) for y in range(a.year, b.year + 1)]
        if a == b:
            return []
        middle = a + (b - a) // 2
        return [(name, low, f"{middle:%Y%m%d}"), (name, f"{middle + timedelta(days=1):%Y%m%d}", high)]

    def partitions(self) -> list[InputPartition]:
        """One session asks for counts, one thing at a time; what it holds are parts, not rows."""
        opener = session()
        fetched(self.start, opener, None, self.tries, self.wait)
        frontier = deque((c, "", "") for c in self.children)
        out: list[InputPartition] = []
        while frontier:
            name, low, high = frontier.popleft()
            html = self.asked(opener, name, low, high, 1)
            if over := re.search(OVER, html):
                parts = self.split(name, low, high)
                frontier.extend(parts)
                if not parts:
                    out.append(Stretch(name, low, high, int(over[1]), 0))
            elif found := re.search(FOUND, html):
                out.append(Stretch(name, low, high, int(found[1]), int(found[2])))
            elif NONE not in html:
                raise ValueError(f"{name} [{low}, {high}]: the page says no count")
            time.sleep(self.pause if frontier else 0)
        return out

    def read(self, partition: Stretch) -> Iterator[tuple]:
        p = partition
        if not p.pages:
            yield p.name, p.low, p.high, 0, None, f"{p.n} rows on one day, over what the source gives"
            return
        opener = session()
        fetched(self.start, opener, None, self.tries, self.wait)
        for page in range(1, p.pages + 1):
            yield p.name, p.low, p.high, page, self.asked(opener, p.name, p.low, p.high, page), None
            time.sleep(self.pause if page < p.pages else 0)


class PlannedResults(DataSource):
    """Rows (class, low, high, page, html, error) of all classes of a JSON object of classes and their children.

    A day that is over the cap by itself is one row with page 0 and an error, so that nothing is lost unsaid.
    """

    @classmethod
    def name(cls) -> str:
        return "docweave_planned_results"

    def schema(self) -> str:
        return "class string, low string, high string, page int, html string, error string"

    def reader(self, schema) -> PlannedReader:
        return PlannedReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Addresses)
    spark.dataSource.register(Results)
    spark.dataSource.register(PlannedResults)
