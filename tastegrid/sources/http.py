"""Pages over HTTP as a batch data source: ``spark.read.format("http_pages").option("urls", ...)``."""

from __future__ import annotations

import random
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Answers that may be different next time; every other failure is final.
TRANSIENT = frozenset({429, 500, 502, 503, 504})
#: Seconds to wait after each failed attempt; the last one holds for all later ones.
PAUSES_S = (1.0, 2.0, 4.0, 8.0, 16.0, 30.0)
JITTER_S, TIMEOUT_S, ATTEMPTS = 1.0, 20.0, 5


def pause_before(attempt: int, retry_after: str | None, jitter: Callable[[], float] = lambda: random.uniform(0, JITTER_S)) -> float:
    """Seconds before the next attempt: what the server asks for in whole seconds, else the schedule with jitter."""
    wish = (retry_after or "").strip()
    return float(wish) if wish.isdecimal() else PAUSES_S[min(attempt, len(PAUSES_S) - 1)] + jitter()


def fetch(url: str, attempts: int = ATTEMPTS, sleep: Callable[[float], None] = time.sleep) -> str | None:
    """The body of a page; null after a final answer or too many attempts."""
    for attempt in range(attempts):
        asked = None
        try:
            with urllib.request.urlopen(url, timeout=TIMEOUT_S) as answer:
                return answer.read().decode(answer.headers.get_content_charset() or "utf-8", "replace")
        except urllib.error.HTTPError as e:
            if e.code not in TRANSIENT:
                return None
            asked = e.headers.get("Retry-After")
        except (urllib.error.URLError, TimeoutError, ConnectionError):
            pass
        if attempt < attempts - 1:
            sleep(pause_before(attempt, asked))
    return None


@dataclass
class _Urls(InputPartition):
    urls: list[str]


class _Reader(DataSourceReader):
    def __init__(self, urls: list[str], at_once: int, attempts: int) -> None:
        self.urls, self.at_once, self.attempts = urls, at_once, attempts

    def partitions(self) -> list[InputPartition]:
        n = max(1, min(self.at_once, len(self.urls)))
        return [_Urls(self.urls[k::n]) for k in range(n)]

    def read(self, partition: _Urls) -> Iterator[tuple]:
        for url in partition.urls:
            yield url, fetch(url, self.attempts)


class HttpPages(DataSource):
    """url, html of the pages of the option ``urls`` (one a line); null html for a page that could not be had.

    ``at_once`` is the number of partitions, and so of requests in flight.
    """

    @classmethod
    def name(cls) -> str:
        return "http_pages"

    def schema(self) -> str:
        return "url string, html string"

    def reader(self, schema) -> DataSourceReader:
        urls = [u for u in self.options.get("urls", "").splitlines() if u.strip()]
        return _Reader(urls, int(self.options.get("at_once", "10")), int(self.options.get("attempts", str(ATTEMPTS))))


def read_rates(spark: SparkSession, template: str, days: list[str], at_once: int = 1, attempts: int = 3) -> DataFrame:
    """review_date, price_currency, rate from one answer a day, ``{"rates": {currency: rate}}``.

    ``template`` has ``{day}`` in it; a day that could not be had keeps a row of nulls.
    """
    spark.dataSource.register(HttpPages)
    asked = spark.createDataFrame([(template.format(day=d), d) for d in days], "url string, day string")
    reader = spark.read.format("http_pages").option("urls", "\n".join(template.format(day=d) for d in days))
    answers = reader.option("at_once", at_once).option("attempts", attempts).load()
    rates = F.from_json("html", "rates map<string,double>")["rates"]
    return asked.join(answers, "url", "left").select(F.to_date("day").alias("review_date"), F.explode_outer(rates).alias("price_currency", "rate"))
