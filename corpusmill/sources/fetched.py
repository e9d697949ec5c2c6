"""A Python data source that fetches pages: one partition a host, at a given rate, with retries."""

from __future__ import annotations

import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Host(InputPartition):
    """URLs of one host, which are fetched one after another."""

    def __init__(self, urls: list[str]):
        self.urls = urls


class Fetched(DataSource):
    """Format `fetched`: option `urls` (one a line), `rate` (requests a second and host), `attempts`, `timeout` (seconds).

    A row a URL: url, html (null where nothing came), status (200; null where there was no answer), attempts. Blank lines
    and repeats are left out. The session must know the class: spark.dataSource.register(Fetched).
    """

    @classmethod
    def name(cls) -> str:
        return "fetched"

    def schema(self) -> str:
        return "url string, html string, status int, attempts int"

    def reader(self, schema) -> Pages:
        return Pages(dict(self.options))


class Pages(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.urls = list(dict.fromkeys(u.strip() for u in options.get("urls", "").splitlines() if u.strip()))
        self.rate, self.attempts, self.timeout = (float(options.get(k, v)) for k, v in (("rate", 1), ("attempts", 3), ("timeout", 20)))

    def partitions(self) -> list[Host]:
        hosts: dict[str, list[str]] = {}
        for u in self.urls:
            hosts.setdefault(urllib.parse.urlsplit(u).netloc, []).append(u)
        return [Host(x) for x in hosts.values()] or [Host([])]

    def read(self, partition: Host) -> Iterator[tuple]:
        for k, url in enumerate(partition.urls):
            if k and self.rate:
                time.sleep(1 / self.rate)
            yield (url, *self.fetch(url))

    def fetch(self, url: str) -> tuple[str | None, int | None, int]:
        """(text, status, attempts): 5 * 2^k seconds of patience where the server asks for it, 2^k after an exception."""
        status = None
        for k in range(int(self.attempts)):
            try:
                with urllib.request.urlopen(url, timeout=self.timeout) as answer:
                    return answer.read().decode("utf-8", "replace"), getattr(answer, "status", None) or 200, k + 1
            except urllib.error.HTTPError as e:
                status, wait = e.code, 5 * 2**k
                if status != 429 and status < 500:
                    return None, status, k + 1
            except OSError:
                wait = 2**k
            if k + 1 < self.attempts and self.rate:
                time.sleep(wait)
        return None, status, int(self.attempts)
