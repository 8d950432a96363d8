"""Yields over HTTP or from files as a Spark data source: ``spark.read.format("yields")``.

Options: ``url``, which may hold {start} and {end} (dates); ``start`` and ``end``, the days to read, both included; ``years``, the length of a
partition (1). With both marks each partition asks the server for its own years; without them one task reads the whole answer. ``retries`` (3) and
``timeout`` in seconds (60). The answer is CSV with a header, the date first and the yield second; an empty value or "." is
null. An answer without a date column or with a wrong number is an error, as is a server that fails each time.
"""

from __future__ import annotations

import csv
import datetime as dt
import time
import urllib.error
import urllib.request
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Years(InputPartition):
    def __init__(self, start: dt.date, end: dt.date):
        super().__init__(f"{start}/{end}")
        self.start, self.end = start, end


class YieldReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.url = options.get("url", "")
        if not self.url:
            raise ValueError("the option url is missing")
        self.first, self.last = (dt.date.fromisoformat(options.get(k, v)) for k, v in (("start", "1900-01-01"), ("end", "2100-01-01")))
        self.years, self.retries, self.timeout = (int(options.get(k, v)) for k, v in (("years", "1"), ("retries", "3"), ("timeout", "60")))
        if self.last < self.first or self.years < 1 or self.retries < 1:
            raise ValueError("start must not be after end; years and retries must be at least 1")

    def partitions(self) -> list[InputPartition]:
        if "{start}" not in self.url or "{end}" not in self.url:
            return [Years(self.first, self.last)]
        out, at = [], self.first
        while at <= self.last:
            after = dt.date(at.year - at.year % self.years + self.years, 1, 1)
            out.append(Years(at, min(after - dt.timedelta(1), self.last)))
            at = after
        return out

    def _fetch(self, part: Years) -> list[str]:
        url = self.url.replace("{start}", str(part.start)).replace("{end}", str(part.end))
        for k in range(self.retries):
            try:
                with urllib.request.urlopen(url, timeout=self.timeout) as answer:
                    return answer.read().decode("utf-8-sig").splitlines()
            except urllib.error.HTTPError as e:
                if e.code < 500 or k + 1 == self.retries:
                    raise
            except OSError:
                if k + 1 == self.retries:
                    raise
            time.sleep(min(2**k, 10) / 10)
        return []

    def read(self, partition: Years) -> Iterator[tuple]:
        rows = csv.reader(self._fetch(partition))
        if len(next(rows, [])) < 2:
            raise ValueError("the answer has no header with a date and a yield")
        for row in rows:
            if row:
                day = dt.date.fromisoformat(row[0].strip()[:10])
                if partition.start <= day <= partition.end:
                    text = row[1].strip() if len(row) > 1 else ""
                    yield day, None if text in ("", ".") else float(text)


class YieldSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "yields"

    def schema(self) -> str:
        return "obs_date date, yield_pct double"

    def reader(self, schema) -> DataSourceReader:
        return YieldReader(dict(self.options))


def read_yields(spark: SparkSession, url: str, **options: str) -> DataFrame:
    """obs_date, yield_pct from ``url`` (http, https or file)."""
    spark.dataSource.register(YieldSource)
    return spark.read.format("yields").options(url=url, **options).load()
