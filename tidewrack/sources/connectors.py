"""Sources and sinks with a service behind them: the interface, and forms in memory that need no network."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class ChannelPage(InputPartition):
    def __init__(self, page: int):
        self.page = page


class ChannelReader(DataSourceReader):
    """Pages of a channel's history; ``fetch`` gives the rows (user, ts, text, subtype) of a page."""

    def __init__(self, fetch: Callable[[int], list[tuple]], pages: int):
        self.fetch, self.pages = fetch, pages

    def partitions(self) -> list[InputPartition]:
        return [ChannelPage(i) for i in range(self.pages)]

    def read(self, partition: ChannelPage) -> Iterator[tuple]:
        yield from self.fetch(partition.page)


def channel_source(fetch: Callable[[int], list[tuple]], pages: int) -> type[DataSource]:
    """A data source ``channel`` to register with ``spark.dataSource``; one task a page."""

    class Channel(DataSource):
        @classmethod
        def name(cls) -> str:
            return "channel"

        def schema(self) -> str:
            return "user string, ts string, text string, subtype string"

        def reader(self, schema) -> DataSourceReader:
            return ChannelReader(fetch, pages)

    return Channel


def channel_messages(history: DataFrame, users: DataFrame) -> DataFrame:
    """source, sender, timestamp, text of a channel's rows without subtype; the sender is the user's name (user, name), else the id."""
    x = history.where("subtype IS NULL AND trim(coalesce(text, '')) <> ''").join(users, "user", "left")
    return x.select(F.lit("slack").alias("source"), F.coalesce("name", "user", F.lit("unknown")).alias("sender"), F.col("ts").alias("timestamp"), F.btrim("text").alias("text"))


def fetch_mail(query: str, limit: int = 50) -> DataFrame:
    """Live mail needs a service's credentials; read a dump with ``tidewrack.sources.mail`` instead."""
    raise NotImplementedError("live mail is not available; read a dump with tidewrack.sources.mail")


def deliver(text: str, post: Callable[[str], None] | None = None, dry_run: bool = False) -> str:
    """Send a briefing to ``post``, or to the console on a dry run or without one; says where it went."""
    if dry_run or post is None:
        print(text)
        return "console"
    post(text)
    return "posted"


def json_line(columns: list[str]) -> Column:
    """The columns as one line of JSON, by name; null ones are left out."""
    return F.to_json(F.struct(*sorted(columns)))


def write_jsonl(artifacts: DataFrame, path: str) -> None:
    """JSON lines with sorted keys, one folder a source."""
    line = json_line([c for c in artifacts.columns])
    artifacts.select(line.alias("value"), F.col("source").alias("of_source")).write.mode("overwrite").partitionBy("of_source").text(path)
