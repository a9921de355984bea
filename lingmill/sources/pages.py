"""A Spark data source of numbered pages: any paginated store behind `fetch(offset, length)`."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Page(InputPartition):
    def __init__(self, offset: int, length: int):
        self.offset, self.length = offset, length


def paged_source(name: str, schema: str, fetch: Callable[[int, int], list[tuple]], pages: int, length: int = 100) -> type[DataSource]:
    """A class for spark.dataSource.register(): one task a page; an empty page gives no rows."""

    class Reader(DataSourceReader):
        def partitions(self) -> list[InputPartition]:
            return [Page(i * length, length) for i in range(pages)]

        def read(self, partition: Page) -> Iterator[tuple]:
            yield from fetch(partition.offset, partition.length)

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
            return Reader()

    return Paged
