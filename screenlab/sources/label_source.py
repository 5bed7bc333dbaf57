"""Synthetic labels as a data source: tables and streams of any range of indexes."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..plans import synth
from . import schema


class Span(InputPartition):
    def __init__(self, start: int, stop: int) -> None:
        super().__init__((start, stop))


class _Labels:
    """What both readers share: options as numbers, and the rows of a span of indexes."""

    def __init__(self, options: dict) -> None:
        number = lambda name, default: int(options.get(name, default))
        self.start, self.count, self.seed, self.rows = number("start", 0), number("count", 0), number("seed", 42), number("rowsperpartition", 10_000)
        self.canvas = (number("width", 320), number("height", 240))
        self.vocabulary = json.loads(options["vocabulary"]) if "vocabulary" in options else synth.WORDS
        names = lambda name: [x for x in options[name].split(",") if x] if name in options else None
        self.order = synth.schedule(self.seed, names("languages"), names("patterns"), self.vocabulary)
        if self.start < 0 or self.count < 0 or self.rows < 1:
            raise ValueError("start and count must not be negative, rowsPerPartition not under 1")

    def spans(self, start: int, stop: int) -> list[Span]:
        return [Span(i, min(i + self.rows, stop)) for i in range(start, stop, self.rows)] or [Span(start, start)]

    def read(self, partition: Span) -> Iterator[tuple]:
        for i in range(*partition.value):
            made = synth.label(i, *self.order[i % len(self.order)], self.seed, self.canvas, self.vocabulary)
            elements = [tuple(e.get(k) for k in ("type", "bbox", "text", "icon_name", "selected", "truncated", "color_class", "size_class")) for e in made["elements"]]
            yield made["image_path"], made["pattern"], made["language"], made["background"], made["canvas_size"], elements, made["raw_text"]


class TableReader(_Labels, DataSourceReader):
    def partitions(self) -> list[Span]:
        return self.spans(self.start, self.start + self.count)


class StreamReader(_Labels, DataSourceStreamReader):
    """Offsets are indexes: a stream that starts again, perhaps with a larger count, goes on behind the last label made."""

    def initialOffset(self) -> dict:
        return {"index": self.start}

    def latestOffset(self) -> dict:
        return {"index": self.start + self.count}

    def partitions(self, start: dict, end: dict) -> list[Span]:
        return self.spans(start["index"], end["index"])

    def commit(self, end: dict) -> None:
        pass


class ScreenLabels(DataSource):
    """Format ``screen_labels`` with the options start, count, seed, languages and patterns (comma-separated), width, height, vocabulary (JSON) and rowsPerPartition."""

    @classmethod
    def name(cls) -> str:
        return "screen_labels"

    def schema(self) -> str:
        return schema.LABELS

    def reader(self, schema) -> TableReader:
        return TableReader(self.options)

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(self.options)


def label_table(spark: SparkSession, **options) -> DataFrame:
    """Labels of the indexes from ``start``, as ``synth.screens`` gives them."""
    spark.dataSource.register(ScreenLabels)
    return spark.read.format("screen_labels").options(**options).load()


def label_stream(spark: SparkSession, **options) -> DataFrame:
    """The same as a stream, for ``jobs.append``: its checkpoint holds the index up to which labels have been made."""
    spark.dataSource.register(ScreenLabels)
    return spark.readStream.format("screen_labels").options(**options).load()
