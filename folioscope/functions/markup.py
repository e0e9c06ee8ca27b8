"""A web page as a flat list of events, which the page readers go through once."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

AT_ONCE = 1_000_000        # characters of pages that are objects at one time, or one page


class Event(NamedTuple):
    kind: str                  # "start", "end" or "text"
    what: str                  # the element's name, or the text with its references decoded
    marks: dict[str, str]      # attributes of a start


class _Recorder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.events: list[Event] = []

    def handle_starttag(self, tag: str, attrs) -> None:
        self.events.append(Event("start", tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag: str) -> None:
        self.events.append(Event("end", tag, {}))

    def handle_data(self, data: str) -> None:
        self.events.append(Event("text", data, {}))


def events(source: str | None) -> Sequence[Event]:
    recorder = _Recorder()
    recorder.feed(source or "")
    recorder.close()
    return recorder.events


def read_pages(pages: DataFrame, keep: Sequence[str], columns: Sequence[str], read: Callable[..., tuple], out: T.StructType) -> DataFrame:
    """`pages` with what `read` makes of some columns, the page's source first. A batch from Spark is taken in pieces of `AT_ONCE`
    characters, and what is made of one is handed back before the next is read, so that a worker's memory does not follow the batch."""
    given = [f"__{c}" for c in columns]
    rows = pages.select(*keep, *[F.col(c).alias(g) for c, g in zip(columns, given)])
    kinds = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            upto = np.cumsum(pc.fill_null(pc.utf8_length(batch.column(given[0])), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            start = 0
            while start < batch.num_rows:
                before = upto[start - 1] if start else 0
                end = max(start + 1, int(np.searchsorted(upto, before + AT_ONCE, "right")))
                part = batch.slice(start, end - start)
                made = [read(*row) for row in zip(*(part.column(g).to_pylist() for g in given))]
                arrays = [pa.array([m[i] for m in made], kind.type) for i, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), *arrays], names=[*keep, *out.names])
                start = end

    return rows.mapInArrow(run, T.StructType([*(rows.schema[k] for k in keep), *out.fields]))
