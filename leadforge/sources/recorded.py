"""``recorded``: a data source that replays saved provider answers, one partition for each search (vertical, tile, keyword).

Answers lie as JSON lines under ``vertical=V/tile=N/keyword=K``, the layout that :func:`write_answers` leaves. Options:

- ``path``: root of the answers, any address that Arrow's file systems know (a shared mount, an object store),
- ``verticals``, ``keywords``: comma-separated, ``tiles``: a count; together they are the searches, whether or not they were ever made.

A search without a file has no rows, as a provider that finds nothing. Filters by equality or ``in`` on vertical, tile and keyword are
pushed down: searches that they exclude are not planned. Lines that hold no object are skipped; what an object lacks is null in
:func:`leadforge.sources.providers.listing`.
"""

from __future__ import annotations

import io
import itertools
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from leadforge.sources.providers import listing

SCHEMA = "vertical string, tile int, keyword string, place string"
KEYS = ("vertical", "tile", "keyword")
#: Lines that are passed on at once.
LINES = 2_000


@dataclass(frozen=True)
class Search(InputPartition):
    vertical: str
    tile: int
    keyword: str


def folder(search: Search) -> str:
    """Folder of a search's answers, escaped as partition folders are."""
    return "/".join(f"{k}={quote(str(getattr(search, k)), safe=' !$()+,-.;@_~&')}" for k in KEYS)


class RecordedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        missing = [k for k in ("path", "verticals", "keywords", "tiles") if not options.get(k)]
        if missing:
            raise ValueError(f"recorded answers need the options {', '.join(missing)}")
        self.path = options["path"]
        listed = lambda name: [x.strip() for x in options[name].split(",") if x.strip()]
        self.searches = {"vertical": listed("verticals"), "tile": list(range(int(options["tiles"]))), "keyword": listed("keywords")}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes the filters that choose searches; gives back the others."""
        for f in filters:
            key = f.attribute[0] if isinstance(f, EqualTo | In) and len(f.attribute) == 1 else None
            if key not in self.searches:
                yield f
                continue
            wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
            self.searches[key] = [x for x in self.searches[key] if x in wanted]

    def partitions(self) -> list[Search]:
        # an empty plan is read as one partition that is no search: it has no rows
        return [Search(*key) for key in itertools.product(*(self.searches[k] for k in KEYS))] or [Search("", -1, "")]

    def read(self, partition: Search) -> Iterator[pa.RecordBatch]:
        store, root = pa.fs.FileSystem.from_uri(self.path)
        at = pa.fs.FileSelector(f"{root.rstrip('/')}/{folder(partition)}", allow_not_found=True)
        for info in sorted(store.get_file_info(at), key=lambda i: i.path):
            if info.type != pa.fs.FileType.File or info.base_name[0] in "._":
                continue
            held: list[str] = []
            with store.open_input_stream(info.path) as raw, io.BufferedReader(raw) as lines:
                for line in lines:
                    text = line.strip()
                    if text[:1] == b"{":
                        held.append(text.decode(errors="replace"))
                    if len(held) >= LINES:
                        yield rows(partition, held)
                        held = []
            if held:
                yield rows(partition, held)


def rows(search: Search, places: list[str]) -> pa.RecordBatch:
    n = len(places)
    columns = [pa.array([search.vertical] * n), pa.array([search.tile] * n, pa.int32()), pa.array([search.keyword] * n), pa.array(places)]
    return pa.RecordBatch.from_arrays(columns, names=[*KEYS, "place"])


class RecordedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "recorded"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RecordedReader:
        return RecordedReader(dict(self.options))


#: Sources by name; more can be added.
SOURCES: dict[str, type[DataSource]] = {"recorded": RecordedSource}


def read_source(spark: SparkSession, name: str, **options: str) -> DataFrame:
    """Listings of a source chosen by name, with the search that found each.

    Spark keeps one reader for a loaded relation, that of the last filters. The condition on tiles, which always holds, makes every plan
    push its filters anew, so a frame can be used again with other filters. Within one query (a self-join) call this once for each use.
    """
    if name not in SOURCES:
        raise ValueError(f"unknown source {name}; there are {', '.join(sorted(SOURCES))}")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SOURCES[name])
    return spark.read.format(name).options(**options).load().where("tile >= 0")


def listings(answers: DataFrame) -> DataFrame:
    """Rows of a source as flat listings. Filter by vertical, tile or keyword before it or after it: both reach the source."""
    return answers.select(*KEYS, listing(answers["place"]).alias("l")).select(*KEYS, "l.*")


def write_answers(answers: DataFrame, path: str) -> None:
    """Saves (vertical, tile, keyword, place) as the source reads them."""
    answers.select(*KEYS, "place").write.partitionBy(*KEYS).mode("overwrite").text(path)
