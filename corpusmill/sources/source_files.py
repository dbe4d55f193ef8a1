"""Files of a folder through the processors of a registry, as a Spark source.

    registry = Registry()
    registry.register("csv", lambda f: f.name.endswith(".csv"), lambda data, f: data.decode().replace(",", " "))
    spark.dataSource.register(registry.source())
    spark.read.format("source_files").load(folder)

Each file goes to the first processor that takes it; a processor that fails makes a row with an error, and files that none
takes make none. Partitions hold files of about the same bytes, and filters on category, name and processor leave files
out before they are opened.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

from pyarrow import fs as arrow_fs
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringEndsWith, StringStartsWith

from .files import CATEGORIES
from .page_files import opened

PARTITION_BYTES = 64 << 20
SCHEMA = "source_id string, category string, name string, size long, processor string, content string, error string"


@dataclass(frozen=True)
class SourceFile:
    path: str
    category: str
    name: str
    size: int


@dataclass
class Registry:
    """Processors in the order in which they are asked: name, test of a file, and what makes text of its bytes."""

    processors: list[tuple[str, Callable[[SourceFile], bool], Callable[[bytes, SourceFile], str | None]]] = field(default_factory=list)

    def register(self, name: str, takes: Callable[[SourceFile], bool], process: Callable[[bytes, SourceFile], str | None]) -> Registry:
        self.processors.append((name, takes, process))
        return self

    def of(self, file: SourceFile) -> tuple[str, Callable[[bytes, SourceFile], str | None]] | None:
        return next(((name, process) for name, takes, process in self.processors if takes(file)), None)

    def source(self) -> type[DataSource]:
        """A source with the processors that are registered by now, which go to the workers with it."""
        held = Registry(list(self.processors))

        class SourceFiles(DataSource):
            @classmethod
            def name(cls) -> str:
                return "source_files"

            def schema(self) -> str:
                return SCHEMA

            def reader(self, schema) -> DataSourceReader:
                return Reader(held, self.options["path"], int(self.options.get("partition_bytes", PARTITION_BYTES)), schema.names)

        return SourceFiles


def default_registry() -> Registry:
    """Texts of pages, external pages and PDFs, as whole files in UTF-8."""
    return Registry().register("file", lambda f: f.category in ("pages", "external", "pdf-texts") and f.name.endswith(".txt"), lambda data, f: data.decode())


@dataclass
class Files(InputPartition):
    files: list[SourceFile]


class Reader(DataSourceReader):
    def __init__(self, registry: Registry, path: str, partition_bytes: int, columns: list[str]):
        self.registry, self.path, self.partition_bytes, self.columns = registry, path.rstrip("/"), partition_bytes, columns
        self.tests: list[tuple[str, Callable[[str], bool]]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes filters on what a name tells; the rest stays with Spark."""
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column not in ("category", "name", "processor"):
                yield f
            elif isinstance(f, EqualTo):
                self.tests.append((column, lambda x, v=f.value: x == v))
            elif isinstance(f, In):
                self.tests.append((column, lambda x, v=tuple(f.value): x in v))
            elif isinstance(f, StringEndsWith):
                self.tests.append((column, lambda x, v=f.value: x.endswith(v)))
            elif isinstance(f, StringStartsWith):
                self.tests.append((column, lambda x, v=f.value: x.startswith(v)))
            else:
                yield f

    def wanted(self, f: SourceFile) -> bool:
        if (found := self.registry.of(f)) is None:
            return False
        own = {"category": f.category, "name": f.name, "processor": found[0]}
        return all(test(own[column]) for column, test in self.tests)

    def listed(self) -> list[SourceFile]:
        """The files of the known folders that a processor takes, by path; hidden ones are left out."""
        fs, base = opened(self.path)
        out = []
        for x in fs.get_file_info(arrow_fs.FileSelector(base, recursive=True)):
            parts = x.path[len(base) :].strip("/").split("/")
            if x.type == arrow_fs.FileType.File and not parts[-1].startswith(".") and len(parts) > 1 and parts[-2] in CATEGORIES:
                f = SourceFile(x.path, parts[-2], parts[-1], x.size)
                if self.wanted(f):
                    out.append(f)
        return sorted(out, key=lambda f: f.path)

    def partitions(self) -> list[Files]:
        """Largest files first, each to the partition with the least bytes."""
        files = sorted(self.listed(), key=lambda f: (-f.size, f.path))
        n = max(1, min(len(files), -(-sum(f.size for f in files) // self.partition_bytes)))
        heap = [(0, k) for k in range(n)]
        held: list[list[SourceFile]] = [[] for _ in range(n)]
        for f in files:
            size, k = heapq.heappop(heap)
            held[k].append(f)
            heapq.heappush(heap, (size + f.size, k))
        return [Files(x) for x in held]

    def read(self, partition: Files) -> Iterator[tuple]:
        fs, _ = opened(self.path)
        for f in partition.files:
            name, process = self.registry.of(f)
            content = error = None
            try:
                with fs.open_input_stream(f.path) as stream:
                    content = process(stream.read(), f)
            except Exception as e:  # a file that cannot be read or processed is a row
                error = f"{type(e).__name__}: {e}"
            row = {"source_id": f"file://{f.path}", "category": f.category, "name": f.name, "size": f.size, "processor": name, "content": content, "error": error}
            yield tuple(row[c] for c in self.columns)


def register(spark, registry: Registry) -> None:
    """Makes "source_files" a format of the session, with filters pushed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(registry.source())
