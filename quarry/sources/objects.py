"""A source of object listings for ``spark.read.format("objects")``: folders are walked by tasks, a literal beginning each.

All files are seen, those too whose names begin with ``_`` or ``.``.  The file system
is the machine's own, or any that Arrow knows by its scheme.

Options: ``path`` (a folder, or one object), ``prefix`` (any beginning of the key),
``pattern`` (a regular expression that the key is found to match by the caller; here its
leading group of literal branches alone counts, ``^(A|B)...``), ``parts`` (folders that are
walked apart, about), ``single`` (whether the path itself is the object, which may not be).
Comparisons of ``key`` and the beginnings and ends of it that a query asks for are
taken over, and no folder is opened in which no key can hold to them.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringEndsWith, StringStartsWith

SCHEMA = "uri string, key string, size long"
BATCH = 10_000


def literal_branches(pattern: str | None) -> list[str]:
    """Beginnings that every key a pattern is found in has one of: the branches of an anchored leading group of literals, ``^(A|B)...``; of any other pattern the empty one.

    Without the anchor a group may be found anywhere in a key, and a branch after the
    group stands beside it, so neither bounds how keys begin.
    """
    group = re.match(r"\^\(([A-Za-z0-9._|-]+)\)(?![*+?{])", pattern or "")
    if not group or "|" in pattern[group.end() :]:
        return [""]
    # A full stop stands for any character, so what is before it alone is literal.
    begins = {b.partition(".")[0] for b in group[1].split("|")}
    return sorted(b for b in begins if not any(b != o and b.startswith(o) for o in begins))


def file_system(uri: str):
    """(file system, path in it, what goes before a path in a uri)."""
    from pyarrow import fs

    if re.match(r"^(file:|/|[^:]*$)", uri):
        path = re.sub(r"^file:/*", "/", uri)
        return fs.LocalFileSystem(), path.rstrip("/") or "/", uri[: len(uri) - len(path)] if uri.startswith("file:") else ""
    system, path = fs.FileSystem.from_uri(uri)
    path = path.rstrip("/")
    return system, path, uri[: uri.rindex(path)] if path and path in uri else ""


def children(system, path: str):
    """What lies directly in a folder."""
    from pyarrow import fs

    return system.get_file_info(fs.FileSelector(path, recursive=False))


@dataclass
class Folder(InputPartition):
    """A folder below the root, by its key, with what lies below it or without; only names that begin with ``stem``."""

    key: str
    deep: bool
    stem: str = ""


class ObjectReader(DataSourceReader):
    def __init__(self, options):
        self.root = options["path"]
        self.parts = int(options.get("parts", 64))
        self.single = str(options.get("single", "false")).lower() == "true"
        prefix = options.get("prefix", "")
        branches = literal_branches(options.get("pattern"))
        #: Each of these lists must have a beginning of the key.
        self.begins: list[list[str]] = [[prefix], branches]
        self.ends: list[str] = []
        self.among: set[str] | None = None

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            match f:
                case StringStartsWith(("key",), value):
                    self.begins.append([value])
                case StringEndsWith(("key",), value):
                    self.ends.append(value)
                case EqualTo(("key",), value) if value is not None:
                    self.among = {value} if self.among is None else self.among & {value}
                case In(("key",), values):
                    self.among = set(values) if self.among is None else self.among & set(values)
                case IsNotNull((("key" | "uri" | "size"),)):
                    pass  # none is null
                case _:
                    yield f

    def may_hold(self, folder: str) -> bool:
        """Whether a folder of this key, with a slash at its end, can have a key that is asked for."""
        near = lambda b: folder.startswith(b) or b.startswith(folder)
        return all(any(map(near, bs)) for bs in self.begins) and (self.among is None or any(k.startswith(folder) for k in self.among))

    def asked_for(self, key: str) -> bool:
        return all(any(map(key.startswith, bs)) for bs in self.begins) and all(map(key.endswith, self.ends)) and (self.among is None or key in self.among)

    def _heads(self) -> list[str]:
        """The longest beginnings that all keys have one of."""
        heads = [""]
        for bs in self.begins:
            heads = sorted({max(h, b, key=len) for h in heads for b in bs if h.startswith(b) or b.startswith(h)})
        return heads

    def partitions(self):
        from pyarrow import fs

        system, path, _ = file_system(self.root)
        info = system.get_file_info(path)
        if info.type == fs.FileType.NotFound and not self.single:
            raise FileNotFoundError(f"no such path: {self.root}")
        if info.type != fs.FileType.Directory or self.single:
            return [Folder("", False)]
        # A head's last slash ends the folder that is opened first; what follows it begins the names there.
        waiting, done = [], []
        for head in self._heads():
            folder, slash, stem = head.rpartition("/")
            waiting.append(Folder(folder + slash, True, stem))
        while waiting and len(waiting) + len(done) < self.parts:
            at = waiting.pop(0)
            try:
                below = children(system, f"{path}/{at.key}".rstrip("/"))
            except FileNotFoundError:
                continue
            names = [(i.base_name, i.type) for i in below if i.base_name.startswith(at.stem)]
            if any(t != fs.FileType.Directory for _, t in names):
                done.append(Folder(at.key, False, at.stem))
            waiting += [f for n, t in names if t == fs.FileType.Directory and self.may_hold((f := Folder(f"{at.key}{n}/", True)).key)]
        return [*done, *waiting] or [Folder("", False, "\0")]

    def read(self, partition: Folder):
        import pyarrow as pa
        from pyarrow import fs

        system, path, before = file_system(self.root)
        kinds = pa.schema({"uri": pa.string(), "key": pa.string(), "size": pa.int64()})
        info = system.get_file_info(path)
        if info.type != fs.FileType.Directory or self.single:
            key = path.rpartition("/")[2]
            if info.type == fs.FileType.File and self.asked_for(key):
                yield pa.RecordBatch.from_pylist([{"uri": self.root, "key": key, "size": info.size}], kinds)
            return
        rows, left = [], [partition]
        while left:
            at = left.pop()
            try:
                below = children(system, f"{path}/{at.key}".rstrip("/"))
            except FileNotFoundError:  # gone since, or a head that nothing has
                continue
            for i in below:
                if not i.base_name.startswith(at.stem):
                    continue
                key = at.key + i.base_name
                if i.type == fs.FileType.Directory:
                    if at.deep and self.may_hold(f"{key}/"):
                        left.append(Folder(f"{key}/", True))
                elif self.asked_for(key):
                    rows.append({"uri": f"{before}{path}/{key}", "key": key, "size": i.size})
            while len(rows) >= BATCH:
                yield pa.RecordBatch.from_pylist(rows[:BATCH], kinds)
                rows = rows[BATCH:]
        if rows:
            yield pa.RecordBatch.from_pylist(rows, kinds)


class Objects(DataSource):
    @classmethod
    def name(cls) -> str:
        return "objects"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ObjectReader:
        if "path" not in self.options:
            raise ValueError("a listing needs a path")
        return ObjectReader(self.options)


def registered(spark: SparkSession) -> SparkSession:
    """The session with this source, and with filters handed to Python sources."""
    spark.dataSource.register(Objects)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark
