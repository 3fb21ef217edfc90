"""Cursor-paged collections as a Spark data source, in batch and as a stream.

A collection is a chain of pages, each a JSON object with ``results``, ``has_more`` and ``next_cursor``; the first page's
cursor is ``start``. Pages of an entity lie either one by one, at ``<path>/<entity>/collection=<name>/cursor=<cursor>``, or
many in a file, at ``<path>/<entity>/bundle=<k>-of-<n>``, where ``k`` is the collection's CRC-32 modulo ``n`` and each line
holds a page with its collection, cursor and number, the pages of a chain in order. A partition follows the chains of some
collections, or of a bundle, and holds as many pages as make a small batch. A filter on ``collection`` leaves the other
chains, or bundles, unread. A stream's offsets are the cursors that come next, so a chain that grows goes on where it
stopped, and the files of bundles that were read; of a chain that goes on in a later file, each part is checked by itself.

A page without results, a page that has more but no cursor, and a cursor that comes again end the read with an error.
"""

from __future__ import annotations

import io
import json
import posixpath
import zlib
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition, IsNotNull
from pyspark.sql.types import StructType

from foliate.sources.batches import BATCH_BYTES, BATCH_ROWS

START = "start"
#: An offset's entry for the files of bundles; no collection has this name.
FILES = "\x00files"
#: What each entity's items hold; anything else about them stays in ``item``.
ENTITIES = {
    "pages": "id string, title string, last_edited_time string, in_trash boolean",
    "blocks": "id string, page_id string, type string, has_children boolean",
    "markdown": "page_id string, markdown string, truncated boolean",
    "databases": "id string, title string",
    "data_source_rows": "id string, object string, properties string",
    "messages": "turn long, role string, text string",
}
PLACE = "collection string, page_no long, place long, item string"


class CursorError(ValueError):
    """A page breaks the contract of cursors."""


class _Store:
    """Pages of an entity, in whatever file system the path names."""

    def __init__(self, path: str, entity: str) -> None:
        self.fs, base = pyarrow.fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
        self.root = posixpath.join(base, entity)
        self._folders: dict[str, str] | None = None

    def _list(self, path: str) -> list[str]:
        found = self.fs.get_file_info(pyarrow.fs.FileSelector(path, allow_not_found=True))
        return sorted(f.path for f in found if not posixpath.basename(f.path).startswith(("_", ".")))

    def folders(self) -> dict[str, str]:
        """Collections whose pages lie one by one, with their folders; listed once."""
        if self._folders is None:
            names = {p: unquote(posixpath.basename(p)) for p in self._list(self.root)}
            self._folders = {n.removeprefix("collection="): p for p, n in names.items() if n.startswith("collection=")}
        return self._folders

    def bundles(self, only: set[str] | None = None) -> dict[str, list[str]]:
        """Files of each bundle, of those that may hold ``only``."""
        found = {}
        for path in self._list(self.root):
            name = posixpath.basename(path)
            if name.startswith("bundle="):
                k, n = map(int, name.removeprefix("bundle=").split("-of-"))
                if only is None or any(zlib.crc32(c.encode()) % n == k for c in only):
                    found[name] = [posixpath.basename(f) for f in self._list(path)]
        return found

    def _folder(self, collection: str) -> str:
        return self.folders().get(collection, "")

    def has(self, collection: str, cursor: str) -> bool:
        return bool(self._list(posixpath.join(self._folder(collection), f"cursor={cursor}")))

    def page(self, collection: str, cursor: str) -> dict:
        files = self._list(posixpath.join(self._folder(collection), f"cursor={cursor}"))
        if not files:
            raise CursorError(f"{collection}: no page at cursor {cursor}")
        with self.fs.open_input_stream(files[0]) as held:
            page = json.loads(held.read())
        return self.checked(collection, cursor, page)

    @staticmethod
    def checked(collection: str, cursor: str, page: dict) -> dict:
        if not isinstance(page.get("results"), list):
            raise CursorError(f"{collection}: a page without results at cursor {cursor}")
        if page.get("has_more") and not page.get("next_cursor"):
            raise CursorError(f"{collection}: more to come but no cursor after {cursor}")
        return page

    def follow(self, collection: str, cursor: str | None, end: str | None = None, partial: bool = False) -> Iterator[tuple[str, dict]]:
        """Pages from ``cursor`` on, up to ``end`` (not included); ``partial``: up to where the chain is written so far."""
        seen = set()
        while cursor and cursor != end:
            if cursor in seen:
                raise CursorError(f"{collection}: cursor {cursor} comes again")
            seen.add(cursor)
            if partial and not self.has(collection, cursor):
                return
            page = self.page(collection, cursor)
            yield cursor, page
            cursor = page.get("next_cursor") if page.get("has_more") else None


    def lines(self, files: list[str], only: set[str] | None, partial: bool) -> Iterator[tuple[str, int, dict]]:
        """Collection, number and page of each line of a bundle's files; ``partial``: chains may begin and end within."""
        ahead: dict[str, tuple[str, int, set[str]]] = {}  # chains that go on: next cursor, its number, cursors so far
        ended = set()
        for file in files:
            with io.BufferedReader(self.fs.open_input_stream(posixpath.join(self.root, file)), 1 << 20) as held:
                for line in held:
                    row = json.loads(line)
                    collection, cursor, number = row["collection"], row["cursor"], row["page_no"]
                    if only is not None and collection not in only:
                        continue
                    first = (cursor, number, set()) if partial and collection not in ended else (START, 0, set())
                    wanted, at, seen = ahead.get(collection, first)
                    if cursor in seen or collection in ended:
                        raise CursorError(f"{collection}: cursor {cursor} comes again")
                    if (cursor, number) != (wanted, at):
                        raise CursorError(f"{collection}: no page at cursor {wanted}")
                    page = self.checked(collection, cursor, row["page"])
                    seen.add(cursor)
                    yield collection, number, page
                    if page.get("has_more"):
                        if page["next_cursor"] in seen:
                            raise CursorError(f"{collection}: cursor {page['next_cursor']} comes again")
                        ahead[collection] = (page["next_cursor"], number + 1, seen)
                    else:
                        ahead.pop(collection, None)
                        ended.add(collection)
        if ahead and not partial:
            collection, (cursor, _, _) = next(iter(ahead.items()))
            raise CursorError(f"{collection}: no page at cursor {cursor}")


class Bundle(InputPartition):
    """Files of one bundle, and the collections that are asked for."""

    def __init__(self, files: list[str], only: set[str] | None, partial: bool) -> None:
        super().__init__(None)
        self.files, self.only, self.partial = files, only, partial


class Chains(InputPartition):
    """Chains of one partition: collection, first cursor, the cursor to stop at, and the number of the first page."""

    def __init__(self, chains: list[tuple[str, str, str | None, int]]) -> None:
        super().__init__(None)
        self.chains = chains


class _Rows:
    """What the batch and the stream reader share."""

    def __init__(self, options: dict[str, str], schema: StructType) -> None:
        self.path, self.entity, self.schema = options["path"], options["entity"], schema
        self.partitions_wanted = int(options.get("partitions", "32"))

    def dealt(self, chains: list[tuple[str, str, str | None, int]]) -> list[InputPartition]:
        n = min(self.partitions_wanted, len(chains))
        return [Chains(chains[k::n]) for k in range(n)]

    def rows(self, partition: Chains | Bundle) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        store, schema = _Store(self.path, self.entity), to_arrow_schema(self.schema)
        kinds = {f.name: f.dataType.simpleString() for f in self.schema.fields[4:]}

        def value(item: dict, name: str, kind: str):
            x = item.get(name) if isinstance(item, dict) else None
            right = {"string": str, "boolean": bool, "bigint": int}[kind]
            return x if isinstance(x, right) and (kind == "boolean" or not isinstance(x, bool)) else None

        def pages() -> Iterator[tuple[str, int, dict]]:
            if isinstance(partition, Bundle):
                yield from store.lines(partition.files, partition.only, partition.partial)
                return
            for collection, cursor, end, number in partition.chains:
                for page_no, (_, page) in enumerate(store.follow(collection, cursor, end), number):
                    yield collection, page_no, page

        def batch() -> pa.RecordBatch:
            columns = [*zip(*held, strict=True)] + [[value(x, name, kind) for x in items] for name, kind in kinds.items()]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        held, items, size = [], [], 0
        for collection, page_no, page in pages():
            for place, x in enumerate(page["results"]):
                held.append((collection, page_no, place, json.dumps(x, ensure_ascii=False)))
                items.append(x)
                size += len(held[-1][3])
                if len(held) >= BATCH_ROWS or size >= BATCH_BYTES // 2:  # an item's fields stand beside its JSON
                    yield batch()
                    held, items, size = [], [], 0
        if held:
            yield batch()


class CursorReader(DataSourceReader, _Rows):
    def __init__(self, options: dict[str, str], schema: StructType) -> None:
        _Rows.__init__(self, options, schema)
        self.only: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes equality with a collection; the rest goes back to Spark."""
        for f in filters:
            if isinstance(f, EqualTo | In) and tuple(f.attribute) == ("collection",):
                asked = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.only = asked if self.only is None else self.only & asked
            elif not (isinstance(f, IsNotNull) and tuple(f.attribute) == ("collection",)):  # a collection is never null
                yield f

    def partitions(self) -> list[InputPartition]:
        store = _Store(self.path, self.entity)
        chains = self.dealt([(c, START, None, 0) for c in sorted(store.folders()) if self.only is None or c in self.only])
        bundles = [Bundle([f"{b}/{f}" for f in files], self.only, False) for b, files in store.bundles(self.only).items()]
        return chains + bundles or [Chains([])]

    def read(self, partition: Chains | Bundle) -> Iterator[pa.RecordBatch]:
        return self.rows(partition)


class CursorStream(DataSourceStreamReader, _Rows):
    """Offsets: for each collection the cursor that comes next (null at the end) and the number of its page."""

    def __init__(self, options: dict[str, str], schema: StructType) -> None:
        _Rows.__init__(self, options, schema)
        self.at: dict[str, list] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """Follows each chain from where it stood as far as it is written; of bundles only the files are listed."""
        store = _Store(self.path, self.entity)
        for c in sorted(store.folders()):
            cursor, number = self.at.get(c, [START, 0])
            for _, page in store.follow(c, cursor, partial=True):
                cursor, number = page["next_cursor"] if page.get("has_more") else None, number + 1
            self.at[c] = [cursor, number]
        files = [f"{b}/{f}" for b, found in store.bundles().items() for f in found]
        return {c: list(x) for c, x in self.at.items()} | ({FILES: files} if files else {})

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        end = dict(end)
        old, new = set(start.get(FILES, ())), {}
        for f in end.pop(FILES, ()):
            if f not in old:
                new.setdefault(posixpath.dirname(f), []).append(f)
        begun = {c: start.get(c, [START, 0]) for c in end}
        chains = self.dealt([(c, begun[c][0], end[c][0], begun[c][1]) for c in sorted(end) if begun[c] != list(end[c]) and begun[c][0]])
        return chains + [Bundle(files, None, True) for files in new.values()] or [Chains([])]

    def commit(self, end: dict) -> None:
        pass

    def read(self, partition: Chains | Bundle) -> Iterator[pa.RecordBatch]:
        return self.rows(partition)


class CursorSource(DataSource):
    """``spark.read.format("cursors").option("entity", ...).load(path)``."""

    @classmethod
    def name(cls) -> str:
        return "cursors"

    def schema(self) -> str:
        if self.options.get("entity") not in ENTITIES:
            raise ValueError(f"entity must be one of {', '.join(ENTITIES)}")
        return f"{PLACE}, {ENTITIES[self.options['entity']]}"

    def reader(self, schema: StructType) -> DataSourceReader:
        return CursorReader(self.options, schema)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return CursorStream(self.options, schema)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CursorSource)


def export(items: DataFrame, path: str, entity: str, page_size: int = 100) -> None:
    """Writes ``items`` (``collection, place`` and the entity's fields) as cursor pages in bundles, a file or so for each shuffle partition."""
    fields = [c for c in items.columns if c not in ("collection", "place")]
    number = F.floor((F.row_number().over(Window.partitionBy("collection").orderBy("place")) - 1) / page_size)
    pages = items.withColumn("page_no", number).groupBy("collection", "page_no").agg(F.array_sort(F.collect_list(F.struct("place", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("item")))).alias("held"))
    last = F.col("page_no") == F.max("page_no").over(Window.partitionBy("collection"))
    cursor = lambda n: F.concat(F.lit("c"), n.cast("string"))
    body = F.concat(F.lit('{"results":['), F.array_join(F.transform("held", lambda x: x["item"]), ","), F.lit('],"has_more":'), (~last).cast("string"), F.lit(',"next_cursor":'), F.when(last, "null").otherwise(F.concat(F.lit('"'), cursor(F.col("page_no") + 1), F.lit('"'))), F.lit("}"))
    name = F.coalesce(F.col("collection").cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__"))
    place = F.to_json(F.struct(name.alias("collection"), "page_no", F.when(F.col("page_no") == 0, START).otherwise(cursor(F.col("page_no"))).alias("cursor")))
    n = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bundle = F.concat((F.crc32(name.cast("binary")) % n).cast("string"), F.lit(f"-of-{n}"))
    written = pages.select(bundle.alias("bundle"), "collection", "page_no", F.concat(F.substring(place, F.lit(1), F.length(place) - 1), F.lit(',"page":'), body, F.lit("}")).alias("value"))
    dealt = written.repartition(n, "bundle").sortWithinPartitions("bundle", "collection", "page_no").select("bundle", "value")
    dealt.write.partitionBy("bundle").text(f"{path.rstrip('/')}/{entity}")
