"""Exchange formats as data sources of Spark's: OPML, bookmark files, RSS documents and takeout archives.

``register(spark)`` makes them known as formats "opml", "bookmarks", "rss" and "takeout". A path is a file or a folder, local or in any store that
pyarrow opens; one task reads one file, and of an archive one member. Each task writes files of its own into a folder of the job's, and only a whole job's files
are moved to the path, so that tasks that fail or run twice leave nothing. Overwriting removes what was there only then.
"""

from __future__ import annotations

import csv
import io
import json
import re
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from datetime import datetime, timezone
from xml.etree.ElementTree import iterparse
from xml.sax.saxutils import escape, quoteattr

from pyarrow import fs as stores
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: The takeout format that this writes, and the newest that it reads.
VERSION = 1
#: Settings that never leave, by their keys.
SECRET = re.compile(r"(?i)passw|secret|token|api[_-]?key|credential|private[_-]?key|session")
#: What XML can't hold.
UNWRITABLE = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ud800-\udfff\ufffe\uffff]")


def store_of(path: str) -> tuple[stores.FileSystem, str]:
    return stores.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (stores.LocalFileSystem(), path)


def files_below(path: str) -> list[str]:
    """A path's files by name; those that begin with a dot or underscore are not data."""
    store, where = store_of(path)
    info = store.get_file_info(where)
    if info.type == stores.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == stores.FileType.File else store.get_file_info(stores.FileSelector(where, recursive=True))
    inside = lambda p: p[len(where) :].split("/")
    return sorted(f.path for f in found if f.type == stores.FileType.File and (f.path == where or not any(x[:1] in ("_", ".") for x in inside(f.path))))


@contextmanager
def opened(path: str, file: str) -> Iterator[io.BufferedIOBase]:
    with store_of(path)[0].open_input_file(file) as f:
        yield f


@dataclass
class Part(InputPartition):
    file: str
    member: str | None = None


@dataclass
class Written(WriterCommitMessage):
    files: list[str]
    rows: int


class Reader(DataSourceReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.names = path, schema.names

    def parts_of(self, file: str) -> list[Part]:
        return [Part(file)]

    def partitions(self) -> list[Part]:
        return [p for f in files_below(self.path) for p in self.parts_of(f)] or [Part("")]

    def read(self, partition: Part) -> Iterator[tuple]:
        if partition.file:
            for row in self.rows(partition):
                yield tuple(row.get(n) for n in self.names)

    def rows(self, part: Part) -> Iterator[dict]:
        raise NotImplementedError


class Writer(DataSourceWriter):
    suffix = ""

    def __init__(self, path: str, schema: StructType, needed: list[str], overwrite: bool):
        missing = set(needed) - set(schema.names)
        if missing:
            raise ValueError(f"columns missing: {', '.join(sorted(missing))}")
        self.path, self.overwrite, self.job = path, overwrite, f"_job-{uuid.uuid4().hex}"

    @contextmanager
    def output(self, files: list[str]) -> Iterator[io.BufferedIOBase]:
        """A new file of this task's, in the job's folder."""
        store, where = store_of(self.path)
        task = TaskContext.get()
        name = f"part-{task.partitionId() if task else 0:05}-{uuid.uuid4().hex}{self.suffix}"
        store.create_dir(f"{where}/{self.job}", recursive=True)
        with store.open_output_stream(f"{where}/{self.job}/{name}") as out:
            yield out
        files.append(name)

    def commit(self, messages: list[Written | None]) -> None:
        store, where = store_of(self.path)
        old = files_below(self.path) if self.overwrite and store.get_file_info(where).type == stores.FileType.Directory else []
        for m in messages:
            for name in m.files if m else ():
                store.move(f"{where}/{self.job}/{name}", f"{where}/{name}")
        for f in old:
            store.delete_file(f)
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        store, where = store_of(self.path)
        if store.get_file_info(f"{where}/{self.job}").type == stores.FileType.Directory:
            store.delete_dir(f"{where}/{self.job}")


class Exchange(DataSource):
    columns, reads, writes = "", Reader, Writer

    def schema(self) -> str:
        return self.columns

    def reader(self, schema: StructType) -> DataSourceReader:
        return self.reads(self.options["path"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return self.writes(self.options["path"], schema, [c.split()[0] for c in self.columns.split(", ")], overwrite)


def writable(text: object) -> str:
    return UNWRITABLE.sub("", str(text))


# ---- OPML


class OpmlReader(Reader):
    def rows(self, part: Part) -> Iterator[dict]:
        with opened(self.path, part.file) as f:
            above: list[str | None] = []
            for event, e in iterparse(f, ("start", "end")):
                if e.tag.lower() != "outline":
                    continue
                if event == "end":
                    above.pop()
                    e.clear()
                    continue
                own = {k.lower(): v for k, v in e.attrib.items()}
                title = own.get("title", own.get("text"))
                if own.get("xmlurl"):
                    yield {"url": own["xmlurl"], "title": title, "folder": "/".join(x for x in above if x) or None}
                above.append(None if own.get("xmlurl") else title)


class OpmlWriter(Writer):
    suffix = ".opml"

    def write(self, iterator) -> Written:
        files, n = [], 0
        with self.output(files) as out:
            put = lambda s: out.write(s.encode())
            put('<?xml version="1.0" encoding="UTF-8"?>\n<opml version="2.0"><head/><body>\n')
            folder: tuple[str, ...] = ()
            for row in iterator:
                if row["url"] is None:
                    continue
                wanted = tuple((row["folder"] or "").split("/")) if row["folder"] else ()
                same = next((i for i, (a, b) in enumerate(zip(folder, wanted, strict=False)) if a != b), min(len(folder), len(wanted)))
                put("</outline>" * (len(folder) - same) + "".join(f"<outline text={quoteattr(writable(w))}>" for w in wanted[same:]))
                folder = wanted
                title = "" if row["title"] is None else f" title={quoteattr(writable(row['title']))}"
                put(f"<outline type=\"rss\" text={quoteattr(writable(row['title'] or row['url']))}{title} xmlUrl={quoteattr(writable(row['url']))}/>\n")
                n += 1
            put("</outline>" * len(folder) + "</body></opml>\n")
        return Written(files, n)


class Opml(Exchange):
    """(url, title, folder): subscriptions; ``folder`` is the path of folders with slashes between them, null at the top. Rows without a url aren't written, nor is what XML can't hold."""

    columns, reads, writes = "url string, title string, folder string", OpmlReader, OpmlWriter

    @classmethod
    def name(cls) -> str:
        return "opml"


# ---- bookmark files


class BookmarkReader(Reader):
    def rows(self, part: Part) -> Iterator[dict]:
        with opened(self.path, part.file) as f, io.TextIOWrapper(f, "utf-8-sig", newline="") as text:
            lines = csv.reader(text)
            names = [n.strip().lower() for n in next(lines, [])]
            for line in lines:
                cell = dict(zip(names, line, strict=False))
                if (cell.get("url") or "").strip():
                    stamp = (cell.get("timestamp") or "").strip()
                    when = datetime.fromtimestamp(int(stamp), timezone.utc) if re.fullmatch(r"-?\d{1,11}", stamp) else None
                    yield {"url": cell["url"].strip(), "title": cell.get("title") or None, "archived": (cell.get("folder") or "").strip().lower() == "archive", "saved_at": when, "tags": tags_of(cell.get("tags") or "")}


def tags_of(cell: str) -> list[str]:
    """Tags of a cell, as JSON or with commas between."""
    try:
        found = json.loads(cell)
        found = found if isinstance(found, list) else [found]
    except ValueError:
        found = cell.split(",")
    return [t for t in (str(x).strip() for x in found) if t]


class BookmarkWriter(Writer):
    suffix = ".csv"

    def write(self, iterator) -> Written:
        files, n = [], 0
        with self.output(files) as out:
            text = io.TextIOWrapper(out, "utf-8", newline="", write_through=True)
            lines = csv.writer(text)
            lines.writerow(["URL", "Title", "Folder", "Timestamp", "Tags"])
            for row in iterator:
                if row["url"]:
                    stamp = "" if row["saved_at"] is None else int(row["saved_at"].timestamp())
                    lines.writerow([row["url"], row["title"] or "", "Archive" if row["archived"] else "Unread", stamp, json.dumps(list(row["tags"] or []), ensure_ascii=False)])
                    n += 1
            text.detach()
        return Written(files, n)


class Bookmarks(Exchange):
    """(url, title, archived, saved_at, tags): saved articles. Times are whole seconds, an empty title is a null one; rows without a url aren't written."""

    columns, reads, writes = "url string, title string, archived boolean, saved_at timestamp, tags array<string>", BookmarkReader, BookmarkWriter

    @classmethod
    def name(cls) -> str:
        return "bookmarks"


# ---- RSS documents


class RssReader(Reader):
    def rows(self, part: Part) -> Iterator[dict]:
        with opened(self.path, part.file) as f:
            feed, inside = None, False
            for event, e in iterparse(f, ("start", "end")):
                if e.tag == "item":
                    inside = event == "start"
                    if event == "end":
                        own = {c.tag: c.text or "" for c in e}
                        when = own.get("pubDate")
                        yield {"feed": feed, **{k: own.get(k) for k in ("guid", "link", "title", "description")}, "published": datetime.strptime(when, "%a, %d %b %Y %H:%M:%S %z") if when else None}
                        e.clear()
                elif event == "end" and e.tag == "link" and not inside:
                    feed = e.text


class RssWriter(Writer):
    suffix = ".rss"

    def write(self, iterator) -> Written:
        files, n, rows = [], 0, iter(iterator)
        row = next(rows, None)
        while row is not None:
            feed = row["feed"]
            with self.output(files) as out:
                put = lambda s: out.write(s.encode())  # noqa: E731, B023
                tag = lambda name, value: "" if value is None else f"<{name}>{escape(writable(value), {chr(13): '&#13;'})}</{name}>"
                put('<?xml version="1.0" encoding="UTF-8"?>\n<rss version="2.0"><channel>' + tag("title", feed) + tag("link", feed) + "\n")
                while row is not None and row["feed"] == feed:
                    when = None if row["published"] is None else row["published"].astimezone(timezone.utc).strftime("%a, %d %b %Y %H:%M:%S +0000")
                    put("<item>" + "".join(tag(k, row[k]) for k in ("guid", "link", "title", "description")) + tag("pubDate", when) + "</item>\n")
                    n += 1
                    row = next(rows, None)
                put("</channel></rss>\n")
        return Written(files, n)


class Rss(Exchange):
    """(feed, guid, link, title, description, published): a document for each run of rows with the same feed, so rows should be dealt and sorted by feed. Times are whole seconds."""

    columns, reads, writes = "feed string, guid string, link string, title string, description string, published timestamp", RssReader, RssWriter

    @classmethod
    def name(cls) -> str:
        return "rss"


# ---- takeout archives


def withheld(kind: str, record: str) -> bool:
    """Whether a setting is a secret."""
    return kind == "settings" and bool(SECRET.search(str(json.loads(record).get("key", ""))))


class TakeoutReader(Reader):
    def parts_of(self, file: str) -> list[Part]:
        with opened(self.path, file) as f, zipfile.ZipFile(f) as z:
            names = z.namelist()
            manifest = json.loads(z.read("manifest.json")) if "manifest.json" in names else {}
            version = manifest.get("takeout_version", 1)
            if not isinstance(version, int) or version > VERSION:
                raise ValueError(f"{file}: takeout version {version} is newer than {VERSION}")
            return [Part(file, n) for n in names if n.endswith((".jsonl", ".json")) and n != "manifest.json"]

    def rows(self, part: Part) -> Iterator[dict]:
        kind = part.member.rsplit(".", 1)[0].split("/")[0]
        with opened(self.path, part.file) as f, zipfile.ZipFile(f) as z, z.open(part.member) as m:
            if part.member.endswith(".jsonl"):
                records = (json.loads(line) for line in m if line.strip())
            else:
                got = json.load(m)
                records = got if isinstance(got, list) else ({"key": k, "value": v} for k, v in got.items())
            for r in records:
                record = json.dumps(r, ensure_ascii=False)
                if not withheld(kind, record):
                    yield {"kind": kind, "record": record}


class TakeoutWriter(Writer):
    suffix = ".zip"

    def write(self, iterator) -> Written:
        files, counts = [], {}
        with self.output(files) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            kind = member = None
            for row in iterator:
                if row["kind"] is None or row["record"] is None or withheld(row["kind"], row["record"]):
                    continue
                if row["kind"] != kind:
                    if member:
                        member.close()
                    kind = row["kind"]
                    member = z.open(f"{kind}/{len(z.namelist())}.jsonl", "w", force_zip64=True)
                member.write(json.dumps(json.loads(row["record"]), ensure_ascii=False).encode() + b"\n")
                counts[kind] = counts.get(kind, 0) + 1
            if member:
                member.close()
            z.writestr("manifest.json", json.dumps({"takeout_version": VERSION, "records": counts}))
        return Written(files, sum(counts.values()))


class Takeout(Exchange):
    """(kind, record): a library's records as JSON objects, with the table that each is of. An archive for each task, with a member for each run of one
    kind, so rows should be sorted by kind, and a manifest. Archives of a newer version are refused; settings whose key names a secret are neither written nor read.
    """

    columns, reads, writes = "kind string, record string", TakeoutReader, TakeoutWriter

    @classmethod
    def name(cls) -> str:
        return "takeout"


def register(spark: SparkSession) -> None:
    for source in (Opml, Bookmarks, Rss, Takeout):
        spark.dataSource.register(source)


def taken_out(tables: dict[str, DataFrame]) -> DataFrame:
    """The records of several tables for a takeout, sorted by kind within their tasks."""
    rows = None
    for kind, df in tables.items():
        own = df.select(F.lit(kind).alias("kind"), F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("record"))
        rows = own if rows is None else rows.unionByName(own)
    return rows.sortWithinPartitions("kind")


def merged(existing: DataFrame, takeout: DataFrame, kind: str, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(all, added): existing rows, unchanged, with those of a takeout whose keys are new, each once. Importing again adds nothing."""
    rows = takeout.where(F.col("kind") == kind).select(F.from_json("record", existing.schema).alias("r")).select("r.*")
    match = [F.col(f"there.{k}").eqNullSafe(F.col(f"new.{k}")) for k in keys]
    added = rows.alias("new").join(existing.select(*keys).distinct().alias("there"), match, "left_anti").dropDuplicates(keys)
    return existing.unionByName(added), added
