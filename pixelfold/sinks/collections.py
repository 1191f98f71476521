"""Result collections: items in files, and a root document that is written when the job commits.

Every task writes its items and reports their box, time and number in its
commit message.  The root is put together from these messages alone, so a job
that fails leaves none, and what an attempt wrote without being committed is in
no root.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

ROOT = "collection.json"
ITEMS = "items"
BOX = ("west", "south", "east", "north")
# Rows a file holds at most.
FILE_ROWS = 1_000_000


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or address, and the path in it."""
    return pafs.FileSystem.from_uri("file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path)


@dataclass
class Written(WriterCommitMessage):
    """What one task wrote."""

    files: list = field(default_factory=list)
    count: int = 0
    box: list | None = None
    span: list | None = None


def _merged(a: list | None, b: list | None, low: int) -> list | None:
    """The smaller of the first ``low`` entries and the larger of the others; None is ignored."""
    if a is None or b is None:
        return a or b
    return [x if y is None else y if x is None else (min if i < low else max)(x, y) for i, (x, y) in enumerate(zip(a, b, strict=True))]


class CollectionWriter(DataSourceArrowWriter):
    def __init__(self, options, overwrite: bool):
        self.path, self.time, self.overwrite = options["path"], options.get("time", "datetime"), overwrite
        self.name, self.description = options.get("id", "result"), options.get("description", "")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, base = filesystem(self.path)
        done, out, rows = Written(), None, FILE_ROWS
        for batch in iterator:
            if not batch.num_rows:
                continue
            if rows >= FILE_ROWS:
                if out is not None:
                    out.close()
                fs.create_dir(f"{base}/{ITEMS}", recursive=True)
                done.files.append(f"{ITEMS}/part-{uuid.uuid4().hex}.parquet")
                out, rows = pq.ParquetWriter(fs.open_output_stream(f"{base}/{done.files[-1]}"), batch.schema), 0
            out.write_batch(batch)
            rows += batch.num_rows
            done.count += batch.num_rows
            edge = lambda f, c: f(batch.column(batch.schema.get_field_index(c))).as_py()
            done.box = _merged(done.box, [edge(pc.min, c) for c in BOX[:2]] + [edge(pc.max, c) for c in BOX[2:]], 2)
            ends = [f(pc.cast(batch.column(batch.schema.get_field_index(self.time)), pa.timestamp("us"))).as_py() for f in (pc.min, pc.max)]
            done.span = _merged(done.span, [e and e.isoformat() for e in ends], 1)
        if out is not None:
            out.close()
        return done

    def commit(self, messages: list) -> None:
        fs, base = filesystem(self.path)
        earlier = None
        if fs.get_file_info(f"{base}/{ROOT}").type == pafs.FileType.File:
            earlier = json.loads(fs.open_input_file(f"{base}/{ROOT}").read())
        written = [m for m in messages if m is not None]
        if earlier and not self.overwrite:
            extent = earlier["extent"]
            written.insert(0, Written([a["href"] for a in earlier["links"]], earlier["item_count"], (extent["spatial"]["bbox"] or [None])[0],
                                      (extent["temporal"]["interval"] or [None])[0]))
        box, span = reduce(lambda a, b: _merged(a, b, 2), [m.box for m in written], None), reduce(lambda a, b: _merged(a, b, 1), [m.span for m in written], None)
        files = [f for m in written for f in m.files]
        root = {"type": "Collection", "id": self.name, "description": self.description, "item_count": sum(m.count for m in written),
                "extent": {"spatial": {"bbox": [box] if box else []}, "temporal": {"interval": [span] if span else []}},
                "links": [{"rel": "items", "href": f} for f in files]}
        fs.create_dir(base, recursive=True)
        # complete before it gets its name
        draft = f"{base}/.{uuid.uuid4().hex}.json"
        with fs.open_output_stream(draft) as out:
            out.write(json.dumps(root).encode())
        fs.move(draft, f"{base}/{ROOT}")
        if earlier and self.overwrite:
            for link in earlier["links"]:
                fs.delete_file(f"{base}/{link['href']}")

    def abort(self, messages: list) -> None:
        fs, base = filesystem(self.path)
        for f in (f for m in messages if m is not None for f in m.files):
            fs.delete_file(f"{base}/{f}")


class CollectionSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "collection"

    def writer(self, schema, overwrite: bool) -> CollectionWriter:
        missing = [c for c in (*BOX, self.options.get("time", "datetime")) if c not in schema.names]
        if missing:
            raise ValueError(f"items need the columns {missing}")
        return CollectionWriter(self.options, overwrite)


def write_collection(items: DataFrame, path: str, name="result", mode="append", time="datetime", description="") -> str:
    """Write items with their box and time below ``path``; returns the address of the root document.

    ``append`` adds to the collection that stands there, ``overwrite`` replaces
    it.  An empty table gives a root without extent.  ``path`` must be a place
    all executors reach.
    """
    items.sparkSession.dataSource.register(CollectionSource)
    items.write.format("collection").option("time", time).option("id", name).option("description", description).mode(mode).save(path)
    return f"{path.rstrip('/')}/{ROOT}"


ROOT_SCHEMA = ("id string, description string, item_count long, extent struct<spatial: struct<bbox: array<array<double>>>, "
               "temporal: struct<`interval`: array<array<string>>>>, links array<struct<rel: string, href: string>>")


def read_root(spark: SparkSession, root: str) -> DataFrame:
    """One row: id, item_count, box, interval and number of files of a root document."""
    document = spark.read.schema(ROOT_SCHEMA).json(root, multiLine=True)
    box, span = F.get("extent.spatial.bbox", F.lit(0)), F.get("extent.temporal.interval", F.lit(0))
    return document.select("id", "item_count", *[F.get(box, F.lit(i)).alias(n) for i, n in enumerate(BOX)],
                           *[F.try_to_timestamp(F.get(span, F.lit(i))).alias(n) for i, n in enumerate(("start", "end"))],
                           F.size("links").alias("files"))


def read_items(spark: SparkSession, root: str, schema=None) -> DataFrame:
    """The items that a root document names."""
    folder = root.rsplit("/", 1)[0]
    links = spark.read.schema(ROOT_SCHEMA).json(root, multiLine=True).select(F.explode("links.href")).collect()
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(*[f"{folder}/{link[0]}" for link in links])
