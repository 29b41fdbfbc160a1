"""Objects by key in a folder that Spark can reach, and Python's data source of feeds."""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def file_system(spark: SparkSession, path: str):
    """(Hadoop file system, path) of an address."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = file_system(spark, path)
    return bool(fs.exists(at))


class Store:
    """Content-addressed objects: a key is written once, and its content never changes."""

    def __init__(self, spark: SparkSession, root: str, public: str = ""):
        self.spark, self.root, self.public = spark, root.rstrip("/"), public.rstrip("/")

    def exists(self, key: str) -> bool:
        return exists(self.spark, f"{self.root}/{key}")

    def get(self, key: str) -> bytes | None:
        if not self.exists(key):
            return None
        row = self.spark.read.format("binaryFile").load(f"{self.root}/{key}").select("content").first()
        return bytes(row.content)

    def put(self, key: str, content: bytes) -> bool:
        """Writes a key that isn't there yet; whether it did."""
        if self.exists(key):
            return False
        fs, at = file_system(self.spark, f"{self.root}/{key}")
        out = fs.create(at, False)
        try:
            out.write(bytearray(content))
        finally:
            out.close()
        return True

    def delete(self, key: str) -> bool:
        fs, at = file_system(self.spark, f"{self.root}/{key}")
        return bool(fs.delete(at, False))

    def url(self, key: str) -> str:
        return f"{self.public}/{key}"


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def feed_items(raw: bytes) -> list[tuple[str | None, ...]]:
    """(url, title, summary, published) of each item of an RSS or Atom document; none of a broken one."""
    try:
        root = ElementTree.fromstring(raw)
    except ElementTree.ParseError:
        return []
    found = []
    for item in (e for e in root.iter() if _local(e.tag) in ("item", "entry")):
        text: dict[str, str] = {}
        for child in item:
            name, own = _local(child.tag), (child.text or "").strip()
            if name == "link" and not own and child.get("rel") in (None, "alternate"):
                own = child.get("href", "").strip()
            if own:
                text.setdefault(name, own)
        url = text.get("link") or text.get("guid") or text.get("id")
        if url and url.startswith("http"):
            found.append((url, text.get("title"), text.get("encoded") or text.get("content") or text.get("description") or text.get("summary"), text.get("pubDate") or text.get("date") or text.get("published") or text.get("updated")))
    return found


class _FeedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = [p for p in options.get("paths", options.get("path", "")).split(",") if p]
        self.most = int(options.get("limit", "20"))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import pyarrow.fs as pafs

        fs, path = pafs.FileSystem.from_uri(partition.value if "://" in partition.value else f"file://{partition.value}")
        with fs.open_input_stream(path) as source:
            items = feed_items(source.read())
        for item in items[: self.most]:
            yield (partition.value, *item)


class FeedSource(DataSource):
    """``spark.read.format("feed").option("paths", "a,b")``: at most ``limit`` candidates of each feed, whatever its kind."""

    @classmethod
    def name(cls) -> str:
        return "feed"

    def schema(self) -> str:
        return "feed string, url string, title string, summary string, published string"

    def reader(self, schema) -> DataSourceReader:
        return _FeedReader(self.options)
