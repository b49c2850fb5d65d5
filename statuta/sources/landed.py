"""Landed files: sniffing, fingerprints, archive members, package parts."""

from __future__ import annotations

import hashlib
import io
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator
from functools import reduce
from typing import IO
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import sniffed

# The formats tried for a source, best first.
PRIORITY = ("json", "xml", "html", "pdf")


#: Bytes of a file read at a time.
BLOCK = 1 << 20


def best_url(urls: Column) -> Column:
    """Struct (format, url) of the first format that the map has."""
    pick = F.coalesce(*[F.when(F.try_element_at(urls, F.lit(f)).isNotNull(), F.struct(F.lit(f).alias("format"), F.try_element_at(urls, F.lit(f)).alias("url"))) for f in PRIORITY])
    return pick


def files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Landed files with their kind and MD5, read by Spark wherever they lie."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    return df.select("path", "length", F.md5("content").alias("content_hash"), sniffed(F.col("content"), F.lit(None).cast("string")).alias("kind"), "content")


def _opened(name: str):
    """A landed file, opened where the task runs, as something that seeks."""
    from pyarrow import fs

    store, key = fs.FileSystem.from_uri(quote(name if "://" in name else name.replace(":", "://", 1), safe=":/@"))
    return store.open_input_file(key)


def fingerprints(spark: SparkSession, path: str, glob: str = "*", block: int = BLOCK) -> DataFrame:
    """(path, length, content_hash) of landed files, each read in blocks of a mebibyte: no file is
    ever whole in memory. The listing reads no content; executors open the files themselves, so
    the store must be one that pyarrow knows (local, HDFS, S3, GCS). Empty files are not listed."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path).select("path", "length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for name in batch.column(0).to_pylist():
                digest = hashlib.md5()
                with _opened(name) as f:
                    while some := f.read(block):
                        digest.update(some)
                found.append(digest.hexdigest())
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(found, pa.string())], ["path", "length", "content_hash"])

    return listed.mapInArrow(run, "path string, length long, content_hash string")


def table_sizes(tables: dict[str, DataFrame]) -> DataFrame:
    """A2: (table, files, bytes) of file-based tables, from the metadata that Spark hides in each row;
    no column is read. A table without rows has none."""
    one = lambda name, df: df.select(F.lit(name).alias("table"), "_metadata.file_path", "_metadata.file_size").groupBy("table", "file_path").agg(F.max("file_size").alias("size"))
    per_file = reduce(DataFrame.unionByName, [one(name, df) for name, df in tables.items()])
    return per_file.groupBy("table").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            try:
                with zipfile.ZipFile(io.BytesIO(content or b"")) as z:
                    info = [i for i in z.infolist() if not i.is_dir()]
                    yield pa.RecordBatch.from_pylist([{"path": path, "member": i.filename, "size": i.file_size, "body": z.read(i)} for i in info], schema=_MEMBER)
            except zipfile.BadZipFile:
                continue  # not an archive: it has no members


_MEMBER = pa.schema([("path", pa.string()), ("member", pa.string()), ("size", pa.int64()), ("body", pa.binary())])


def zip_members(landed: DataFrame) -> DataFrame:
    """S3: (path, member, size, body) of every archive's members; other files have none."""
    return landed.select("path", "content").mapInArrow(_members, "path string, member string, size long, body binary")


def chosen_member(members: DataFrame) -> DataFrame:
    """S3: the largest .docx of an archive, else its largest .xml."""
    kind = F.when(F.lower("member").endswith(".docx"), 1).when(F.lower("member").endswith(".xml"), 0)
    return members.withColumn("_k", kind).where(F.col("_k").isNotNull()).groupBy("path").agg(F.max_by(F.struct("member", "size"), F.struct("_k", "size", "member")).alias("m")).select("path", "m.member", "m.size")


_PKG = "{http://schemas.microsoft.com/office/2006/xmlPackage}"
_ER = "{http://www.easa.europa.eu/erules-export}"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
# The attributes of a topic that become columns.
TOPIC = {"sdt_id": "sdt-id", "title": "source-title", "erules_id": "ERulesId", "applicability_date": "ApplicabilityDate", "entry_into_force_date": "EntryIntoForceDate", "regulatory_source": "RegulatorySource", "type_of_content": "TypeOfContent", "amended_by": "AmendedBy"}


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


_SAID = {"tab": "\t", "br": "\n", "p": "\n", "cr": "\n"}


def _events(source: IO[bytes]) -> Iterator[dict]:
    """Rows of a package, pulled event by event: what is read is dropped as soon as no open content
    control holds it, so memory is that of one outermost control. A control's text includes that of
    the controls in it; the words are held once. pos: where the element starts, in document order."""
    open_elements: list[ET.Element] = []
    controls: list[tuple[int, int]] = []  # pos, and the words before it
    said: list[str] = []
    pos = -1
    for event, e in ET.iterparse(source, events=("start", "end")):
        kind = _local(e.tag)
        if event == "start":
            pos += 1
            open_elements.append(e)
            if kind == "heading" and e.get("title") is not None:
                yield {"pos": pos, "kind": kind, "title": e.get("title").strip()}
            elif kind == "topic":
                yield {"pos": pos, "kind": kind} | {c: e.get(a) for c, a in TOPIC.items()}
            elif e.tag == f"{_W}sdt":
                controls.append((pos, len(said)))
            if controls and kind in _SAID:
                said.append(_SAID[kind])
            continue
        open_elements.pop()
        if controls and kind == "t":
            said.append(e.text or "")
        if e.tag == f"{_W}sdt":
            at, begin = controls.pop()
            pr, content = e.find(f"{_W}sdtPr"), e.find(f"{_W}sdtContent")
            named = lambda c: next((x.get(f"{_W}val") for x in ([] if pr is None else pr) if _local(x.tag) == c), None)  # noqa: E731, B023
            paras = [" ".join("".join(p.itertext()).split()) for p in ([] if content is None else content.findall(f"{_W}p"))]
            yield {"pos": at, "kind": "sdt", "sdt_id": named("id"), "alias": named("alias"), "text": "".join(said[begin:]), "paragraphs": [p for p in paras if p], "xml": ET.tostring(e, encoding="unicode")}
            if not controls:
                said.clear()
        if not controls and open_elements:
            open_elements[-1].remove(e)


def _rows_of(path: str, source: IO[bytes]) -> Iterator[pa.RecordBatch]:
    """A package's rows, some at a time; a broken one has those before the break."""
    rows: list[dict] = []
    try:
        for r in _events(source):
            rows.append({"path": path} | r)
            if len(rows) >= _ROWS_A_BATCH:
                yield pa.RecordBatch.from_pylist(rows, schema=_ROWS)
                rows = []
    except ET.ParseError:
        pass
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema=_ROWS)


def _package(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            yield from _rows_of(path, io.BytesIO(content or b""))


_ROWS_A_BATCH = 256
_ROWS = pa.schema([("path", pa.string()), ("pos", pa.int64()), ("kind", pa.string()), *[(c, pa.string()) for c in TOPIC], ("alias", pa.string()), ("text", pa.string()), ("paragraphs", pa.list_(pa.string())), ("xml", pa.string())])
_DDL = "path string, pos long, kind string, " + ", ".join(f"{c} string" for c in TOPIC) + ", alias string, text string, paragraphs array<string>, xml string"


def package_rows(landed: DataFrame) -> DataFrame:
    """Headings, topics and content controls of flat packages, one row each; pos is their place."""
    return landed.select("path", "content").mapInArrow(_package, _DDL)


def archive_members(spark: SparkSession, path: str, glob: str = "*.zip") -> DataFrame:
    """S3: (path, member, size) of every archive's members, from the archives' directories alone."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path).select("path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                try:
                    with _opened(name) as f, zipfile.ZipFile(f) as z:
                        info = [i for i in z.infolist() if not i.is_dir()]
                except (zipfile.BadZipFile, pa.ArrowInvalid):
                    continue  # not an archive, or too short for one
                yield pa.record_batch([pa.array([name] * len(info), pa.string()), pa.array([i.filename for i in info], pa.string()), pa.array([i.file_size for i in info], pa.int64())], ["path", "member", "size"])

    return listed.mapInArrow(run, "path string, member string, size long")


def archive_rows(members: DataFrame, tasks: int | None = None) -> DataFrame:
    """Package rows of archive members (path, member), whose path becomes archive!member. Members of
    one archive are dealt to several tasks; each is inflated and parsed as it is read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, member in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with _opened(name) as f, zipfile.ZipFile(f) as z, z.open(member) as part:
                    yield from _rows_of(f"{name}!{member}", part)

    n = tasks or members.sparkSession.sparkContext.defaultParallelism
    return members.select("path", "member").repartition(n, "path", "member").mapInArrow(run, _DDL)


def pruned(rows: DataFrame, alias: str = "topic") -> DataFrame:
    """(path, sdt_id, para, text and the topic's attributes): of a package only the paragraphs that
    stand directly in content controls of that alias, white space made single, joined to what the
    table of contents says of the control; controls it does not name keep empty attributes."""
    attributes = [c for c in TOPIC if c != "sdt_id"]
    told = rows.where("kind = 'topic' AND sdt_id IS NOT NULL").groupBy("path", "sdt_id").agg(F.min_by(F.struct(*attributes), "pos").alias("t"))
    kept = rows.where((F.col("kind") == "sdt") & (F.col("alias") == alias)).select("path", "sdt_id", "pos", F.posexplode("paragraphs").alias("para", "text"))
    return kept.join(told, ["path", "sdt_id"], "left").select("path", "sdt_id", "pos", "para", "text", "t.*")


def topics_with_text(rows: DataFrame) -> DataFrame:
    """Topics with the text of their content control; of controls with one id the last counts;
    topics without one, or without text, go."""
    from ..functions.text import normalised

    sdt = rows.where("kind = 'sdt' AND sdt_id IS NOT NULL").groupBy("path", "sdt_id").agg(F.max_by(F.struct("text", "xml"), "pos").alias("s"))
    t = rows.where("kind = 'topic' AND title IS NOT NULL AND trim(title) <> ''").drop("text", "xml", "kind", "alias", "paragraphs")
    return t.join(sdt, ["path", "sdt_id"]).select(*t.columns, normalised(F.col("s.text")).alias("content_text"), F.col("s.xml").alias("xml")).where("content_text <> ''")


def image_uris(rels: DataFrame, media: DataFrame) -> DataFrame:
    """(rel_id, uri): pictures as data URIs; emf is skipped."""
    uri = F.concat(F.lit("data:"), F.col("content_type"), F.lit(";base64,"), F.base64("content"))
    return rels.join(media, "target").where(~F.lower("target").endswith(".emf")).select("rel_id", uri.alias("uri"))
