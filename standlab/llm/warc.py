"""WARC archives with a two-level capture index.

Writing.  Every page becomes one WARC record: a response with the payload, or a revisit that
refers to the response with the same payload.  Of equal payloads the smallest page_id responds;
they are found by digest, pre-aggregated in every task.  Spark's text writer puts records
into files of about FILE_BYTES (as many records as have it on average): the CR LF CR LF that ends each record is the
line separator, so the files are plain WARC, written under Spark's commit protocol to any file system.

Index.  The files are read back and cut by Content-Length, which gives offset and length of each
record.  Captures are sorted by key (reversed host, path, then page) across partitions and packed
into compressed blocks of BLOCK lines; a sparse directory holds each block's first and last line.  Both
are tables.  A lookup finds blocks by binary search in the directory, decompresses them, finds keys by
binary search in their lines, and reads the records at their offsets, from any store that pyarrow reads.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import re
import zlib
from dataclasses import dataclass
from urllib.parse import quote

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from standlab.llm.registry import register
from standlab.llm.tables import SLOTS, ready, table
from standlab.llm.url_filter import UPPER, LOWER
from standlab.session import cut_lineage, scratch_path

BLOCK = 1000  # lines of an index block
FILE_BYTES = 8 << 20  # payload of an archive file, on average
CHUNK = 1 << 20  # bytes of a file that one read takes, or one record
DATE = "2000-01-01T00:00:00Z"  # pages have no time; one date keeps archives reproducible
_END = "\r\n\r\n"
_SAFE = r"[\x00-\x20\x7f]"


@dataclass(frozen=True)
class Archive:
    """Folders of an archive's files, index blocks and block directory."""
    files: str
    blocks: str
    directory: str


def digest_of(payload):
    """Bare upper-case base32 SHA-1 of a binary column: 20 bytes are 32 letters of 5 bits."""
    hexed = F.sha1(payload)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    out = []
    for i in range(0, 40, 10):  # 10 hex digits are 40 bits, 8 letters
        value = F.conv(F.substring(hexed, i + 1, 10), 16, 10).cast("long")
        out += [F.substring(F.lit(letters), F.shiftright(value, 35 - 5 * j).bitwiseAND(31).cast("int") + 1, 1)
                for j in range(8)]
    return F.concat(*out)


def payloads(pages: DataFrame) -> DataFrame:
    """page_id, url, payload (UTF-8 of html, empty for null), its bytes and digest."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    known = pages.select("page_id", "url", payload.alias("payload"))
    return known.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn(
        "payload_digest", digest_of(F.col("payload")))


def with_roles(known: DataFrame, least: int = 0) -> DataFrame:
    """record_type, and refers_to for revisits of payloads of at least ``least`` bytes.

    The smallest page_id with a payload responds; a null id is never referred to while another
    page has the payload.  Of rows that repeat the smallest id, each is a response.
    """
    first = known.filter(F.col("payload_bytes") >= least).groupBy("payload_digest", "payload_bytes").agg(
        F.min("page_id").alias("first"))
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return known.join(first, ["payload_digest", "payload_bytes"], "left").select(
        *known.columns, F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first")).alias("refers_to"))


def capture_key(url):
    """Reversed host, then the rest: com,example,www)/path?query; '-' for a url without host."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)(.*)$", 1)
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)(.*)$", 2)
    host = F.array_join(F.reverse(F.split(F.translate(found, UPPER, LOWER), r"\.")), ",")
    key = F.when(found == "", F.lit("-")).otherwise(F.concat(host, F.lit(")"), rest))
    return F.regexp_replace(key, _SAFE, "_")


def _record():
    """A record's text without its final separator, as bytes in a string column."""
    def line(name, value):
        return F.concat(F.lit(name + ": "), value, F.lit("\r\n"))

    def urn(kind, value):
        return F.concat(F.lit(f"<urn:{kind}:"), F.coalesce(value.cast("string"), F.lit("-")), F.lit(">"))

    revisit = F.col("record_type") == "revisit"
    http = F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n")
    length = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", urn("page", F.col("page_id"))), line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", F.regexp_replace(F.coalesce("url", F.lit("-")), _SAFE, "_")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")),
        F.when(revisit, F.concat(
            line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            line("WARC-Refers-To", urn("page", F.col("refers_to"))))).otherwise(F.lit("")),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        line("Content-Length", length.cast("string")), F.lit("\r\n"), http)
    body = F.when(revisit, F.lit("")).otherwise(F.col("payload").cast("string"))
    return F.concat(head, body)


def write(pages: DataFrame, folder: str, least: int = 0) -> Archive:
    """Archive of ``pages`` (page_id, url, html; others are not used) in a new folder, with its index."""
    spark = pages.sparkSession
    archive = Archive(f"{folder}/files", f"{folder}/blocks", f"{folder}/directory")
    known = payloads(pages)
    again = cut_lineage(with_roles(known.drop("payload"), least).filter("record_type = 'revisit'").select(
        F.col("page_id").alias("r_id"), F.col("url").alias("r_url"), F.col("payload_digest").alias("r_digest"),
        "refers_to").distinct())
    # pages whose hashed digest is free of revisits are written where they are read; only the
    # others are shuffled, to meet the page they refer to
    free = F.pmod(F.xxhash64("payload_digest"), F.lit(SLOTS))
    slots = again.select(F.pmod(F.xxhash64("r_digest"), F.lit(SLOTS)).alias("_slot")).distinct()
    clear = known.join(F.broadcast(slots), free == F.col("_slot"), "left_anti").withColumn(
        "refers_to", F.lit(None).cast("long"))
    met = known.join(F.broadcast(slots), free == F.col("_slot"), "left_semi").join(again, [
        F.col("page_id").eqNullSafe(F.col("r_id")), F.col("url").eqNullSafe(F.col("r_url")),
        F.col("payload_digest") == F.col("r_digest")], "left").select(clear.columns)
    rows = clear.unionByName(met).withColumn(
        "record_type", F.when(F.col("refers_to").isNull(), "response").otherwise("revisit"))
    mean = known.agg(F.avg(F.col("payload_bytes"))).first()[0] or 1
    rows.select(_record().alias("value")).write.option("lineSep", _END).option(
        "maxRecordsPerFile", max(1, int(FILE_BYTES // max(mean, 1)))).text(archive.files)
    index(spark, archive)
    return archive


def records(data: bytes):
    """(offset, length, headers, block) of each record of an archive file."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        head = dict(re.findall(r"([\w-]+): (.*?)\r\n", data[at:end + 2].decode()))
        size = int(head["Content-Length"])
        stop = end + 4 + size
        if data[stop:stop + 4] != b"\r\n\r\n":
            raise ValueError(f"record at {at} does not end where its length says")
        yield at, stop + 4 - at, head, data[end + 4:stop]
        at = stop + 4


def _listed(spark: SparkSession, archive: Archive) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(archive.files)


def _files(spark: SparkSession, archive: Archive) -> DataFrame:
    return _listed(spark, archive).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")


def index(spark: SparkSession, archive: Archive) -> None:
    """Capture lines sorted by key, in compressed blocks, and the directory of their first keys."""
    def scan(batches):
        for batch in batches:
            for file, content in zip(batch["file"], batch["content"]):
                rows = [(h["WARC-Target-URI"], h["WARC-Record-ID"], file, at, size, h["WARC-Type"])
                        for at, size, h, _ in records(content)]
                yield pd.DataFrame(rows, columns=["url", "id", "file", "at", "size", "type"])

    ready(spark)
    seen = _files(spark, archive).mapInPandas(scan, "url string, id string, file string, at long, size long, type string")
    seen = cut_lineage(seen.withColumn("key", capture_key(F.col("url"))))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    line = F.concat_ws(" ", "key", "id", "file", "at", "size", "type")
    ordered = seen.select(line.alias("line")).repartitionByRange(parts, "line").sortWithinPartitions("line")

    def pack(batches):
        lines: list[str] = []
        for batch in batches:
            lines += batch["line"].tolist()
            while len(lines) >= BLOCK:
                yield _block(lines[:BLOCK])
                del lines[:BLOCK]
        if lines:
            yield _block(lines)

    ordered.mapInPandas(pack, "first string, last string, n int, data binary").withColumn(
        "block", F.monotonically_increasing_id()).write.parquet(archive.blocks)
    spark.read.parquet(archive.blocks).select("block", "first", "last", "n").write.parquet(archive.directory)


def _block(lines: list[str]) -> pd.DataFrame:
    return pd.DataFrame({"first": [lines[0]], "last": [lines[-1]], "n": [len(lines)],
                         "data": [zlib.compress("\n".join(lines).encode())]})


def _captures(blocks: DataFrame) -> DataFrame:
    """Lines of blocks (data) whose key is among the block's ``keys``."""
    def read(batches):
        for batch in batches:
            for row in batch.itertuples(index=False):
                lines = zlib.decompress(row.data).decode().split("\n")
                found = []
                for key in row.keys:  # every key has its lines together
                    i = bisect.bisect_left(lines, key + " ")
                    while i < len(lines) and lines[i].startswith(key + " "):
                        found.append(lines[i].split(" "))
                        i += 1
                yield pd.DataFrame({"file": [p[2] for p in found], "at": [int(p[3]) for p in found],
                                    "size": [int(p[4]) for p in found]})

    return blocks.mapInPandas(read, "file string, at long, size long")


def _open(folder: str):
    """Opens files of a folder that Spark named for reads at an offset, on the stores that pyarrow reads."""
    scheme, colon, rest = folder.partition(":")
    if not colon or scheme == "file":
        store, base = fs.LocalFileSystem(), "/" + (rest if colon else folder).lstrip("/")
    else:
        scheme = "s3" if scheme in ("s3a", "s3n") else scheme
        store, base = fs.FileSystem.from_uri(scheme + ":" + quote(rest, safe="/:@"))
    return lambda file: store.open_input_file(f"{base}/{file}")


def _ranges(spark: SparkSession, archive: Archive, captures: DataFrame) -> DataFrame:
    """The records of captures, read from their files at the given offsets.

    Only (file, offset, length) are shuffled, by file and CHUNK of a file; ranges that follow
    each other within a batch are read at once, up to CHUNK bytes or one record.
    """
    one = _listed(spark, archive).select("path").first()
    folder = one["path"].rsplit("/", 1)[0] if one else archive.files

    def slice_(batches):
        opened = _open(folder)
        for batch in batches:
            for file, part in batch.groupby("file", sort=False):
                with opened(file) as source:
                    at, size = part["at"].tolist(), part["size"].tolist()
                    i = 0
                    while i < len(at):
                        j, end = i + 1, at[i] + size[i]
                        while j < len(at) and at[j] == end and end + size[j] - at[i] <= CHUNK:
                            end += size[j]
                            j += 1
                        data = source.read_at(end - at[i], at[i])
                        yield _parsed(data[a - at[i]:a - at[i] + n] for a, n in zip(at[i:j], size[i:j]))
                        i = j

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunk = F.floor(F.col("at") / CHUNK)
    return (captures.select("file", "at", "size", chunk.alias("chunk")).repartition(parts, "file", "chunk")
            .sortWithinPartitions("file", "at").select("file", "at", "size").mapInPandas(
        slice_, "id string, url string, type string, refers string, claimed string, digest string, payload binary"))


def _parsed(datas) -> pd.DataFrame:
    out = []
    for data in datas:
        (_, _, head, block), = records(data)
        payload = block[block.index(b"\r\n\r\n") + 4:]
        out.append((head["WARC-Record-ID"], head["WARC-Target-URI"], head["WARC-Type"], head.get("WARC-Refers-To"),
                    head["WARC-Payload-Digest"], base64.b32encode(hashlib.sha1(payload).digest()).decode(), payload))
    return pd.DataFrame(out, columns=["id", "url", "type", "refers", "claimed", "digest", "payload"])


def _between(key: str, firsts: list[str], lasts: list[str]) -> range:
    """Places, in sorted spans of lines, of those that can hold lines of the key."""
    return range(bisect.bisect_left(lasts, key + " "), bisect.bisect_left(firsts, key + "!"))


def lookup(spark: SparkSession, archive: Archive, urls: DataFrame) -> DataFrame:
    """Records of the given urls (column url): id, url, type, refers, claimed, digest, payload.

    The index was written in as many sorted parts as the session shuffles into; a key finds its
    parts by binary search in their first and last lines, its blocks by binary search in the
    part's share of the directory, and its lines by binary search in the blocks.
    """
    ready(spark)
    directory = spark.read.parquet(archive.directory).withColumn("part", F.shiftright("block", 33).cast("int"))
    top = directory.groupBy("part").agg(F.min("first").alias("first"), F.max("last").alias("last")).orderBy("first").collect()
    firsts, lasts, numbers = [r["first"] for r in top], [r["last"] for r in top], [r["part"] for r in top]

    @F.pandas_udf("array<int>")
    def parts_of(keys: pd.Series) -> pd.Series:
        return keys.map(lambda key: [numbers[i] for i in _between(key, firsts, lasts)])

    def blocks_of(keys, blocks):
        blocks = blocks.sort_values("first")
        firsts, lasts, numbers = (blocks[c].tolist() for c in ("first", "last", "block"))
        found = [(numbers[i], key) for key in keys["key"] for i in _between(key, firsts, lasts)]
        return pd.DataFrame(found, columns=["block", "key"])

    keys = urls.select(capture_key(F.regexp_replace("url", _SAFE, "_")).alias("key")).distinct()
    keys = keys.select("key", F.explode(parts_of("key")).alias("part"))
    met = (keys.groupBy("part").cogroup(directory.groupBy("part")).applyInPandas(blocks_of, "block long, key string")
           .groupBy("block").agg(F.collect_list("key").alias("keys")))
    captures = _captures(spark.read.parquet(archive.blocks).join(met, "block").select("data", "keys"))
    return _ranges(spark, archive, captures)


def page_records(spark: SparkSession, archive: Archive, urls: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of the urls' records.

    A response's digest is taken from the payload that was read back; a revisit's length and digest
    are those of the response it refers to, which has to be among the urls' records.
    """
    def page(column):
        return F.expr(f"try_cast(regexp_extract({column}, '^<urn:page:(.*)>$', 1) AS long)")

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    read = cut_lineage(lookup(spark, archive, urls).select(
        page("id").alias("page_id"), "type", page("refers").alias("refers_to"), "digest",
        F.pmod(F.monotonically_increasing_id(), F.lit(parts)).alias("salt"),
        F.regexp_replace("claimed", "^sha1:", "").alias("claimed"), F.octet_length("payload").cast("long").alias("bytes")))
    # a page_id may have several payloads: a revisit's is the one whose digest it claims
    response = read.filter("type = 'response' AND page_id IS NOT NULL").select(
        F.col("page_id").alias("refers_to"), F.col("digest").alias("claimed"), F.col("bytes").alias("full"), "digest").distinct()
    # a response with very many revisits is told to each salt of them, never to all in one task
    revisits = read.filter("type <> 'response'").drop("digest")
    told = revisits.select("refers_to", "claimed", "salt").distinct().join(response, ["refers_to", "claimed"])
    both = revisits.join(told, ["refers_to", "claimed", "salt"], "left").select(
        "page_id", "type", "refers_to", F.coalesce("full", "bytes").alias("bytes"), F.col("digest").alias("found"))
    own = read.filter("type = 'response'").select("page_id", "type", "refers_to", "bytes", F.col("digest").alias("found"))
    return both.union(own).select(
        "page_id", F.col("bytes").alias("payload_bytes"), F.col("found").alias("payload_digest"),
        F.col("type").alias("record_type"), "refers_to")


@register("op4_warc")
def op4_warc(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return page_records(spark, write(pages, scratch_path(spark, "warc")), pages)
