"""WARC archives with a two-level capture index.

Writing: every page becomes a gzip member of an archive file in shared
storage; of pages with equal payloads the one with the largest id carries
the payload, the others refer to it.  Index: the entries of all captures are
sorted by reversed-host URL key into range partitions; each partition writes
its lines in blocks of ``BLOCK_LINES``, each block a gzip member, and one
directory row per block (its first key, file, offset and length).  Reading:
a lookup finds its block by binary search in the sparse directory, range-reads
and searches that block, and range-reads the record it names.

Files of failed or repeated task attempts have names of their own; the index
holds only what committed attempts reported, so lost executors leave nothing
but unused files behind.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import re
import uuid
import zlib
from functools import lru_cache
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, rows

BLOCK_LINES = 512
#: index lines of a range partition, about; the driver holds one key range
#: for each
PART_LINES = 20_000
#: archive bytes that a task reads, about
READ_BYTES = 64 << 20
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DEFAULT_PORT = {"http": 80, "https": 443}


def url_key(url: str | None) -> str:
    """Host labels reversed and joined by commas, a bracket, then path and
    query in lower case without fragment; a leading www label, the scheme and
    a default port are dropped.  Null or unparsable URLs keep their text
    behind a bracket, so they sort together and stay findable."""
    if url is None:
        return ")"
    text = url.strip()
    try:
        parts = urlsplit(text if "//" in text else f"//{text}")
        host, port = (parts.hostname or "").rstrip("."), parts.port
    except ValueError:
        return ")" + re.sub(r"\s", "%20", text)
    if host.startswith("www."):
        host = host[4:]
    key = ",".join(reversed(host.split(".")))
    if port and port != _DEFAULT_PORT.get(parts.scheme):
        key += f":{port}"
    query = f"?{parts.query}" if parts.query else ""
    return re.sub(r"\s", "%20", f"{key}){parts.path or '/'}{query}".lower())


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, payload_digest: str,
           refers_to: int | None = None) -> bytes:
    """One record; a revisit (without payload) names its original."""
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
            f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>",
            f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {' '.join(url.split())}")
    head.append(f"WARC-Payload-Digest: sha1:{payload_digest}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {_PROFILE}"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(headers by lower-case name, block) of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record starts here")
    headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    size = int(headers["content-length"])
    if len(rest) != size + 4 or not rest.endswith(b"\r\n\r\n"):
        raise ValueError("a record's length does not match its block")
    return headers, rest[:size]


def _named(urn: str) -> int | None:
    text = urn[len("<urn:page:"):-1]
    return None if text == "null" else int(text)


def store(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI and the path in it (local paths too)."""
    if re.match(r"[a-z0-9]+:", uri):
        return pafs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", re.sub(r"^file:/+", "file:///", uri)))
    return pafs.LocalFileSystem(), uri


def _range(files: dict, fs: pafs.FileSystem, path: str, offset: int, length: int) -> bytes:
    """A range read; the last opened file stays open."""
    if path not in files:
        for old in files.values():
            old.close()
        files.clear()
        files[path] = fs.open_input_file(path)
    return files[path].read_at(length, offset)


# -- writing ------------------------------------------------------------------

def write_archives(pages: DataFrame, root: str, min_payload: int = 0, id_col: str = "page_id",
                   url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write one record per row under ``root``; returns url_key, page_id,
    file, offset, length of every record (to be materialised once)."""
    source = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"),
                          F.coalesce(F.col(payload_col), F.lit("")).cast("binary").alias("payload"))
    mark = source.select("page_id", F.sha2("payload", 256).alias("same"), F.length("payload").alias("size"))
    # narrow rows only: who refers to whom, one row per revisiting page and payload
    groups = (mark.filter(F.col("size") >= min_payload).groupBy("same")
              .agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1"))
    revisits = (mark.join(groups, "same").filter("not (page_id <=> refers_to) and refers_to is not null")
                .select(F.col("page_id").alias("r_id"), F.col("same").alias("r_same"), "refers_to").distinct())
    joined = source.withColumn("same", F.sha2("payload", 256)).join(
        revisits, F.col("page_id").eqNullSafe(F.col("r_id")) & (F.col("same") == F.col("r_same")), "left")
    joined = joined.select("page_id", "url", "refers_to",
                           F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"),
                           F.unhex(F.sha1("payload")).alias("sha"))
    schema = pa.schema([("url_key", pa.string()), ("page_id", pa.int64()), ("file", pa.string()),
                        ("offset", pa.int64()), ("length", pa.int64())])

    def run(batches):
        fs, folder = store(root)
        fs.create_dir(folder, recursive=True)
        name = f"part-{uuid.uuid4().hex}.warc.gz"
        out, at = None, 0
        try:
            for batch in batches:
                made = {f.name: [] for f in schema}
                for page_id, url, refers_to, payload, sha in zip(*(batch.column(c).to_pylist() for c in (
                        "page_id", "url", "refers_to", "payload", "sha"))):
                    raw = gzip.compress(record(page_id, url, payload or b"",
                                               base64.b32encode(sha).decode(), refers_to), LEVEL, mtime=0)
                    if out is None:
                        out = fs.open_output_stream(f"{folder}/{name}", compression=None)
                    out.write(raw)
                    for c, v in (("url_key", url_key(url)), ("page_id", page_id), ("file", name),
                                 ("offset", at), ("length", len(raw))):
                        made[c].append(v)
                    at += len(raw)
                yield rows(made, schema)
        finally:
            if out is not None:
                out.close()

    return joined.mapInArrow(run, "url_key string, page_id long, file string, offset long, length long")


# -- the two-level index ------------------------------------------------------

def write_index(captures: DataFrame, root: str, lines: int) -> DataFrame:
    """Write the captures in blocks of sorted lines; returns the directory:
    first_key, first_id, last_key, last_id, file, offset, length per block.

    ``lines`` (the number of captures) sizes the range partitions.  Captures
    of one URL are in order of their page id (null first), so even a URL
    with very many captures is spread over blocks and partitions.
    """
    parts = max(1, round(lines / PART_LINES))
    ordered = (captures.repartitionByRange(parts, F.col("url_key"), F.col("page_id").asc_nulls_first(),
                                           F.col("file"), F.col("offset"))
               .sortWithinPartitions("url_key", F.col("page_id").asc_nulls_first(), "file", "offset"))
    schema = pa.schema([("first_key", pa.string()), ("first_id", pa.int64()), ("last_key", pa.string()),
                        ("last_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()),
                        ("length", pa.int64())])

    def run(batches):
        fs, folder = store(root)
        fs.create_dir(folder, recursive=True)
        name, at, out, held = f"index-{uuid.uuid4().hex}.gz", 0, None, []

        def block(part: list[tuple]) -> dict:
            nonlocal at, out
            raw = gzip.compress("".join(
                f"{k} {'' if i is None else i} {f} {o} {n}\n" for k, i, f, o, n in part).encode(), LEVEL, mtime=0)
            if out is None:
                out = fs.open_output_stream(f"{folder}/{name}", compression=None)
            out.write(raw)
            at += len(raw)
            return {"first_key": part[0][0], "first_id": part[0][1], "last_key": part[-1][0],
                    "last_id": part[-1][1], "file": name, "offset": at - len(raw), "length": len(raw)}

        try:
            for batch in batches:
                held += zip(*(batch.column(c).to_pylist() for c in ("url_key", "page_id", "file", "offset", "length")))
                made = []
                while len(held) >= BLOCK_LINES:
                    made.append(block(held[:BLOCK_LINES]))
                    held = held[BLOCK_LINES:]
                yield pa.RecordBatch.from_pylist(made, schema=schema)
            if held:
                yield pa.RecordBatch.from_pylist([block(held)], schema=schema)
        finally:
            if out is not None:
                out.close()

    return ordered.mapInArrow(run, "first_key string, first_id long, last_key string, last_id long, "
                                   "file string, offset long, length long")


def _place(key: str, page_id: int | None) -> tuple[str, int, int]:
    """Sort key of a capture: null ids before all others."""
    return key, page_id is not None, page_id or 0


def _block_lines(raw: bytes) -> list[tuple]:
    out = []
    for line in gzip.decompress(raw).decode().split("\n")[:-1]:
        key, page_id, file, offset, length = line.rsplit(" ", 4)
        out.append((_place(key, int(page_id) if page_id else None), file, int(offset), int(length)))
    return out


class Directory:
    """The sparse level of the index, in key order; one entry per block."""

    def __init__(self, blocks: list[tuple]):
        self.blocks = sorted(blocks, key=lambda b: (_place(b[0], b[1]), _place(b[2], b[3])))
        self.first = [_place(b[0], b[1]) for b in self.blocks]
        self.last = [_place(b[2], b[3]) for b in self.blocks]

    def find(self, low: tuple, high: tuple) -> range:
        """Numbers of the blocks that can hold places from low to high."""
        return range(bisect.bisect_left(self.last, low), bisect.bisect_right(self.first, high))


class CaptureIndex:
    """Lookups in the two-level index of an archive folder."""

    def __init__(self, root: str, directory: Directory):
        self.fs, self.folder = store(root)
        self.directory, self.files = directory, {}
        self.block = lru_cache(maxsize=4)(self._block)

    def _block(self, number: int) -> list[tuple]:
        _, _, _, _, file, offset, length = self.directory.blocks[number]
        return _block_lines(_range(self.files, self.fs, f"{self.folder}/{file}", offset, length))

    def captures(self, key: str, page_id: int | None) -> list[tuple[str, int, int]]:
        """(file, offset, length) of the records of a URL key and page id."""
        place, out = _place(key, page_id), []
        for number in self.directory.find(place, place):
            lines = self.block(number)
            at = bisect.bisect_left(lines, place, key=lambda x: x[0])
            while at < len(lines) and lines[at][0] == place:
                out.append(lines[at][1:])
                at += 1
        return out

    def url(self, url: str) -> list[tuple[str, int, int]]:
        """(file, offset, length) of all captures of a URL."""
        key, out = url_key(url), []
        for number in self.directory.find((key, False, 0), (key, True, 1 << 63)):
            out += [x[1:] for x in self.block(number) if x[0][0] == key]
        return out


def read_record(fs: pafs.FileSystem, files: dict, path: str, offset: int, length: int):
    raw = _range(files, fs, path, offset, length)
    return parse(zlib.decompress(raw, wbits=31))


# -- reading ------------------------------------------------------------------

def look_up(wanted: DataFrame, directory: DataFrame, root: str) -> DataFrame:
    """Places (file, offset, length) of distinct (url_key, page_id) rows.

    A row is routed to the index files whose key range holds it (a binary
    search over one range per ``PART_LINES`` captures) and meets only the
    directory rows of that file in its task.
    """
    spans = (directory.groupBy("file")
             .agg(F.min(_struct("first_key", "first_id")).alias("low"),
                  F.max(_struct("last_key", "last_id")).alias("high")).collect())
    bounds = sorted((tuple(r["low"]), tuple(r["high"]), r["file"]) for r in spans)
    lows, highs, names = ([b[k] for b in bounds] for k in range(3))

    def route(batches):
        for batch in batches:
            keys, ids = batch.column("url_key").to_pylist(), batch.column("page_id").to_pylist()
            out = {"url_key": [], "page_id": [], "part": []}
            for key, page_id in zip(keys, ids):
                place = _place(key, page_id)
                for n in range(bisect.bisect_left(highs, place), bisect.bisect_right(lows, place)):
                    out["url_key"].append(key)
                    out["page_id"].append(page_id)
                    out["part"].append(names[n])
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema(
                [("url_key", pa.string()), ("page_id", pa.int64()), ("part", pa.string())]))

    routed = wanted.select("url_key", "page_id").mapInArrow(route, "url_key string, page_id long, part string")
    schema = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])

    def find(asked: pa.Table, blocks: pa.Table) -> pa.Table:
        if not asked.num_rows or not blocks.num_rows:
            return schema.empty_table()
        names = ["first_key", "first_id", "last_key", "last_id", "file", "offset", "length"]
        index = CaptureIndex(root, Directory(list(zip(*(blocks[c].to_pylist() for c in names)))))
        places = sorted(zip(asked["url_key"].to_pylist(), asked["page_id"].to_pylist()), key=lambda x: _place(*x))
        found = [c for key, page_id in places for c in index.captures(key, page_id)]
        return pa.table([list(c) for c in zip(*found)] if found else [[], [], []], schema=schema)

    return routed.groupBy("part").cogroup(directory.withColumn("part", F.col("file")).groupBy("part")) \
        .applyInArrow(find, "file string, offset long, length long").distinct()


def _struct(key: str, page_id: str):
    return F.struct(F.col(key).alias("k"), F.col(page_id).isNotNull().alias("f"),
                    F.coalesce(F.col(page_id), F.lit(0)).alias("i"))


def read_archives(places: DataFrame, root: str) -> DataFrame:
    """page_id, record_type, refers_to, payload_bytes, payload_digest of the
    records at the given places (a written table); size and digest come from
    the block of a response, for a revisit the digest is what its header
    states and the size is null.  Places are dealt by file and offset, so a
    task reads forward through a few files."""
    total = places.agg(F.sum("length")).first()[0] or 0
    # rows are narrow and work is not: the number of tasks follows the bytes
    # to read, but uses the session's parallelism for small archives
    usual = int(places.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, -(-total // READ_BYTES), min(usual, -(-total // (1 << 20))))
    schema = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()),
                        ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])
    ordered = places.repartitionByRange(parts, "file", "offset").sortWithinPartitions("file", "offset")

    def run(batches):
        fs, folder = store(root)
        files: dict = {}
        for batch in batches:
            out = {f.name: [] for f in schema}
            for file, offset, length in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length"))):
                headers, block = read_record(fs, files, f"{folder}/{file}", offset, length)
                stated = headers["warc-payload-digest"].removeprefix("sha1:")
                kind = headers["warc-type"]
                if kind == "response" and digest(block) != stated:
                    raise ValueError(f"a payload of {file} does not match its digest")
                for name, v in (("page_id", _named(headers["warc-record-id"])), ("record_type", kind),
                                ("refers_to", _named(headers["warc-refers-to"]) if kind == "revisit" else None),
                                ("payload_bytes", len(block) if kind == "response" else None),
                                ("payload_digest", stated)):
                    out[name].append(v)
            yield rows(out, schema)

    return ordered.mapInArrow(run, "page_id long, record_type string, refers_to long, payload_bytes long, "
                                   "payload_digest string")


def round_trip(pages: DataFrame, min_payload: int = 0, root: str | None = None, **columns) -> DataFrame:
    """Write ``pages`` as archives with an index under ``root`` (default: a
    folder in the shared scratch space), look every capture up and read it
    back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Null html is an empty payload.  Among equal payloads all rows with the
    largest page id are responses (a repeated row cannot revisit itself);
    rows with a null id revisit that page too, and are all responses if no
    copy has an id.  Null URLs are archived without a target.  An empty table
    gives no rows; other columns are ignored.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    root = root or scratch.path("archive")
    captures = scratch.table(write_archives(pages, root, min_payload, **columns), "captures")
    lines = captures.count()
    directory = scratch.table(write_index(captures, root, lines), "directory")
    wanted = captures.select("url_key", "page_id").distinct()
    places = scratch.table(look_up(wanted, directory, root), "places")
    back = scratch.table(read_archives(places, root), "records")
    # the size of a revisit's payload is that of the response it names; that
    # side has one row per page, so a page with very many revisits is an
    # ordinary skewed key of the other side
    shape = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    responses = back.filter("record_type = 'response'").select(*shape)
    sizes = (responses.groupBy(F.col("page_id").alias("refers_to"), "payload_digest")
             .agg(F.max("payload_bytes").alias("payload_bytes")))
    revisits = (back.filter("record_type = 'revisit'").drop("payload_bytes")
                .join(sizes, ["refers_to", "payload_digest"], "left").select(*shape))
    out = responses.union(revisits)
    return scratch.result(out)
