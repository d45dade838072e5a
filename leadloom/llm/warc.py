"""WARC archives with a two-level capture index (operator 4).

Writing: one WARC record per page, each a gzip member of its own, in files of
the shared folder. Of records with equal payloads the one with the smallest
page id is a ``response``; the others are ``revisit`` records that name it.

Index: one line per record under its reversed-host URL key, sorted, cut into
compressed blocks of ``BLOCK_LINES`` lines. Every index file has a sparse
directory (first key, offset and length of each block), and the list of index
files with their first keys is the directory's upper level. A lookup searches
the list, then the file's directory, then reads one block by its byte range,
and records are read by theirs.

Scale: pages are shuffled once, by payload digest, to learn of earlier copies;
the heads of repeated payloads are written first, so a skewed digest is a join
that Spark splits. The driver holds one row per index file. Lookups go to tasks by
ranges of (index file, key), so one file is no single task; a key with very many
captures spans blocks and files, which a lookup walks and gives out block by block. Files have a new name per task attempt, so a lost task leaves at most an
unreferenced file. The folder must be in a store that pyarrow opens (shared
file system, HDFS, S3, GCS).

Edge cases: a null html is an empty payload; a null url has the key ``''``; a
null page id sorts after all others; rows that repeat page id, url and payload
of a response are responses too; an empty table writes nothing; columns beside
``page_id``, ``url`` and ``html`` are ignored.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import re
import uuid
import zlib
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, shared_dir, stage

BLOCK_LINES = 1000
MAX_FILE_BYTES = 1 << 30
LEVEL = 3
DATE = "2000-01-01T00:00:00Z"
END = b"\r\n\r\n"


def open_store(uri: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(uri)


def clean_url(url: str | None) -> str:
    """The url with everything outside printable ASCII percent-encoded."""
    return quote(url or "", safe="".join(map(chr, range(33, 127))))


def surt(url: str | None) -> str:
    """Reversed-host key: ``http://a.b.com:80/x?y`` -> ``com,b,a)/x?y``."""
    u = clean_url(url)
    if not u:
        return ""
    try:
        p = urlsplit(u if re.match(r"[A-Za-z][A-Za-z0-9+.-]*://", u) else f"//{u}")
        host, port = p.hostname or "", p.port
    except ValueError:
        return u.lower()
    key = ",".join(reversed(host.split(".")))
    if port is not None and port not in (80, 443):
        key += f":{port}"
    return f"{key}){p.path or '/'}" + (f"?{p.query}" if p.query else "")


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _urn(page_id) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page(urn: str) -> int | None:
    x = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(x) if x else None


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One gzip member. ``refers_to``: the response's record id for a revisit.
    A revisit keeps the HTTP header, whose Content-Length is the full size."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {len(payload)}\r\n\r\n").encode()
    block = http if refers_to else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: {_urn(page_id)}",
            f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {clean_url(url)}")
    if refers_to:
        head += [f"WARC-Refers-To: {refers_to}",
                 "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return _member("\r\n".join(head).encode() + END + block + END)


def parse(member: bytes) -> dict:
    """The fields of one record; for a response, digest and size are those of
    the payload itself, checked against the header."""
    data = zlib.decompress(member, 31)
    cut = data.index(END)
    first, *lines = data[:cut].decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    head = dict(x.split(": ", 1) for x in lines)
    block = data[cut + 4:cut + 4 + int(head["Content-Length"])]
    http_end = block.index(END) + 4
    size = int(re.search(rb"\r\nContent-Length: (\d+)", block[:http_end])[1])
    digest, kind = head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"]
    payload = None
    if kind == "response":
        payload = block[http_end:]
        if len(payload) != size or digest_of(payload) != digest:
            raise ValueError(f"damaged record {head['WARC-Record-ID']}")
    return {"page_id": _page(head["WARC-Record-ID"]), "url": head.get("WARC-Target-URI"), "payload": payload,
            "payload_bytes": size, "payload_digest": digest, "record_type": kind,
            "refers_to": _page(head["WARC-Refers-To"]) if kind == "revisit" else None}


# --------------------------------------------------------------------- writing


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Write every page; returns the staged capture rows (key, page_id, file,
    offset, length). Payloads below ``min_bytes`` are always responses."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "url",
                     F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    p = p.withColumn("digest", F.sha1("payload"))
    me = F.struct(F.col("page_id").isNull().alias("n"), F.col("page_id").alias("id"),
                  F.coalesce("url", F.lit("")).alias("u"))
    heads = (p.where(F.octet_length("payload") >= min_bytes).groupBy("digest")
             .agg(F.min(me).alias("head"), F.count(F.lit(1)).alias("c")).where("c > 1").select("digest", "head"))
    # written: a join with the aggregate itself could not be split at a hot digest
    heads = stage(heads, "heads")
    rows = p.join(heads, "digest", "left").select(
        "page_id", "url", "payload",
        F.when(F.col("head").isNotNull() & ~me.eqNullSafe(F.col("head")),
               F.coalesce(F.col("head.id").cast("string"), F.lit(""))).alias("refers"))

    def run(batches):
        fs, root = open_store(folder)
        out, name, at = None, "", 0
        try:
            for b in batches:
                rows = []
                for page_id, url, payload, refers in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "payload", "refers"))):
                    if out is None or at >= MAX_FILE_BYTES:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = fs.open_output_stream(f"{root}/{name}", compression=None)
                    data = record(page_id, url, payload, digest_of(payload), f"<urn:page:{refers}>" if refers is not None else None)
                    out.write(data)
                    rows.append((surt(url), page_id, name, at, len(data)))
                    at += len(data)
                if rows:
                    yield pa.RecordBatch.from_pydict({k: pa.array(v, t) for k, t, v in zip(
                        ("key", "page_id", "file", "offset", "length"),
                        (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()), zip(*rows))})
        finally:
            if out is not None:
                out.close()

    make_folder(folder)
    return stage(map_arrow(rows, run, "key string, page_id long, file string, offset long, length long"), "captures")


def make_folder(folder: str) -> None:
    fs, root = open_store(folder)
    fs.create_dir(root, recursive=True)


class CaptureIndex:
    """The two-level index of one folder of archives."""

    def __init__(self, folder: str, files: list[tuple[str, str]]):
        self.folder = folder
        self.files = files               # (first key, index file), ascending

    @classmethod
    def build(cls, captures: DataFrame, folder: str, block_lines: int = BLOCK_LINES) -> CaptureIndex:
        """Sort the captures by key and write blocks and directories."""
        spread = captures.repartitionByRange("key", "page_id", "file", "offset")
        ordered = spread.sortWithinPartitions("key", "page_id", "file", "offset")

        def run(batches):
            fs, root = open_store(folder)
            name, out, at, first, lines, blocks = f"{uuid.uuid4().hex}.idx", None, 0, None, [], []

            def close_block():
                nonlocal at, lines
                if lines:
                    data = _member("".join(x[1] for x in lines).encode())
                    out.write(data)
                    blocks.append(f"{lines[0][0]}\t{at}\t{len(data)}\n")
                    at, lines = at + len(data), []

            for b in batches:
                for key, page_id, file, offset, length in zip(*(b.column(c).to_pylist() for c in ("key", "page_id", "file", "offset", "length"))):
                    if out is None:
                        out, first = fs.open_output_stream(f"{root}/{name}", compression=None), key
                    lines.append((key, f"{key}\t{'' if page_id is None else page_id}\t{file}\t{offset}\t{length}\n"))
                    if len(lines) >= block_lines:
                        close_block()
            if out is None:
                return
            close_block()
            out.close()
            with fs.open_output_stream(f"{root}/{name}.dir", compression=None) as d:
                d.write("".join(blocks).encode())
            yield pa.RecordBatch.from_pydict({"first": [first], "file": [name]})

        found = stage(map_arrow(ordered, run, "first string, file string"), "index")
        # one row per index file
        return cls(folder, sorted((r["first"], r["file"]) for r in found.collect()))

    def lookup(self, urls: DataFrame, column: str = "url") -> DataFrame:
        """All captures of the given urls' keys: (key, page_id, file, offset,
        length); every distinct key is looked up once."""
        firsts, files, folder = [f for f, _ in self.files], [f for _, f in self.files], self.folder

        def keys(batches):
            for b in batches:
                yield pa.RecordBatch.from_pydict({"key": pa.array([surt(u) for u in b.column(0).to_pylist()], pa.string())})

        def route(batches):
            for b in batches:
                k, f = [], []
                for key in b.column(0).to_pylist():
                    lo = max(0, bisect.bisect_left(firsts, key) - 1)
                    for i in range(lo, bisect.bisect_right(firsts, key)):
                        k.append(key)
                        f.append(files[i])
                yield pa.RecordBatch.from_pydict({"key": pa.array(k, pa.string()), "index": pa.array(f, pa.string())})

        def captures_of(found):
            cols = list(zip(*found)) if found else [()] * 5
            return pa.RecordBatch.from_pydict({
                "key": pa.array(cols[0], pa.string()), "page_id": pa.array([int(x) if x else None for x in cols[1]], pa.int64()),
                "file": pa.array(cols[2], pa.string()), "offset": pa.array(list(map(int, cols[3])), pa.int64()),
                "length": pa.array(list(map(int, cols[4])), pa.int64())})

        def find(batches):
            fs, root = open_store(folder)
            now, block, source, directory, lines = None, None, None, [], []
            out = []
            for b in batches:
                for key, index in zip(b.column("key").to_pylist(), b.column("index").to_pylist()):
                    if index != now:
                        if source is not None:
                            source.close()
                        now, block, source = index, None, fs.open_input_file(f"{root}/{index}")
                        with fs.open_input_stream(f"{root}/{index}.dir", compression=None) as d:
                            directory = [x.rsplit("\t", 2) for x in d.read().decode().splitlines()]
                        starts = [x[0] for x in directory]
                    lo = max(0, bisect.bisect_left(starts, key) - 1)
                    for i in range(lo, bisect.bisect_right(starts, key)):
                        if block != i:
                            raw = source.read_at(int(directory[i][2]), int(directory[i][1]))
                            lines = [x.split("\t") for x in zlib.decompress(raw, 31).decode().splitlines()]
                            own, block = [x[0] for x in lines], i
                        out += lines[bisect.bisect_left(own, key):bisect.bisect_right(own, key)]
                        if len(out) >= BLOCK_LINES:
                            yield captures_of(out)
                            out = []
            if source is not None:
                source.close()
            yield captures_of(out)

        wanted = map_arrow(urls.select(F.col(column).alias("url")).distinct(), keys, "key string").distinct()
        routed = map_arrow(wanted, route, "key string, index string")
        sorted_keys = routed.repartitionByRange("index", "key").sortWithinPartitions("index", "key")
        return map_arrow(sorted_keys, find, "key string, page_id long, file string, offset long, length long")

    def read(self, captures: DataFrame, with_payload: bool = False) -> DataFrame:
        """The records of the given captures by range reads: page_id, url,
        payload_bytes, payload_digest, record_type, refers_to (and payload)."""
        folder = self.folder
        types = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(),
                 "record_type": pa.string(), "refers_to": pa.int64()} | ({"payload": pa.binary()} if with_payload else {})
        schema = ("page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
                  + (", payload binary" if with_payload else ""))

        def run(batches):
            fs, root = open_store(folder)
            now, source = None, None
            for b in batches:
                out = []
                for file, offset, length in zip(*(b.column(c).to_pylist() for c in ("file", "offset", "length"))):
                    if file != now:
                        if source is not None:
                            source.close()
                        now, source = file, fs.open_input_file(f"{root}/{file}")
                    out.append(parse(source.read_at(length, offset)))
                yield pa.RecordBatch.from_pydict({k: pa.array([x[k] for x in out], t) for k, t in types.items()})
            if source is not None:
                source.close()

        places = captures.select("file", "offset", "length")
        return map_arrow(places.repartitionByRange("file", "offset").sortWithinPartitions("file", "offset"), run, schema)


def archive(pages: DataFrame, folder: str | None = None) -> CaptureIndex:
    """Write pages and their index below ``folder`` (default: a new one in the
    shared folder)."""
    folder = folder or shared_dir(pages.sparkSession, "warc")
    return CaptureIndex.build(write_archives(pages, folder), folder)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages, then read every capture back through the index."""
    index = archive(pages)
    return index.read(index.lookup(pages)).drop("url")
