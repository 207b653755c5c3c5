"""WARC archives of pages, and their index as globally ordered capture histories.

Each task writes its captures, sorted by URL key and time, to archives of its own: a sorted run. Reading them back gives index
rows. For the index, every range of keys takes its part of every run and merges the parts with a loser tree.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from roadpoints.llm.registry import query, table
from roadpoints.session import cut, cut_counting, shared_dir

#: payloads from this size on are stored once; an archive is closed when it has reached this many bytes
REVISIT_BYTES, ARCHIVE_BYTES = 1000, 64 << 20
#: index rows that a task of the merge holds, on average
RANGE_ROWS = 500_000
#: shares into which captures of one payload are dealt when they look up their response
SHARES = 16
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def url_key(url: Column) -> Column:
    """Sort-friendly key: the host's labels from the last to the first, then path and query, all in lower case; of a null url empty."""
    low = F.lower(F.coalesce(url, F.lit("")))
    host = F.regexp_extract(low, r"(?s)^[^:/?#]*://(?:www\.)?([^/?#:]*)", 1)
    rest = F.regexp_extract(low, r"(?s)^[^:/?#]*://[^/?#]*([^#]*)", 1)
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest)


def revisits(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """(page_id, digest, refers_to): captures whose payload of at least ``least`` bytes is that of a capture with a larger page_id, the largest; any is larger than none."""
    light = pages.select("page_id", F.sha1("html").alias("digest"), F.octet_length("html").alias("n"), F.pmod(F.xxhash64("page_id", "url"), F.lit(SHARES)).alias("share"))
    light = light.where(F.col("n") >= least).drop("n")
    many = light.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("k")).where("k > 1").drop("k")
    many = many.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1)).cast("array<long>")))
    return light.join(many, ["digest", "share"]).where("refers_to > page_id or page_id is null and refers_to is not null").select("page_id", "digest", "refers_to").distinct()


def _uri(page: int | None) -> str:
    return f"<urn:uuid:{uuid.UUID(int=1 << 64 if page is None else page & (1 << 64) - 1)}>"


def _page(uri: str) -> int | None:
    n = uuid.UUID(uri[10:-1]).int
    if n >> 64:
        return None
    return n - (1 << 64) if n >> 63 else n


def record(page: int | None, url: str | None, time: str, payload: bytes, refers_to: int | None) -> bytes:
    """One record as a gzip member; the extra header tells the length of a payload that is not stored."""
    digest = hashlib.sha1(payload).digest()
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_uri(page)}",
            f"WARC-Date: {time}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c.isprintable() and c != "\\" else f"\\u{ord(c):06x}" for c in url))
    if refers_to is not None:
        head += [f"WARC-Refers-To: {_uri(refers_to)}", f"WARC-Profile: {_PROFILE}", f"X-Payload-Length: {len(payload)}"]
    block = _HTTP + payload if refers_to is None else _HTTP
    head.append(f"Content-Length: {len(block)}")
    out = zlib.compressobj(1, zlib.DEFLATED, 31)
    return out.compress("\r\n".join(head).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n") + out.flush()


def read(stream) -> Iterator[tuple[int, int, dict, bytes]]:
    """(offset, length, headers, payload) of the records of an archive, one in memory at a time."""
    offset, rest = 0, b""
    while True:
        member, out, size = zlib.decompressobj(31), [], 0
        while not member.eof:
            chunk = rest or stream.read(1 << 16)
            if not chunk:
                if size:
                    raise ValueError("archive ends within a record")
                return
            out.append(member.decompress(chunk))
            rest = member.unused_data
            size += len(chunk) - len(rest)
        head, _, block = b"".join(out).partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode("utf-8").split("\r\n")[1:])
        yield offset, size, fields, block[:int(fields["Content-Length"])].partition(b"\r\n\r\n")[2]
        offset += size


def _writer(folder: str, limit: int):
    def run(batches):
        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        number = TaskContext.get().partitionId()
        out, name, done = None, "", []
        for batch in batches:
            for page, url, time, html, refers in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    # a name of this attempt: archives of lost attempts are in no manifest
                    name = f"run-{number:06d}-{uuid.uuid4().hex}.warc.gz"
                    out = store.open_output_stream(f"{path}/{name}", compression=None)
                out.write(record(page, url, time, html.encode("utf-8"), refers))
                if out.tell() >= limit:
                    out.close()
                    done.append(name)
                    out = None
        if out is not None:
            out.close()
            done.append(name)
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], names=["archive"])
    return run


_INDEX = "archive string, seq long, url string, captured string, page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long, offset long, length long"


def _reader(folder: str):
    names = [c.split()[0] for c in _INDEX.split(", ")]
    kinds = [pa.string() if c.endswith("string") else pa.int64() for c in _INDEX.split(", ")]

    def entry(archive, seq, offset, length, head, payload):
        revisit = head["WARC-Type"] == "revisit"
        digest = base64.b32decode(head["WARC-Payload-Digest"][5:]).hex()
        if not revisit and hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError(f"{archive} at {offset}: payload does not match its digest")
        return (archive, seq, head.get("WARC-Target-URI"), head["WARC-Date"], _page(head["WARC-Record-ID"]), head["WARC-Type"],
                int(head["X-Payload-Length"]) if revisit else len(payload), digest, _page(head["WARC-Refers-To"]) if revisit else None, offset, length)

    def run(batches):
        store, path = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                rows = []
                with store.open_input_stream(f"{path}/{archive}", compression=None) as stream:
                    for seq, (offset, length, head, payload) in enumerate(read(stream)):
                        rows.append(entry(archive, seq, offset, length, head, payload))
                        if len(rows) == 5000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
    return run


def write_archives(pages: DataFrame, folder: str, limit: int = ARCHIVE_BYTES) -> tuple[DataFrame, int]:
    """Archives of ``pages`` (page_id, url, captured, html) in ``folder``, a URI that all executors reach: (archive) rows and their number."""
    known = revisits(pages.select("page_id", "url", "html")).withColumnRenamed("page_id", "page")
    rows = pages.withColumn("digest", F.sha1("html")).alias("p").join(known.alias("k"), F.expr("p.page_id <=> k.page and p.digest = k.digest"), "left").select("p.*", "refers_to")
    runs = rows.select("page_id", "url", "captured", "html", "refers_to", url_key(F.col("url")).alias("k")).sortWithinPartitions("k", "captured", "page_id").drop("k")
    return cut_counting(runs.mapInArrow(_writer(folder, limit), "archive string"))


def read_archives(manifest: DataFrame, n: int, folder: str) -> DataFrame:
    """Index rows of the ``n`` archives of ``manifest``, each read by one task."""
    rows = manifest.repartition(max(1, n), "archive").mapInArrow(_reader(folder), _INDEX)
    return rows.withColumn("urlkey", url_key(F.col("url")))


class LoserTree:
    """Merges sorted runs: every inner place keeps the loser of its match, so the next winner costs one path to the top."""

    def __init__(self, runs: list[list], key):
        self.runs, self.key = runs, key
        self.k = len(runs)
        self.at = [0] * self.k
        self.heads = [key(r[0]) if r else None for r in runs]
        self.tree = [-1] * max(1, self.k)
        for i in range(self.k):
            self._play(i)

    def _less(self, a: int, b: int) -> bool:
        """Whether run ``a`` goes before run ``b``; a run that is used up loses, equal keys go by run."""
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return x is not None
        return (x, a) < (y, b)

    def _play(self, i: int) -> None:
        place = (i + self.k) // 2
        while place > 0:
            other = self.tree[place]
            if other < 0:  # the first to come waits for its match
                self.tree[place] = i
                return
            if self._less(other, i):
                self.tree[place], i = i, other
            place //= 2
        self.tree[0] = i

    def __iter__(self):
        while self.k and self.heads[i := self.tree[0]] is not None:
            run = self.runs[i]
            yield run[self.at[i]]
            self.at[i] += 1
            self.heads[i] = self.key(run[self.at[i]]) if self.at[i] < len(run) else None
            self._play(i)


def _merged(columns: list[str]):
    at = [columns.index(c) for c in ("urlkey", "captured", "page_id", "archive", "seq")]

    def run(batches):
        held = list(batches)
        if not held:
            return
        whole = pa.Table.from_batches(held)
        key, time, page, archive, seq = (whole.column(k).to_pylist() for k in at)
        runs: dict[str, list[int]] = {}
        for i, a in enumerate(archive):
            runs.setdefault(a, []).append(i)
        parts = [sorted(runs[a], key=seq.__getitem__) for a in sorted(runs)]  # the order in the archive, whatever order the shuffle gave
        order = list(LoserTree(parts, lambda i: (key[i].encode("utf-8"), time[i], page[i] is not None, page[i] or 0)))
        for batch in whole.take(pa.array(order, pa.int64())).combine_chunks().to_batches():
            yield batch
    return run


def merged_index(index: DataFrame) -> DataFrame:
    """``index`` in order of URL key, time and page_id over all partitions. A task holds the index rows of one range of keys, about
    RANGE_ROWS of them whatever the table's size, as a URL of many captures is divided by their times."""
    n = max(int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-index.count() // RANGE_ROWS))
    ranges = index.repartitionByRange(n, "urlkey", "captured", "page_id")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in index.schema)
    return ranges.mapInArrow(_merged(index.columns), fields)


def archive(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """The index of archives written for ``pages`` (page_id, url, html; other columns are ignored) and read back, one row per row.

    Of captures with equal payloads of at least 1000 bytes the one with the largest page_id is stored as response, the others as revisits
    of it; smaller payloads are stored each time. Captures without a page_id have a record too and are never referred to. A null html is an empty payload, a null url has no target and the key ")". Rows of
    equal page_id and payload are stored each. Time of capture is the column captured (ISO), if there is one, else page_id seconds after 2020.
    ``folder`` is a URI that all executors can write to, by default a new one in the shared folder.
    """
    spark = pages.sparkSession
    time = F.col("captured") if "captured" in pages.columns else F.date_format(F.timestamp_seconds(F.lit(1577836800) + F.col("page_id")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(time, F.lit("1970-01-01T00:00:00Z")).alias("captured"),
                                                     F.coalesce("html", F.lit("")).alias("html"))
    folder = folder or f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    manifest, n = write_archives(rows, folder)
    return merged_index(cut(read_archives(manifest, n, folder)))


@query("op7_warc")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page of the table, in the order of the index."""
    return archive(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "urlkey", "captured")
