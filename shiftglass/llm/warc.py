"""WARC archives and a globally ordered capture index by external merging.

Captures of equal payload share one ``response`` record, the others are ``revisit``
records that point to it and hold no payload. Every task writes its captures into archives
whose records are in index order, so that each archive is a sorted run. Reading an archive
back yields its records; the runs' entries are dealt by key range and each range merges its
runs with a loser tree, which gives the capture history of all archives in order of URL key
and time.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import urllib.parse
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .common import Scratch, hot_join, slices, widened

MIN_REVISIT = 1000
ARCHIVE_BYTES = 8 << 20
EPOCH = 1_700_000_000
CLOCK = 1 << 32
RANGE_ROWS = 200_000
WINDOW = 1 << 16


def captured_at(page_id: int | None) -> int:
    """Pages carry no time: their id, modulo ``CLOCK``, counts as seconds from ``EPOCH`` on (a null id as 0)."""
    return EPOCH + (page_id or 0) % CLOCK


def url_key(url: str | None) -> str:
    """Sort key of a URL: host labels reversed, then path and query; no scheme, port or fragment."""
    if url is None:
        return ""
    rest = re.sub(r"^[a-zA-Z][a-zA-Z0-9+.-]*://", "", url).split("#")[0]
    host, slash, path = rest.partition("/")
    host = host.rpartition("@")[2].partition(":")[0].lower()
    return ",".join(reversed(host.split("."))) + ")" + (slash + path or "/")


def stamp(seconds: int) -> str:
    import datetime as dt

    return dt.datetime.fromtimestamp(seconds, dt.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def uri(page_id: int) -> str:
    return f"<urn:page:{page_id}>"


# --------------------------------------------------------------------------- one record
def record(kind: str, page_id, url, at: int, payload: bytes | None, size: int, digest: str, refers_to) -> bytes:
    """One gzip member. A revisit holds no payload; its size is in a header."""
    body = b""
    if kind == "response":
        body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Date: {stamp(at)}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {size}"]
    if page_id is not None:
        head.append(f"WARC-Record-ID: {uri(page_id)}")
    if url is not None:
        head.append(f"WARC-Target-URI: {urllib.parse.quote(url, safe='/:?#[]@!$&()*+,;=~')}")
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {uri(refers_to)}"]
    head.append(f"Content-Length: {len(body)}")
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + z.flush()


def records(archive: bytes):
    """(offset, headers, block) of each record of an archive; its bytes are fed to the decoder window by window."""
    at, view = 0, memoryview(archive)
    while at < len(view):
        z, parts, pos = zlib.decompressobj(31), [], at
        while not z.eof:
            if pos >= len(view):
                raise ValueError(f"the record at {at} is cut off")
            parts.append(z.decompress(view[pos : pos + WINDOW]))
            pos = min(pos + WINDOW, len(view))
        head, _, rest = b"".join(parts).partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError(f"no WARC record at {at}")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        yield at, fields, rest[: int(fields["Content-Length"])]
        at = pos - len(z.unused_data)


def place(key: str, at: int, page_id: int | None, digest: str) -> tuple:
    """A capture's place in the index: by URL key, time, page_id (null first) and digest."""
    return key, at, page_id is not None, page_id or 0, digest


# --------------------------------------------------------------------------- writing
def captures(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """page_id, url, payload (null for revisits), payload_bytes, digest, record_type and refers_to of every row.

    Null html counts as empty. Among equal payloads of ``min_revisit`` bytes or more the
    largest page_id responds (all rows that carry it); a null page_id never does unless the
    whole group is null. A payload of very many pages is told by a broadcast of its digest.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("digest", F.sha1("payload"))
    long_ones = rows.where(F.col("payload_bytes") >= min_revisit).groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("copies"))
    keepers = Scratch(pages.sparkSession, "keepers").keep(long_ones.where("copies > 1"))
    found = hot_join(rows, keepers, ["digest"], "copies", pages.count(), ["page_id", "url"])
    revisit = F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    return found.select(
        "page_id", "url", F.when(~revisit, F.col("payload")).alias("payload"), "payload_bytes", "digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("keeper")).alias("refers_to"),
    )


def write(found: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Archives (archive, content) of about ``archive_bytes`` of payload."""

    def run(batches):
        task, number, held, size = TaskContext.get().partitionId(), 0, [], 0

        def archive():
            held.sort(key=lambda x: x[0])
            info = zlib.compressobj(1, zlib.DEFLATED, 31)
            text = b"software: shiftglass\r\nformat: WARC File Format 1.1\r\n"
            head = b"WARC/1.1\r\nWARC-Type: warcinfo\r\nContent-Type: application/warc-fields\r\nContent-Length: %d\r\n\r\n" % len(text)
            first = info.compress(head + text + b"\r\n\r\n") + info.flush()
            return pa.RecordBatch.from_pydict({"archive": [f"captures-{task:06d}-{number:05d}.warc.gz"], "content": pa.array([first + b"".join(x for _, x in held)], pa.binary())})

        for b in slices(batches, "payload", archive_bytes):
            for r in b.to_pylist():
                at = captured_at(r["page_id"])
                made = record(r["record_type"], r["page_id"], r["url"], at, r["payload"], r["payload_bytes"], r["digest"], r["refers_to"])
                held.append((place(url_key(r["url"]), at, r["page_id"], r["digest"]), made))
                size += len(made) + len(r["payload"] or b"")
                if size >= archive_bytes:
                    yield archive()
                    number, held, size = number + 1, [], 0
        if held:
            yield archive()

    return found.mapInArrow(run, "archive string, content binary")


# --------------------------------------------------------------------------- reading and indexing
ENTRY = "url_key string, captured_at long, page_id long, record_type string, payload_digest string, payload_bytes long, refers_to long, archive string, offset long, number long"


def read(archives: DataFrame) -> DataFrame:
    """One index entry per record; a response's digest and size come from the stored payload."""

    def run(batches):
        import calendar
        import time

        for b in batches:
            for name, content in zip(b.column("archive").to_pylist(), b.column("content")):
                out, n = [], 0
                for offset, f, block in records(content.as_py()):
                    kind = f["WARC-Type"]
                    if kind not in ("response", "revisit"):
                        continue
                    digest, size = f["WARC-Payload-Digest"].removeprefix("sha1:"), int(f["X-Payload-Length"])
                    if kind == "response":
                        payload = block.partition(b"\r\n\r\n")[2]
                        if hashlib.sha1(payload).hexdigest() != digest:
                            raise ValueError(f"{name}: the record at {offset} does not match its digest")
                        size = len(payload)
                    number = lambda key: int(f[key][len("<urn:page:") : -1]) if key in f else None
                    url = urllib.parse.unquote(f["WARC-Target-URI"]) if "WARC-Target-URI" in f else None
                    at = calendar.timegm(time.strptime(f["WARC-Date"], "%Y-%m-%dT%H:%M:%SZ"))
                    out.append((url_key(url), at, number("WARC-Record-ID"), kind, digest, size, number("WARC-Refers-To"), name, offset, n))
                    n += 1
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), TYPES)] if out else [pa.array([], t) for t in TYPES], names=NAMES)

    return archives.mapInArrow(run, ENTRY)


NAMES = [x.split()[0] for x in ENTRY.split(", ")]
TYPES = [pa.string() if x.split()[1] == "string" else pa.int64() for x in ENTRY.split(", ")]


def loser_tree(runs: list[list]):
    """The items of sorted lists in order; each step replays one path of the tree of losers."""
    k = len(runs)
    its = [iter(r) for r in runs]
    heads = [next(it, None) for it in its]

    def beats(a: int, b: int) -> bool:
        if heads[a] is None or heads[b] is None:
            return heads[b] is None and (heads[a] is not None or a < b)
        return (heads[a], a) < (heads[b], b)

    tree, winners = [0] * k, [0] * k + list(range(k))
    for i in range(k - 1, 0, -1):
        a, b = winners[2 * i], winners[2 * i + 1]
        winners[i], tree[i] = (a, b) if beats(a, b) else (b, a)
    top = winners[1] if k > 1 else 0
    while k and heads[top] is not None:
        yield heads[top]
        heads[top], i = next(its[top], None), (top + k) // 2
        while i:
            if beats(tree[i], top):
                tree[i], top = top, tree[i]
            i //= 2


def merge(entries: DataFrame, ranges: int) -> DataFrame:
    """``entries`` in global order of (url_key, captured_at, page_id, payload_digest), with ``range`` and ``place`` in it.

    Each key range holds parts of many runs, every one already in order; a key of many
    captures is split by time and id.
    """
    dealt = entries.repartitionByRange(ranges, "url_key", "captured_at", "page_id", "payload_digest", "archive", "number")

    def run(batches):
        task, tables = TaskContext.get().partitionId(), [b for b in batches if b.num_rows]
        if not tables:
            return
        t = pa.Table.from_batches(tables)
        keys = [place(*x) for x in zip(*(t.column(c).to_pylist() for c in ("url_key", "captured_at", "page_id", "payload_digest")))]
        parts: dict[str, list] = {}
        for i, (name, n) in enumerate(zip(t.column("archive").to_pylist(), t.column("number").to_pylist())):
            parts.setdefault(name, []).append((n, i))
        runs = [[(keys[i], name, n, i) for n, i in sorted(part)] for name, part in sorted(parts.items())]
        for run in runs:
            if any(a > b for a, b in itertools.pairwise(run)):
                raise ValueError(f"archive {run[0][1]} is not in order")
        order = pa.array([x[-1] for x in loser_tree(runs)], pa.int64())
        out = t.take(order).append_column("range", pa.array([task] * len(order), pa.int64())).append_column("place", pa.array(range(len(order)), pa.int64()))
        yield from out.combine_chunks().to_batches()

    return dealt.mapInArrow(run, widened(entries, "range long", "place long"))


def capture_index(pages: DataFrame, min_revisit: int = MIN_REVISIT, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write all pages into archives, read them back and merge their index.

    One row per page: its record's headers, archive and offset, and ``position``, 0, 1, ...
    in the order of the index. Any page_id, null and repeated ones included, and any URL
    (null: the empty key) will do; an empty table gives an empty index.
    """
    scratch = Scratch(pages.sparkSession, "warc")
    archives = scratch.keep(write(captures(pages, min_revisit), archive_bytes))
    entries = scratch.keep(read(archives))
    merged = scratch.keep(merge(entries, max(1, -(-entries.count() // RANGE_ROWS))))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    sizes = merged.groupBy("range").agg(F.count("*").alias("n")).select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    return merged.join(F.broadcast(sizes), "range").withColumn("position", F.col("first") + F.col("place")).drop("range", "place", "first")
