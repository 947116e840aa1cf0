"""WARC archives with a globally ordered capture index, by external index merge.

Each task writes one archive (a gzip member a record) and the run of its captures, sorted by URL key and timestamp. The runs
are merged externally: captures are cut into ranges of (URL key, timestamp, page) of about ``RANGE_ROWS``, so the captures of one hot URL are
several ranges and no task holds more than a range, and in each range the sorted stretches of all runs go through a loser tree. A capture's rank is
its place in its range and what all earlier ranges hold. The merged index leads the reading back. Of records with one payload the one with the largest page id is the response and the others revisit it.

Files are written under a name of the attempt, and only the index of the attempt that ended well names them; so lost
executors and repeated tasks leave no wrong record, only unreferenced files.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

LEAST_REVISIT = 0
#: Payloads seen more than once are broadcast up to this many rows of about 200 bytes; beyond it a join shuffles.
BROADCAST_ROWS = 50_000
#: Captures of one range of the index.
RANGE_ROWS = 50_000
CAPTURE = "url_key string, captured_at long, page_id long, file string, at long, size long, record_type string, payload_digest string"
_EPOCH = 1_704_067_200


def url_key(url: str | None) -> str:
    """The key under which captures are ordered: the host's labels reversed, then port, path and query, lower case."""
    if not url:
        return ""
    rest = re.sub(r"^[a-z][a-z0-9+.-]*://", "", url.strip().lower())
    rest = rest.partition("#")[0]
    m = re.match(r"(?:[^/?@]*@)?([^/?:]*)(:\d+)?(.*)", rest, re.DOTALL)
    host = m[1][4:] if m[1].startswith("www.") else m[1]
    return ",".join(reversed(host.split("."))) + (m[2] or "") + ")" + (m[3] or "/")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def _line(x: str | None) -> str:
    """A header value on one line; what would break it is percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", x) if x else "urn:absent"


def _date(seconds: int | None) -> str:
    import datetime as dt

    return dt.datetime.fromtimestamp(seconds or 0, dt.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def record(page_id, url, seconds, payload: bytes, digest: str, keeper) -> bytes:
    """One record; ``keeper``: (page id, url, seconds) of the response it revisits, or None."""
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if keeper else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {_date(seconds)}",
        f"WARC-Target-URI: {_line(url)}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response",
    ]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if keeper else http + payload
    if keeper:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(keeper[0], digest)}",
            f"WARC-Refers-To-Target-URI: {_line(keeper[1])}", f"WARC-Refers-To-Date: {_date(keeper[2])}", f"X-Refers-To-Page-Id: {keeper[0]}",
        ]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(record headers, HTTP headers, payload) of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"no WARC record: {first[:40]!r}")
    headers = dict(x.split(": ", 1) for x in lines)
    block = rest[: int(headers["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return headers, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload


def _store(folder: str):
    from pyarrow import fs

    # Hadoop names local files file:/path as well as file:///path.
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", folder))


def _gzip(data: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}.warc.gz"
        store, root = _store(folder)
        captures, at, out = [], 0, None
        for batch in batches:
            for r in batch.to_pylist():
                if out is None:
                    store.create_dir(root, recursive=True)
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                payload = (r["payload"] or "").encode()
                digest = base64.b32encode(bytes.fromhex(r["sha1"])).decode()
                k = r["keeper"]
                keeper = (k["page_id"], k["url"], k["seconds"]) if r["revisit"] else None
                data = _gzip(record(r["page_id"], r["url"], r["seconds"], payload, digest, keeper))
                out.write(data)
                captures.append((url_key(r["url"]), r["seconds"] or 0, r["page_id"], name, at, len(data), "revisit" if keeper else "response", digest))
                at += len(data)
        if out is not None:
            out.close()
            captures.sort(key=_place)
            for i in range(0, len(captures), 20_000):
                yield _captures(captures[i : i + 20_000])

    return run


INDEX = CAPTURE + ", range_no long, place long"
_NAMES = [x.split()[0] for x in INDEX.split(", ")]
_TYPES = [pa.string() if x.endswith("string") else pa.int64() for x in INDEX.split(", ")]
_OF_RUN = len(CAPTURE.split(", "))


def _captures(rows) -> pa.RecordBatch:
    columns = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(list(c), type=t) for c, t in zip(columns, _TYPES)], names=_NAMES[: len(columns)])


def _place(row) -> tuple:
    """Order of captures: URL key, time, page id with null first, then the file and the place in it."""
    return row[0].encode(), row[1], row[2] is not None, row[2] or 0, row[3], row[4]


def merge_runs(runs: Iterable[Iterable], key=_place) -> Iterator:
    """One ordered stream of sorted runs, by a loser tree: each step replays only the path of the run that won."""
    streams = [iter(r) for r in runs]
    n = len(streams)
    if not n:
        return
    heads = [next(s, None) for s in streams]
    keys = [None if h is None else key(h) for h in heads]

    def beats(a: int, b: int) -> bool:
        if a < 0 or b < 0:  # -1 stands for a place not yet played: it loses to none
            return a < 0
        if keys[a] is None or keys[b] is None:
            return keys[b] is None and keys[a] is not None
        return (keys[a], a) < (keys[b], b)

    tree = [-1] * n

    def replay(winner: int) -> None:
        node = (winner + n) // 2
        while node:
            if beats(tree[node], winner):
                tree[node], winner = winner, tree[node]
            node //= 2
        tree[0] = winner

    for i in range(n):
        replay(i)
    while (w := tree[0]) >= 0 and keys[w] is not None:
        yield heads[w]
        heads[w] = next(streams[w], None)
        keys[w] = None if heads[w] is None else key(heads[w])
        replay(w)


def _merger(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range: rows come ordered by run and place in the run, which restores the stretch of each run."""
    from pyspark import TaskContext

    number = TaskContext.get().partitionId()
    runs: dict[str, list[tuple]] = {}
    for batch in batches:
        for row in zip(*(batch.column(n).to_pylist() for n in _NAMES[:_OF_RUN])):
            runs.setdefault(row[3], []).append(row)
    rows = []
    for place, row in enumerate(merge_runs(runs.values())):
        rows.append((*row, number, place))
        if len(rows) == 20_000:
            yield _captures(rows)
            rows = []
    if rows:
        yield _captures(rows)


def decide(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """``pages`` (page_id, url, seconds, payload) with sha1, revisit and keeper (page_id, url, seconds)."""
    told = pages.withColumn("bytes", F.coalesce(F.octet_length("payload"), F.lit(0))).withColumn("sha1", F.sha1(F.coalesce("payload", F.lit("")).cast("binary")))
    several = told.filter(F.col("bytes") >= least).groupBy("sha1", "bytes").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url", "seconds"))).alias("keeper")
    )
    several = common.written(several.filter("n > 1 AND keeper IS NOT NULL"), "payloads")
    if several.count() <= BROADCAST_ROWS:
        joined = told.join(F.broadcast(several), ["sha1", "bytes"], "left")
    else:
        joined = common.spread_join(told, several, ["sha1", "bytes"], "n", how="left")
    revisit = F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper.page_id"))
    return joined.select("page_id", "url", "seconds", "payload", "sha1", revisit.alias("revisit"), "keeper")


def write_archives(pages: DataFrame, folder: str, least: int = LEAST_REVISIT) -> DataFrame:
    """Write ``pages`` (page_id, url, seconds, payload) to archives in ``folder``; the runs of captures, as a table."""
    common.prepare(pages.sparkSession)
    return common.written(decide(pages, least).mapInArrow(_writer(folder), CAPTURE), "runs")


def capture_index(runs: DataFrame) -> DataFrame:
    """All captures in global order of URL key, timestamp and page: partition i holds what is before partition i + 1. ``range_no`` is that
    partition and ``place`` the place in it, from 0."""
    order = ["url_key", "captured_at", "page_id", "file", "at"]
    ranges = common.blocks_for(runs.count(), RANGE_ROWS)
    return runs.repartitionByRange(ranges, *order).sortWithinPartitions("file", *order[:3], "at").mapInArrow(_merger, INDEX)


def ranked(index: DataFrame) -> DataFrame:
    """A written ``capture_index`` with ``capture_rank``: the place of a capture in the whole order, from 1."""
    before = Window.orderBy("no").rowsBetween(Window.unboundedPreceding, -1)
    # One row a range.
    starts = index.groupBy(F.col("range_no").alias("no")).agg(F.count(F.lit(1)).alias("there")).select("no", F.coalesce(F.sum("there").over(before), F.lit(0)).alias("start"))
    return index.join(starts, F.col("range_no") == F.col("no")).withColumn("capture_rank", F.col("start") + F.col("place") + 1).drop("no", "start", "range_no", "place")


def _reader(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        name, source = None, None
        for batch in batches:
            rows = []
            for file, at, size, rank in zip(*(batch.column(n).to_pylist() for n in ("file", "at", "size", "capture_rank"))):
                if file != name:
                    if source is not None:
                        source.close()
                    name, source = file, store.open_input_file(f"{root}/{file}")
                headers, http, payload = parse(zlib.decompress(source.read_at(size, at), 31))
                page, refers = headers.get("X-Page-Id"), headers.get("X-Refers-To-Page-Id")
                kind, digest = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha1:")
                if kind == "response" and base32_sha1(payload) != digest:
                    raise ValueError(f"{file} at {at}: the payload has another digest than {digest}")
                rows.append((page and int(page), headers["WARC-Target-URI"], int(http["Content-Length"]), digest, kind, refers and int(refers), payload if kind == "response" else None, rank))
            types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int64()]
            names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload", "capture_rank"]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), type=t) for c, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types], names=names)

    return run


def read_archives(captures: DataFrame, folder: str) -> DataFrame:
    """The records that ``captures`` name, read from the archives in ``folder``; payload is null for revisits."""
    ordered = captures.select("file", "at", "size", "capture_rank").repartition("file").sortWithinPartitions("file", "at")
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, capture_rank long"
    return ordered.mapInArrow(_reader(folder), schema)


def archive_pages(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", time_col: str | None = None, least: int = LEAST_REVISIT) -> tuple[DataFrame, DataFrame]:
    """(records read back, capture index) of ``pages``, written to ``folder``.

    Null html: an empty payload, which is a payload like any other. Null url: key "" and an absent target. Null ids: a
    record of its own that never is what others refer to, and a response where its payload has no id at all. Rows repeated
    whole: a record each; all rows with the largest id are responses. Without ``time_col`` the time is the id in seconds
    after the start of 2024. Payloads under ``least`` bytes are all responses. An empty table gives empty ones.
    """
    seconds = F.col(time_col).cast("long") if time_col else F.lit(_EPOCH) + F.coalesce(F.pmod(F.col(id_col).cast("long"), F.lit(1 << 31)), F.lit(0))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), seconds.alias("seconds"), F.col(html_col).alias("payload"))
    runs = write_archives(rows, folder, least)
    merged = common.written(capture_index(runs), "captures")
    index = common.written(ranked(merged), "index")
    common.discard(runs, merged)
    return read_archives(index, folder), index


def query(spark, sf_dir: str) -> DataFrame:
    records, _ = archive_pages(common.table(spark, sf_dir, "pages").select("page_id", "url", "html"), common.work_path(spark, "warc"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "capture_rank")


# DuckDB has SHA-1 but no base 32: five bits at a time, through the hexadecimal digest's 40 digits. The key of a URL as in ``url_key``.
ORACLE_SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body,
    split_part(regexp_replace(lower(regexp_replace(coalesce(url, ''), '^\s+|\s+$', '', 'g')), '^[a-z][a-z0-9+.-]*://', ''), '#', 1) AS rest
  FROM pages
), u AS (
  SELECT *, regexp_extract(rest, '(?s)^(?:[^/?@]*@)?([^/?:]*)(:\d+)?(.*)', 1) AS host, regexp_extract(rest, '(?s)^(?:[^/?@]*@)?([^/?:]*)(:\d+)?(.*)', 2) AS port,
    regexp_extract(rest, '(?s)^(?:[^/?@]*@)?([^/?:]*)(:\d+)?(.*)', 3) AS path
  FROM p
), k AS (
  SELECT page_id, body,
    CASE WHEN rest = '' THEN '' ELSE array_to_string(list_reverse(string_split(regexp_replace(host, '^www[.]', ''), '.')), ',') || port || ')' || CASE WHEN path = '' THEN '/' ELSE path END END AS url_key
  FROM u
), d AS (
  SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, sha1(body) AS h, max(page_id) OVER (PARTITION BY body) AS keeper,
    row_number() OVER (ORDER BY url_key, page_id % 2147483648, page_id) AS capture_rank
  FROM k
), b AS (
  SELECT *,
    list_reduce(list_transform(range(0, 40), lambda i: lpad(bin(strpos('0123456789abcdef', substr(h, CAST(i + 1 AS BIGINT), 1)) - 1), 4, '0')), lambda x, y: x || y) AS bits
  FROM d
)
SELECT page_id, payload_bytes,
  list_reduce(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + 16 * CAST(substr(bits, 5 * i + 1, 1) AS BIGINT) + 8 * CAST(substr(bits, 5 * i + 2, 1) AS BIGINT) + 4 * CAST(substr(bits, 5 * i + 3, 1) AS BIGINT)
      + 2 * CAST(substr(bits, 5 * i + 4, 1) AS BIGINT) + CAST(substr(bits, 5 * i + 5, 1) AS BIGINT), 1)), lambda x, y: x || y) AS payload_digest,
  CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = keeper THEN NULL ELSE keeper END AS refers_to, capture_rank
FROM b
"""
