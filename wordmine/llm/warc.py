"""WARC archives of pages, and one index of all captures in order.

``write_archives`` writes a WARC 1.1 record per page as gzip files, through Spark's
text writer, which commits and retries them on any file system.  Of pages with
equal payloads the one with the largest id becomes a response, the others revisits.
A gzip file is read by one task in order, so ``read_runs`` takes the records apart
by their stated lengths, checks every digest, and sorts what it read, some ten
thousand captures at a time, into a run.

``merged`` is the external merge.  Splitters are weighted quantiles of the first
keys of the runs' blocks.  Every block is cut at the splitters, and the cuts of one
range, each in order already, meet in one task, where a loser tree merges as many
lists as there are runs.  A capture's key ends with its place in the archives, so a
URL with very many captures is split like any other.

Defined cases: a null ``html`` is an empty payload, a null ``url`` has no target and
the key ``''``, which sorts first.  White space and control characters in a URL are
written as URIs ask.  Pages without an id sort first; they revisit the page with the
largest id, if any has one.  Repeated rows stay: those with the largest id are all
responses.  An empty table gives no captures.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from hashlib import sha1
from itertools import pairwise

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wordmine.session import materialize

#: Captures of a sorted run, and of a block of it, at most.
RUN = 1 << 16
BLOCK = 1 << 10
#: Captures of a range, about; blocks looked at for splitters, and ranges, at most.
PER_RANGE = 1 << 14
SAMPLE_BLOCKS = 20_000
MOST_RANGES = 10_000

# RFC 4648 digits in the order of conv()'s, and the revisit profile.
_CONV32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NOT_IN_URI = [chr(c) for c in (*range(0x21), 0x7F)]


# Writing


def base32(hexed: Column) -> Column:
    """40 hex digits in base 32."""
    spans = ((1, 15, 12), (16, 15, 12), (31, 10, 8))
    digits = [F.lpad(F.conv(F.substring(hexed, a, n), 16, 32), width, "0") for a, n, width in spans]
    return F.translate(F.concat(*digits), _CONV32, _BASE32)


def _uri(url: Column) -> Column:
    written = url
    for c in _NOT_IN_URI:
        written = F.replace(written, F.lit(c), F.lit(f"%{ord(c):02X}"))
    return F.when(url.rlike(r"[\x00-\x20\x7F]"), written).otherwise(url)


def captured_at(page_id: Column) -> Column:
    """A time for pages that carry none: one second per id, within ten years."""
    seconds = F.pmod(F.coalesce(page_id, F.lit(0)), F.lit(315_360_000))
    interval = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))
    moment = F.expr("timestamp_ntz'2020-01-01 00:00:00'") + interval
    return F.concat(F.replace(moment.cast("string"), F.lit(" "), F.lit("T")), F.lit("Z"))


def _urn(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("-")), F.lit(">"))


def records(pages: DataFrame, least: int = 0) -> DataFrame:
    """One WARC record per page, as ``value``, without its last line feed.

    Payloads of fewer than ``least`` bytes are never revisited.  The groups of equal
    payloads (by SHA-256) are stored; only those of two pages or more are joined.
    """
    kinds = {"page_id": "long", "url": "string", "html": "string"}
    rows = pages.select(*[F.col(c).cast(k).alias(c) for c, k in kinds.items()])
    rows = rows.withColumn("html", F.coalesce("html", F.lit("")))
    rows = rows.withColumns({"same": F.unhex(F.sha2("html", 256)), "size": F.octet_length("html")})
    groups = rows.where(F.col("size") >= least).groupBy("same")
    groups = groups.agg(F.max("page_id").alias("first"), F.count("*").alias("n"))
    shared = materialize(groups.where("n > 1").select("same", "first"))
    rows = rows.join(shared.withColumn("shared", F.lit(True)), "same", "left")
    revisit = F.col("shared").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("size").cast("string"),
        F.lit("\r\n\r\n"),
    )
    length = F.length(http) + F.when(revisit, 0).otherwise(F.col("size"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    empty = F.lit("")
    referred = F.concat(line("WARC-Refers-To", _urn(F.col("first"))), line("WARC-Profile", F.lit(_PROFILE)))
    return rows.select(
        F.concat(
            F.lit("WARC/1.1\r\n"),
            line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
            line("WARC-Record-ID", _urn(F.col("page_id"))),
            line("WARC-Date", captured_at(F.col("page_id"))),
            F.coalesce(line("WARC-Target-URI", _uri(F.col("url"))), empty),
            line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.sha1("html")))),
            F.when(revisit, referred).otherwise(empty),
            line("WARC-Archive-Part", F.spark_partition_id().cast("string")),
            line("Content-Type", F.lit("application/http;msgtype=response")),
            line("Content-Length", length.cast("string")),
            F.lit("\r\n"),
            http,
            F.when(revisit, empty).otherwise(F.col("html")),
            F.lit("\r\n\r"),
        ).alias("value")
    )


def write_archives(pages: DataFrame, path: str, least: int = 0) -> None:
    """Write the records of ``pages`` (``page_id, url, html``) below ``path``.

    ``WARC-Archive-Part`` of a record is the number in the name of its file.
    """
    records(pages, least).write.option("compression", "gzip").text(path)


# Reading


def url_key(url: str | None) -> str:
    """The host's labels from the top down, then path and query: captures of a site stand together."""
    if url is None:
        return ""
    rest = url.split("#", 1)[0]
    if "://" not in rest:
        return rest
    host, path = re.fullmatch(r"([^/?]*)(.*)", rest.split("://", 1)[1], re.S).groups()
    return ",".join(reversed(host.lower().split("."))) + ")" + (path or "/")


def _number(urn: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(found[1]) if found else None


def parsed(head: bytes, block: memoryview, offset: int) -> tuple:
    """A capture, by key, out of a record's header and block; its digest is checked."""
    lines = head.decode("utf-8", "replace").split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    http = bytes(block).split(b"\r\n\r\n", 1)
    size = int(re.search(rb"\r\nContent-Length: (\d+)", http[0])[1])
    kind, stated = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response":
        held = base64.b32encode(sha1(http[1]).digest()).decode()
        if held != stated or len(http[1]) != size:
            raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    page = _number(fields["WARC-Record-ID"])
    return (
        url_key(fields.get("WARC-Target-URI")),
        fields["WARC-Date"],
        page is not None,
        page or 0,
        int(fields["WARC-Archive-Part"]),
        offset,
        size,
        stated,
        kind,
        _number(fields.get("WARC-Refers-To")),
    )


def captures(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The captures of the files of a task, out of their lines; one record is held at a time."""
    data, part, offset = b"", None, 0
    for batch in batches:
        column = batch["value"].cast(pa.binary())
        whole = pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column)
        data += pc.binary_join(whole, b"\n")[0].as_py() + b"\n"
        view, at = memoryview(data), 0
        while (end := data.find(b"\r\n\r\n", at)) >= 0:
            head = data[at:end]
            length = int(re.search(rb"\r\nContent-Length: (\d+)$", head)[1])
            stop = end + 4 + length + 4
            if stop > len(data):
                break
            own = re.search(rb"\r\nWARC-Archive-Part: (\d+)", head)[1]
            if own != part:
                part, offset = own, 0
            yield parsed(head, view[end + 4 : stop - 4], offset)
            offset += stop - at
            at = stop
        data = data[at:]
    if data:
        raise ValueError("an archive ends within a record")


_NAMES = "url_key captured has_id page part offset payload_bytes payload_digest record_type refers_to".split()
_KINDS = "string string boolean long long long long string string long".split()
_TYPES = {"string": pa.string(), "boolean": pa.bool_(), "long": pa.int64()}
_FIELDS = ", ".join(f"{n} {k}" for n, k in zip(_NAMES, _KINDS, strict=True))
_LIST = "captures array<struct<" + ", ".join(f"{n}: {k}" for n, k in zip(_NAMES, _KINDS, strict=True)) + ">>"
#: Of a capture's values, so many are its key; they are unique.
_KEY = 6


def _struct(rows: list[tuple]) -> pa.StructArray:
    columns = zip(*rows, strict=True)
    arrays = [pa.array(c, _TYPES[k]) for c, k in zip(columns, _KINDS, strict=True)]
    return pa.StructArray.from_arrays(arrays, names=_NAMES)


def _lists(pieces: list[list[tuple]]) -> pa.ListArray:
    ends = [0]
    for piece in pieces:
        ends.append(ends[-1] + len(piece))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), _struct([r for p in pieces for r in p]))


def _tuples(array: pa.ListScalar) -> list[tuple]:
    fields = array.values.flatten()
    return list(zip(*[f.to_pylist() for f in fields], strict=True))


def read_runs(spark: SparkSession, path: str, run: int = RUN, block: int = BLOCK) -> DataFrame:
    """``run, block, n, captures``: the captures of the archives in sorted runs, stored.

    A run holds ``run`` captures at most, a block of it ``block``.
    """

    def blocks(number: int, held: list[tuple]) -> pa.RecordBatch:
        held.sort(key=lambda r: r[:_KEY])
        pieces = [held[i : i + block] for i in range(0, len(held), block)]
        columns = [
            pa.array([number] * len(pieces), pa.int64()),
            pa.array(range(len(pieces)), pa.int32()),
            pa.array([len(p) for p in pieces], pa.int32()),
            _lists(pieces),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["run", "block", "n", "captures"])

    def sorted_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 24, []
        for capture in captures(batches):
            held.append(capture)
            if len(held) == run:
                yield blocks(number, held)
                number, held = number + 1, []
        if held:
            yield blocks(number, held)

    lines = spark.read.option("lineSep", "\n").text(path)
    return materialize(lines.mapInArrow(sorted_runs, f"run long, block int, n int, {_LIST}"))


# Merging


class LoserTree:
    """Merges sorted lists: every inner node holds the list that lost there.

    Keys are the first ``key`` values of a row.  The winner gives all its rows up to
    the best key among those it beat, so that long stretches cost one search.
    """

    def __init__(self, lists: list[list[tuple]], key: int):
        self.lists = [x for x in lists if x]
        self.key = key
        self.keys = [[r[:key] for r in x] for x in self.lists]
        self.at = [0] * len(self.lists)
        self.size = max(1, len(self.lists))
        self.losers = [-1] * self.size

    def _beats(self, a: int, b: int) -> bool:
        if a < 0 or self.at[a] == len(self.keys[a]):
            return False
        if b < 0 or self.at[b] == len(self.keys[b]):
            return True
        return (self.keys[a][self.at[a]], a) < (self.keys[b][self.at[b]], b)

    def _build(self, node: int) -> int:
        """The winner below a node; leaf i stands at size + i."""
        if node >= self.size:
            leaf = node - self.size
            return leaf if leaf < len(self.lists) else -1
        a, b = self._build(2 * node), self._build(2 * node + 1)
        winner, self.losers[node] = (a, b) if self._beats(a, b) else (b, a)
        return winner

    def __iter__(self) -> Iterator[tuple]:
        if not self.lists:
            return
        winner = self._build(1)
        while winner >= 0 and self.at[winner] < len(self.keys[winner]):
            path, node = [], (winner + self.size) // 2
            while node:
                path.append(node)
                node //= 2
            second = -1
            for node in path:
                if self._beats(self.losers[node], second):
                    second = self.losers[node]
            start, stop = self.at[winner], len(self.keys[winner])
            if second >= 0 and self.at[second] < len(self.keys[second]):
                limit = self.keys[second][self.at[second]]
                cut = bisect_right if winner < second else bisect_left
                stop = cut(self.keys[winner], limit, start)
            yield from self.lists[winner][start:stop]
            self.at[winner] = stop
            for node in path:
                if self._beats(self.losers[node], winner):
                    winner, self.losers[node] = self.losers[node], winner


def splitters(runs: DataFrame, per_range: int) -> list[tuple]:
    """Keys that part all captures into ranges of about equal numbers.

    At most ``SAMPLE_BLOCKS`` blocks are looked at, those whose hash is smallest.
    """
    total = runs.agg(F.sum("n")).first()[0] or 0
    ranges = min(MOST_RANGES, -(-total // per_range))
    if ranges < 2:
        return []
    first = [F.col("captures")[0][c].alias(c) for c in _NAMES[:_KEY]]
    some = runs.orderBy(F.xxhash64("run", "block"), "run", "block").limit(SAMPLE_BLOCKS).select(*first, "n")
    seen = sorted((tuple(r[:_KEY]), r["n"]) for r in some.collect())
    weight, step, found = 0, sum(n for _, n in seen) / ranges, []
    for key, n in seen:
        if weight >= step * (len(found) + 1):
            found.append(key)
        weight += n
    return found


def merged(runs: DataFrame, per_range: int = PER_RANGE) -> DataFrame:
    """The captures of all runs in one order; ``place`` numbers them from 1.  Stored at once."""
    limits = splitters(runs, per_range)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run, block, found in zip(
                batch["run"].to_pylist(), batch["block"].to_pylist(), batch["captures"], strict=True
            ):
                rows = _tuples(found)
                keys = [r[:_KEY] for r in rows]
                low, high = (bisect_right(limits, k) for k in (keys[0], keys[-1]))
                ends = [0, *[bisect_left(keys, limits[i]) for i in range(low, high)], len(rows)]
                pieces = [(low + i, rows[a:b]) for i, (a, b) in enumerate(pairwise(ends)) if a < b]
                columns = [
                    pa.array([i for i, _ in pieces], pa.int32()),
                    pa.array([run] * len(pieces), pa.int64()),
                    pa.array([block] * len(pieces), pa.int32()),
                    _lists([p for _, p in pieces]),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["range", "run", "block", "captures"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, last, lists = None, None, []

        def one() -> Iterator[pa.RecordBatch]:
            rows = list(LoserTree(lists, _KEY))
            for i in range(0, len(rows), BLOCK):
                part = _struct(rows[i : i + BLOCK])
                number = pa.array(range(i + 1, i + 1 + len(part)), pa.int64())
                columns = [pa.array([current] * len(part), pa.int32()), number, *part.flatten()]
                yield pa.RecordBatch.from_arrays(columns, names=["range", "number", *_NAMES])

        # Cuts come in order of range, run and block.
        for batch in batches:
            for k, run, found in zip(
                batch["range"].to_pylist(), batch["run"].to_pylist(), batch["captures"], strict=True
            ):
                if k != current:
                    if lists:
                        yield from one()
                    current, last, lists = k, None, []
                if run != last:
                    lists.append([])
                    last = run
                lists[-1] += _tuples(found)
        if lists:
            yield from one()

    cuts = runs.select("run", "block", "captures").mapInArrow(cut, f"range int, run long, block int, {_LIST}")
    cuts = cuts.repartition("range").sortWithinPartitions("range", "run", "block")
    found = materialize(cuts.mapInArrow(merge, f"range int, number long, {_FIELDS}"))
    # One row per range, so at most MOST_RANGES.
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = found.groupBy("range").agg(F.count("*").alias("n"))
    shifts = sizes.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    return found.join(F.broadcast(shifts), "range").withColumn("place", F.col("number") + F.col("shift"))


def capture_index(spark: SparkSession, path: str, per_range: int = PER_RANGE) -> DataFrame:
    """All captures of the archives below ``path``, in order of URL key, time and page.

    ``part`` and ``offset`` say where a record starts: the number in its file's name,
    and the byte of the file's uncompressed contents.
    """
    found = merged(read_runs(spark, path), per_range)
    return found.select(
        F.when(F.col("has_id"), F.col("page")).alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        "refers_to",
        "url_key",
        "captured",
        "place",
        "part",
        "offset",
    )
