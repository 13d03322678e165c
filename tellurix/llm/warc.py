"""WARC archives with an external merge of their indexes: each task writes an archive and a locally sorted run of index
rows; the runs are merged by URL key and time in trees of losers, a bounded number at a time, which gives captures in one
global order."""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator
from itertools import batched

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tellurix.llm.common import Scratch, record_batch

REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_ID = "urn:tellurix:page:"
#: Level of compression of each record, and archives that a merging task has open at a time.
LEVEL, OPEN = 3, 64
#: Runs that are merged at a time: what a merging task has open as index files.
FAN_IN = 512
#: Bytes of records that a merging task reads back, about, and bytes that it holds of its runs' index files at a time.
TASK_BYTES, BUFFER = 64 << 20, 64 << 20
INDEX = "url_key string, timestamp string, page_id long, run string, `from` long, `to` long, length long"
CAPTURES = "page_id long, url_key string, timestamp string, payload_bytes long, payload_digest string, record_type string, refers_to long, file string, offset long, part int, place long"


def url_key(url: Column) -> Column:
    """The host's labels from right to left, then path and query, lower-cased: com,example,www)/a?b."""
    rest = F.lower(F.regexp_replace(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://|#.*$", ""))
    host = F.regexp_extract(rest, r"^([^/?:]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?]*(.*)$", 1)
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), path)


def record(url: str | None, page_id: int | None, when: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record as a gzip member. A revisit holds the response's HTTP header but not its payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    name = lambda i: f"<{RECORD_ID}{'' if i is None else i}>"
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {when}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        head += [f"WARC-Refers-To: {name(refers_to)}", f"WARC-Profile: {REVISIT_PROFILE}"]
    block = http + (payload if refers_to is None else b"")
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + block + b"\r\n\r\n") + z.flush()


def read_record(member: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """A record's WARC fields, its HTTP header and its payload."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    return fields, http, payload


def number(name: str) -> int | None:
    digits = name[1:-1].removeprefix(RECORD_ID)
    return int(digits) if digits else None


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a URI, by pyarrow, as tasks have no JVM. Names that Spark has for S3 are S3's here."""
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", uri))


def index_line(key: str, when: str | None, page_id: int | None, archive: str, offset: int, length: int) -> bytes:
    return json.dumps([key, when, page_id, archive, offset, length], ensure_ascii=False).encode() + b"\n"


def written(folder: str):
    """Writes a task's rows, which come sorted, as one archive and one index file, and yields the index rows with their bytes'
    places in that file. A second attempt of a task writes other files, and only the rows of the attempt that Spark
    commits name them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = opened(folder)
        name, out, index, offset, at = uuid.uuid4().hex, None, None, 0, 0
        for b in batches:
            if b.num_rows and out is None:
                store.create_dir(path, recursive=True)
                out, index = (store.open_output_stream(f"{path}/{name}{x}", compression=None) for x in (".warc.gz", ".index"))
            starts, ends, lengths = [], [], []
            payloads = b.column("html").cast(pa.binary())
            rest = [b.column(c).to_pylist() for c in ("url_key", "url", "page_id", "timestamp", "digest", "refers_to")]
            for i, (key, url, page_id, when, digest, refers_to) in enumerate(zip(*rest, strict=True)):
                data = record(url, page_id, when, payloads[i].as_py() or b"", base64.b32encode(bytes.fromhex(digest)).decode(), refers_to)
                line = index_line(key, when, page_id, name, offset, len(data))
                out.write(data)
                index.write(line)
                starts.append(at)
                ends.append(at := at + len(line))
                lengths.append(len(data))
                offset += len(data)
            own = {c: (b.column(c), t) for c, t in (("url_key", pa.string()), ("timestamp", pa.string()), ("page_id", pa.int64()))}
            yield record_batch(own | {"run": ([name] * b.num_rows, pa.string()), "from": (starts, pa.int64()), "to": (ends, pa.int64()), "length": (lengths, pa.int64())})
        if out is not None:
            out.close()
            index.close()

    return run


def index_rows(folder: str, run: str, start: int, end: int, block: int) -> Iterator[tuple]:
    """The rows of a sorted run's index file between two places, as (key, archive, offset, length), read block by block."""
    store, path = opened(folder)
    with store.open_input_file(f"{path}/{run}.index") as f:
        rest = b""
        while start < end:
            data = f.read_at(min(block, end - start), start)
            start += len(data)
            *lines, rest = (rest + data).split(b"\n")
            for line in lines:
                key, when, page_id, archive, offset, length = json.loads(line)
                yield (key, when is not None, when or "", page_id is not None, page_id or 0), archive, offset, length


class LoserTree:
    """Merges sorted sequences. Each inner node keeps the loser of the match between its subtrees' winners, so that after
    the winner's next key only the matches on its own path are played again."""

    def __init__(self, sources: list[Iterator]):
        self.sources = sources
        self.heads = [next(s, None) for s in sources]
        n = len(sources)
        self.losers = [0] * n
        winners = [*([0] * n), *range(n)]
        for node in range(n - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self.before(a, b) else (b, a)
        self.winner = winners[1] if n > 1 else 0

    def before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or (x, a) <= (y, b))

    def __iter__(self) -> Iterator:
        while self.sources and self.heads[self.winner] is not None:
            w = self.winner
            yield self.heads[w]
            self.heads[w] = next(self.sources[w], None)
            node = (w + len(self.sources)) // 2
            while node:
                if self.before(self.losers[node], w):
                    w, self.losers[node] = self.losers[node], w
                node //= 2
            self.winner = w


class Archives:
    """Archives open for reading, the longest unused closed first."""

    def __init__(self):
        self.open = OrderedDict()

    def read(self, file: str, offset: int, length: int) -> bytes:
        if file not in self.open:
            store, path = opened(file)
            self.open[file] = store.open_input_file(path)
            if len(self.open) > OPEN:
                self.open.popitem(last=False)[1].close()
        self.open.move_to_end(file)
        return self.open[file].read_at(length, offset)


def tree_of(folder: str, slices: list[dict]) -> LoserTree:
    block = max(1 << 12, BUFFER // len(slices))
    return LoserTree([index_rows(folder, x["run"], x["from"], x["to"], block) for x in slices])


def lengthened(folder: str):
    """Merges the index files of each group of runs into one of a longer run, and yields its rows as `written` does. The
    records stay in their archives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = opened(folder)
        types = {"url_key": pa.string(), "timestamp": pa.string(), "page_id": pa.int64(), "run": pa.string(), "from": pa.int64(), "to": pa.int64(), "length": pa.int64()}
        for b in batches:
            for slices in b.column("slices").to_pylist():
                name, at, rows = uuid.uuid4().hex, 0, tree_of(folder, slices)
                with store.open_output_stream(f"{path}/{name}.index", compression=None) as index:
                    for some in batched(rows, 5000):
                        out = []
                        for (key, has_time, when, has_id, page_id), file, offset, length in some:
                            own = (key, when if has_time else None, page_id if has_id else None)
                            line = index_line(*own, file, offset, length)
                            index.write(line)
                            out.append((*own, name, at, at := at + len(line), length))
                        yield record_batch({n: (list(c), t) for (n, t), c in zip(types.items(), zip(*out, strict=True), strict=True)})

    return run


def merged(folder: str):
    """Merges the runs' slices of a key range in a tree of losers, and reads each record back in that order. Index files and
    archives are read as the merge goes on: as each is sorted by the same key, a slice's bytes stand one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, slices in zip(b.column("part").to_pylist(), b.column("slices").to_pylist(), strict=True):
                archives, out = Archives(), []
                for place, (key, name, offset, length) in enumerate(tree_of(folder, slices)):
                    file = f"{folder}/{name}.warc.gz"
                    out.append((*capture(archives.read(file, offset, length), key), file, offset, part, place))
                    if len(out) == 5000:
                        yield as_batch(out)
                        out = []
                if out:
                    yield as_batch(out)

    return run


def capture(member: bytes, key: tuple) -> tuple:
    """What a record says of its page."""
    fields, http, payload = read_record(member)
    kind = fields["WARC-Type"]
    if kind == "response":
        size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
    else:
        size, digest = int(re.search(rb"Content-Length: (\d+)", http)[1]), fields["WARC-Payload-Digest"].removeprefix("sha1:")
    refers = number(fields["WARC-Refers-To"]) if kind == "revisit" else None
    return number(fields["WARC-Record-ID"]), key[0], key[2] if key[1] else None, size, digest, kind, refers


def as_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    schema = [x.split() for x in CAPTURES.split(", ")]
    return record_batch({n: (list(c), kinds[k]) for (n, k), c in zip(schema, zip(*rows, strict=True), strict=True)})


def archive(pages: DataFrame, spark: SparkSession, least_bytes: int = 0) -> tuple[DataFrame, Scratch]:
    """Writes a WARC record for each row of `pages` (page_id, url, timestamp, html; other columns are dropped) and returns
    the sorted runs' index rows. Of the records with equal payloads of `least_bytes` or more, that with the largest
    page_id is the response and the others revisit it. Only digests and ids are shuffled to find them, and payloads
    only where there are too many revisits to send to all tasks."""
    scratch = Scratch(spark, "warc")
    try:
        opened(scratch.base)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError) as e:
        raise ValueError(f"archives are written by tasks, with pyarrow: spark.checkpoint.dir must be of a kind that it opens, not {scratch.base}") from e
    payload = F.coalesce("html", F.lit(""))
    own = pages.select("page_id", "url", "timestamp", "html", F.sha1(payload).alias("digest"), F.octet_length(payload).cast("long").alias("bytes"))
    thin = own.select("page_id", "digest", "bytes")
    equal = scratch.table(thin.where(F.col("bytes") >= least_bytes).groupBy("digest", "bytes").agg(F.max("page_id").alias("last"), F.count("*").alias("c")).where("c > 1").drop("c"), "equal")
    again = thin.join(equal, ["digest", "bytes"]).where("last is not null and (page_id is null or page_id < last)").select("page_id", "digest", F.col("last").alias("refers_to"))
    again = scratch.table(again.distinct(), "revisits").select(F.col("page_id").alias("_id"), F.col("digest").alias("_digest"), "refers_to")
    rows = own.join(again, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")), "left")
    rows = rows.select("page_id", "url", "timestamp", "html", "digest", "refers_to", url_key(F.col("url")).alias("url_key")).sortWithinPartitions("url_key", "timestamp", "page_id")
    return scratch.table(rows.mapInArrow(written(f"{scratch.base}/archives"), INDEX), "runs"), scratch


def groups_of_runs(runs: DataFrame, n: int) -> DataFrame:
    """The `n` runs in groups of FAN_IN at most: group, part, slices. They are dealt by a hash of their names, about FAN_IN to
    a group, and larger groups are cut."""
    whole = runs.groupBy("run").agg(F.lit(0).cast("long").alias("from"), F.max("to").alias("to"))
    dealt = whole.groupBy(F.pmod(F.xxhash64("run"), F.lit(-(-n // FAN_IN))).alias("group")).agg(F.array_sort(F.collect_list(F.struct("run", "from", "to"))).alias("all"))
    return dealt.select("group", "all", F.explode(F.sequence(F.lit(0), F.size("all") - 1, F.lit(FAN_IN))).alias("part")).select("group", "part", F.slice("all", F.col("part") + 1, F.lit(FAN_IN)).alias("slices"))


def few_runs(runs: DataFrame, scratch: Scratch) -> DataFrame:
    """The index rows of FAN_IN runs at most: passes over groups of runs make one longer run of each, until there are so few."""
    while (n := runs.agg(F.count_distinct("run")).first()[0]) > FAN_IN:
        groups = scratch.table(groups_of_runs(runs, n), "groups")
        before, runs = runs, scratch.table(groups.repartitionByRange(-(-2 * n // FAN_IN), "group", "part").mapInArrow(lengthened(f"{scratch.base}/archives"), INDEX), "runs")
        scratch.drop(before, groups)
    return runs


def captures(pages: DataFrame, spark: SparkSession, least_bytes: int = 0) -> DataFrame:
    """Archives `pages` (see `archive`) and reads all records back in the global order of URL key, time and page_id:
    page_id, url_key, timestamp, payload_bytes, payload_digest, record_type, refers_to, file, offset, and part and place,
    by which the captures are in that order.

    Runs are as many as tasks that write; passes of merges make them FAN_IN at most, whatever the table's size.
    Index rows are dealt by ranges of the whole key, so that the captures of a URL with a third of all rows are spread
    over tasks, in as many ranges as the records' bytes ask for. Of each range, only where each run's slice of it
    begins and ends goes on; a task streams its slices through the merge. A null html is an empty payload, a null url
    has an empty key, null times and ids come first; rows that repeat the largest id of a payload are each a
    response, and a row with a null id counts as the smallest. Very long pages are one record each; an empty table
    gives an empty one. The archives lie in the shared folder until the driver ends.
    """
    runs, scratch = archive(pages, spark, least_bytes)
    runs = few_runs(runs, scratch)
    total = runs.agg(F.sum("length")).first()[0] or 0
    parts = max(spark.sparkContext.defaultParallelism, -(-total // TASK_BYTES))
    dealt = runs.repartitionByRange(parts, "url_key", "timestamp", "page_id").select(F.spark_partition_id().alias("part"), "run", "from", "to")
    slices = dealt.groupBy("part", "run").agg(F.min("from").alias("from"), F.max("to").alias("to")).groupBy("part").agg(F.collect_list(F.struct("run", "from", "to")).alias("slices"))
    slices = scratch.table(slices, "slices").repartitionByRange(parts, "part")
    return scratch.table(slices.mapInArrow(merged(f"{scratch.base}/archives"), CAPTURES), "captures")


def op1(pages: DataFrame, spark: SparkSession) -> DataFrame:
    """The pages have no time of capture, so it is made by rule from page_id, in UTC whatever the session's zone."""
    seconds = F.lit(1_700_000_000) + F.coalesce("page_id", F.lit(0)) % 100_000_000
    of_day = (seconds % 86_400).cast("int")
    clock = F.format_string("T%02d:%02d:%02dZ", F.expr("_of_day div 3600").cast("int"), F.expr("_of_day div 60 % 60").cast("int"), F.expr("_of_day % 60").cast("int"))
    when = F.concat(F.date_from_unix_date(F.expr("_seconds div 86400").cast("int")).cast("string"), clock)
    own = pages.select("page_id", "url", "html", seconds.alias("_seconds"), of_day.alias("_of_day")).select("page_id", "url", when.alias("timestamp"), "html")
    return captures(own, spark).drop("part", "place", "file", "offset")


SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS b, lower(regexp_replace(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://|#.*$', '', 'g')) AS rest FROM pages),
h AS (SELECT page_id, octet_length(b)::BIGINT AS n, sha1(b) AS x, rest FROM p),
w AS (SELECT *, max(page_id) OVER (PARTITION BY n, x) AS last FROM h)
SELECT page_id, n AS payload_bytes,
       array_to_string(list_reverse(string_split(regexp_extract(rest, '^([^/?:]*)', 1), '.')), ',') || ')' || regexp_extract(rest, '(?s)^[^/?]*(.*)$', 1) AS url_key,
       strftime(make_timestamp((1700000000 + coalesce(page_id, 0) % 100000000) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS timestamp,
       list_aggregate(list_transform(range(0, 32), lambda i:
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((('0x' || x[(i // 4) * 5 + 1:(i // 4) * 5 + 5])::INTEGER >> (15 - 5 * (i % 4))::INTEGER) & 31) + 1]), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < last THEN last END AS refers_to
FROM w
"""
