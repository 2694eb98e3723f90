"""WARC archives: pages written as records, whole-file gzip streams made random-access, records read back by offset.

Monolithic gzip normaliser. Spark's text writer makes archives that are one gzip stream each, as plain compression of a WARC
file does: no record can be reached without inflating all before it. The normaliser inflates such a stream once, in pieces,
rewrites each record as a gzip member of its own, and writes a sidecar index beside the archive: a JSON line a record with the
member's offset and length. Neither a stream nor a record is ever held whole while rewriting. Streams that have several
members already are taken too, so normalising twice changes nothing.

A task names its archive by its attempt and returns one row for it; only rows of tasks that succeed are kept, so what a lost
task has left behind is never read. Tasks open files by `pyarrow.fs` (local and shared folders, hdfs, s3, gs).

Equal payloads. Groups of equal SHA-256 digests are counted without their payloads. A bitmap of fixed size tells each page
whether its digest may be shared; most pages are written by the scan that reads them. Pages of groups of over 1/100,000 of all
rows meet their group by a broadcast, the others by a shuffle; the payload is dropped where a revisit is written.

Defined results
- Null html is an empty payload. Payloads under `least` bytes are never revisited. Of equal ones the smallest id is the response,
  a null id last. Ties (one id in rows of different URLs): the smaller URL, a null one last; of repeated rows one is the response and
  the others revisit it.
- A null id or URL: the record has no such field. White space and control characters of a URL are written as %20.
- Very long payloads: written and rewritten in pieces; reading back holds one record. Any bytes may stand in a payload, those of
  a record's head too, as lengths decide.
- Empty table: archives without records, no rows. Extra columns, whatever their names, are ignored.
- A damaged stream: the records before the damage are kept, and `error` of its row tells. Reading raises where an error is told.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pfs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratagraph.functions.vectors import uuid5
from stratagraph.plans.scratch import shared_dir

from .common import HOT_GROUPS, LEAST_HOT, bitmap_of, bound_batches, materialize, text_of, with_bit, with_groups

#: Bytes read, inflated or fetched at once; level of the members' compression; rows of an Arrow batch.
PIECE, LEVEL, ROWS = 1 << 20, 4, 512
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END = "\r\n"

# Writing -----------------------------------------------------------------------------------------


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(_END)), F.lit(""))


def record(payload: Column, size: Column, digest: Column, refers_to: Column, date: str) -> Column:
    """A record's bytes over columns url, source and record_id, up to the last line end, which the text writer adds. A revisit has no payload."""
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_END}Content-Type: text/html; charset=utf-8{_END}Content-Length: "), size.cast("string"), F.lit(_END * 2))
    revisit = refers_to.isNotNull()
    body = F.when(revisit, F.lit("")).otherwise(payload)
    head = F.concat(
        F.lit(f"WARC/1.1{_END}"),
        _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", F.concat(F.lit("<urn:uuid:"), "record_id", F.lit(">"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.lower(F.hex(digest)))),
        _line("WARC-Refers-To", F.concat(F.lit("<urn:uuid:"), refers_to, F.lit(">"))),
        _line("WARC-Profile", F.when(revisit, PROFILE)),
        _line("X-Source-ID", F.url_encode("source")),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", (F.octet_length(http) + F.octet_length(body)).cast("string")),
        F.lit(_END),
    )
    return F.concat(head, http, body, F.lit(_END))


def _identity(*columns: str) -> Column:
    """A name for the record that its revisits refer to."""
    return uuid5(F.concat_ws(":", *[F.coalesce(F.col(c), F.lit("-")) for c in columns]))


def page_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 100, date: str = "2020-01-01T00:00:00Z") -> DataFrame:
    """One column, the bytes of each page's record: a response, or a revisit of the response of an equal payload."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(id_col).cast("string").alias("source"), F.col(url_col).alias("url"), text_of(html_col).alias("payload"))
    rows = rows.withColumns({"size": F.octet_length("payload").cast("long"), "digest": F.unhex(F.sha2(F.col("payload").cast("binary"), 256))})
    place = F.struct(F.col("id").isNull().alias("a"), F.col("id").alias("b"), F.col("url").isNull().alias("c"), F.col("url").alias("d"))
    each = rows.where(F.col("size") >= least).groupBy("digest", "id", "source", "url").agg(F.count("*").alias("k"))
    groups = each.groupBy("digest").agg(F.sum("k").alias("n"), F.min_by(F.struct("source", "url", "k"), place).alias("first")).where("n > 1")
    groups = materialize(groups.select("digest", "n", "first"), "warc_groups")

    told = with_bit(rows.drop("id"), "digest", materialize(bitmap_of(groups, "digest"), "warc_shared"), "shared")
    shared = (F.col("size") >= least) & F.col("shared")
    bar = max(LEAST_HOT, -(-pages.count() // HOT_GROUPS))
    columns = ["source", "url", "payload", "size", "digest"]
    alone = told.where(~shared).select(*columns, F.lit(None).cast(groups.schema["first"].dataType).alias("first"))
    met = told.where(shared).select(*columns).join(F.broadcast(groups.where(F.col("n") > bar)), "digest", "left")
    hot = met.where("n is not null").select(*columns, "first")
    cold = met.where("n is null").select(*columns).join(groups.where(F.col("n") <= bar).select("digest", "first"), "digest", "left").select(*columns, "first")

    # A name of its own for what nothing refers to; the response of a group is named by what it holds.
    own = uuid5(F.concat(F.lit("record:"), F.monotonically_increasing_id().cast("string")))
    everything = alone.unionByName(hot).unionByName(cold)
    is_first = F.col("first").isNotNull() & F.col("source").eqNullSafe(F.col("first.source")) & F.col("url").eqNullSafe(F.col("first.url"))
    hexed = F.hex("digest")
    named = everything.select(*columns, is_first.alias("is_first"), "first.k", F.when(F.col("first").isNotNull(), uuid5(F.concat_ws(":", hexed, F.coalesce("first.source", F.lit("-")), F.coalesce("first.url", F.lit("-"))))).alias("group_id"))
    once = named.where(~F.col("is_first") | (F.col("k") == 1))
    # Of a response's repeated rows, one is written with the payload and the others follow without.
    again = named.where(F.col("is_first") & (F.col("k") > 1)).groupBy("digest", "source", "url", "size", "k", "group_id").agg(F.first("payload").alias("payload"))
    again = again.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("k"))).alias("j"))
    again = again.select("source", "url", F.when(F.col("j") == 1, F.col("payload")).alias("payload"), "size", "digest", (F.col("j") == 1).alias("is_first"), "k", "group_id")
    out = once.unionByName(again)
    out = out.select("*", F.when(F.col("is_first"), F.col("group_id")).otherwise(own).alias("record_id"), F.when(~F.col("is_first"), F.col("group_id")).alias("refers_to"))
    return out.select(record(F.col("payload"), F.col("size"), F.col("digest"), F.col("refers_to"), date).alias("record"))


def write_monolithic(records: DataFrame, folder: str) -> str:
    """Archives of one gzip stream each, a task's records in one."""
    records.write.option("lineSep", _END).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(folder)
    return folder


# Normalising -------------------------------------------------------------------------------------


class Inflated:
    """What a gzip file of one or more members holds, read in pieces."""

    def __init__(self, source):
        self.source, self.inflate, self.buffer, self.at = source, zlib.decompressobj(31), b"", 0
        self.fresh = True

    def _more(self) -> bool:
        while True:
            raw = self.inflate.unconsumed_tail or (self.inflate.unused_data if self.inflate.eof else b"")
            if not raw and not (raw := self.source.read(PIECE)):
                if not (self.fresh or self.inflate.eof):
                    raise ValueError("the stream ends within a member")
                return False
            if self.inflate.eof:
                if not raw.strip(b"\0"):
                    self.inflate, self.fresh = zlib.decompressobj(31), True
                    continue
                self.inflate = zlib.decompressobj(31)
            self.fresh = False
            if new := self.inflate.decompress(raw, PIECE):
                self.buffer, self.at = self.buffer[self.at :] + new, 0
                return True

    def until(self, mark: bytes) -> bytes | None:
        """Up to and with the mark; None at the end."""
        begin = self.at
        while (k := self.buffer.find(mark, begin)) < 0:
            held = len(self.buffer) - self.at
            if not self._more():
                if held:
                    raise ValueError("the stream ends within a record's head")
                return None
            begin = max(0, held - len(mark) + 1)
        out, self.at = self.buffer[self.at : k + len(mark)], k + len(mark)
        return out

    def take(self, n: int) -> Iterator[bytes]:
        """The next n bytes."""
        while n:
            if self.at == len(self.buffer) and not self._more():
                raise ValueError("the stream ends within a record")
            out = self.buffer[self.at : self.at + n]
            self.at += len(out)
            n -= len(out)
            yield out


def fields_of(head: bytes) -> dict[str, str]:
    """A head's fields by lower-case name."""
    first, *lines = head.decode("utf-8", "replace").split(_END)
    if not first.startswith("WARC/"):
        raise ValueError("not a record")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines) if k}


def rewrite(source, sink, level: int = LEVEL) -> Iterator[dict]:
    """Rewrite a gzip file's records as members of their own; an index entry each."""
    stream, at = Inflated(source), 0
    while (head := stream.until(b"\r\n\r\n")) is not None:
        fields = fields_of(head)
        gz, begin = zlib.compressobj(level, zlib.DEFLATED, 31), at
        at += sink.write(gz.compress(head))
        for piece in stream.take(int(fields["content-length"])):
            at += sink.write(gz.compress(piece))
        if (tail := b"".join(stream.take(4))) != b"\r\n\r\n":
            raise ValueError("a record is longer or shorter than its head says")
        at += sink.write(gz.compress(tail) + gz.flush())
        yield {"offset": begin, "length": at - begin, "id": fields.get("warc-record-id"), "type": fields.get("warc-type"), "uri": fields.get("warc-target-uri"), "digest": fields.get("warc-payload-digest")}


def _place(uri: str) -> tuple[pfs.FileSystem, str]:
    return pfs.FileSystem.from_uri(uri)


_ARCHIVES = "archive string, sidecar string, records long, bytes long, error string"


def normalise(spark: SparkSession, source: str, target: str | None = None, level: int = LEVEL) -> DataFrame:
    """Rewrite the gzip files of a folder; (archive, sidecar, records, bytes, error), a row an archive, written.

    The files are listed by Spark and dealt to tasks by their sizes. `target` is a folder that all executors reach; by default one
    of the session's shared folder.
    """
    target = target or shared_dir(spark) + "/warc"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt = TaskContext.get().taskAttemptId()
        to, folder = _place(target)
        to.create_dir(folder, recursive=True)
        for batch in batches:
            for k, uri in enumerate(batch.column(0).to_pylist()):
                name = f"{folder}/{hashlib.sha256(uri.encode()).hexdigest()[:20]}-{attempt}"
                records, error, last = 0, None, {"offset": 0, "length": 0}
                of, path = _place(uri)
                with of.open_input_stream(path, compression=None) as raw, to.open_output_stream(f"{name}.warc.gz", compression=None) as sink, to.open_output_stream(f"{name}.cdxj") as side:
                    try:
                        for last in rewrite(raw, sink, level):
                            side.write(json.dumps(last).encode() + b"\n")
                            records += 1
                    except (ValueError, KeyError, zlib.error) as e:
                        error = f"{type(e).__name__}: {e}"
                row = (f"{target}/{name.rpartition('/')[2]}.warc.gz", f"{target}/{name.rpartition('/')[2]}.cdxj", records, last["offset"] + last["length"], error)
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()))], names=[c.split()[0] for c in _ARCHIVES.split(", ")])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(source).select("path")
    return materialize(files.mapInArrow(run, _ARCHIVES), "warc_archives")


# Reading -----------------------------------------------------------------------------------------


def _runs(entries: list[dict]) -> Iterator[list[dict]]:
    """Entries whose members follow one another, PIECE bytes or one member at a time."""
    run: list[dict] = []
    for e in entries:
        if run and (run[-1]["offset"] + run[-1]["length"] != e["offset"] or e["offset"] + e["length"] - run[0]["offset"] > PIECE):
            yield run
            run = []
        run.append(e)
    if run:
        yield run


def parse(member: bytes) -> dict:
    """Fields and payload of one member."""
    record = zlib.decompress(member, 31)
    cut = record.index(b"\r\n\r\n") + 4
    fields = fields_of(record[:cut])
    block = memoryview(record)[cut : cut + int(fields["content-length"])]
    if fields.get("content-type", "").startswith("application/http"):
        block = block[bytes(block[: PIECE]).index(b"\r\n\r\n") + 4 :]
    return fields | {"payload": block}


def _bare(uri: str | None) -> str | None:
    return uri.strip("<>").removeprefix("urn:uuid:") if uri else None


_READ = "record_id string, record_type string, source string, target_uri string, payload_bytes long, payload_digest string, declared_digest string, refers_to string"


def read_records(archives: DataFrame, ids: list[str] | None = None, with_payload: bool = False) -> DataFrame:
    """Records of normalised archives, found through their sidecars; with `ids`, only those members are fetched and inflated.

    payload_bytes and payload_digest are of the payload as read, null for revisits; declared_digest is the head's.
    """
    wanted = None if ids is None else frozenset(ids)
    kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()] + [pa.binary()] * with_payload
    names = [c.split()[0] for c in _READ.split(", ")] + ["payload"] * with_payload

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, sidecar, error in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if error:
                    raise ValueError(f"{archive}: {error}")
                of, path = _place(archive)
                with of.open_input_stream(_place(sidecar)[1]) as side:
                    entries = [json.loads(x) for x in side.read().splitlines()]
                if wanted is not None:
                    entries = [e for e in entries if _bare(e["id"]) in wanted]
                rows, held = [], 0
                with of.open_input_file(path) as f:
                    for some in _runs(entries):
                        raw = memoryview(f.read_at(some[-1]["offset"] + some[-1]["length"] - some[0]["offset"], some[0]["offset"]))
                        for e in some:
                            x = parse(raw[(at := e["offset"] - some[0]["offset"]) : at + e["length"]])
                            full = x["warc-type"] != "revisit"
                            row = (_bare(x.get("warc-record-id")), x["warc-type"], x.get("x-source-id"), x.get("warc-target-uri"), len(x["payload"]) if full else None, hashlib.sha256(x["payload"]).hexdigest() if full else None)
                            row += ((x.get("warc-payload-digest") or "").removeprefix("sha256:") or None, _bare(x.get("warc-refers-to")))
                            rows.append(row + (bytes(x["payload"]),) * with_payload)
                            held += len(x["payload"]) * with_payload
                            if len(rows) >= ROWS or held >= 8 * PIECE:
                                yield batch_of(rows)
                                rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    bound_batches(archives.sparkSession)
    # One archive a task: a row is little to read but much to do.
    dealt = archives.select("archive", "sidecar", "error").repartition(max(1, min(archives.count(), 4 * archives.sparkSession.sparkContext.defaultParallelism)))
    return dealt.mapInArrow(run, _READ + ", payload binary" * with_payload).withColumn("source", F.url_decode("source"))


def resolved(records: DataFrame) -> DataFrame:
    """records, each revisit with source, size and digest of the response it refers to: (source, record_type, payload_bytes, payload_digest, refers_to_source).

    Responses that many revisits refer to are broadcast; see `common.with_groups`.
    """
    keep = ["record_id", "record_type", "source", "payload_bytes", "payload_digest", "refers_to"]
    records = materialize(records.select(*keep), "warc_records")
    n = records.where("refers_to is not null").groupBy("refers_to").agg(F.count("*").alias("n"))
    full = records.where("refers_to is null").select(F.col("record_id").alias("refers_to"), F.struct("source", "payload_bytes", "payload_digest").alias("full"))
    targets = materialize(n.join(full, "refers_to").select("refers_to", "n", "full"), "warc_targets")
    out = with_groups(records, targets, "refers_to", "n")
    return out.select(
        "source", "record_type", F.coalesce("payload_bytes", "full.payload_bytes").alias("payload_bytes"), F.coalesce("payload_digest", "full.payload_digest").alias("payload_digest"), F.col("full.source").alias("refers_to_source")
    )
