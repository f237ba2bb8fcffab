"""WARC archives: writing captures, reading records back, and assembling each capture's transaction."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickwise.llm.common import small_batches, stage, text_or_empty

END = "\r\n"
MARK = "WARC/1."
BASE32_OF_CONV, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
SAME_DIGEST = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = (
    "archive string, type string, record_id string, concurrent_to array<string>, refers_to string, uri string, date string, "
    "digest string, headers string, body binary, body_bytes long, truncated boolean"
)


def sha1_base32(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1 (20 bytes are four groups of 40 bits, so there is no padding)."""
    digest = F.upper(F.sha1(payload))
    groups = [F.lpad(F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*groups), BASE32_OF_CONV, BASE32)


# --- writing ----------------------------------------------------------------


def _record(kind: str, headers: list[tuple[str, Column]], block: Column) -> Column:
    """One record but for its closing blank lines. Headers that are null are left out, line ends in them are escaped."""
    lines = [F.lit(f"{MARK}1{END}WARC-Type: {kind}{END}")]
    for name, value in [*headers, ("Content-Length", F.octet_length(block).cast("string"))]:
        safe = F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
        lines.append(F.coalesce(F.concat(F.lit(f"{name}: "), safe, F.lit(END)), F.lit("")))
    return F.concat(*lines, F.lit(END), block)


def captures(pages: DataFrame, key: str, url: str, payload: str, least_bytes: int = 0) -> DataFrame:
    """One column ``value`` with the records of each page: a response or revisit, its request and its metadata.

    Of pages with equal payloads of at least ``least_bytes`` bytes, that with the
    largest key holds the payload, the others are revisits that refer to it and carry the HTTP headers
    alone. Payloads are compared by digest and length; only digests that occur more than once are
    looked up, and they are counted where they are read, so one payload may fill any share of the pages. Null payloads count as empty,
    null urls leave the header out.
    """
    rows = pages.select(F.col(key).cast("string").alias("key"), F.col(key).alias("rank"), F.col(url).alias("url"), text_or_empty(payload).alias("payload"))
    rows = rows.withColumn("digest", sha1_base32(F.col("payload"))).withColumn("size", F.octet_length("payload").cast("long"))
    repeated = (
        rows.filter(F.col("size") >= least_bytes).groupBy(F.col("digest").alias("d"), F.col("size").alias("s"))
        .agg(F.max("rank").alias("holder"), F.count("*").alias("n")).filter("n > 1").select("d", "s", "holder")
    )
    # stored first, so that its size is known: if it is small, no payload moves
    repeated = stage(repeated, "warc-repeated")
    rows = rows.join(repeated, (F.col("digest") == F.col("d")) & (F.col("size") == F.col("s")), "left")
    key_ = F.coalesce(F.col("key"), F.lit("null"))
    name = lambda part, k=key_: F.concat(F.lit("<urn:page:"), k, F.lit(f":{part}>"))
    revisits = F.col("holder").isNotNull() & ~F.col("rank").eqNullSafe(F.col("holder"))
    common = [("WARC-Target-URI", F.col("url")), ("WARC-Date", F.lit("2024-01-01T00:00:00Z"))]
    digest = F.concat(F.lit("sha1:"), F.col("digest"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.col("size").cast("string"), F.lit(END + END))
    answer = [("WARC-Record-ID", name("response")), *common, ("WARC-Payload-Digest", digest), ("Content-Type", F.lit("application/http;msgtype=response"))]
    response = _record("response", answer, F.concat(http, F.col("payload")))
    refers = [("WARC-Profile", F.lit(SAME_DIGEST)), ("WARC-Refers-To", name("response", F.col("holder").cast("string")))]
    revisit = _record("revisit", answer[:-1] + refers + answer[-1:], http)
    beside = ("WARC-Concurrent-To", name("response"))
    request = _record(
        "request",
        [("WARC-Record-ID", name("request")), beside, *common, ("Content-Type", F.lit("application/http;msgtype=request"))],
        F.concat(F.lit(f"GET / HTTP/1.1{END}"), F.lit(END)),
    )
    about = F.concat(F.lit("page-id: "), key_, F.lit(f"{END}payload-bytes: "), F.col("size").cast("string"), F.lit(END))
    metadata = _record(
        "metadata", [("WARC-Record-ID", name("metadata")), ("WARC-Concurrent-To", name("request")), *common, ("Content-Type", F.lit("application/warc-fields"))], about
    )
    end = F.lit(END + END)
    return rows.select(F.concat(F.when(revisits, revisit).otherwise(response), end, request, end, metadata).alias("value"))


def write_archives(records: DataFrame, path: str) -> None:
    """Writes one gzip archive per task; Spark's committer keeps a retried task from leaving a second one."""
    records.write.option("lineSep", END + END).option("compression", "gzip").text(path)


# --- reading ----------------------------------------------------------------


def _length(value: str | None) -> int | None:
    """A length as headers give it; None if it isn't one."""
    return int(value) if value is not None and value.isascii() and value.strip().isdigit() else None


def _parsed(archive: str, data: bytes, cut: bool) -> dict:
    """``data`` follows the mark: minor version, header lines, an empty line, and the block.

    A record without a readable length is truncated; its block is what there is up to the next record.
    """
    head, _, rest = data.partition(b"\r\n\r\n")
    fields: dict[str, list[str]] = {}
    for line in head.decode("utf-8", "replace").split(END)[1:]:
        name, _, value = line.partition(":")
        fields.setdefault(name.strip().lower(), []).append(value.strip())
    one = lambda name: fields.get(name, [None])[0]
    length = _length(one("content-length"))
    block = rest[:length] if length is not None else rest.removesuffix(b"\r\n\r\n")
    headers, body, size = "", block, None
    if (one("content-type") or "").startswith("application/http"):
        top, _, body = block.partition(b"\r\n\r\n")
        headers = top.decode("utf-8", "replace")
        if one("warc-type") == "revisit":
            size = next((_length(x.split(":")[1].strip()) for x in headers.lower().split(END) if x.startswith("content-length:")), None)
    return {
        "archive": archive,
        "type": one("warc-type"),
        "record_id": one("warc-record-id"),
        "concurrent_to": fields.get("warc-concurrent-to", []),
        "refers_to": one("warc-refers-to"),
        "uri": one("warc-target-uri"),
        "date": one("warc-date"),
        "digest": one("warc-payload-digest"),
        "headers": headers,
        "body": body,
        "body_bytes": len(body) if size is None else size,
        "truncated": cut or length is None,
    }


def _complete(data: bytes) -> bool:
    head, found, rest = data.partition(b"\r\n\r\n")
    if not found:
        return False
    lines = head.decode("utf-8", "replace").lower().split(END)
    length = next((_length(x.split(":")[1].strip()) for x in lines if x.startswith("content-length:")), None)
    return length is None or len(rest) >= length


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives below ``path``, in any store that Spark reads.

    Archives are read in pieces that begin at the version mark, in order, so no archive is held
    whole. Where a block holds the mark itself, pieces are put together until the
    record's Content-Length is reached. Compressed archives aren't split, so
    all pieces are at hand; pieces of others are brought together first, an archive a task. An archive that ends within a record gives that record as ``truncated``.
    ``body`` is the payload behind the HTTP headers, or the block; ``body_bytes`` of a revisit is what its headers say.
    """

    def records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [x.split()[0] for x in RECORD.split(", ")]
        archive, held = None, None
        for batch in batches:
            out, size = [], 0
            for name, piece in zip(batch["archive"], batch["piece"]):
                piece = bytes(piece)
                if name != archive:
                    if held is not None:
                        out.append(_parsed(archive, held, True))
                    archive, held = name, None
                    if not piece:
                        continue
                held = piece if held is None else held + MARK.encode() + piece
                if _complete(held):
                    out.append(_parsed(archive, held, False))
                    size += len(held)
                    held = None
                if size > 1 << 24:
                    yield pd.DataFrame(out, columns=columns)
                    out, size = [], 0
            if out:
                yield pd.DataFrame(out, columns=columns)
        if held is not None:
            yield pd.DataFrame([_parsed(archive, held, True)], columns=columns)

    small_batches(spark)
    lines = spark.read.option("lineSep", MARK).text(path)
    name = F.col("_metadata.file_path")
    packed = F.lit(False)
    for ending in COMPRESSED:
        packed = packed | F.endswith(F.lower(name), F.lit(ending))
    piece = F.col("value").cast("binary").alias("piece")
    whole = lines.filter(packed).select(name.alias("archive"), piece)
    split = lines.filter(~packed).select(name.alias("archive"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("line"), piece)
    joined = split.repartition("archive").sortWithinPartitions("archive", "start", "line").select("archive", "piece")
    return whole.mapInPandas(records, RECORD).unionByName(joined.mapInPandas(records, RECORD))


#: Endings of archives that can't be split.
COMPRESSED = (".gz", ".bz2", ".zst", ".xz", ".lz4", ".snappy")


# --- transactions -----------------------------------------------------------

ANCHORS = ("response", "revisit", "resource")


def assemble(records: DataFrame, part: int = 64) -> DataFrame:
    """One nested row per capture: (capture, part, response, requests, metadata).

    The response, revisit or resource record is the capture. Others, of any type but warcinfo, belong to it if their
    WARC-Concurrent-To names it, if its own names them, or if theirs names a record that belongs
    to it, over any number of steps; a record that belongs nowhere is a capture without response, and records without an id are
    one. ``requests`` has the requests and ``metadata`` all other companions. Repeated companions count once; repeated
    responses are a row each. A capture with more than ``part`` companions goes on in further rows
    (part 1, 2, ... without response), so that a row and its group stay small whatever is concurrent to one record.
    ``records`` is read several times and should be stored.
    """
    anchors = records.filter(F.col("type").isin(*ANCHORS))
    others = records.filter(~F.coalesce(F.col("type").isin(*ANCHORS, "warcinfo"), F.lit(False)))
    ids = anchors.select(F.col("record_id").alias("capture")).distinct()
    named = others.select(F.col("record_id").alias("id"), F.explode("concurrent_to").alias("to")).distinct()
    direct = named.join(ids, F.col("to") == F.col("capture")).select("id", "capture")
    back = anchors.select(F.explode("concurrent_to").alias("id"), F.col("record_id").alias("capture"))
    near = direct.unionByName(back).distinct()
    belongs = reached = stage(near, "warc-near")
    while not reached.isEmpty():
        far = named.alias("n").join(reached.alias("m"), F.col("n.to") == F.col("m.id")).select("n.id", "m.capture").distinct()
        reached = stage(far.join(belongs, ["id", "capture"], "left_anti"), "warc-far")
        belongs = belongs.unionByName(reached)

    detail = F.struct("type", "record_id", "uri", "date", "headers", "body", "body_bytes", "truncated")
    known = others.select(F.col("record_id").alias("rid"), detail.alias("record"))
    placed = known.join(belongs, F.col("rid") == F.col("id"), "left").withColumn("capture", F.coalesce("capture", "rid"))
    counts = placed.groupBy("capture").agg(F.ceil(F.count("*") / F.lit(part)).alias("parts"))
    counts = counts.withColumnRenamed("capture", "of")
    which = F.xxhash64("rid", "record.type", "record.uri", "record.body")
    numbered = placed.join(counts, F.col("capture").eqNullSafe(F.col("of"))).withColumn("part", F.pmod(which, F.col("parts")).cast("int"))
    asks = F.coalesce(F.col("record.type") == "request", F.lit(False))
    of = lambda kind: F.array_sort(F.collect_set(F.when(kind, F.col("record"))))
    grouped = numbered.groupBy("capture", "part").agg(of(asks).alias("requests"), of(~asks).alias("metadata"))

    answer = F.struct("type", "record_id", "refers_to", "uri", "date", "digest", "headers", "body", "body_bytes", "truncated")
    first = anchors.select(F.col("record_id").alias("rid"), answer.alias("response"))
    whole = grouped.filter("part = 0").join(first, F.col("capture") == F.col("rid"), "full")
    nothing = F.array().cast(grouped.schema["requests"].dataType)
    whole = whole.select(
        F.coalesce("capture", "rid").alias("capture"), F.lit(0).alias("part"), "response",
        F.coalesce("requests", nothing).alias("requests"), F.coalesce("metadata", nothing).alias("metadata"),
    )
    rest = grouped.filter("part > 0").select("capture", "part", F.lit(None).cast(whole.schema["response"].dataType).alias("response"), "requests", "metadata")
    return whole.unionByName(rest)
