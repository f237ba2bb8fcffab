"""Bar pages as a data source: one partition a ticker, page after page by its token, from its start on.

``land_pages`` keeps pages as a bar service would hand them out, a folder a page, or a folder some that follow each other, named by the time of
its first bar, so that reading from a start opens no earlier folder. They are written, found and read through
Arrow's file systems (local folders, ``hdfs://``, ``s3://``), since it runs in Python.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition

from tickwise.sources.bars import BAR_KEYS

SCHEMA = "ticker string, " + ", ".join(
    f"{name} {'timestamp' if key == 't' else 'bigint' if key == 'v' else 'double'}" for key, name in BAR_KEYS.items()
)
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
PAGE_BARS = 1000


def land_pages(bars: DataFrame, path: str, order: list[str], size: int = PAGE_BARS, together: int = 1) -> None:
    """Writes each ticker's bars as pages of ``size`` in order, each with the token of the next.

    A folder holds one page as text or, for ``together`` over one, up to so many pages that follow each other, a line each, in one zstd file: then
    neither pages nor folders fill the disk. It is named by its first page. (Spark's JSON reader needs Hadoop's native library for zstd; the data source doesn't.)

    Bars move once, in compressed pieces, to the task of their ticker and month, where they are sorted and pages are written as they come to be,
    each file under its final name in one step, so that a repeated task writes the same file again and the driver has no folder to move. Only the pages
    at a month's ends, which may go on in another month, move on as text to be put together.
    """
    bar = F.to_json(F.struct(*[F.col(name).alias(key) for key, name in BAR_KEYS.items()]), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"})
    values = [c for c in BAR_KEYS.values() if c not in order]
    rows = bars.select("ticker", *order, *values, F.trunc("market_ts", "month").alias("_month"))
    counts = rows.groupBy("ticker", "_month").agg(F.count(F.lit(1)).alias("_count"))
    earlier = Window.partitionBy("ticker").orderBy("_month").rowsBetween(Window.unboundedPreceding, -1)
    # a row before the first of each month says how many bars the ticker has in the months before
    offsets = counts.select("ticker", "_month", F.coalesce(F.sum("_count").over(earlier), F.lit(0)).alias("_offset"))
    dealt = dealt_out(rows.unionByName(offsets, allowMissingColumns=True), ["ticker", "_month"])
    # rows that are equal in all of these are equal pages, whichever comes first in a repeated task
    placed = dealt.sortWithinPartitions("ticker", "_month", F.col("_offset").asc_nulls_last(), *order, *values)
    name = f"part-{uuid.uuid4().hex}.txt{'.zst' if together > 1 else ''}"

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Writes pages that begin and end in a month, and hands on the first and last page of each."""
        pages = PageWriter(path, name, size, together)
        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in ("ticker", "_offset", "_at", "_bar")]):
                pages.add(*row)
            yield pages.ends()
        pages.end_month()
        yield pages.ends()

    def put_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pages, count = PageWriter(path, name, size, together), 0
        for batch in batches:
            for ticker, page, text, following in zip(*[batch.column(c).to_pylist() for c in ("ticker", "page", "bars", "following")]):
                pages.write(ticker, page, [page_text(ticker, text, following)])
                count += 1
        yield pa.RecordBatch.from_pydict({"pages": pa.array([count], pa.int64())})

    ends = placed.select("ticker", "_offset", F.unix_micros("market_ts").alias("_at"), bar.alias("_bar")).mapInArrow(put, ENDS)
    parts = F.transform(F.array_sort(F.collect_list(F.struct("n", "bars"))), lambda x: x["bars"])
    merged = ends.groupBy("ticker", "number").agg(F.array_join(parts, ",").alias("bars"), F.min("first").alias("_first"), F.max("following").alias("_known"))
    named = merged.withColumn("page", F.format_string("%020d-%d", "_first", "number"))
    # where the next page isn't known it begins in another month, as the first there
    along = Window.partitionBy("ticker").orderBy("number")
    following = F.coalesce("_known", F.when(F.lead("number").over(along) == F.col("number") + 1, F.lead("page").over(along)))
    named.select("ticker", "page", "bars", following.alias("following")).mapInArrow(put_ends, "pages long").agg(F.sum("pages")).first()


#: The first and last page of each month: ``n`` is the place of its first bar, ``following`` the next page's token where it begins in that month.
ENDS = "ticker string, number long, n long, first long, following string, bars string"
#: Parts of the rows' keys, and rows that are packed at a time.
PARTS, PACKED_ROWS = 1024, 400_000


def dealt_out(df: DataFrame, keys: list[str]) -> DataFrame:
    """The rows, those of a key in one partition; what moves is packed by column and compressed, which takes about half the disk of rows."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for table in gathered(batches, PACKED_ROWS):
            part = table["_part"].to_numpy()
            order = np.argsort(part, kind="stable")
            rows, part = table.drop_columns(["_part"]).take(pa.array(order)).combine_chunks(), part[order]
            at = [*np.flatnonzero(np.diff(part, prepend=-1)).tolist(), len(part)]
            raw = [rows.slice(a, b - a).to_batches() for a, b in zip(at, at[1:])]
            packs, codec = [_stream(rows.schema, x) for x in raw], pa.Codec("zstd", 6)
            columns = [pa.array(part[at[:-1]], pa.int32()), pa.array([x.size for x in packs], pa.int64()), pa.array([codec.compress(x, asbytes=True) for x in packs], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["_part", "_bytes", "_pack"])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, packed in zip(batch.column("_bytes").to_pylist(), batch.column("_pack")):
                with pa.ipc.open_stream(pa.decompress(packed.as_buffer(), size, "zstd")) as stream:
                    yield from stream

    part = F.pmod(F.xxhash64(*keys), F.lit(PARTS)).cast("int")
    packed = df.withColumn("_part", part).mapInArrow(pack, "_part int, _bytes long, _pack binary")
    return packed.repartition("_part").mapInArrow(unpack, df.schema)


def gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Tables of about so many rows."""
    held, count = [], 0
    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count >= rows:
            yield pa.Table.from_batches(held)
            held, count = [], 0
    if count:
        yield pa.Table.from_batches(held)


def _stream(schema: pa.Schema, batches: list[pa.RecordBatch]) -> pa.Buffer:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, schema) as stream:
        for batch in batches:
            stream.write_batch(batch)
    return sink.getvalue()


def page_text(ticker: str | None, bars: str, following: str | None) -> str:
    token = "null" if following is None else f'"{following}"'
    return f'{{"bars":{{{json.dumps(ticker, ensure_ascii=False)}:[{bars}]}},"next_page_token":{token}}}'


class PageWriter:
    """Cuts a month's bars, which come in order, into pages and writes all but the month's first and last."""

    def __init__(self, path: str, name: str, size: int, together: int):
        self.system, self.root = file_system(path)
        self.name, self.size, self.together = name, size, together
        self.handed: list[tuple] = []
        self.open = False

    def add(self, ticker: str | None, offset: int | None, at: int | None, bar: str) -> None:
        if offset is not None:
            self.end_month()
            self.open, self.ticker, self.n = True, ticker, offset
            self.first_number, self.number, self.place, self.bars, self.ats, self.before, self.run = offset // self.size, offset // self.size, offset, [], [], None, []
            return
        if self.n // self.size != self.number:
            self._end_page()
            self.number, self.place, self.bars, self.ats = self.n // self.size, self.n, [], []
        self.bars.append(bar)
        if at is not None:
            self.ats.append(at)
        self.n += 1

    def _end_page(self) -> None:
        """The page is kept until the first time of the next is known."""
        first = min(self.ats, default=None)
        token = f"{'null' if first is None else format(first, '020d'):>20}-{self.number}"
        self._hand_on(token)
        self.before = (self.number, self.place, first, token, ",".join(self.bars))

    def _hand_on(self, following: str | None) -> None:
        if self.before is None:
            return
        number, place, first, token, text = self.before
        if number == self.first_number or following is None:
            self.handed.append((self.ticker, number, place, first, following, text))
            return
        self.run.append((token, page_text(self.ticker, text, following)))
        if len(self.run) == self.together:
            self._write_run()

    def _write_run(self) -> None:
        if self.run:
            self.write(self.ticker, self.run[0][0], [text for _, text in self.run])
            self.run = []

    def end_month(self) -> None:
        if self.open and self.bars:
            self._end_page()
            self._hand_on(None)
            self._write_run()
        self.open = False

    def ends(self) -> pa.RecordBatch:
        """What is to be put together with pages of other months."""
        types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
        columns = zip(*self.handed) if self.handed else [[] for _ in types]
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["ticker", "number", "n", "first", "following", "bars"])
        self.handed = []
        return batch

    def write(self, ticker: str | None, page: str, texts: list[str]) -> None:
        """A file, put under its name when it is whole."""
        from pyarrow import fs

        folder = f"{self.root}/{part_folder('ticker', ticker)}/{part_folder('page', page)}"
        self.system.create_dir(folder, recursive=True)
        own = f"{folder}/.{self.name}.{uuid.uuid4().hex}" if isinstance(self.system, fs.LocalFileSystem | fs.HadoopFileSystem) else f"{folder}/{self.name}"
        data = "".join(f"{x}\n" for x in texts).encode()
        with self.system.open_output_stream(own, compression=None) as stream:
            stream.write(pa.Codec("zstd", 1).compress(data) if self.together > 1 else data)
        if own != f"{folder}/{self.name}":
            self.system.move(own, f"{folder}/{self.name}")


def file_system(path: str):
    """Arrow's file system of a path, and the path within it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


#: What Spark writes as %XX in the names of partition folders, beside control characters.
ESCAPED = frozenset("\"#%'*/:=?\\\x7f{[]^")


def part_folder(column: str, value: str | None) -> str:
    """The name of a partition's folder, as Spark writes it."""
    name = "".join(f"%{ord(c):02X}" if c in ESCAPED or ord(c) < 32 else c for c in value or "")
    return f"{column}={name or '__HIVE_DEFAULT_PARTITION__'}"


class TickerPages(InputPartition):
    """A ticker's pages from a time on, in microseconds."""

    def __init__(self, ticker: str, start: int):
        super().__init__((ticker, start))
        self.ticker, self.start = ticker, start


class PageReader(DataSourceReader):
    def __init__(self, path: str, starts: dict[str, int], earliest: int):
        self.path, self.starts, self.earliest = path, starts, earliest
        self.tickers: set[str] | None = None

    def partitions(self) -> list[InputPartition]:
        chosen = self.starts if self.tickers is None else {t: s for t, s in self.starts.items() if t in self.tickers}
        return [TickerPages(t, max(s, self.earliest)) for t, s in sorted(chosen.items())]

    def read(self, partition: TickerPages) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, root = file_system(self.path)
        folder = f"{root}/{part_folder('ticker', partition.ticker)}"
        pages = sorted(x.base_name.removeprefix("page=") for x in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)))
        # the last page that begins before the start may hold bars after it
        token = max((p for p in pages if int(p.split("-")[0]) < partition.start), default=pages[0] if pages else None)
        while token is not None:
            bars = []
            for page in self._pages(system, f"{folder}/page={token}"):
                bars += [bar for found in (page["bars"] or {}).values() for bar in found]
                token = page["next_page_token"]
            at = _times([bar["t"] for bar in bars])
            columns = [at if key == "t" else pa.array([bar.get(key) for bar in bars], field.type) for key, field in zip(BAR_KEYS, list(ARROW)[1:])]
            read = pa.RecordBatch.from_arrays([pa.array([partition.ticker] * len(bars), pa.string()), *columns], schema=ARROW)
            kept = read.filter(pc.greater_equal(at.cast(pa.int64()), partition.start))
            if kept.num_rows:
                yield kept

    def _pages(self, system, folder: str) -> list[dict]:
        """The pages of a folder, which follow each other."""
        from pyarrow import fs

        files = [x.path for x in system.get_file_info(fs.FileSelector(folder)) if x.base_name.startswith("part-")]
        with system.open_input_stream(files[0]) as stream:
            return [json.loads(line) for line in stream.read().splitlines()]


class FilteringPageReader(PageReader):
    """A reader that leaves out tickers and pages by the query's conditions."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Tickers choose partitions, and a least time raises their starts; Spark checks the rows all the same."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("ticker",):
                chosen = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.tickers = chosen if self.tickers is None else self.tickers & chosen
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)) and f.attribute == ("market_ts",):
                self.earliest = max(self.earliest, _micros(f.value))
            yield f


ARROW = pa.schema([("ticker", pa.string()), *[(name, pa.timestamp("us", "UTC") if key == "t" else pa.int64() if key == "v" else pa.float64()) for key, name in BAR_KEYS.items()]])


def _value(key: str, value):
    return datetime.fromisoformat(value.replace("Z", "+00:00")) if key == "t" and value is not None else value


def _times(texts: list[str]) -> pa.Array:
    try:
        return pa.array(texts, pa.string()).cast(pa.timestamp("us", "UTC"))
    except pa.ArrowInvalid:  # more digits than microseconds
        return pa.array([_value("t", x) for x in texts], pa.timestamp("us", "UTC"))


def _micros(at: datetime) -> int:
    at = at.replace(tzinfo=timezone.utc) if at.tzinfo is None else at
    since = at - datetime.fromtimestamp(0, timezone.utc)
    return (since.days * 86_400 + since.seconds) * 1_000_000 + since.microseconds


class BarPages(DataSource):
    """Format ``bar_pages`` with options ``path``, ``starts`` (a JSON object of tickers and microseconds) and ``pushdown``."""

    @classmethod
    def name(cls) -> str:
        return "bar_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        kind = FilteringPageReader if self.options.get("pushdown") == "true" else PageReader
        return kind(self.options["path"], json.loads(self.options["starts"]), -(1 << 62))


def read_bars(spark: SparkSession, path: str, starts: DataFrame, pushdown: bool = False) -> DataFrame:
    """The bars of each ticker of ``starts`` (ticker, start) from its start on.

    The universe is a configured list of a few hundred tickers, which the driver holds; a
    ticker without pages gives no rows. ``pushdown`` lets conditions on ticker and time choose pages; Spark keeps them for every
    use of the frame in a plan, so it is for frames that a plan uses once.
    """
    spark.dataSource.register(BarPages)
    if pushdown:
        spark.conf.set(PUSHDOWN, "true")
    found = starts.select("ticker", F.unix_micros("start").alias("start")).collect()
    options = {"path": path, "starts": json.dumps({r.ticker: r.start for r in found}), "pushdown": str(pushdown).lower()}
    return spark.read.format("bar_pages").options(**options).load()
