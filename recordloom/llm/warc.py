"""WARC archives of captures, their index, and capture histories in global order.

1. Each task writes one archive, a gzip member per record. Captures with the payload
   of another are revisit records that refer to it. Beside the archive it hands over
   its index as runs: at most RUN captures, sorted by URL key, time and id, cut into
   blocks of BLOCK entries.
2. The runs are merged externally. Blocks are cut into parts by the order of their
   first entries, and a block goes to every part its entries may reach into. A part
   then is one merge: the blocks of each run in turn, the runs against each other in
   a loser tree, entries outside the part's bounds left to its neighbours. At most
   FAN_IN runs meet in a merge; more runs take further rounds. A URL with very many
   captures is cut by time like any other part of the order.
3. Readers fetch records from the archives at the places the index gives.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import date

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.functions.joins import lookup_join
from recordloom.functions.ranking import number_rows
from recordloom.llm.records import opened
from recordloom.llm.shared import column, slices, small_batches
from recordloom.session import materialise, new_folder

RUN = 100_000  # captures sorted at once by the task that wrote them
BLOCK = 64  # index entries in a block
PART = 64  # blocks that start in a part
FAN_IN = 32  # runs that are merged at once
PART_BITS = 32  # a merged block's number is its part's, shifted, and its place in it
PARTS_AT_ONCE = 4096  # parts whose sizes are added up together
SEGMENT = 8 << 20  # bytes of an archive that are read at once
NO_ID = -(1 << 63)  # stands for a null id
PAGE = "urn:x-page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: The order of the histories; no two captures are equal in all of it.
PLACE = ("url_key", "captured", "page_id", "archive", "place")
_PLACE = "url_key: string, captured: bigint, page_id: bigint, archive: string, place: bigint"
BLOCK_ROW = (
    f"run bigint, block bigint, low struct<{_PLACE}>, entries array<struct<{_PLACE}, length: bigint>>"
)
_LOW = [
    ("url_key", pa.string()), ("captured", pa.int64()), ("page_id", pa.int64()),
    ("archive", pa.string()), ("place", pa.int64()),
]
_BLOCK_ROW = pa.schema(
    [
        ("run", pa.int64()), ("block", pa.int64()), ("low", pa.struct(_LOW)),
        ("entries", pa.list_(pa.struct([*_LOW, ("length", pa.int64())]))),
    ]
)


def url_key(url: Column) -> Column:
    """Host labels in reverse order, then the path and query: pages of a site, and
    sites of a domain, are neighbours. A URL without a host is its own key; a null
    one is empty."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    rest = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1)
    turned = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest)
    return F.coalesce(F.when(host == "", url).otherwise(turned), F.lit(""))


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _header_value(text: str) -> str:
    """A value that stays on its line: control characters, spaces and what is not
    ASCII are percent-encoded."""
    return "".join(chr(b) if 32 < b < 127 else f"%{b:02X}" for b in text.encode("utf-8", "surrogatepass"))


def _date(seconds: int) -> str:
    days, rest = divmod(seconds, 86_400)
    # Python's dates end at the year 9999.
    day = date.fromordinal(max(1, min(719_163 + days, date.max.toordinal())))
    return f"{day.isoformat()}T{rest // 3600:02d}:{rest // 60 % 60:02d}:{rest % 60:02d}Z"


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{name}: {value}" for name, value in fields), f"Content-Length: {len(block)}"]
    head = "\r\n".join(lines).encode() + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head + block + b"\r\n\r\n") + packer.flush()


def _info_record(name: str) -> bytes:
    body = b"software: recordloom\r\nformat: WARC File Format 1.1\r\n"
    fields = [
        ("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<{PAGE}info:{name}>"),
        ("WARC-Filename", name), ("WARC-Date", _date(0)), ("Content-Type", "application/warc-fields"),
    ]
    return _record(fields, body)


def capture_record(
    page_id: int | None, url: str | None, captured: int, payload: bytes, refers_to: int | None
) -> bytes:
    """A response record, or a revisit of the response of page ``refers_to``. A
    revisit has the HTTP head of its own capture but no payload."""
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    shown = "" if page_id is None else str(page_id)
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<{PAGE}{shown}>"),
        ("WARC-Date", _date(captured)),
        ("WARC-Payload-Digest", f"sha1:{digest_of(payload)}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if url is not None:
        fields.insert(3, ("WARC-Target-URI", _header_value(url)))
    if refers_to is not None:
        fields += [("WARC-Refers-To", f"<{PAGE}{refers_to}>"), ("WARC-Profile", PROFILE)]
    return _record(fields, http if refers_to is not None else http + payload)


def _head(data: bytes) -> tuple[dict[str, str], bytes]:
    """The fields of a header, and what follows it."""
    head, found, rest = data.partition(b"\r\n\r\n")
    if not found:
        raise ValueError("a header does not end")
    lines = head.decode().split("\r\n")
    return {n.lower(): v.strip() for n, _, v in (x.partition(":") for x in lines[1:])}, rest


def _page(value: str) -> int | None:
    shown = value.strip("<>").removeprefix(PAGE)
    return int(shown) if shown else None


def read_record(data: bytes) -> dict:
    """What a record of this module's archives holds; a damaged one raises."""
    unpacker = zlib.decompressobj(31)
    fields, rest = _head(unpacker.decompress(data) + unpacker.flush())
    length = int(fields["content-length"])
    if not unpacker.eof or len(rest) != length + 4:
        raise ValueError("a record is cut")
    http, payload = _head(rest[:length])
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    size = int(http["content-length"])
    kind = fields["warc-type"]
    if kind == "response" and (digest_of(payload) != digest or len(payload) != size):
        raise ValueError("a payload does not fit its digest")
    return {
        "page_id": _page(fields["warc-record-id"]),
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": _page(fields["warc-refers-to"]) if kind == "revisit" else None,
        "html": payload if kind == "response" else None,
    }


def _order(entry: dict) -> tuple:
    return tuple(entry[name] for name in PLACE)


def _block_rows(run: int, entries: list[dict], first: int = 0) -> pa.RecordBatch:
    """Sorted entries as block rows."""
    blocks = [entries[at : at + BLOCK] for at in range(0, len(entries), BLOCK)]
    rows = [
        {"run": run, "block": first + at, "low": {k: x[0][k] for k in PLACE}, "entries": x}
        for at, x in enumerate(blocks)
    ]
    return pa.RecordBatch.from_pylist(rows, _BLOCK_ROW)


def _writer(folder: str, most: int):
    def run(batches) -> Iterator[pa.RecordBatch]:
        files, path = opened(folder)
        part = TaskContext.get().partitionId()
        # A name of its own for every attempt: only the one whose rows are kept counts.
        name = f"part-{part:06d}-{uuid.uuid4().hex}.warc.gz"
        out, place, entries, runs = None, 0, [], 0

        def sorted_run():
            return _block_rows((part << 20) + runs, sorted(entries, key=_order))

        try:
            for batch in batches:
                for row in (x for some in slices(batch) for x in some.to_pylist()):
                    if out is None:
                        files.create_dir(path, recursive=True)
                        out = files.open_output_stream(f"{path}/{name}", compression=None)
                        head = _info_record(name)
                        out.write(head)
                        place = len(head)
                    record = capture_record(
                        row["page_id"], row["url"], row["captured"], row["payload"], row["refers_to"]
                    )
                    out.write(record)
                    entries.append(
                        {
                            "url_key": row["url_key"], "captured": row["captured"],
                            "page_id": NO_ID if row["page_id"] is None else row["page_id"],
                            "archive": name, "place": place, "length": len(record),
                        }
                    )
                    place += len(record)
                    if len(entries) == most:
                        yield sorted_run()
                        runs, entries = runs + 1, []
        finally:
            if out is not None:
                out.close()
        if entries:
            yield sorted_run()

    return run


def write_archives(
    pages: DataFrame,
    folder: str,
    captured: Column | None = None,
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
    run: int = RUN,
) -> DataFrame:
    """Write one archive per task and return the index runs as stored block rows.

    The payload is the html in UTF-8, a null one is empty. Of the captures with equal
    payloads those with the smallest id are responses (a null id only where all are
    null); the others are revisits of it. ``captured`` is the capture time in seconds
    (default 0; null counts as 0). Only payloads that occur more than once are looked
    up, by SHA-256; the pages themselves move only if those are too many to broadcast.
    """
    small_batches(pages.sparkSession)
    when = F.lit(0) if captured is None else F.coalesce(captured.cast("bigint"), F.lit(0))
    rows = pages.select(
        column(page_id).cast("bigint").alias("page_id"),
        column(url).cast("string").alias("url"),
        F.coalesce(column(html).cast("string"), F.lit("")).cast("binary").alias("payload"),
        when.cast("bigint").alias("captured"),
    )
    rows = rows.withColumn("url_key", url_key(F.col("url"))).withColumn("_sha", F.sha2("payload", 256))
    repeated = (
        rows.groupBy(F.unhex("_sha").alias("_sha"))
        .agg(F.min("page_id").alias("_first"), F.count("*").alias("_times"))
        .filter("_times > 1 and _first is not null")
        .select("_sha", "_first")
    )
    rows = rows.withColumn("_sha", F.unhex("_sha"))
    placed = lookup_join(rows, repeated, ["_sha"], "left", ["page_id", "url"])
    known = placed.select(
        "page_id", "url", "url_key", "captured", "payload",
        F.when(~F.col("page_id").eqNullSafe(F.col("_first")), F.col("_first")).alias("refers_to"),
    )
    return materialise(known.mapInArrow(_writer(folder, run), BLOCK_ROW), "index-runs")


class LoserTree:
    """Merges sorted streams. Every inner node remembers the loser of its match, so
    the next winner takes one comparison a level on the path of the last one."""

    def __init__(self, streams: list[Iterator[dict]]):
        self.streams = streams
        self.size = 1
        while self.size < len(streams):
            self.size *= 2
        self.heads = [self._next(at) for at in range(self.size)]
        self.losers = [0] * self.size
        self.winner = self._play(1)

    def _next(self, at: int) -> tuple | None:
        """The stream's next entry behind its order; nothing when it has ended."""
        entry = next(self.streams[at], None) if at < len(self.streams) else None
        return None if entry is None else (_order(entry), at, entry)

    def _before(self, one: int, other: int) -> bool:
        """Whether the head of stream ``one`` comes first; ended streams come last,
        equal heads in the order of their streams."""
        a, b = self.heads[one], self.heads[other]
        if a is None or b is None:
            return a is not None or (b is None and one < other)
        return a[:2] < b[:2]

    def _play(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        one, other = self._play(2 * node), self._play(2 * node + 1)
        if not self._before(one, other):
            one, other = other, one
        self.losers[node] = other
        return one

    def __iter__(self) -> Iterator[dict]:
        while self.heads[self.winner] is not None:
            yield self.heads[self.winner][2]
            at = self.winner
            self.heads[at] = self._next(at)
            node = (at + self.size) // 2
            while node:
                if self._before(self.losers[node], at):
                    self.losers[node], at = at, self.losers[node]
                node //= 2
            self.winner = at


def _stream(blocks: list[dict], low: tuple, high: tuple | None) -> Iterator[dict]:
    """Entries of one run's blocks between the bounds, block after block."""
    for block in blocks:
        for entry in block["entries"]:
            place = _order(entry)
            if low <= place and (high is None or place < high):
                yield entry


def merge_part(blocks: list[dict]) -> list[dict]:
    """The entries of one part in order; its blocks come sorted by run and block."""
    runs: dict[int, list[dict]] = {}
    for block in blocks:
        runs.setdefault(block["run"], []).append(block)
    low = _order(blocks[0]["from"])
    high = blocks[0]["to"] and _order(blocks[0]["to"])
    return list(LoserTree([_stream(x, low, high) for x in runs.values()]))


def _merger(batches) -> Iterator[pa.RecordBatch]:
    """Parts arrive one after the other; what a part gives is bounded by PART."""
    held: list[dict] = []

    def merged() -> pa.RecordBatch:
        # Part numbers ascend with the order, so they number the new run's blocks.
        return _block_rows(held[0]["group"], merge_part(held), held[0]["part"] << PART_BITS)

    for batch in batches:
        for row in batch.to_pylist():
            if held and row["part"] != held[0]["part"]:
                yield merged()
                held = []
            held.append(row)
    if held:
        yield merged()


def merge_runs(runs: DataFrame, fan_in: int = FAN_IN, part: int = PART) -> DataFrame:
    """One round: every ``fan_in`` runs become one, as stored block rows of the new run.

    The first and last entries of all blocks are put in one order, which is cut into
    parts; a block goes to the parts from that of its first entry to that of its
    last. No task sees more than the blocks that start or end in its part and, of
    each run of its group, one block that spans it.
    """
    names = number_rows(runs.select("run").distinct(), ["run"], "_no")
    grouped = names.select("run", F.expr(f"(_no - 1) div {fan_in}").alias("group"))
    blocks = lookup_join(runs, grouped, ["run"], "inner", ["block"])
    last = F.element_at("entries", -1)
    high = F.struct(*[last[name].alias(name) for name in PLACE])
    ends = blocks.select("group", "run", "block", F.explode(F.array("low", high)).alias("end"))
    numbered = number_rows(ends, ["group", "end"], "_no")
    cut = F.expr(f"(_no - 1) div {2 * part}").alias("cut")
    numbered = materialise(numbered.select("group", "run", "block", "end", cut), "block-order")
    firsts = numbered.groupBy("group", "cut").agg(F.min("end").alias("from"))
    parts = materialise(number_rows(firsts, ["group", "cut"], "part"), "parts")
    following = parts.select((F.col("part") - 1).alias("part"), "group", F.col("from").alias("to"))
    bounds = parts.select("part", "group", "from").join(following, ["part", "group"], "left")
    reach = (
        numbered.join(parts.select("group", "cut", "part"), ["group", "cut"])
        .groupBy("run", "block")
        .agg(F.min("part").alias("_first"), F.max("part").alias("_last"))
        .select("run", "block", F.explode(F.sequence("_first", "_last")).alias("part"))
    )
    tasks = runs.select("run", "block", "entries").join(reach, ["run", "block"]).join(bounds, "part")
    merged = (
        tasks.select("group", "part", "from", "to", "run", "block", "entries")
        .repartition("part")
        .sortWithinPartitions("part", "run", "block")
        .mapInArrow(_merger, BLOCK_ROW)
    )
    return materialise(merged, "index-runs")


def histories(runs: DataFrame, fan_in: int = FAN_IN, part: int = PART) -> DataFrame:
    """All captures in the order of URL key, time and id: url_key, captured, page_id,
    archive, place, length and index_place (from 1), the place in that order.

    Captures equal in all three are ordered by archive and place.
    """
    while runs.select("run").distinct().limit(2).count() > 1:
        runs = merge_runs(runs, fan_in, part)
    sized = runs.select(
        "block", F.shiftright("block", PART_BITS).alias("_part"), F.size("entries").alias("_size")
    ).withColumn("_many", F.expr(f"_part div {PARTS_AT_ONCE}"))

    def before(*order: str, within: str | None = None) -> Column:
        window = Window.partitionBy(within) if within else Window
        rows = window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("_size").over(rows), F.lit(0))

    # Counts of many parts, of parts among many, of blocks in a part: each window has
    # few rows, and the last one a row for every PARTS_AT_ONCE parts.
    many = sized.groupBy("_many").agg(F.sum("_size").alias("_size"))
    many = many.select("_many", before("_many").alias("_a"))
    parts = sized.groupBy("_many", "_part").agg(F.sum("_size").alias("_size"))
    parts = parts.select("_many", "_part", before("_part", within="_many").alias("_b"))
    blocks = sized.select("_part", "block", before("block", within="_part").alias("_c"))
    placed = blocks.join(parts, "_part").join(many, "_many")
    placed = placed.select("block", (F.col("_a") + F.col("_b") + F.col("_c")).alias("_before"))
    rows = runs.join(placed, "block").select("_before", F.posexplode("entries").alias("_at", "_entry"))
    page = F.when(F.col("_entry.page_id") != NO_ID, F.col("_entry.page_id"))
    return rows.select(
        "_entry.url_key", "_entry.captured", page.alias("page_id"), "_entry.archive", "_entry.place",
        "_entry.length", (F.col("_before") + F.col("_at") + 1).alias("index_place"),
    )


def _reader(folder: str):
    def run(batches) -> Iterator[pa.RecordBatch]:
        files, path = opened(folder)
        name, data, held, start = None, None, b"", 0
        for batch in batches:
            for some in slices(batch):
                rows = []
                for row in some.to_pylist():
                    if row["archive"] != name:
                        name, held, start = row["archive"], b"", 0
                        data = files.open_input_file(f"{path}/{name}")
                    at = row["place"] - start
                    if not 0 <= at <= len(held) - row["length"]:
                        held = data.read_at(max(SEGMENT, row["length"]), row["place"])
                        start, at = row["place"], 0
                    found = read_record(held[at : at + row["length"]])
                    if found["page_id"] != row["page_id"]:
                        raise ValueError(f"{name} does not fit its index")
                    rows.append(found | {"url_key": row["url_key"], "index_place": row["index_place"]})
                yield pa.RecordBatch.from_pylist(rows, READ)

    return run


READ = pa.schema(
    [
        ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
        ("record_type", pa.string()), ("refers_to", pa.int64()), ("url_key", pa.string()),
        ("index_place", pa.int64()), ("html", pa.binary()),
    ]
)


def read_archives(index: DataFrame, folder: str) -> DataFrame:
    """The records at the places of ``index`` (rows of ``histories``): page_id,
    payload_bytes, payload_digest, record_type, refers_to, url_key, index_place, and
    the payload of responses as ``html``. A damaged record raises.

    As many tasks as there are archives, whose records are read in file order.
    """
    archives = max(1, index.select("archive").distinct().count())
    ordered = index.repartition(archives, "archive").sortWithinPartitions("archive", "place")
    return ordered.mapInArrow(
        _reader(folder),
        "page_id bigint, payload_bytes bigint, payload_digest string, record_type string,"
        " refers_to bigint, url_key string, index_place bigint, html binary",
    )


def archived(pages: DataFrame, captured: Column | None = None) -> DataFrame:
    """Write the archives under the shared folder, merge their indexes, read them back."""
    folder = new_folder(pages.sparkSession, "warc")
    index = materialise(histories(write_archives(pages, folder, captured)), "capture-index")
    return read_archives(index, folder)
