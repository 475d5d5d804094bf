"""WARC records in ZIP-packaged archives: write, and read back by ranges.

An archive is a ZIP file of *stored* members: ``archive/data.warc.gz`` (one gzip
member per record) and ``indexes/index.cdxj`` (a line per record with its place).
Archives of several ``archive/`` members and indexes of any name are read too: each index
line names its member, and a member that no index names is an error.
The ZIP64 forms are written where 32-bit fields don't suffice and read
wherever they occur. The reader never extracts a member: it reads the end record (and
the ZIP64 one), the central directory and the index members, and then each
record by its range within the stored archive member.

Of records with equal payloads of ``min_revisit`` bytes or more the one with
the largest page id is a response and the others revisit it; the rest are all
responses. The equal payloads are found by (SHA-1, length) and a map-side
combined aggregate; only that small table is joined with the pages, so a
payload that a third of all pages share is no hot task (Spark broadcasts a
small table and splits a large one's hot keys).

Scale: each task writes its pages as archives of about ``ARCHIVE_BYTES`` of payload
in the shared folder, under names of their own, so that a retried or lost task
leaves no half archive in use: only archives in the written list of finished
tasks are read. Archives are dealt to tasks of their own (``READERS`` at most, then several to a task) and read in record batches.

Cases: a null or empty html is an empty payload (a response); a null url is
written as an empty target; a null page id comes back as null and never is the
response of a group that has another; of rows equal in page id, url and payload
one is the response; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.relational import materialize
from ..session import MATERIALIZED, checkpoint_dir
from .common import only

ARCHIVE_BYTES = 16 << 20
MIN_REVISIT = 1000
READERS = 10_000  # tasks that read archives, at most
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"

# ZIP record signatures and sizes (fixed values of the format)
_LOCAL, _CENTRAL, _END, _END64, _LOCATOR = 0x04034B50, 0x02014B50, 0x06054B50, 0x06064B50, 0x07064B50
_FULL16, _FULL32 = 0xFFFF, 0xFFFFFFFF
_URN = "urn:tidemark:page:"


class ZipStore:
    """Writes stored members one after the other to a file object."""

    def __init__(self, out, force64: bool = False):
        self.out, self.at, self.members, self.force64 = out, 0, [], force64

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, name: str, parts, size: int, crc: int) -> None:
        """A member of known size and checksum from an iterable of its parts."""
        start, raw = self.at, name.encode()
        big = self.force64 or size >= _FULL32
        extra = struct.pack("<HHQQ", 1, 16, size, size) if big else b""
        shown = _FULL32 if big else size
        self._put(struct.pack("<IHHHHHIIIHH", _LOCAL, 45 if big else 20, 0x800, 0, 0, 0x21, crc, shown, shown, len(raw), len(extra)))
        self._put(raw + extra)
        for p in parts:
            self._put(p)
        self.members.append((raw, crc, size, start, big))

    def close(self) -> None:
        begin = self.at
        for raw, crc, size, start, big in self.members:
            far = self.force64 or start >= _FULL32
            wide = ([size, size] if big else []) + ([start] if far else [])
            extra = struct.pack(f"<HH{len(wide)}Q", 1, 8 * len(wide), *wide) if wide else b""
            shown = _FULL32 if big else size
            self._put(struct.pack("<IHHHHHHIIIHHHHHII", _CENTRAL, 45, 45 if wide else 20, 0x800, 0, 0, 0x21, crc, shown, shown,
                                  len(raw), len(extra), 0, 0, 0, 0, _FULL32 if far else start) + raw + extra)
        size, n = self.at - begin, len(self.members)
        if self.force64 or begin >= _FULL32 or size >= _FULL32 or n >= _FULL16:
            end = self.at
            self._put(struct.pack("<IQHHIIQQQQ", _END64, 44, 45, 45, 0, 0, n, n, size, begin))
            self._put(struct.pack("<IIQI", _LOCATOR, 0, end, 1))
            n, size, begin = _FULL16, _FULL32, _FULL32
        self._put(struct.pack("<IHHHHIIH", _END, 0, 0, n, n, size, begin, 0))


def zip_directory(read_at, total: int, packed_names: list[str] | None = None) -> dict[str, tuple[int, int]]:
    """{member: (start of its data, size)} of the stored members; the names of the others
    go to ``packed_names``. ``read_at(offset, length)`` reads a range; nothing but the
    directories and the members' headers is read."""
    tail_at = max(0, total - 22 - _FULL16)
    tail = read_at(tail_at, total - tail_at)
    at = tail.rfind(struct.pack("<I", _END))
    while at >= 0 and (at + 22 > len(tail) or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
        at = tail.rfind(struct.pack("<I", _END), 0, at)  # the bytes of the signature within the comment
    if at < 0:
        raise ValueError("not a ZIP file: no end record")
    n, size, begin = struct.unpack_from("<HII", tail, at + 10)
    if n == _FULL16 or size == _FULL32 or begin == _FULL32:
        mark, _, end64, _ = struct.unpack("<IIQI", read_at(tail_at + at - 20, 20))
        if mark != _LOCATOR:
            raise ValueError("ZIP64 locator missing")
        mark, *_, n, size, begin = struct.unpack("<IQHHIIQQQQ", read_at(end64, 56))
        if mark != _END64:
            raise ValueError("ZIP64 end record missing")
    directory, out, at = read_at(begin, size), {}, 0
    for _ in range(n):
        mark, method, packed, plain, n_name, n_extra, n_note, start = struct.unpack_from("<I6xH8xIIHHH8xI", directory, at)
        if mark != _CENTRAL:
            raise ValueError("broken central directory")
        name = directory[at + 46:at + 46 + n_name].decode()
        extra = directory[at + 46 + n_name:at + 46 + n_name + n_extra]
        while len(extra) >= 4:
            kind, length = struct.unpack_from("<HH", extra)
            if kind == 1:  # ZIP64: those of plain size, packed size and start that are full, in this order
                wide = list(struct.unpack_from(f"<{length // 8}Q", extra, 4))
                plain = wide.pop(0) if plain == _FULL32 else plain
                packed = wide.pop(0) if packed == _FULL32 else packed
                start = wide.pop(0) if start == _FULL32 else start
            extra = extra[4 + length:]
        if method == 0 and packed == plain:
            mark, n_name_here, n_extra_here = struct.unpack("<I22xHH", read_at(start, 30))
            if mark != _LOCAL:
                raise ValueError(f"no member at the place of {name}")
            out[name] = (start + 30 + n_name_here + n_extra_here, packed)
        elif packed_names is not None:
            packed_names.append(name)
        at += 46 + n_name + n_extra + n_note
    return out


def _urn(page_id) -> str:
    return f"<{_URN}{'null' if page_id is None else page_id}>"


def _page(urn: str | None):
    value = (urn or "<:null>").strip("<>").rpartition(":")[2]
    return None if value == "null" else int(value)


def _head(value: str) -> str:
    return " ".join((value or "").split())


def warc_record(page_id, url: str | None, payload: bytes, digest: bytes, revisit_of, is_revisit: bool) -> bytes:
    """One WARC/1.1 record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if is_revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if is_revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}",
            "WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Target-URI: {_head(url)}",
            "Content-Type: application/http; msgtype=response",
            f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}", f"Content-Length: {len(block)}"]
    if is_revisit:
        head += [f"WARC-Refers-To: {_urn(revisit_of)}",
                 "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC headers, HTTP headers, payload) of an uncompressed record; names in lower case."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    warc = _headers(head)
    block = rest[:int(warc["content-length"])]
    if len(block) != int(warc["content-length"]) or not head.startswith(b"WARC/"):
        raise ValueError("broken WARC record")
    http, _, payload = block.partition(b"\r\n\r\n")
    return warc, _headers(http), payload


def _headers(raw: bytes) -> dict[str, str]:
    lines = [x.partition(":") for x in raw.decode().split("\r\n")[1:]]
    return {k.strip().lower(): v.strip() for k, _, v in lines}


def record_places(read_at, total: int, path: str) -> list[tuple[int, int, dict]]:
    """(start in the file, length, index line) of every record that the indexes name, each once."""
    packed: list[str] = []
    members = zip_directory(read_at, total, packed)
    if lost := [m for m in packed if m.startswith(("archive/", "indexes/"))]:
        raise ValueError(f"{path}: members are packed, not stored: {lost}")
    data = {m: at for m, at in members.items() if m.startswith("archive/") and at[1]}
    out: dict[tuple[str, int], tuple[int, int, dict]] = {}
    for index, (start, size) in members.items():
        if not index.startswith("indexes/") or index.endswith(".idx"):  # .idx: places in a packed index
            continue
        raw = read_at(start, size)
        for line in (gzip.decompress(raw) if index.endswith(".gz") else raw).decode().split("\n"):
            if not line.strip() or line.startswith("!"):
                continue
            p = json.loads(line if line.startswith("{") else line.split(" ", 2)[2])  # after the key and the time
            name = p.get("filename") or (next(iter(data)) if len(data) == 1 else "")
            name = name if name.startswith("archive/") else f"archive/{name}"
            if name not in data:
                raise ValueError(f"{path}: {index} names no stored member: {line}")
            at, length = int(p["offset"]), int(p["length"])
            if at + length > data[name][1]:
                raise ValueError(f"{path}: a record beyond its member")
            out[name, at] = (data[name][0] + at, length, p)
    if lost := sorted(set(data) - {name for name, _ in out}):
        raise ValueError(f"{path}: members with no index: {lost}")
    return list(out.values())


def _file(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def shared_uri(folder: str) -> str:
    """The folder as a URI that pyarrow.fs takes."""
    if "://" not in folder and not folder.startswith("file:"):
        return f"file://{folder}"
    return folder.replace("file:/", "file:///", 1) if folder.startswith("file:/") and not folder.startswith("file:///") else folder


def write_archives(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url",
                   html_col: str = "html", min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Write every page as a record; returns (path, records, bytes) of the archives
    written, itself written in the shared folder. ``folder``: a shared one that
    pyarrow.fs reaches (default: a new one in ``spark.checkpoint.dir``)."""
    spark = pages.sparkSession
    rows = only(pages, id_col, url_col, html_col).select(
        F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    rows = rows.select("*", F.sha1("html").alias("digest"), F.octet_length("html").alias("bytes"),
                       F.monotonically_increasing_id().alias("tie"))
    order = F.struct("id", "url", "tie")
    most = (rows.where(F.col("bytes") >= min_revisit).groupBy("digest", "bytes")
            .agg(F.count("*").alias("n"), F.max(order).alias("top")).where("n > 1").select("digest", "bytes", "top"))
    most = materialize(most, "equal")
    target = shared_uri(folder or f"{checkpoint_dir(spark)}/{MATERIALIZED}/archives-{uuid.uuid4().hex}")
    revisit = F.col("top").isNotNull() & ~order.eqNullSafe(F.col("top"))
    dealt = rows.join(most, ["digest", "bytes"], "left").select(
        "id", "url", "html", "digest", F.coalesce(revisit, F.lit(False)).alias("revisit"), F.col("top.id").alias("to"))

    def store(batches):
        fs, base = _file(target)
        fs.create_dir(base, recursive=True)
        for lines, records, payload in _archives(batches):
            data, index, at = [], [], 0
            for key, raw in zip(lines, records):
                data.append(gzip.compress(raw, 1, mtime=0))
                index.append(json.dumps({"id": key, "filename": DATA.rpartition("/")[2], "offset": at, "length": len(data[-1])}) + "\n")
                at += len(data[-1])
            crc = 0
            for d in data:
                crc = zlib.crc32(d, crc)
            listing = "".join(index).encode()
            name = f"{base}/{uuid.uuid4().hex}.wacz"
            with fs.open_output_stream(name) as out:
                z = ZipStore(out)
                z.add(DATA, data, at, crc)
                z.add(INDEX, [listing], len(listing), zlib.crc32(listing))
                z.close()
                size = z.at
            yield pa.RecordBatch.from_pydict({"path": [f"{target}/{name.rpartition('/')[2]}"], "records": [len(records)], "bytes": [size]})

    return materialize(dealt.mapInArrow(store, "path string, records long, bytes long"), "archives")


def _archives(batches):
    """Runs of records with about ARCHIVE_BYTES of payload."""
    keys, records, size = [], [], 0
    for b in batches:
        for page_id, url, html, digest, revisit, to in zip(*(b.column(i) for i in range(6))):
            page_id, payload = page_id.as_py(), html.as_py().encode()
            records.append(warc_record(page_id, url.as_py(), payload, bytes.fromhex(digest.as_py()), to.as_py(), revisit.as_py()))
            keys.append(page_id)
            size += len(payload)
            if size >= ARCHIVE_BYTES:
                yield keys, records, size
                keys, records, size = [], [], 0
    if records:
        yield keys, records, size


def read_archives(paths: DataFrame, path_col: str = "path", with_payload: bool = True) -> DataFrame:
    """Every record of the archives: page_id, url, record_type, refers_to,
    payload_bytes, payload_digest (hex SHA-1) and payload (null for a revisit, which stores none).
    A response's bytes and digest are those of the payload read, checked against its header."""
    paths = only(paths, path_col)
    tasks = min(READERS, max(1, paths.count()))

    def load(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                fs, name = _file(path)
                with fs.open_input_file(name) as f:
                    def at(offset, length):
                        f.seek(offset)
                        return f.read(length)

                    out, held = [], 0
                    for start, length, p in record_places(at, f.size(), path):
                        warc, http, payload = parse_record(gzip.decompress(at(start, length)))
                        digest = base64.b32decode(warc["warc-payload-digest"].partition(":")[2]).hex()
                        revisit = warc["warc-type"] == "revisit"
                        if not revisit and hashlib.sha1(payload).hexdigest() != digest:
                            raise ValueError(f"{path}: payload of {warc['warc-record-id']} differs from its digest")
                        if "id" in p and _page(warc["warc-record-id"]) != p["id"]:
                            raise ValueError(f"{path}: the index names another record")
                        out.append({
                            "page_id": _page(warc["warc-record-id"]), "url": warc["warc-target-uri"],
                            "record_type": warc["warc-type"], "refers_to": _page(warc.get("warc-refers-to")),
                            "payload_bytes": int(http["content-length"]) if revisit else len(payload), "payload_digest": digest,
                            **({"payload": None if revisit else payload} if with_payload else {})})
                        held += len(payload)
                        if held >= 4 << 20:
                            yield pa.RecordBatch.from_pylist(out, schema=kind)
                            out, held = [], 0
                    if out:
                        yield pa.RecordBatch.from_pylist(out, schema=kind)

    fields = [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
              ("payload_bytes", pa.int64()), ("payload_digest", pa.string())] + [("payload", pa.binary())] * with_payload
    kind = pa.schema(fields)
    schema = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string"
    schema += ", payload binary" * with_payload
    # ranges of names, as many as archives: adaptive execution does not merge a stated number into one task
    return paths.repartitionByRange(tasks, path_col).mapInArrow(load, schema)
