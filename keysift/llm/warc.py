"""WARC archives with one Zstandard frame for each record and a dictionary in front.

An archive begins with a skippable frame that holds a dictionary trained on its first
records; every record after it is one frame compressed with that dictionary.  A task
writes its archives under hidden names, renames each when it is whole, and returns their
names as rows; the list that Spark stores names only files of tasks that counted, so
what a lost or repeated task left behind is never read.

The folder is any that Arrow can open (``file:``, ``hdfs:``, ``s3:``, ``gs:``); it is read back by
Spark's own reader of binary files.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs as arrow_fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keysift.llm.common import materialize, new_scratch, read_table, slices
from keysift.session import join_keys

# Magic numbers (little endian) of the dictionary's frame, of a dictionary and of a
# frame; record version; the profile of a revisit.
SKIPPABLE = bytes.fromhex("5d2a4d18")
DICTIONARY = bytes.fromhex("37a430ec")
FRAME = bytes.fromhex("28b52ffd")
VERSION = b"WARC/1.1"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")

# An archive ends once its records hold so many bytes; a longer record is still written whole.
ARCHIVE_BYTES = 8 << 20
DICTIONARY_BYTES = 16 << 10
_TRAINED_ON = 1 << 20
_FED = 16 << 10
DATE = "1970-01-01T00:00:00Z"
LEVEL = 3

RECORD = ("archive string, offset long, warc_type string, record_id string, page_id long, "
          "target_uri string, date string, refers_to long, payload_digest string, "
          "payload_bytes long, payload binary, error string")


def digest_of(data: bytes) -> str:
    """Base32 of the SHA-1, in upper case."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode("ascii")


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def record(page: dict, date: str = DATE) -> bytes:
    """One WARC record: the page's answer, or a revisit that names the page it repeats."""
    payload = (page["payload"] or "").encode("utf-8")
    digest = digest_of(payload)
    revisit = page["first_id"] is not None and page["first_id"] != page["page_id"]
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {len(payload)}\r\n\r\n").encode("ascii")
    block = http if revisit else http + payload
    # A line break or blank inside an address would end the header line or the value.
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", page["url"] or "")
    fields = [("WARC-Type", "revisit" if revisit else "response"),
              ("WARC-Record-ID", record_id(page["page_id"], digest)),
              ("WARC-Date", date),
              ("WARC-Target-URI", uri or f"urn:page:{page['page_id']}"),
              ("WARC-Payload-Digest", f"sha1:{digest}"),
              ("WARC-Block-Digest", f"sha1:{digest_of(block)}"),
              ("Content-Type", "application/http; msgtype=response"),
              ("Content-Length", str(len(block)))]
    if page["page_id"] is not None:
        fields.append(("X-Page-Id", str(page["page_id"])))
    if revisit:
        fields += [("WARC-Profile", SAME_PAYLOAD),
                   ("WARC-Refers-To", record_id(page["first_id"], digest)),
                   ("X-Refers-To-Page-Id", str(page["first_id"]))]
    head = "".join(f"{k}: {v}\r\n" for k, v in fields).encode("utf-8")
    return VERSION + b"\r\n" + head + b"\r\n" + block + b"\r\n\r\n"


def dictionary_of(records: list[bytes]) -> bytes:
    """A dictionary trained on the records, or nothing if they are too few to train on."""
    held, sample = 0, []
    for r in records:
        if held >= _TRAINED_ON:
            break
        sample.append(r[:_TRAINED_ON - held])
        held += len(sample[-1])
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, sample).as_bytes()
    except (zstandard.ZstdError, MemoryError):
        return b""


def archive(records: list[bytes], level: int = LEVEL) -> bytes:
    """The bytes of an archive: the dictionary in a skippable frame, then a frame each."""
    found = dictionary_of(records)
    trained = zstandard.ZstdCompressionDict(found) if found else None
    packer = zstandard.ZstdCompressor(level=level, dict_data=trained, write_content_size=True)
    parts = [SKIPPABLE + len(found).to_bytes(4, "little") + found] if found else []
    return b"".join(parts + [packer.compress(r) for r in records])


def _leading_dictionary(data: memoryview) -> tuple[zstandard.ZstdCompressionDict | None, int]:
    """The dictionary at the front and where the records begin."""
    if bytes(data[:4]) != SKIPPABLE:
        return None, 0
    size = int.from_bytes(data[4:8], "little")
    if len(data) < 8 + size:
        raise ValueError("the dictionary frame is cut off")
    held = bytes(data[8:8 + size])
    if held[:4] == FRAME:  # it may itself be compressed
        held = zstandard.ZstdDecompressor().decompressobj().decompress(held)
    if held[:4] != DICTIONARY:
        raise ValueError("the first frame holds no dictionary")
    return zstandard.ZstdCompressionDict(held), 8 + size


def frames(data: bytes) -> Iterator[tuple[int, bytes | None, str | None]]:
    """(offset, record, error) of each frame; after a broken one it goes on at the next magic."""
    view = memoryview(data)
    try:
        trained, at = _leading_dictionary(view)
    except (ValueError, zstandard.ZstdError) as e:
        yield 0, None, str(e)
        return
    reader = zstandard.ZstdDecompressor(dict_data=trained)
    while at < len(view):
        if _is_skippable(view, at):
            at += 8 + int.from_bytes(view[at + 4:at + 8], "little")
            continue
        one, held, end = reader.decompressobj(), [], at
        try:
            while not one.eof:
                if end >= len(view):
                    raise zstandard.ZstdError("the frame is cut off")
                fed = view[end:end + _FED]
                held.append(one.decompress(fed))
                end += len(fed)
            end -= len(one.unused_data)
            yield at, b"".join(held), None
            at = end
        except zstandard.ZstdError as e:
            yield at, None, f"no whole frame: {e}"
            at = data.find(FRAME, at + 1)
            if at < 0:
                return


def _is_skippable(view: memoryview, at: int) -> bool:
    return bytes(view[at + 1:at + 4]) == SKIPPABLE[1:] and view[at] >> 4 == 5


def parse(data: bytes) -> dict:
    """Fields and payload of a record; ValueError if a header, length or digest isn't right."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or lines[0] != VERSION:
        raise ValueError("no WARC/1.1 header")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.decode("utf-8").partition(":")
        if not colon or not name or name != name.strip():
            raise ValueError("a header line without a name")
        if fields.setdefault(name.lower(), value.strip()) != value.strip():
            raise ValueError(f"two values of {name}")
    missing = [x for x in REQUIRED if not fields.get(x)]
    if missing:
        raise ValueError(f"without {', '.join(missing)}")
    if not re.fullmatch("[0-9]+", fields["content-length"]):
        raise ValueError("Content-Length is no number")
    size = int(fields["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"Content-Length is {size}, the block has {len(rest) - 4}")
    block = rest[:size]
    if (told := fields.get("warc-block-digest")) and told != f"sha1:{digest_of(block)}":
        raise ValueError("the block has another digest")
    http, gap, payload = block.partition(b"\r\n\r\n")
    told = re.search(rb"(?im)^content-length:[ \t]*([0-9]+)[ \t]*\r?$", http + b"\r\n")
    if not gap or not told:
        raise ValueError("no HTTP header with a length")
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if fields["warc-type"] == "response":
        if len(payload) != int(told[1]):
            raise ValueError("the payload has another length")
        if digest and digest != digest_of(payload):
            raise ValueError("the payload has another digest")
    elif fields["warc-type"] == "revisit":
        if payload or not fields.get("warc-refers-to"):
            raise ValueError("a revisit with a payload or without what it revisits")
    return {"fields": fields, "payload": payload if fields["warc-type"] == "response" else None,
            "payload_bytes": int(told[1]), "payload_digest": digest}


def with_first(pages: DataFrame, payload: Column, least: int = 0) -> DataFrame:
    """page_id, url, payload and first_id: the smallest page_id among equal payloads.

    first_id is null for payloads without a copy and for those of fewer than ``least`` bytes.
    Payloads that many pages share meet no single task: the table of repeated payloads is broadcast
    if it was counted and is small, else joined by digest and salt (``session.join_keys``).
    """
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn(
        "digest", F.sha1(F.coalesce("payload", F.lit("")).cast("binary")))
    long_enough = F.octet_length(F.coalesce("payload", F.lit(""))) >= least
    first = rows.where(long_enough).groupBy("digest").agg(
        F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    first = first.where("n > 1").select("digest", "first_id")
    return join_keys(rows, first, "digest", "left", ["page_id", "url"]).select(
        "page_id", "url", "payload", "first_id")


def arrow_uri(spark: SparkSession, folder: str) -> str:
    """The folder as a URI with the scheme that Spark's own readers take for it.

    Without a scheme that is the default file system's, so writers and readers use one store.  Off a
    local master a folder of the machines' own file system has to be named as such, by ``file:``.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    uri = store.makeQualified(path).toUri()
    scheme = uri.getScheme()
    if scheme == "file":
        master = spark.conf.get("spark.master", "local")
        if not folder.startswith("file:") and master != "local" and not master.startswith("local["):
            raise ValueError(f"{folder} is a folder of one machine: name a shared one, with its scheme")
        return "file://" + uri.getPath()
    # The names that Hadoop and Arrow have for one store.
    return {"s3a": "s3", "s3n": "s3"}.get(scheme, scheme) + uri.toString()[len(scheme):]


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write ``pages`` (page_id, url, payload, first_id) to ``folder``; the list of archives.

    Columns: archive, records, bytes.  The list is stored, so what it names is written once.
    """
    place = arrow_uri(pages.sparkSession, folder)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = arrow_fs.FileSystem.from_uri(place)
        store.create_dir(root, recursive=True)
        listed: list[tuple] = []

        def close(records: list[bytes]) -> None:
            name = f"{uuid.uuid4().hex}.warc.zst"
            data = archive(records)
            with store.open_output_stream(f"{root}/_{name}", compression=None) as out:
                out.write(data)
            store.move(f"{root}/_{name}", f"{root}/{name}")
            listed.append((name, len(records), len(data)))

        held, size = [], 0
        for batch in batches:
            for part in slices(batch, "payload"):
                for page in part.to_pylist():
                    held.append(record(page))
                    size += len(held[-1])
                    if size >= archive_bytes:
                        close(held)
                        held, size = [], 0
        if held:
            close(held)
        names, counts, sizes = zip(*listed) if listed else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array(counts, pa.int64()),
             pa.array(sizes, pa.int64())], ["archive", "records", "bytes"])

    columns = pages.select("page_id", "url", "payload", "first_id")
    return materialize(
        columns.mapInArrow(task, "archive string, records long, bytes long"), "archives")


def read_archives(
    spark: SparkSession, folder: str, listed: DataFrame | None = None, payloads: bool = True
) -> DataFrame:
    """One row for each record of the archives in ``folder`` (of those listed, if a list is given).

    Columns as in ``RECORD``.  A frame or record that is not right gives a row with ``error`` and nulls;
    the records after it are still read.  A listed archive that is missing, or holds another number of
    records than the list says, gives such a row, too.  Without ``payloads`` that column is null.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("archive"), "content")
    if listed is None:
        files = files.withColumn("records", F.lit(None).cast("long"))
        missing = None
    else:
        missing = listed.select("archive").join(files.select("archive"), "archive", "left_anti")
        files = files.join(listed.select("archive", "records"), "archive")

    def number(fields: dict, name: str) -> int | None:
        return int(fields[name]) if name in fields else None

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in RECORD.split(", ")])
        for batch in batches:
            for i in range(batch.num_rows):
                name, rows, held = batch.column("archive")[i].as_py(), [], 0
                count, wanted = 0, batch.column("records")[i].as_py()
                for offset, data, error in frames(batch.column("content")[i].as_py()):
                    row = {"archive": name, "offset": offset, "error": error}
                    if error is None:
                        try:
                            found = parse(data)
                            f = found.pop("fields")
                            row |= found | {
                                "warc_type": f["warc-type"], "record_id": f["warc-record-id"],
                                "target_uri": f.get("warc-target-uri"), "date": f["warc-date"],
                                "page_id": number(f, "x-page-id"),
                                "refers_to": number(f, "x-refers-to-page-id")}
                        except ValueError as e:
                            row["error"] = str(e)
                    if not payloads:
                        row.pop("payload", None)
                    rows.append(row)
                    count += 1
                    held += len(row.get("payload") or b"")
                    if held > 4 << 20 or len(rows) >= 4096:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
                if wanted is not None and wanted != count:
                    rows.append({"archive": name, "error": f"{count} records instead of {wanted}"})
                yield pa.RecordBatch.from_pylist(rows, schema)

    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    found = files.select("archive", "content", "records").mapInArrow(task, RECORD)
    if missing is None:
        return found
    lost = missing.withColumn("error", F.lit("no such archive"))
    return found.unionByName(lost, allowMissingColumns=True)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written to archives and read back: size, digest, kind and what a page revisits.

    A null html is an empty payload.  Rows that share the smallest page_id of a payload are all
    responses, since none could name another; a null page_id revisits the page that has one, and
    is a response if none has.  A record that cannot be read back raises an error.
    """
    pages = with_first(read_table(spark, sf_dir, "pages"), F.col("html"))
    folder = new_scratch(spark, "warc")
    listed = write_archives(pages, folder)
    if listed.limit(1).count() == 0:
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, "
                                         "record_type string, refers_to long")
    found = read_archives(spark, folder, listed, payloads=False)
    broken = F.concat(F.lit("record not read: "), F.col("archive"), F.lit(" "), F.col("error"))
    kind = F.when(F.col("error").isNull(), F.col("warc_type")).otherwise(F.raise_error(broken))
    return found.select("page_id", "payload_bytes", "payload_digest", kind.alias("record_type"),
                        "refers_to")


# base32: the 40 hex digits of the SHA-1 are 8 groups of 5; a group of 20 bits gives 4 letters.
SQL = """
WITH hashed AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h
  FROM pages),
first AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS f FROM hashed)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 +
    ((('0x' || substr(h, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31), 1)), '')
    AS payload_digest,
  CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = f THEN NULL ELSE f END AS refers_to
FROM first
"""
