"""Content-addressed web archive: payloads once by digest, exact record headers apart, records rebuilt by a join.

WARC files (gzip) go in and out record by record. A record is its header block, an empty line and its block; files end
each record with two line breaks. Reading streams a file and cuts it by Content-Length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shuffle_files_freed

#: Shorter payloads are stored with a response record each, even when they are equal.
MIN_REVISIT_BYTES = 100
#: The time that records carry where the table has none.
DATE = "2026-01-01T00:00:00Z"
_CRLF = "\r\n"
#: What parts the files into pieces, and how a record starts.
_MARK, _VERSION = b"WARC/1.", re.compile(rb"WARC/1\.\d+\r\n")
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = f"HTTP/1.1 200 OK{_CRLF}Content-Type: text/html; charset=utf-8{_CRLF * 2}"


def _header(*lines: tuple[str, Column]) -> Column:
    """Header block; a line whose value is null is left out."""
    parts = [F.concat(F.lit(f"{name}: "), value.cast("string")) for name, value in lines]
    return F.concat(F.concat_ws(_CRLF, F.lit("WARC/1.1"), *parts), F.lit(_CRLF * 2))


def _one_line(text: Column) -> Column:
    """Reversible: a percent sign before 0D, 0A or 25 and line breaks as %25, %0D and %0A, so that a header line is never cut and reads back exactly."""
    return F.replace(F.replace(F.regexp_replace(text, "%(?=0[AD]|25)", "%25"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def _lines_again(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("%0D"), F.lit("\r")), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def warc_records(df: DataFrame, id_col: str, url_col: str, payload_col: str, min_revisit: int = MIN_REVISIT_BYTES, date: str = DATE) -> tuple[DataFrame, DataFrame]:
    """(headers, payloads): a header row (id, digest, header, http) for each row of df, and each distinct payload once.

    Payloads meet by (SHA-256, bytes), combined before the shuffle; of equal payloads of at least min_revisit bytes
    the smallest id is the response, the others are revisits that name it. A null payload is empty; rows that repeat
    the smallest id are responses as well; a null id is never a smallest one. Each record has an id of its own. Very long
    payloads are moved once; an empty table gives empty tables; extra columns are ignored.
    """
    payload = F.coalesce(F.col(f"`{payload_col}`").cast("string"), F.lit(""))
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("digest"), F.octet_length(payload).cast("long").alias("n_bytes"))
    payloads = rows.groupBy("digest", "payload").agg(F.min("id").alias("owner"))
    owners = payloads.groupBy(F.col("digest").alias("o_digest")).agg(F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("two payloads have one SHA-256")).cast("long")).otherwise(F.min("owner")).alias("owner"))
    # By the bytes of the digest: both sides are dealt anew, so that the rows of a very common payload can be split.
    joined = rows.drop("payload").join(owners.hint("merge"), F.unhex("digest") == F.unhex("o_digest"))
    revisit = (F.col("n_bytes") >= min_revisit) & ~F.col("id").eqNullSafe(F.col("owner"))
    kind = F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))
    name = lambda id_: F.concat(F.lit("<urn:page:"), F.coalesce(id_.cast("string"), F.lit("none")), F.lit(">"))
    header = _header(
        ("WARC-Type", kind), ("WARC-Record-ID", F.concat(F.lit("<urn:uuid:"), F.expr("uuid()"), F.lit(">"))), ("WARC-Date", F.lit(date)), ("WARC-Target-URI", _one_line(F.col("url"))),
        ("WARC-Page-ID", name(F.col("id"))), ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))), ("WARC-Profile", F.when(revisit, F.lit(_REVISIT))),
        ("WARC-Refers-To-Page", F.when(revisit, name(F.col("owner")))), ("Content-Type", F.lit("application/http; msgtype=response")),
        ("Content-Length", F.lit(len(_HTTP)) + F.when(revisit, F.lit(0).cast("long")).otherwise(F.col("n_bytes"))))
    return joined.select("id", "digest", header.alias("header"), F.lit(_HTTP).alias("http")), payloads.select("digest", "payload")


def write_archive(headers: DataFrame, payloads: DataFrame, path: str) -> None:
    """Two Parquet tables under path: headers and payloads. Both grow with the input; nothing is kept on one machine."""
    with shuffle_files_freed(headers.sparkSession):
        payloads.write.mode("overwrite").parquet(f"{path}/payloads", compression="zstd")
        headers.write.mode("overwrite").parquet(f"{path}/headers")


def _line(name: str) -> Column:
    """The value of a header line, null without one; names of lines count in any case."""
    found = F.regexp_extract("header", rf"(?i)\r\n{name}:[ \t]*([^\r\n]*)\r\n", 1)
    return F.when(F.regexp_like("header", F.lit(rf"(?i)\r\n{name}:")), found)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Rebuilt records (record: header, HTTP head and payload) from the two tables.

    Headers that have a payload of their own (responses) meet it by the digest; revisits have none and stay as they are,
    so a payload that very many records share is sent to its responses alone.
    """
    headers = spark.read.parquet(f"{path}/headers")
    payloads = spark.read.parquet(f"{path}/payloads").select(F.col("digest").alias("p_digest"), "payload")
    revisit = _line("WARC-Type") == "revisit"
    rebuilt = headers.where(~revisit).join(payloads.hint("merge"), F.unhex("digest") == F.unhex("p_digest"), "left")
    whole = rebuilt.select(F.concat("header", "http", F.coalesce("payload", F.raise_error(F.concat(F.lit("no payload of digest "), F.col("digest"))).cast("string"))).alias("record"))
    return whole.union(headers.where(revisit).select(F.concat("header", "http").alias("record")))


def parsed(records: DataFrame) -> DataFrame:
    """What records say: id, url, record_type, refers_to, header, said (the digest in the header), content (the payload's bytes),
    payload (their text, null where they aren't UTF-8), payload_bytes, payload_digest.

    Records are a column `record`, or header, block, head and error as import_warc gives them. A response's payload is digested anew; one that doesn't match its header stops the read, as does a record
    with an error (take those out before, if the others are wanted). A digest of another kind than SHA-256 isn't compared.
    Revisits have no payload of their own: resolved() takes it from the response that they name.
    """
    if "record" in records.columns:
        end = F.instr("record", _CRLF * 2) + 3
        split = records.select(F.left("record", end).alias("header"), F.substring("record", end + 1, F.length("record")).alias("block"))
        wrong = F.when(~F.octet_length("block").eqNullSafe(_line("Content-Length").cast("long")), F.lit("a record whose length differs from its header"))
        split = split.select("header", F.col("block").cast("binary").alias("block"), (F.instr("block", _CRLF * 2) + 3).alias("head"), wrong.alias("error"))
    else:
        split = records.select("header", "block", "head", "error")
    page = lambda name: F.nullif(F.regexp_extract(_line(name), r"^<urn:page:(-?\d+)>$", 1), F.lit("")).cast("long")
    said = F.coalesce(F.regexp_extract(_line("WARC-Payload-Digest"), r"^sha256:(\w+)$", 1), F.lit(""))
    whole = F.when(F.col("error").isNull(), F.substring("block", F.col("head") + 1, F.octet_length("block"))).otherwise(F.raise_error(F.col("error")).cast("binary"))
    read = split.select(page("WARC-Page-ID").alias("id"), _lines_again(_line("WARC-Target-URI")).alias("url"), _line("WARC-Type").alias("record_type"), page("WARC-Refers-To-Page").alias("refers_to"), "header", said.alias("said"), whole.alias("content"))
    actual = F.sha2("content", 256)
    verified = F.when((actual == F.col("said")) | (F.col("said") == ""), actual).otherwise(F.raise_error(F.concat(F.lit("damaged archive record of digest "), F.col("said"))).cast("string"))
    read = read.withColumn("payload", F.try_validate_utf8(F.col("content").cast("string")))
    return read.withColumn("payload_digest", F.when(F.col("record_type") == "response", verified)).withColumn("payload_bytes", F.octet_length("content").cast("long"))


def resolved(read: DataFrame) -> DataFrame:
    """parsed() rows without their payloads: id, url, record_type, refers_to, payload_digest, payload_bytes; a revisit has the
    verified digest and size of the response whose id and digest it names."""
    own = read.where("record_type = 'response'").select("id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes")
    known = own.groupBy(F.col("id").alias("k_id"), F.col("payload_digest").alias("k_digest")).agg(F.max("payload_bytes").alias("k_bytes"))
    again = read.where("record_type = 'revisit'").select("id", "url", "record_type", "refers_to", "said")
    # Dealt anew by the complement of the id, so that the many revisits of one record can be split.
    found = again.join(known.hint("merge"), (F.bitwise_not("refers_to") == F.bitwise_not("k_id")) & (F.col("said") == F.col("k_digest")), "left")
    missing = F.raise_error(F.concat(F.lit("a revisit of a record that isn't there, digest "), F.col("said")))
    return own.union(found.select("id", "url", "record_type", "refers_to", F.coalesce("k_digest", missing.cast("string")), "k_bytes"))


def export_warc(records: DataFrame, path: str, rows_per_file: int = 20_000) -> None:
    """WARC files (gzip): Spark's text writer with the record separator of the format as line separator."""
    with shuffle_files_freed(records.sparkSession):
        records.select("record").write.option("lineSep", _CRLF * 2).option("maxRecordsPerFile", rows_per_file).text(path, compression="gzip")


class _Cutter:
    """Puts the pieces of one file together to records: (header, block, length of the HTTP head, error)."""

    def __init__(self, name: str):
        self.name, self.held, self.size, self.need = name, [], 0, 0

    def _first_goes(self, why: str) -> tuple[tuple, list[bytes]]:
        """The held record can't be completed: it is given with its error, and the pieces after it are to be read anew."""
        header, _, block = self.held[0].partition(b"\r\n\r\n")
        rest = self.held[1:]
        self.held, self.size, self.need = [], 0, 0
        name = re.search(rb"(?i)\r\nwarc-record-id:[ \t]*([^\r\n]*)", header)
        which = name[1].decode(errors="replace") if name else "without an id"
        return (header.decode(errors="replace") + "\r\n\r\n", block, 0, f"a record {why} in {self.name}, {which}"), rest

    def feed(self, piece: bytes) -> Iterator[tuple]:
        todo = [piece]
        while todo:
            piece = todo.pop(0)
            starts = _VERSION.match(piece) is not None
            if self.held and not self.need and starts:
                row, rest = self._first_goes("ends inside its header")
                yield row
                todo = [*rest, piece, *todo]
                continue
            self.held.append(piece)
            self.size += len(piece)
            if len(self.held) == 1 and not starts:
                yield self._first_goes("without a version line")[0]
                continue
            if not self.need and (end := (whole := b"".join(self.held)).find(b"\r\n\r\n")) >= 0:
                length = re.search(rb"(?i)\r\ncontent-length:[ \t]*(\d+)[ \t]*\r\n", whole[: end + 2])
                if length is None:
                    row, rest = self._first_goes("without Content-Length")
                    yield row
                    todo = rest + todo
                    continue
                self.need = end + 4 + int(length[1])
            if self.need and self.size >= self.need:
                whole = b"".join(self.held)
                if whole[self.need :].strip(b"\r\n"):
                    row, rest = self._first_goes("ends inside its block" if len(self.held) > 1 else "longer than its Content-Length")
                    yield row
                    todo = rest + todo
                    continue
                end = whole.find(b"\r\n\r\n") + 4
                header, block = whole[:end], whole[end : self.need]
                head = block.find(b"\r\n\r\n") + 4 if re.search(rb"(?i)\r\ncontent-type:[ \t]*application/http", header) else 0
                self.held, self.size, self.need = [], 0, 0
                yield header.decode(errors="replace"), block, head if head > 3 else 0, None

    def end(self) -> Iterator[tuple]:
        while self.held:
            row, rest = self._first_goes("ends inside the file")
            yield row
            for piece in rest:
                yield from self.feed(piece)


def import_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of WARC files: header, block (bytes), head (length of the block's HTTP head) and error, null for a sound record.

    The text reader gives what stands between version lines, in order, as bytes; a piece that starts like a record but lies
    inside a block is joined to the record whose Content-Length covers it. Where no such joining comes out even, the record
    was cut short: it is given with its error, and what follows is read as records of their own. Files of all versions 1.x
    are read, names of header lines count in any case, and blocks may have any bytes. A file is one task, and only the
    record at hand is held. Files must not be split for that: gzip files never are, and a plain file that is larger than a
    split stops the read. No files give no records.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Cutter | None = None
        schema = pa.schema([("header", pa.string()), ("block", pa.binary()), ("head", pa.int32()), ("error", pa.string())])
        batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        for batch in batches:
            rows: list[tuple] = []
            for name, at, value in zip(*[batch.column(k).to_pylist() for k in range(3)], strict=True):
                if at:
                    raise ValueError(f"{name} is larger than a split; compress it by gzip")
                if now is None or name != now.name:
                    rows += now.end() if now else ()
                    now, first = _Cutter(name), True
                if not first or value:  # before a file's first version line there is nothing
                    rows += now.feed(value if first else _MARK + value)
                first = False
            if rows:
                yield batch_of(rows)
        if now is not None and (rows := list(now.end())):
            yield batch_of(rows)

    read = spark.read.option("lineSep", _MARK.decode()).text(path).select("_metadata.file_path", "_metadata.file_block_start", F.col("value").cast("binary").alias("value"))
    return read.mapInArrow(cut, "header string, block binary, head int, error string")
