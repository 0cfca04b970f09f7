"""WARC derivatives: a metadata and a plain-text conversion record for each response record.

Records are rows: type, id, target URI, date, content type, the headers that a
derivative must carry, and the block.  A derivative refers to its response by
``WARC-Refers-To`` (with the response's URI and date), keeps the source headers
named in ``KEPT``, and states SHA-256 digests of its block and of its payload;
the metadata block lists the response's own digests.  Ids are UUIDs of the
source's id and the record type, so that a task that runs again writes the same.

Records are written with Spark's text writer, so that files of any size are read in
splits and a lost task leaves no half file.  Plain files: the line separator is the
two line ends that close a record; a reader cuts at these where a record may begin,
and where a page itself quotes a record, puts the pieces together by the lengths
that the headers state.  Compressed files: every record is a gzip member of its own,
and the separator is an empty member, which no text can hold; any tool that reads
joined gzip members reads them.  Blocks are text (UTF-8).

Defined cases: a null html is an empty payload, whose conversion block is empty; a
null url gives records without a target URI, and blanks and control characters of
one are percent-encoded; a null page_id is carried and its ids come of the URL and
text; repeated rows give records with the same ids; line ends in header values
become blanks; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

import gzip
import html as entities
import re
from collections.abc import Iterator
from hashlib import sha256
from uuid import NAMESPACE_URL, uuid5

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridstat.sources.scratch import new_path, stash

DATE = "2024-01-01T00:00:00Z"
KEPT = ("WARC-IP-Address", "WARC-Warcinfo-ID", "WARC-Identified-Payload-Type", "WARC-Truncated")
RECORD = "source long, type string, id string, target string, date string, content_type string, refers_to string, headers map<string,string>, block string, block_digest string, payload_digest string"
_END = "\r\n\r\n"
_SEP = _END + "WARC/1."
#: An empty gzip member.
_EMPTY = gzip.compress(b"", mtime=0)
_ATTRIBUTES = r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+"""
_HIDDEN = re.compile(rf"<!--.*?(?:-->|\Z)|<(head|script|style|noscript|template)\b{_ATTRIBUTES}(?:>.*?(?:</\1\s*>|\Z)|\Z)", re.S | re.I)
_BREAK = re.compile(rf"</?(?:address|article|aside|blockquote|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|header|hr|li|main|nav|ol|option|p|pre|section|table|tbody|td|tfoot|th|thead|tr|ul)\b{_ATTRIBUTES}>", re.I)
_TAG = re.compile(rf"</?[a-zA-Z!?]{_ATTRIBUTES}(?:>|\Z)")
_TITLE = re.compile(r"<title\b[^>]*>(.*?)</title\s*>", re.S | re.I)
_LANG = re.compile(r"<html\b[^>]*\blang\s*=\s*[\"']?([A-Za-z0-9-]+)", re.I)
_CHARSET = re.compile(r"<meta\b[^>]*\bcharset\s*=\s*[\"']?([A-Za-z0-9_-]+)", re.I)
_LINK = re.compile(r"<a\b[^>]*\bhref\s*=", re.I)
_BLANK = re.compile(r"[ \t\f\v\r\xa0]+")


def plain_text(page: str) -> str:
    """Visible text, a line for each block element, without runs of blanks and empty lines."""
    t = _TAG.sub("", _BREAK.sub("\n", _HIDDEN.sub(" ", page)))
    lines = (_BLANK.sub(" ", x).strip() for x in entities.unescape(t).split("\n"))
    return "\n".join(x for x in lines if x)


def digest(data: bytes) -> str:
    return "sha256:" + sha256(data).hexdigest()


def record_id(source: str, kind: str) -> str:
    return f"<urn:uuid:{uuid5(NAMESPACE_URL, f'{kind}:{source}')}>"


def _fields(pairs: list[tuple[str, object]]) -> str:
    return "".join(f"{k}: {' '.join(str(v).split())}\r\n" for k, v in pairs if v not in (None, ""))


def _address(url: str | None) -> str | None:
    """The URL without blanks and control characters, which a header line can't hold."""
    return url and re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def response(page_id: int | None, url: str | None, page: str | None, date: str = DATE) -> dict:
    body = page or ""
    size = len(body.encode())
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n{body}"
    return {
        "source": page_id, "type": "response", "id": record_id(f"{page_id}|{url}|{'' if page_id is not None else body}", "response"), "target": _address(url), "date": date,
        "content_type": "application/http; msgtype=response", "refers_to": None, "headers": [("WARC-Identified-Payload-Type", "text/html")], "block": block,
        "block_digest": digest(block.encode()), "payload_digest": digest(body.encode()),
    }


def derive(r: dict) -> tuple[dict, dict]:
    """The metadata and conversion records of a response record."""
    head, _, body = r["block"].partition(_END)
    kept = [(k, v) for k, v in (r["headers"] or []) if k in KEPT]
    linked = [("WARC-Refers-To-Target-URI", r["target"]), ("WARC-Refers-To-Date", r["date"])]
    linked = [(k, v) for k, v in linked if v is not None]
    status = head.split("\r\n", 1)[0]
    text = plain_text(body)
    title, lang, charset = (m[1] if (m := p.search(body)) else None for p in (_TITLE, _LANG, _CHARSET))
    facts = _fields(
        [("source-status", status), ("source-block-digest", r["block_digest"]), ("source-payload-digest", r["payload_digest"]), ("payload-bytes", len(body.encode())), ("title", entities.unescape(title) if title else None),
         ("language", lang), ("charset", charset), ("links", len(_LINK.findall(body))), ("text-chars", len(text))]
    )
    both = []
    for kind, content, block in (("metadata", "application/warc-fields", facts), ("conversion", "text/plain; charset=utf-8", text)):
        d = digest(block.encode())
        both.append({"source": r["source"], "type": kind, "id": record_id(r["id"], kind), "target": r["target"], "date": r["date"], "content_type": content, "refers_to": r["id"], "headers": kept + linked, "block": block, "block_digest": d, "payload_digest": d})
    return both[0], both[1]


_ARROW = pa.schema(
    [("source", pa.int64())] + [(c, pa.string()) for c in ("type", "id", "target", "date", "content_type", "refers_to")] + [("headers", pa.map_(pa.string(), pa.string()))] + [(c, pa.string()) for c in ("block", "block_digest", "payload_digest")]
)
_ROWS = 200


def _mapped(df: DataFrame, fn) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, _ROWS):
                yield pa.RecordBatch.from_pylist([x for row in b.slice(i, _ROWS).to_pylist() for x in fn(row)], _ARROW)

    return df.mapInArrow(run, RECORD)


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """Response records of raw pages (page_id, url, html)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return _mapped(rows, lambda r: [response(r["page_id"], r["url"], r["html"], date)])


def derivatives(records: DataFrame) -> DataFrame:
    """Both derivative records of every response record; other records give none."""
    return _mapped(records.filter(F.col("type") == "response"), derive)


def page_derivatives(pages: DataFrame, date: str = DATE) -> DataFrame:
    """The derivatives of raw pages' responses in one pass over the pages."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return _mapped(rows, lambda r: derive(response(r["page_id"], r["url"], r["html"], date)))


def _line(name: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), F.regexp_replace(value.cast("string"), r"[\r\n]+", " "), F.lit("\r\n"))).otherwise("")


def write_warc(records: DataFrame, path: str, compression: str = "none") -> None:
    """Write the records as WARC/1.1 files; with ``gzip``, each record as a member of its own."""
    c = F.col
    head = F.concat(
        F.lit("WARC/1.1\r\n"), _line("WARC-Type", c("type")), _line("WARC-Record-ID", c("id")), _line("WARC-Date", c("date")), _line("WARC-Target-URI", c("target")), _line("WARC-Refers-To", c("refers_to")),
        F.array_join(F.transform(F.map_entries("headers"), lambda e: F.concat(F.regexp_replace(e["key"], r"[\r\n:]+", " "), F.lit(": "), F.regexp_replace(e["value"], r"[\r\n]+", " "), F.lit("\r\n"))), ""),
        _line("WARC-Block-Digest", c("block_digest")), _line("WARC-Payload-Digest", c("payload_digest")), _line(SOURCE, c("source")), _line("Content-Type", c("content_type")), _line("Content-Length", F.octet_length("block")),
    )
    rows = records.select(F.concat(F.coalesce(head, F.lit("WARC/1.1\r\n")), F.lit("\r\n"), c("block")).alias("value"))
    if compression == "none":
        rows.write.option("lineSep", _END).text(path)
        return

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([gzip.compress(x.encode() + _END.encode(), 6, mtime=0) for x in b.column(0).to_pylist()], pa.binary())], ["value"])

    # the writer puts out the bytes of a string as they are
    members = rows.mapInArrow(packed, "value binary").select(F.col("value").cast("string").alias("value"))
    members.write.option("encoding", "ISO-8859-1").option("lineSep", _EMPTY.decode("latin-1")).text(path)


#: A header of our own for the row that a record comes from.
SOURCE = "X-Source-Row"


def parse(raw: bytes) -> dict:
    """A record, with or without the two line ends that close it; an error if its length is not the one it states."""
    head, _, rest = raw.partition(_END.encode())
    lines = re.sub(r"\r\n[ \t]+", " ", head.decode("utf-8", "replace")).split("\r\n")[1:]
    fields = {k.strip(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    names = {k.lower(): k for k in fields}
    take = lambda k: fields.pop(names.get(k.lower(), k), None)
    size = int(take("Content-Length") or 0)
    if rest[size:] not in (b"", _END.encode()) or len(rest) < size:
        raise ValueError(f"length of {fields.get('WARC-Record-ID')} is not as stated")
    source = take(SOURCE)
    named = {"type": take("WARC-Type"), "id": take("WARC-Record-ID"), "target": take("WARC-Target-URI"), "date": take("WARC-Date"), "content_type": take("Content-Type"), "refers_to": take("WARC-Refers-To"), "block_digest": take("WARC-Block-Digest"), "payload_digest": take("WARC-Payload-Digest")}
    return {"source": int(source) if source else None, **named, "headers": list(fields.items()), "block": rest[:size].decode("utf-8", "replace")}


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """What lies between places where a record may begin: file, place in it, bytes, the bytes of a record that begins there as its header states them, and the text.

    All but a file's first piece lack the "WARC/1." that the reader cuts at, here and in both lengths.
    """
    raw = spark.read.option("lineSep", _SEP).text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    head = F.substring_index("value", _END, 1)
    stated = F.regexp_extract(head, r"(?im)^Content-Length:[ \t]*([0-9]+)", 1)
    need = F.octet_length(head) + 4 + F.when(stated != "", stated.cast("long")).otherwise(0)
    return raw.withColumns({"size": F.octet_length("value").cast("long"), "need": need.cast("long")})


def _joined(pieces: DataFrame) -> DataFrame:
    """The records of files in which some pieces are no records: a file's lengths, not its texts, are walked through in one task."""
    pieces = stash(pieces, "pieces")

    def walk(file: pa.Table) -> pa.Table:
        order = sorted(range(file.num_rows), key=lambda i: (block[i], at[i])) if (block := file.column("block").to_pylist()) and (at := file.column("at").to_pylist()) else []
        size, need = file.column("size").to_pylist(), file.column("need").to_pylist()
        record, i = [0] * len(order), 0
        while i < len(order):
            have, j = size[order[i]], i
            while have < need[order[i]] and j + 1 < len(order):
                j += 1
                have += len(_SEP) + size[order[j]]
            if have - need[order[i]] not in (0, 4):
                raise ValueError(f"{file.column('file')[0]}: a record's length is not as stated")
            for k in range(i, j + 1):
                record[order[k]] = at[order[i]]
            i = j + 1
        return pa.table({"at": file.column("at"), "record": pa.array(record, pa.int64())})

    named = pieces.select("file", "block", "at", "size", "need").groupBy("file").applyInArrow(walk, "at long, record long")
    parts = pieces.join(named, "at").groupBy("record").agg(F.array_sort(F.collect_list(F.struct("block", "at", "value"))).alias("p"))
    return parts.select(F.array_join(F.transform("p", lambda x: x["value"]), _SEP).alias("value"))


def read_warc(spark: SparkSession, path: str, compression: str = "none") -> DataFrame:
    """Records of WARC files with text blocks, as ``write_warc`` writes them; large files are read in splits."""
    if compression == "none":
        pieces = _pieces(spark, path)
        whole = (F.col("size") == F.col("need")) | (F.col("size") == F.col("need") + 4)
        broken = stash(pieces.filter(~whole).select("file").distinct(), "broken")
        rows = pieces.join(broken, "file", "left_anti").select("value")
        if not broken.isEmpty():
            rows = rows.unionByName(_joined(pieces.join(broken, "file", "left_semi")))
        unpacked = bytes
    else:
        rows = spark.read.option("encoding", "ISO-8859-1").option("lineSep", _EMPTY.decode("latin-1")).text(path)
        unpacked = gzip.decompress
    return _mapped(rows.select(F.col("value").cast("binary").alias("value")), lambda row: [parse(unpacked(row["value"]))])


def digests(records: DataFrame) -> DataFrame:
    return records.select(
        F.col("source").alias("page_id"), F.col("type").alias("warc_type"), F.col("id").alias("record_id"), "refers_to", F.col("target").alias("target_uri"), F.col("date").alias("warc_date"),
        F.octet_length("block").cast("long").alias("content_length"), "block_digest", F.length("block").cast("long").alias("block_chars"),
    )


def derivative_files(pages: DataFrame, path: str | None = None, date: str = DATE, compression: str = "gzip") -> DataFrame:
    """Write the derivatives of raw pages' responses as WARC files (into the shared folder unless told where), and read them back."""
    path = path or new_path(pages.sparkSession, "warc")
    write_warc(page_derivatives(pages, date), path, compression)
    return read_warc(pages.sparkSession, path, compression)
