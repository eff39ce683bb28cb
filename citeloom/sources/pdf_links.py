"""Links of PDF files, read from the file's own objects: cross-reference tables and streams, object streams, packed or not."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes that one packed stream may unpack to; a larger one is reported, not read.
UNPACKED = 256 << 20
_HEAD = re.compile(rb"\s*(\d+)\s+(\d+)\s+obj\b")
_STREAM = re.compile(rb"stream\r?\n")
_ENTRY = re.compile(rb"(\d{10}) (\d{5}) ([nf])")
_LINK = re.compile(rb"/URI\s*(\(|<(?!<))")
_ESCAPES = {ord("n"): 10, ord("r"): 13, ord("t"): 9, ord("b"): 8, ord("f"): 12}


def _number(head: bytes, name: bytes, default: int | None = None) -> int | None:
    m = re.search(rb"/" + name + rb"\s+(\d+)(?!\s+\d+\s+R)", head)
    return int(m[1]) if m else default


def _numbers(head: bytes, name: bytes) -> list[int]:
    m = re.search(rb"/" + name + rb"\s*\[([\d\s]*)\]", head)
    return [int(x) for x in m[1].split()] if m else []


class Pdf:
    """A file's objects by their numbers, as its newest cross-references name them."""

    def __init__(self, raw: bytes):
        self.raw, self.places, self.packed = raw, {}, {}
        self.encrypted = False
        at = raw.rfind(b"startxref")
        m = re.match(rb"startxref\s+(\d+)", raw[at:]) if at >= 0 else None
        seen: set[int] = set()
        nexts = [int(m[1])] if m else []
        while nexts:  # the newest table first: what it names isn't overridden by an older one
            place = nexts.pop(0)
            if place in seen or not 0 <= place < len(raw):
                continue
            seen.add(place)
            head = self._table(place) if raw[place : place + 4] == b"xref" else self._stream_table(place)
            self.encrypted |= b"/Encrypt" in head
            for name in (b"XRefStm", b"Prev"):
                if (n := _number(head, name)) is not None:
                    nexts.append(n)
        if not self.places:  # no usable cross-reference: every object that stands in the file, the last of a number
            self.places = {int(m[1]): (1, m.start(1), 0) for m in re.finditer(rb"(?<![0-9])(\d+)\s+\d+\s+obj\b", raw)}
            for number in list(self.places):
                body = self.body(number)
                if body is not None and b"/ObjStm" in body[:400]:
                    for i, inner in enumerate(self._inner(number)):
                        self.places.setdefault(inner[0], (2, number, i))

    def _table(self, place: int) -> bytes:
        end = self.raw.find(b"trailer", place)
        end = len(self.raw) if end < 0 else end
        at, lines = 0, self.raw[place + 4 : end]
        while m := re.compile(rb"\s*(\d+)\s+(\d+)\s+").match(lines, at):
            first, count, at = int(m[1]), int(m[2]), m.end()
            for number in range(first, first + count):
                e = _ENTRY.match(lines, at)
                if not e:
                    break
                self.places.setdefault(number, (1, int(e[1]), 0) if e[3] == b"n" else (0, 0, 0))
                at = e.end() + len(re.compile(rb"\s*").match(lines, e.end())[0])
        stop = self.raw.find(b"startxref", end)
        return self.raw[end : stop if stop >= 0 else len(self.raw)]

    def _stream_table(self, place: int) -> bytes:
        m = _HEAD.match(self.raw, place)
        if not m:
            return b""
        head, data = self._stream(m.end())
        widths = _numbers(head, b"W")
        if len(widths) != 3 or data is None:
            return b""
        parts = _numbers(head, b"Index") or [0, _number(head, b"Size", 0)]
        at = 0
        for first, count in zip(parts[::2], parts[1::2]):
            for number in range(first, first + count):
                row = data[at : at + sum(widths)]
                at += sum(widths)
                if len(row) < sum(widths):
                    return head
                a, b = widths[0], widths[0] + widths[1]
                kind = int.from_bytes(row[:a], "big") if a else 1
                self.places.setdefault(number, (kind, int.from_bytes(row[a:b], "big"), int.from_bytes(row[b:], "big")))
        return head

    def _stream(self, at: int) -> tuple[bytes, bytes | None]:
        """The dictionary before a stream, and its unpacked bytes; None if they are packed in a way that isn't read here."""
        stop = self.raw.find(b"endobj", at)
        m = _STREAM.search(self.raw, at, stop if stop >= 0 else len(self.raw))
        if not m:
            return self.raw[at : stop if stop >= 0 else len(self.raw)], None
        head, length = self.raw[at : m.start()], _number(self.raw[at : m.start()], b"Length")
        end = m.end() + length if length is not None and self.raw[m.end() + length :].lstrip()[:9] == b"endstream" else self.raw.find(b"endstream", m.end())
        data = self.raw[m.end() : end if end >= 0 else len(self.raw)]
        kind = re.search(rb"/Filter\s*\[?\s*/(\w+)\s*(/?)", head)
        if kind:
            if kind[1] not in (b"FlateDecode", b"Fl") or kind[2] and re.search(rb"/Filter\s*\[\s*/\w+\s*/", head):
                return head, None
            tool = zlib.decompressobj()
            data = tool.decompress(data, UNPACKED)
            if tool.unconsumed_tail:
                raise ValueError("a stream unpacks to more than is read")
            data = _predicted(data, head)
        return head, data

    def body(self, number: int) -> bytes | None:
        """An object's bytes; of one in a stream those between its neighbours. None if it is free or can't be found."""
        kind, at, index = self.places.get(number, (0, 0, 0))
        if kind == 2:
            inner = self._inner(at)
            return inner[index][1] if index < len(inner) and inner[index][0] == number else dict(inner).get(number)
        if kind != 1:
            return None
        m = _HEAD.match(self.raw, at)
        if not m or int(m[1]) != number:
            return None
        end = self.raw.find(b"endobj", m.end())
        return self.raw[m.end() : end if end >= 0 else len(self.raw)]

    def _inner(self, stream: int) -> list[tuple[int, bytes]]:
        """The (number, bytes) of the objects in an object stream."""
        if stream not in self.packed:
            found: list[tuple[int, bytes]] = []
            kind, at, _ = self.places.get(stream, (0, 0, 0))
            m = _HEAD.match(self.raw, at) if kind == 1 else None
            if m:
                head, data = self._stream(m.end())
                first, count = _number(head, b"First", 0), _number(head, b"N", 0)
                if data is not None:
                    pairs = [int(x) for x in data[:first].split()[: 2 * count]]
                    starts = [first + x for x in pairs[1::2]] + [len(data)]
                    found = [(n, data[a:b]) for n, a, b in zip(pairs[::2], starts, starts[1:])]
            self.packed[stream] = found
        return self.packed[stream]

    def links(self) -> list[str]:
        """The addresses of the live objects' URI actions, in the order of object numbers, each once."""
        found: dict[str, None] = {}
        for number in sorted(self.places):
            body = self.body(number)
            if body is None or b"/URI" not in body:
                continue
            end = _STREAM.search(body)
            for m in _LINK.finditer(body, 0, end.start() if end else len(body)):
                found.setdefault(_string(body, m.start(1)))
        return [x for x in found if x]


def _predicted(data: bytes, head: bytes) -> bytes:
    """Rows of a stream whose bytes are differences to the row above or the byte before, as the head's predictor says."""
    kind, width = _number(head, b"Predictor", 1), _number(head, b"Columns", 1)
    if kind < 10:
        return data
    out, above = bytearray(), bytes(width)
    for at in range(0, len(data), width + 1):
        how, row = data[at], bytearray(data[at + 1 : at + 1 + width])
        if how == 2:
            row = bytearray((x + y) & 255 for x, y in zip(row, above))
        elif how == 1:
            for i in range(1, len(row)):
                row[i] = (row[i] + row[i - 1]) & 255
        elif how:
            raise ValueError(f"row predictor {how}")
        out += row
        above = bytes(row)
    return bytes(out)


def _string(body: bytes, at: int) -> str:
    """The string that begins at a bracket: with escapes and inner brackets, or in hexadecimal digits."""
    if body[at : at + 1] == b"<":
        digits = re.sub(rb"\s", b"", body[at + 1 : body.find(b">", at)])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode("ascii", "ignore")).decode("utf-8", "replace")
    out, depth, i = bytearray(), 0, at
    while i < len(body):
        c = body[i]
        if c == 92 and i + 1 < len(body):
            octal = re.compile(rb"[0-7]{1,3}").match(body, i + 1)
            if octal:
                out.append(int(octal[0], 8) & 255)
                i = octal.end()
                continue
            if body[i + 1] not in b"\r\n":
                out.append(_ESCAPES.get(body[i + 1], body[i + 1]))
            i += 2
            continue
        if c == 40:
            depth += 1
        elif c == 41:
            depth -= 1
            if not depth:
                break
        if not (c == 40 and depth == 1):
            out.append(c)
        i += 1
    return out.decode("utf-8", "replace")


#: Files whose links are handed on at once.
TOGETHER = 256


def links(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(path, links, error) of each file: the addresses of its link annotations, wherever the file packs them.

    Files are read in the tasks. Error says why a file has no links to give: not a PDF, encrypted, broken; the job goes on. A file
    without a usable cross-reference is read object by object. Null contents are an error, and a PDF without links has an empty array.
    """

    def read(raw: bytes | None) -> tuple[list[str] | None, str | None]:
        if raw is None or b"%PDF-" not in raw[:1024]:
            return None, "not a PDF"
        try:
            pdf = Pdf(raw)
            return (None, "encrypted") if pdf.encrypted else (pdf.links(), None)
        except Exception as x:  # a broken file is a result, not a failure of the job
            return None, f"{type(x).__name__}: {x}"[:200]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                some = batch.slice(at, TOGETHER)
                found, errors = zip(*[read(some.column(1)[i].as_py()) for i in range(some.num_rows)])  # one file's bytes at a time
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(found, pa.list_(pa.string())), pa.array(errors, pa.string())], ["path", "links", "error"])

    return files.select(F.col(path).cast("string").alias("path"), F.col(content).alias("content")).mapInArrow(run, "path string, links array<string>, error string")


def allowed(found: Column, hosts: list[str]) -> Column:
    """Those links whose host is one of hosts or below one."""
    names = "|".join(re.escape(h) for h in hosts)
    return F.filter(found, lambda u: u.rlike(rf"^https?://([^/@]+\.)?({names})(:[0-9]+)?(/|$)"))
