"""PDF files made for tests: annotations in plain objects or in packed object streams, with tables or packed cross-references."""

import zlib


def annotation(url):
    return b"<< /Type /Annot /Subtype /Link /Rect [0 0 1 1] /A << /S /URI /URI " + url + b" >> >>"


def plain(objects, older=None):
    """Objects by number with a cross-reference table; older is a file that this one is appended to."""
    out = bytearray(older or b"%PDF-1.4\n")
    before = out.rfind(b"startxref")
    prev = int(out[before + 9 : out.find(b"%%EOF", before)]) if older else None
    places = {}
    for n, body in objects.items():
        places[n] = len(out)
        out += b"%d 0 obj\n%s\nendobj\n" % (n, body)
    at = len(out)
    out += b"xref\n" + b"".join(b"%d 1\n%010d 00000 n \n" % (n, p) for n, p in sorted(places.items()))
    out += b"trailer\n<< /Size 99 " + (b"/Prev %d " % prev if prev is not None else b"") + b">>\nstartxref\n%d\n%%%%EOF\n" % at
    return bytes(out)


def packed(objects, predictor=True, extra=b""):
    """Objects by number in one packed object stream, found through a packed cross-reference stream."""
    out = bytearray(b"%PDF-1.5\n%\xe2\xe3\xcf\xd3\n")
    heads, bodies = [], b""
    for n, body in objects.items():
        heads.append(b"%d %d" % (n, len(bodies)))
        bodies += body + b"\n"
    head = b" ".join(heads) + b"\n"
    data = zlib.compress(head + bodies)
    stream, table = 900, 901
    at = len(out)
    out += b"%d 0 obj\n<< /Type /ObjStm /N %d /First %d /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream\nendobj\n" % (stream, len(objects), len(head), len(data), data)
    rows = [(n, (2).to_bytes(1, "big") + stream.to_bytes(3, "big") + i.to_bytes(1, "big")) for i, n in enumerate(objects)] + [(stream, b"\x01" + at.to_bytes(3, "big") + b"\x00")]
    raw, above = b"", bytes(5)
    for _, r in rows:
        raw += (b"\x02" + bytes((x - y) & 255 for x, y in zip(r, above))) if predictor else r
        above = r
    data = zlib.compress(raw)
    index = b" ".join(b"%d 1" % n for n, _ in rows)
    at = len(out)
    parms = b"/DecodeParms << /Predictor 12 /Columns 5 >> " if predictor else b""
    out += b"%d 0 obj\n<< /Type /XRef /Size 902 /W [1 3 1] /Index [%s] /Filter /FlateDecode %s%s/Length %d >>\nstream\n%s\nendstream\nendobj\nstartxref\n%d\n%%%%EOF\n" % (table, index, parms, extra, len(data), data, at)
    return bytes(out)
