"""Secret scans with a recursive decoding worklist.

A layer is a text whose every character knows the characters of the document it stands for. The
document is the first layer. A layer is scanned, then each decoder makes new layers of it:

* percent codes, Unicode escapes and look-alike forms (full width, mathematical, invisible
  characters) are decoded in place, the rest of the text stays;
* a run of base64 becomes a layer of its own, at each of the four phases a run can start in;
* bytes that open like gzip, zlib, bzip2 or xz data are inflated.

New layers go on the worklist until there are none. A layer seen before (same text, same place) is
not taken again, so cycles end; in-place decoders only shorten, and data is inflated as far as
``LAYER_BYTES`` a layer. A find in a layer is mapped to the document's characters it comes from.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex")
LAYER_BYTES = 16 << 20
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS, _HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]+")
_NAMES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_HEX_BYTES = bytes(104 if chr(b) in "0123456789abcdef" else 32 for b in range(256))
_CODE_BYTES = bytes(98 if chr(b).isascii() and chr(b).isalnum() or chr(b) in "+/_-" else 32 for b in range(256))

_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPES = re.compile(
    r"(?:\\u[0-9A-Fa-f]{4}|\\u\{[0-9A-Fa-f]{1,6}\}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};)+"
)
_ESCAPE = re.compile(r"\\u\{?([0-9A-Fa-f]+)\}?|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&#([0-9]+);|&#[xX]([0-9A-Fa-f]+);")
_ESCAPE_ONE = re.compile(r"\\u[0-9A-Fa-f]{4}|\\u\{[0-9A-Fa-f]{1,6}\}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};")
_UNSEEN = re.compile("[\u00ad\u200b-\u200d\u2060\ufeff]")
_ALIKE_BYTES = (b"\xc2\xad", b"\xe2\x80", b"\xe2\x81\xa0", b"\xef\xbb\xbf", b"\xef\xbc", b"\xef\xbd", b"\xf0\x9d")
_ALIKE = re.compile("[\u00ad\u200b-\u200d\u2060\ufeff\uff01-\uff5e\U0001d400-\U0001d7ff]")
# Sixteen characters of base64 hold twelve bytes, the shortest find ("token=" and six more).
_CODED = re.compile(r"[A-Za-z0-9+/_-]{16,}")
_PLAIN = re.compile(rb"[\x20-\x7e\t\r\n]{12,}")
_OPENERS = {b"\x1f\x8b\x08": "gzip", b"BZh": "bz2", b"\xfd7zXZ\x00": "xz"}


def scan(text: str, raw: bytes | None = None) -> list[tuple[str, int, int]]:
    """Finds in a text, by kind: each kind leftmost and not overlapping, those too short left out."""
    raw = text.encode("utf-8", "surrogatepass") if raw is None else raw
    out = []
    low = raw.lower()
    if any(n in low for n in _NAMES):
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if b"AKIA" in raw:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if b"h" * 24 in raw.translate(_HEX_BYTES):
        out += [("hex", m.start(), m.end()) for m in _HEX.finditer(text) if m.end() - m.start() >= 24]
    return out


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


class _Layer:
    """A text with the start and end in the document of each character, or one ``spot`` for all; the document itself has neither."""

    def __init__(self, text: str, starts: np.ndarray | None = None, ends: np.ndarray | None = None, spot: tuple[int, int] | None = None):
        self.text, self.starts, self.ends, self.spot = text, starts, ends, spot

    def place(self, start: int, end: int) -> tuple[int, int]:
        if self.spot or self.starts is None:
            return self.spot or (start, end)
        return int(self.starts[start:end].min()), int(self.ends[start:end].max())

    def key(self, raw: bytes) -> tuple:
        return _digest(raw), self.spot or _digest(self.starts.tobytes() + self.ends.tobytes())

    def replaced(self, pieces: list[tuple[int, int, list[tuple[str, int, int]]]]) -> _Layer:
        """The layer with ranges put in other characters, each with the range it stands for (here, not in the document)."""
        text, starts, ends, at = [], [], [], 0
        if self.spot:
            for start, end, chars in pieces:
                text += [self.text[at:start], *(c for c, _, _ in chars)]
                at = end
            return _Layer("".join(text) + self.text[at:], spot=self.spot)
        own = np.arange(len(self.text), dtype=np.int64)
        first, last = (own, own + 1) if self.starts is None else (self.starts, self.ends)
        for start, end, chars in [*pieces, (len(self.text), len(self.text), [])]:
            text += [self.text[at:start], *(c for c, _, _ in chars)]
            starts += [first[at:start], np.array([first[s] for _, s, _ in chars], np.int64)]
            ends += [last[at:start], np.array([last[e - 1] for _, _, e in chars], np.int64)]
            at = end
        return _Layer("".join(text), np.concatenate(starts), np.concatenate(ends))

    def part(self, text: str, at: list[tuple[int, int]]) -> _Layer:
        """A new text, each character of which stands for a range here."""
        if self.spot:
            return _Layer(text, spot=self.spot)
        places = [self.place(s, e) for s, e in at]
        return _Layer(text, np.array([p[0] for p in places], np.int64), np.array([p[1] for p in places], np.int64))


def _characters(data: bytes) -> list[tuple[str, int, int]]:
    """Characters of UTF-8 with their bytes; bytes that are none stand for themselves."""
    out, i = [], 0
    while i < len(data):
        n = 1 if data[i] < 0xC0 else 2 if data[i] < 0xE0 else 3 if data[i] < 0xF0 else 4
        try:
            out.append((data[i : i + n].decode("utf-8"), i, i + n))
            i += n
        except UnicodeDecodeError:
            out.append((chr(data[i]), i, i + 1))
            i += 1
    return out


def _inflated(data: bytes) -> tuple[bytes, bool] | None:
    """What compressed data holds, and whether all of it; None if it is none. Broken ends are left away."""
    kind = next((k for head, k in _OPENERS.items() if data.startswith(head)), None)
    if kind is None and not (len(data) > 8 and data[0] & 15 == 8 and (data[0] << 8 | data[1]) % 31 == 0):
        return None
    reader = bz2.BZ2Decompressor() if kind == "bz2" else lzma.LZMADecompressor() if kind == "xz" else zlib.decompressobj(47)
    out, size, feed = [], 0, data
    try:
        while size <= LAYER_BYTES:
            piece = reader.decompress(feed, 1 << 20)
            out.append(piece)
            size += len(piece)
            feed = reader.unconsumed_tail if kind in (None, "gzip") else b""
            if reader.eof or not piece:
                break
    except (zlib.error, OSError, lzma.LZMAError, EOFError):
        pass
    return (b"".join(out)[:LAYER_BYTES], size <= LAYER_BYTES) if size else None


class _Worklist:
    def __init__(self, text: str, raw: bytes):
        self.finds: set[tuple[str, int, int]] = set()
        self.seen: set[tuple] = set()
        self.layers = self.refused = 0
        self.open = [(_Layer(text), raw)]

    def run(self) -> None:
        while self.open:
            layer, raw = self.open.pop()
            self.layers += 1
            self.finds.update((k, *layer.place(s, e)) for k, s, e in scan(layer.text, raw))
            self.decode(layer, raw)

    def push(self, layer: _Layer) -> None:
        raw = layer.text.encode("utf-8", "surrogatepass")
        if raw and (key := layer.key(raw)) not in self.seen:
            self.seen.add(key)
            self.open.append((layer, raw))

    def unpack(self, layer: _Layer, data: bytes, start: int, end: int) -> None:
        """Layers of the bytes of a range: what they hold if they are compressed, also data in data."""
        spot = layer.place(start, end)
        while (key := (_digest(data), spot, "packed")) not in self.seen and (got := _inflated(data)) is not None:
            self.seen.add(key)
            data, complete = got
            self.refused += not complete
            self.push(_Layer(data.decode("utf-8", "replace"), spot=spot))

    def decode(self, layer: _Layer, raw: bytes) -> None:
        text = layer.text
        if b"%" in raw:
            pieces = []
            for m in _PERCENT.finditer(text):
                data = bytes.fromhex(m[0].replace("%", ""))
                self.unpack(layer, data, *m.span())
                pieces.append((m.start(), m.end(), [(c, m.start() + 3 * s, m.start() + 3 * e) for c, s, e in _characters(data)]))
            if pieces:
                self.push(layer.replaced(pieces))
        if b"\\" in raw or b"&#" in raw:
            pieces = [(m.start(), m.end(), self.escaped(layer, m)) for m in _ESCAPES.finditer(text)]
            if pieces:
                self.push(layer.replaced(pieces))
        if any(b in raw for b in _ALIKE_BYTES):
            plain = [(*m.span(), _UNSEEN.sub("", unicodedata.normalize("NFKC", m[0]))) for m in _ALIKE.finditer(text)]
            if plain:
                self.push(layer.replaced([(s, e, [(c, s, e) for c in new]) for s, e, new in plain]))
        if b"b" * 16 in raw.translate(_CODE_BYTES):
            for m in _CODED.finditer(text):
                self.unwrap(layer, m)

    def escaped(self, layer: _Layer, run: re.Match) -> list[tuple[str, int, int]]:
        codes = []
        for m in _ESCAPE_ONE.finditer(run[0]):
            u, long, x, number, hexed = _ESCAPE.fullmatch(m[0]).groups()
            codes.append((int(number) if number else int(u or long or x or hexed, 16), m.start() + run.start(), m.end() + run.start(), bool(x)))
        if all(c < 256 for c, *_ in codes):
            self.unpack(layer, bytes(c for c, *_ in codes), *run.span())
        out, i = [], 0
        while i < len(codes):
            code, start, end, is_byte = codes[i]
            if 0xD800 <= code < 0xDC00 and i + 1 < len(codes) and 0xDC00 <= codes[i + 1][0] < 0xE000:
                code, end, i = 0x10000 + ((code - 0xD800) << 10) + codes[i + 1][0] - 0xDC00, codes[i + 1][2], i + 1
            elif is_byte and code >= 0xC0:  # a character in UTF-8 bytes
                n = 2 if code < 0xE0 else 3 if code < 0xF0 else 4
                try:
                    char = bytes(c[0] for c in codes[i : i + n] if c[3]).decode("utf-8")
                    if len(char) == 1:
                        code, end, i = ord(char), codes[i + n - 1][2], i + n - 1
                except (UnicodeDecodeError, IndexError):
                    pass
            out.append((chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else "\ufffd", start, end))
            i += 1
        return out

    def unwrap(self, layer: _Layer, run: re.Match) -> None:
        """Layers of a base64 run: text of twelve plain characters or more, or what its compressed bytes hold."""
        key = (run[0], *layer.place(*run.span()))
        if key in self.seen:
            return
        self.seen.add(key)
        coded = run[0].replace("-", "+").replace("_", "/")
        for phase in range(4):
            body = coded[phase:]
            body = body[: len(body) - (len(body) % 4 == 1)]
            if len(body) < 16:
                break
            data = base64.b64decode(body + "=" * (-len(body) % 4))
            at = run.start() + phase
            self.unpack(layer, data, at, at + len(body))
            if not _PLAIN.search(data):
                continue
            # byte b lies in characters 4b/3 and the next one
            chars = _characters(data)
            self.push(layer.part("".join(c for c, _, _ in chars), [(at + 4 * s // 3, min(at + len(body), at + 4 * (e - 1) // 3 + 2)) for _, s, e in chars]))


def find_secrets(raw: bytes) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]], int, int]:
    """Finds of a text in UTF-8; finds of all its layers; layers read; layers cut at ``LAYER_BYTES``. Both lists by start, then kind."""
    order = lambda x: (x[1], KINDS.index(x[0]), x[2])
    text = raw.decode("utf-8", "surrogatepass")
    work = _Worklist(text, raw)
    work.run()
    return sorted(scan(text, raw), key=order), sorted(work.finds, key=order), work.layers, work.refused


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [find_secrets(t.as_py() or b"") for t in batch.column(1).cast(pa.binary())]
        spans = [pa.array([[dict(zip(("kind", "start", "end"), s)) for s in f[i]] for f in found], _SPANS) for i in (0, 1)]
        rest = [pa.array([f[i] for f in found], pa.int64()) for i in (2, 3)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *spans, *rest], names=["doc_id", "base", "spans", "n_layers", "n_refused"])


def scan_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, base, spans, n_layers, n_refused`` for every row: finds of the text, and those of all layers.

    Spans count code points of the document, end exclusive; a find inside a coded run covers the
    characters it was coded in. Null texts count as empty. Rows with a null or repeated id are rows of
    their own; other columns are ignored. ``n_refused`` counts layers longer than ``LAYER_BYTES`` when
    inflated, of which only that much was read.
    """
    kind = docs.schema[key].dataType.simpleString()
    spans = "array<struct<kind:string,start:bigint,end:bigint>>"
    rows = docs.select(F.col(f"`{key}`"), F.col(f"`{text}`").cast("string"))
    return rows.mapInArrow(_scanned, f"doc_id {kind}, base {spans}, spans {spans}, n_layers bigint, n_refused bigint")


def span_list(spans: str):
    """``kind:start:end``, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
