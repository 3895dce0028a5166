"""Text segments of web pages and office documents: out, rewritten, and back in.

Cutting markup into segments is the one thing here that Spark has no expression for:
``mapInArrow`` over page rows, with the standard library's parsers. Everything after
that is columns.
"""

from __future__ import annotations

import gc
import io
import itertools
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from graphie.functions.plan import computed_once

# Fixed values.
HIDDEN_TAGS = {"code", "script", "noscript", "style", "textarea"}
HIDDEN_CLASSES = {"notranslate", "notranscribe"}
VOID_TAGS = {
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr",
}


# What a task holds at once, whatever the size of the batches it gets: bytes read, rows or bytes put out.
PIECE_ROWS, PIECE_BYTES = 1000, 1 << 20


def _pieces(sizes: pa.Array) -> Iterator[tuple[int, int]]:
    """``offset, length`` of stretches of rows within the bounds above, or of one row."""
    start = held = 0
    for i, n in enumerate(sizes.to_pylist()):
        if i > start and (i - start >= PIECE_ROWS or held + (n or 0) > PIECE_BYTES):
            yield start, i - start
            start, held = i, 0
        held += n or 0
    if start < len(sizes):
        yield start, len(sizes) - start


def _in_pieces(batches: Iterator[pa.RecordBatch], col: str) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for offset, length in _pieces(pc.binary_length(b.column(col))):
            yield b.slice(offset, length)


class _Segments(HTMLParser):
    """Text nodes in order, with the tag they stand in and whether a hiding element
    encloses them."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[tuple[str, bool, str]] = []
        self.stack: list[tuple[str, bool]] = []

    def _hidden(self) -> bool:
        return bool(self.stack) and self.stack[-1][1]

    def handle_starttag(self, tag, attrs):
        if tag in VOID_TAGS:
            return
        a = dict(attrs)
        classes = set((a.get("class") or "").split())
        editable = "contenteditable" in a and (a["contenteditable"] or "").lower() != "false"
        hide = self._hidden() or tag in HIDDEN_TAGS or bool(classes & HIDDEN_CLASSES) or editable
        self.stack.append((tag, hide))

    def handle_startendtag(self, tag, attrs):
        pass

    def handle_endtag(self, tag):
        if any(t == tag for t, _ in self.stack):
            while self.stack.pop()[0] != tag:
                pass

    def handle_data(self, data):
        tag = self.stack[-1][0] if self.stack else ""
        if self.out and self.out[-1][0] == tag and self.out[-1][1] == self._hidden() and self._joined:
            last = self.out.pop()
            self.out.append((tag, last[1], last[2] + data))
        else:
            self.out.append((tag, self._hidden(), data))
        self._joined = True

    _joined = False

    def parse_starttag(self, i):
        self._joined = False
        return super().parse_starttag(i)

    def parse_endtag(self, i):
        self._joined = False
        return super().parse_endtag(i)


def page_segments(html: str) -> list[tuple[str, bool, str]]:
    p = _Segments()
    p.feed(html)
    p.close()
    return p.out


def html_segments(df: DataFrame, html_col: str, *keys: str) -> DataFrame:
    """``keys, seq, tag, hidden, text``: one row per text node of each page."""
    types = dict(df.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", seq int, tag string, hidden boolean, text string"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _in_pieces(batches, html_col):
            found = [page_segments(html or "") for html in b.column(html_col).to_pylist()]
            row = pa.array([r for r, page in enumerate(found) for _ in page], pa.int32())
            columns = {k: b.column(k).take(row) for k in keys}
            columns["seq"] = pa.array([i for page in found for i in range(len(page))], pa.int32())
            for i, (name, kind) in enumerate((("tag", pa.string()), ("hidden", pa.bool_()), ("text", pa.string()))):
                columns[name] = pa.array([segment[i] for page in found for segment in page], kind)
            yield pa.RecordBatch.from_pydict(columns)

    return df.select(*keys, html_col).mapInArrow(cut, schema)


@F.arrow_udf(StringType())
def _visible(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    def one(h):
        if h is None:
            return None
        return "".join(t + "\n" for _, hidden, t in page_segments(h) if not hidden and t.strip())

    for html in batches:
        for offset, length in _pieces(pc.binary_length(html)):
            yield pa.array([one(h) for h in html.slice(offset, length).to_pylist()], pa.string())


def declared_language(html: Column | str) -> Column:
    """The lang attribute of the html element, '' when there is none."""
    h = F.col(html) if isinstance(html, str) else html
    return F.regexp_extract(h, r'(?is)<html\b[^>]*?\blang\s*=\s*"([^"]*)"', 1)


def visible_text(df: DataFrame, html_col: str) -> DataFrame:
    """Add ``visible`` (the non-blank text nodes shown, one per line) and ``html_lang``."""
    return df.withColumn("visible", _visible(html_col)).withColumn("html_lang", declared_language(html_col))


# --- document files --------------------------------------------------------------

# File kinds by extension.
KINDS = {
    ".txt": "text", ".md": "text", ".mkd": "text", ".html": "html", ".xhtml": "xhtml", ".htmlz": "htmlz",
    ".docx": "docx", ".ppt": "ppt", ".pptx": "pptx", ".doc": "doc", ".odt": "opendocument",
    ".odp": "opendocument", ".epub": "epub",
}
# The members of each container that hold text.
MEMBERS = {
    "docx": r"^word/(document|footnotes|endnotes)\.xml$",
    "pptx": r"^ppt/slides/[^/]*\.xml$",
    "opendocument": r"^(content|styles)\.xml$",
    "epub": r"\.(xhtml|html)$",
    "htmlz": r"\.html$",
}
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_T = "{urn:oasis:names:tc:opendocument:xmlns:text:1.0}"


def document_kind(path: Column | str) -> Column:
    """What a file is by its extension, case ignored; null when unsupported."""
    p = F.col(path) if isinstance(path, str) else path
    ext = F.lower(F.regexp_extract(p, r"\.[^./]+$", 0))
    kind = F.lit(None).cast("string")
    for e, k in KINDS.items():
        kind = F.when(ext == e, k).otherwise(kind)
    return kind


_CONTAINER_SCHEMA = "doc string, kind string, part string, n_bytes bigint, content binary, error string"
_CONTAINER = pa.schema(
    [("doc", pa.string()), ("kind", pa.string()), ("part", pa.string()), ("n_bytes", pa.int64()), ("content", pa.binary()), ("error", pa.string())]
)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def container_members(
    files: DataFrame, doc_col: str = "path", content_col: str = "content", *, max_bytes: int | None = None
) -> DataFrame:
    """``doc, kind, part, n_bytes, content, error`` for the text members of each file.

    Where ``max_bytes`` is given, a container whose text members add up to more, by the sizes
    of its directory, is not unpacked: it yields a single row with ``error`` set. Plain
    files are their own only member.
    """
    patterns = {k: re.compile(p) for k, p in MEMBERS.items()}
    source = files.select(F.col(doc_col).alias("doc"), document_kind(doc_col).alias("kind"), F.col(content_col).alias("content"))

    def members(doc: str, kind: str | None, data: bytes) -> Iterator[tuple]:
        if kind is None:
            yield doc, kind, None, 0, None, "unsupported file format"
        elif kind in ("doc", "ppt"):
            yield doc, kind, None, 0, None, "format too old: save as ." + kind + "x"
        elif kind not in patterns:
            yield doc, kind, "", len(data), data, None
        else:
            rows = []
            try:
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    infos = [i for i in z.infolist() if not i.is_dir() and patterns[kind].search(i.filename)]
                    total = sum(max(1, i.file_size, i.compress_size) for i in infos)
                    if max_bytes is not None and total > max_bytes:
                        rows = [(doc, kind, None, total, None, "files in zip too large")]
                    else:
                        rows = [
                            (doc, kind, i.filename, max(1, i.file_size, i.compress_size), z.read(i), None)
                            for i in infos
                        ]
            except (zipfile.BadZipFile, NotImplementedError, RuntimeError) as e:
                rows = [(doc, kind, None, 0, None, f"not a readable container: {e}")]
            yield from rows

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for b in _in_pieces(batches, "content"):
            for file in zip(*(b.column(c).to_pylist() for c in ("doc", "kind", "content"))):
                for row in members(*file):
                    rows.append(row)
                    held += len(row[4] or b"")
                if len(rows) >= PIECE_ROWS or held >= PIECE_BYTES:
                    yield _batch(rows, _CONTAINER)
                    rows, held = [], 0
        if rows:
            yield _batch(rows, _CONTAINER)

    return source.mapInArrow(unpack, _CONTAINER_SCHEMA)


def _xml_runs(data: bytes, reads: set[str], ends: set[str], skips: str = "") -> tuple[list[int], list[str]]:
    """Groups and texts of the stretches of text that stand directly in an element of ``reads``.

    An element of ``ends`` ends a group of runs; nothing inside a ``skips`` element counts.
    """
    collecting = gc.isenabled()
    gc.disable()  # a tree has no cycles, and looking for them takes a third of the time
    try:
        return _tree_runs(ElementTree.fromstring(data), reads, ends, skips)
    finally:
        if collecting:
            gc.enable()


def _tree_runs(root: ElementTree.Element, reads: set[str], ends: set[str], skips: str) -> tuple[list[int], list[str]]:
    if len(reads) == len(ends) == 1:
        found = _flat_runs(root, *reads, *ends, skips)
        if found is not None:
            return found
    groups: list[int] = []
    texts: list[str] = []
    group = 0
    above = ElementTree.Element("")  # the root is visited as a child, as any other element is
    above.append(root)
    stack = [(above, False, iter(above))]
    while stack:
        parent, read, children = stack[-1]
        for e in children:
            tag = e.tag
            if tag == skips:
                group += sum(x.tag in ends for x in e.iter())
            else:
                if e.text and tag in reads:
                    groups.append(group)
                    texts.append(e.text)
                if len(e):
                    stack.append((e, tag in reads, iter(e)))
                    break
                group += tag in ends
            if read and e.tail:
                groups.append(group)
                texts.append(e.tail)
        else:
            stack.pop()
            group += parent.tag in ends
            if stack and stack[-1][1] and parent.tail:
                groups.append(group)
                texts.append(parent.tail)
    return groups, texts


def _flat_runs(root: ElementTree.Element, reads: str, ends: str, skips: str) -> tuple[list[int], list[str]] | None:
    """The same where text elements hold only text and stand in ends that hold no other, without a visit of every element; else None."""
    if any(map(len, root.iter(skips))) or any(map(len, root.iter(reads))):
        return None
    groups: list[int] = []
    texts: list[str] = []
    n = 0
    for group, end in enumerate(root.iter(ends)):
        some = [e.text for e in end.iter(reads)]
        n += len(some)
        if not all(some):
            some = [t for t in some if t]
        texts += some
        groups += [group] * len(some)
    # Nothing stands outside the ends, and none of them in another.
    if n != len(list(root.iter(reads))) or any(len(list(e.iter(ends))) > 1 for e in root.iter(ends)):
        return None
    return groups, texts


def _office_runs(data: bytes, ns: str) -> tuple[list[int], list[str]]:
    """Text counts only directly inside ``t``; spelling marks are skipped; a paragraph
    ends the group."""
    return _xml_runs(data, {ns + "t"}, {ns + "p"}, ns + "proofErr")


# Elements with mixed content, and elements after which words start afresh.
_ODF_TEXT = {_T + n for n in ("h", "p", "a", "span")}
_ODF_BREAKS = {_T + n for n in ("h", "p", "s", "tab", "line-break")}


def _odf_runs(data: bytes) -> tuple[list[int], list[str]]:
    """Mixed content of headings, paragraphs, links and spans."""
    return _xml_runs(data, _ODF_TEXT, _ODF_BREAKS)


def _segments_of(kind: str, data: bytes) -> tuple[list[int], list[str], list[bool], list[str]]:
    """Places, tags, whether hidden, and texts."""
    if kind in ("docx", "pptx"):
        paras, texts = _office_runs(data, _W if kind == "docx" else _A)
        return paras, ["t"] * len(texts), [False] * len(texts), texts
    if kind == "opendocument":
        paras, texts = _odf_runs(data)
        return paras, ["p"] * len(texts), [False] * len(texts), texts
    if kind == "text":
        return [0], [""], [False], [data.decode("utf-8", "replace")]
    found = page_segments(data.decode("utf-8", "replace"))
    tags, hidden, texts = ([segment[i] for segment in found] for i in range(3))
    return list(range(len(found))), tags, hidden, texts


def member_segments(members: DataFrame) -> DataFrame:
    """``doc, kind, part, seq, para, tag, hidden, text`` of readable members.

    A member that is not well-formed gives one hidden row, tagged ``error``, with the
    reason.
    """
    schema = "doc string, kind string, part string, seq int, para int, tag string, hidden boolean, text string"
    whose = ["doc", "kind", "part"]
    what = {"para": pa.int32(), "tag": pa.string(), "hidden": pa.bool_(), "text": pa.string()}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _in_pieces(batches, "content"):
            row, seq, segments = [], [], {c: [] for c in what}
            for r, (kind, data) in enumerate(zip(b.column("kind").to_pylist(), b.column("content").to_pylist())):
                try:
                    found = _segments_of(kind, data)
                except ElementTree.ParseError as e:
                    found = [0], ["error"], [True], [str(e)]
                row += [r] * len(found[0])
                seq += range(len(found[0]))
                for values, more in zip(segments.values(), found):
                    values += more
            at = pa.array(row, pa.int32())
            columns = {c: b.column(c).take(at) for c in whose} | {"seq": pa.array(seq, pa.int32())}
            columns |= {c: pa.array(values, what[c]) for c, values in segments.items()}
            yield pa.RecordBatch.from_pydict(columns)

    return members.filter("error is null").select("doc", "kind", "part", "content").mapInArrow(cut, schema)


# --- words split over runs -------------------------------------------------------


def _changes(column: pa.Array) -> np.ndarray:
    """Which values differ from the one before, nulls being equal."""
    out = np.ones(len(column), bool)
    try:
        differ = pc.not_equal(column.slice(1), column.slice(0, len(column) - 1))
    except pa.ArrowNotImplementedError:  # equality of such values is left to Spark
        return out
    null = column.is_null().to_numpy(zero_copy_only=False)
    out[1:] = pc.fill_null(differ, False).to_numpy(zero_copy_only=False) | (null[1:] != null[:-1])
    return out


def _strings(offsets: np.ndarray, data: bytes | np.ndarray | pa.Buffer) -> pa.Array:
    """Strings that follow each other in ``data``; one offset more than strings."""
    kind, offset = (pa.string(), np.int32) if offsets[-1] < 1 << 31 else (pa.large_string(), np.int64)
    return pa.Array.from_buffers(kind, len(offsets) - 1, [None, pa.py_buffer(offsets.astype(offset)), pa.py_buffer(data)])


def _lists(counts: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), values)


def _buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of strings without nulls, one after the other, and their offsets in them."""
    offset = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(texts.buffers()[1], offset)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data and at[-1] > at[0] else np.zeros(0, np.uint8), at - at[0]


def _characters(data: np.ndarray) -> np.ndarray:
    """Where each character of UTF-8 begins, and the end."""
    return np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))


def _stacked(runs: DataFrame, keys: list[str], seq: str, text: str) -> DataFrame:
    """``keys, _p``: the runs of a paragraph as pieces ``_s, _n, _t, _m, _up`` in no order.

    ``_s`` are places, ``_n`` sizes in characters, -1 of a null text, ``_t`` the texts put together, ``_m`` how many runs, and ``_up`` is
    whether the places go up. Whole numbers are written as steps from the one before, which pack well; ``_m`` is below zero then. Runs that
    stand together are one piece before the shuffle already.
    """
    types = dict(runs.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + f", _s array<{types[seq]}>, _n array<int>, _t string, _m int, _up boolean"

    def stack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            *whose, places, texts = b.columns
            begins = np.zeros(b.num_rows, bool)
            begins[0] = True
            for k in whose:
                begins |= _changes(k)
            heads = np.flatnonzero(begins)
            counts = np.diff(heads, append=b.num_rows)
            sizes = pc.fill_null(pc.utf8_length(texts), -1).cast(pa.int32())
            data, at = _buffer(pc.fill_null(texts, "") if texts.null_count else texts)
            up = np.ones(b.num_rows, bool)
            try:
                up[1:] = pc.fill_null(pc.greater(places.slice(1), places.slice(0, b.num_rows - 1)), False).to_numpy(zero_copy_only=False)
            except pa.ArrowNotImplementedError:
                up[1:] = False
            numbers = pa.types.is_integer(places.type) and not places.null_count
            if numbers:
                values = places.to_numpy()
                steps = np.diff(values, prepend=values[:1])
                steps[heads] = values[heads]
                places = pa.array(steps, places.type)
            taken = pa.array(heads)
            columns = [k.take(taken) for k in whose]
            columns += [_lists(counts, places), _lists(counts, sizes), _strings(at[np.append(heads, b.num_rows)], data)]
            columns += [pa.array(-counts if numbers else counts, pa.int32()), pa.array(np.logical_and.reduceat(up | begins, heads))]
            yield pa.RecordBatch.from_arrays(columns, [*keys, "_s", "_n", "_t", "_m", "_up"])

    pieces = runs.select(*keys, seq, text).mapInArrow(stack, schema)
    return pieces.groupBy(*keys).agg(F.collect_list(F.struct("_s", "_n", "_t", "_m", "_up")).alias("_p"))


def _places(lists: pa.Array, pieces: pa.Array) -> pa.Array:
    """The places of runs, from the steps and numbers of runs of their pieces."""
    flat, m = lists.flatten(), pieces.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if not (m < 0).any():
        return flat
    counts = np.abs(m)
    steps = np.repeat(m < 0, counts)  # nulls are in the other pieces
    known = flat.fill_null(0).to_numpy() if flat.null_count else flat.to_numpy()
    sums = np.cumsum(np.where(steps, known, 0), dtype=known.dtype)
    begins = np.cumsum(counts) - counts
    sums -= np.repeat(sums[begins] - known[begins], counts)
    return pa.array(np.where(steps, sums, known), flat.type, mask=flat.is_null().to_numpy(zero_copy_only=False))


def _ordered(places: list, sizes: list[int], text: str) -> list[tuple]:
    """``place, text or None`` of runs, null places first, then by place and text as Spark sorts them."""
    runs, at = [], 0
    for place, n in zip(places, sizes):
        runs.append((place, None if n < 0 else text[at : at + n]))
        at += max(n, 0)
    return sorted(runs, key=lambda r: ((r[0] is not None, r[0]) if r[0] is not None else (False,), (r[1] or "").encode(), r[1] is not None))


def _one_by_place(runs: list[tuple]) -> tuple[list, list[int], str, list[list[int]]]:
    """Places, sizes and text where the runs of one place are one run: all heads, then the inner parts, then all tails.

    Last, the sizes of its heads, inner parts and tails. A size below zero, ``~n``, is that of a run of n characters without a space
    that ends a word all the same.
    """
    places, sizes, texts, pieces = [], [], [], []
    for place, some in itertools.groupby(runs, key=lambda r: r[0]):
        parts = [], [], []
        for _, t in some:
            first, last = (0, 0) if t is None else (t.find(" "), t.rfind(" ") + 1)
            for part, x in zip(parts, [t] if first < 0 else ["", "", ""] if t is None else [t[:first], t[first:last], t[last:]]):
                part.append(x)
        parts = [sorted(part, key=str.encode) for part in parts]
        whole = "".join(x for part in parts for x in part)
        places.append(place)
        sizes.append(~len(whole) if parts[1] and not any(parts[1]) else len(whole))
        texts.append(whole)
        pieces.append([[len(x) for x in part] for part in parts])
    return places, sizes, "".join(texts), pieces


def _by_piece(places: list, stretches: list[int], offsets: list[int], pieces: list[list[int]]) -> tuple[list, ...]:
    """Places, stretches, offsets and parts (head, inner or tail) for each piece of the runs of a paragraph."""
    out = [], [], [], []
    for place, stretch, offset, parts in zip(places, stretches, offsets, pieces):
        for i, sizes in enumerate(parts):
            at = offset if i == 0 else 0
            for n in sizes:
                for column, value in zip(out, (place, stretch + i, at, i)):
                    column.append(value)
                at += n
    return out


def _by_place(dealt: list[dict], parts: list[int]) -> list[dict]:
    """The runs of a paragraph from pieces, those of one place and part in the order of what they are now."""
    order = sorted(zip(dealt, parts), key=lambda x: ((False,) if x[0]["seq"] is None else (True, x[0]["seq"]), x[1], x[0]["s"].encode()))
    return [{"seq": seq, "s": "".join(x["s"] for x, _ in some)} for seq, some in itertools.groupby(order, key=lambda x: x[0]["seq"])]


def interleaved(
    runs: DataFrame,
    keys: list[str],
    convert: Callable[[DataFrame, str], DataFrame],
    *,
    seq: str = "seq",
    text: str = "text",
    out: str = "text",
    mark: str | None = None,
) -> DataFrame:
    """Rewrite text that formatting cuts into runs, possibly inside a word.

    ``keys`` name a paragraph: its runs are one piece of text to a reader. A paragraph's
    runs are gathered, cut into stretches that no word crosses (a stretch starts at each
    run that holds a space), rewritten whole by ``convert(df, column)``, and dealt out
    again: each run keeps its own number of characters, the last of a stretch takes the
    rest. One shuffle, of a row per paragraph with all its runs; between gathering and
    dealing only the stretches are rows, and they stay where they are.

    A conversion that goes word by word need not see the stretches as rows: with ``mark``, a
    character of one byte that is part of no word and that ``convert`` leaves where it is, it
    gets one text for each paragraph, with the mark between the stretches.
    """
    if mark is not None:
        return _interleaved_by_marks(runs, keys, convert, seq, text, out, mark)
    # The head of a run up to and including its first space belongs with the runs before
    # it; what follows its last space belongs with the runs after it. Cutting every run
    # at those two places gives pieces; a stretch is a maximal chain of pieces with no
    # space between them. The inner part of a run, piece 1, is a stretch of its own.
    def piece(r: Column, i: int, s: Column) -> Column:
        return F.struct(r["seq"].alias("seq"), F.lit(i).alias("i"), s.alias("s"))

    def pieces(r: Column) -> Column:
        t, first, last = r["s"], r["first"], r["last"]
        return F.when(first == 0, F.array(piece(r, 0, t))).otherwise(
            F.array(
                piece(r, 0, F.substr(t, F.lit(1), first - 1)),
                piece(r, 1, F.substr(t, first, last - first + 1)),
                piece(r, 2, F.substr(t, last + 1)),
            )
        )

    def chains(ps: str, starts: Callable[[Column, Column], Column]) -> Column:
        """The array cut before each element that ``starts(element, the one before)``."""
        p = lambda i: F.get(F.col(ps), i)
        heads = F.filter(F.sequence(F.lit(0), F.size(ps) - 1), lambda i: (i == 0) | starts(p(i), p(i - 1)))
        # Each head next to the one after it.
        spans = F.arrays_zip(heads.alias("a"), F.concat(F.slice(heads, 2, F.size(ps)), F.array(F.size(ps))).alias("b"))
        return F.transform(spans, lambda x: F.slice(ps, x["a"] + 1, x["b"] - x["a"]))

    def spaces(r: Column) -> Column:
        last = F.length(r["s"]) - F.instr(F.reverse(r["s"]), " ") + 1
        return F.struct(r["seq"].alias("seq"), r["s"].alias("s"), F.instr(r["s"], " ").alias("first"), last.alias("last"))

    run = F.struct(F.col(seq).alias("seq"), F.col(text).alias("s"))
    whole = runs.select(*keys, run.alias("_r")).groupBy(*keys).agg(F.collect_list("_r").alias("_rs"))
    marked = F.transform(F.transform("_rs", spaces), pieces)
    whole = whole.select(*keys, computed_once(F.sort_array(F.flatten(marked))).alias("_ps"))
    cut = chains("_ps", lambda p, before: (p["i"] == 1) != (before["i"] == 1))
    whole = whole.select(*keys, F.posexplode(cut).alias("_g", "_ps"))
    whole = whole.withColumn("_whole", F.array_join(F.transform("_ps", lambda p: p["s"]), ""))
    done = convert(whole.withColumn("_was", F.col("_whole")), "_whole")
    starts = F.aggregate(
        F.transform("_ps", lambda p: F.length(p["s"])), F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n))
    )
    done = done.withColumn("_same", F.col("_whole") == F.col("_was"))
    done = done.withColumn("_st", computed_once(F.when(~F.col("_same"), starts)))

    def deal(p: Column, i: Column) -> Column:
        n = F.when(i == F.size("_ps") - 1, F.length("_whole")).otherwise(F.length(p["s"]))
        return F.struct(p["seq"].alias("seq"), p["i"].alias("i"), F.substr("_whole", F.get(F.col("_st"), i) + 1, n).alias("s"))

    # Most stretches come back as they went, and so do their pieces.
    dealt = F.when(F.col("_same"), F.col("_ps")).otherwise(F.transform("_ps", deal))
    back = done.select(*keys, F.struct("_g", dealt.alias("ps")).alias("_x")).groupBy(*keys).agg(F.sort_array(F.collect_list("_x")).alias("_xs"))
    back = back.select(*keys, computed_once(F.sort_array(F.flatten(F.transform("_xs", lambda x: x["ps"])))).alias("_ps"))
    one = F.transform(
        chains("_ps", lambda p, before: ~p["seq"].eqNullSafe(before["seq"])),
        lambda ps: F.struct(F.get(ps, 0)["seq"].alias("seq"), F.array_join(F.transform(ps, lambda p: p["s"]), "").alias("s")),
    )
    return back.select(*keys, F.explode(one).alias("_x")).select(*keys, F.col("_x.seq").alias(seq), F.col("_x.s").alias(out))


def _interleaved_by_marks(
    runs: DataFrame, keys: list[str], convert: Callable[[DataFrame, str], DataFrame], seq: str, text: str, out: str, mark: str
) -> DataFrame:
    if len(mark.encode()) != 1 or mark == " ":
        raise ValueError("the mark must be one character of one byte, other than a space")
    kind = dict(runs.dtypes)[seq]
    # s: places in order; b, o: stretch in which each run begins, and how many characters into it; c: stretches; k: where the text
    # holds the mark itself, the parts of each stretch; e: where runs were not in order, or share a place, s, b and o are of their
    # pieces, and this has which piece; t: the text with the marks
    cut = F.arrow_udf(_cutter(ord(mark)), f"s array<{kind}>, b array<int>, o array<int>, c int, k array<int>, e array<int>, t string")
    deal = F.arrow_udf(_dealer(ord(mark)), f"array<struct<seq:{kind}, s:string>>")
    p = _stacked(runs, keys, seq, text).select(*keys, *_put_together())
    p = p.select(*keys, cut("_s", "_m", "_n", "_t").alias("_c")).select(*keys, "_c", F.col("_c.t").alias("_whole"))
    x = F.explode(deal(F.struct(*[F.col(f"_c.{c}") for c in "sbocke"]), F.coalesce("_whole", F.lit(""))))
    return convert(p, "_whole").select(*keys, x.alias("_x")).select(*keys, F.col("_x.seq").alias(seq), F.col("_x.s").alias(out))


def _put_together() -> list[Column]:
    return [F.flatten("_p._s").alias("_s"), F.col("_p._m").alias("_m"), F.flatten("_p._n").alias("_n"), F.array_join("_p._t", "").alias("_t")]


def _cutter(mark: int) -> Callable[..., pa.Array]:
    def cut_some(places: pa.Array, pieces: pa.Array, sizes: pa.Array, texts: pa.Array) -> pa.Array:
        counts = pc.list_value_length(sizes).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = _places(places, pieces)
        places = _lists(counts, flat)
        whose = np.repeat(np.arange(len(counts)), counts)
        up = np.ones(len(flat), bool)
        try:
            up[1:] = pc.fill_null(pc.greater(flat.slice(1), flat.slice(0, max(0, len(flat) - 1))), False).to_numpy(zero_copy_only=False)
        except pa.ArrowNotImplementedError:
            up[1:] = False
        odd = np.unique(whose[1:][~up[1:] & (whose[1:] == whose[:-1])])
        pieces = {}
        if len(odd):  # runs that are not in order, or more than one of a place
            lists = places.to_pylist(), sizes.to_pylist(), texts.to_pylist()
            for i in odd.tolist():
                lists[0][i], lists[1][i], lists[2][i], pieces[i] = _one_by_place(_ordered(*(column[i] for column in lists)))
            places, sizes, texts = (pa.array(column, old.type) for column, old in zip(lists, (places, sizes, texts)))
            counts = pc.list_value_length(sizes).to_numpy(zero_copy_only=False).astype(np.int64)
            whose = np.repeat(np.arange(len(counts)), counts)
        data, at = _buffer(texts)
        chars = _characters(data)
        n = sizes.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(np.where(n < 0, ~n, n))
        begins = np.append(0, ends)[:-1]
        spaces = np.flatnonzero(data[chars[:-1]] == 32)
        i, j = np.searchsorted(spaces, begins), np.searchsorted(spaces, ends)
        broken = (j > i) | (n < 0)
        spaces = np.append(spaces, 0)
        first, last = np.where(j > i, spaces[i], ends), np.where(j > i, spaces[j - 1] + 1, ends)
        # Every run with a space, or a null one, ends a stretch, is one in its middle, and begins another.
        cuts = np.stack([first[broken], last[broken]], 1).ravel()
        head = np.append(0, np.cumsum(counts))[:-1]  # first run of each paragraph
        before = np.append(0, np.cumsum(broken))  # broken runs before each run
        slot = np.arange(len(counts)) + 2 * before[head]  # first stretch of each paragraph
        starts = np.zeros(len(counts) + len(cuts), np.int64)
        starts[slot] = begins[head]
        starts[np.arange(len(cuts)) + np.repeat(whose[broken], 2) + 1] = cuts
        stretch = 2 * (before[:-1] - before[head][whose])
        offset = begins - starts[slot[whose] + stretch]
        stretches = np.diff(slot, append=len(starts))
        own = np.flatnonzero(data[chars[:-1]] == mark)
        parts = None
        if len(own):
            found = np.bincount(np.searchsorted(starts, own, "right") - 1, minlength=len(starts)) + 1
            with_own = np.add.reduceat(found, slot) > stretches
            parts = [found[a : a + m].tolist() if w else None for a, m, w in zip(slot, stretches, with_own)]
        marked = np.insert(data, chars[cuts], np.uint8(mark))
        shift = 2 * np.append(before[head], before[-1])
        ints = pa.list_(pa.int32())
        runs = [places, *(_lists(counts, pa.array(x, pa.int32())) for x in (stretch, offset)), pa.nulls(len(counts), ints)]
        if pieces:
            lists = [x.to_pylist() for x in runs]
            for i, some in pieces.items():
                for column, value in zip(lists, _by_piece(*(column[i] for column in lists[:3]), some)):
                    column[i] = value
            runs = [pa.array(column, old.type) for column, old in zip(lists, runs)]
        columns = dict(zip("sboe", runs)) | {"c": pa.array(stretches, pa.int32()), "k": pa.array(parts or [None] * len(counts), ints), "t": _strings(at + shift, marked)}
        columns = {c: columns[c] for c in "sbocket"}
        return pa.StructArray.from_arrays(list(columns.values()), list(columns))

    def cut(places: pa.Array, pieces: pa.Array, sizes: pa.Array, texts: pa.Array) -> pa.Array:
        some = [cut_some(*(x.slice(a, n) for x in (places, pieces, sizes, texts))) for a, n in _pieces(pc.binary_length(texts))]
        return pa.concat_arrays(some) if some else cut_none(places.type)

    def cut_none(kind: pa.DataType) -> pa.Array:
        ints = pa.list_(pa.int32())
        return pa.array([], pa.struct([("s", kind), ("b", ints), ("o", ints), ("c", pa.int32()), ("k", ints), ("e", ints), ("t", pa.string())]))

    return cut


def _dealer(mark: int) -> Callable[..., pa.Array]:
    def deal_some(cut: pa.Array, texts: pa.Array) -> pa.Array:
        places, stretch, offset, stretches, parts, piece = cut.flatten()
        counts = pc.list_value_length(stretch).to_numpy(zero_copy_only=False).astype(np.int64)
        stretches = stretches.to_numpy(zero_copy_only=False).astype(np.int64)
        whose = np.repeat(np.arange(len(counts)), counts)
        data, at = _buffer(texts)
        chars = _characters(data)
        marks = np.flatnonzero(data[chars[:-1]] == mark)
        heads = np.searchsorted(chars, at)  # of texts, in characters
        slot = np.append(0, np.cumsum(stretches))[:-1]
        k = np.ones(int(stretches.sum()), np.int64)
        if parts.null_count < len(parts):
            for i, some in enumerate(parts.to_pylist()):
                if some is not None:
                    k[slot[i] : slot[i] + len(some)] = some
        expected = np.add.reduceat(k, slot)
        empty = np.diff(at) == 0  # all was lost, if there was anything
        got = np.diff(np.searchsorted(marks, heads)) + 1
        if (wrong := (got != expected) & ~empty).any():
            raise ValueError(f"the conversion must leave every mark where it is: {wrong.sum()} texts have others than before")
        # Starts of all parts and what ends them: the next mark, or the text. An emptied text has only empty parts.
        first_part = np.append(0, np.cumsum(k))[:-1]
        part_of = np.repeat(np.arange(len(counts)), expected)
        nth = np.arange(len(part_of)) - np.append(0, np.cumsum(expected))[:-1][part_of]
        begun, ended = heads[part_of], heads[part_of + 1]
        full = ~empty[part_of]
        begun[full & (nth > 0)] = marks + 1
        ended[full & (nth < expected[part_of] - 1)] = marks
        start, size = begun[first_part], ended[first_part + k - 1] - begun[first_part]
        ours = np.zeros(len(marks) + 1, bool)
        lasts = np.zeros(len(part_of), bool)
        lasts[first_part + k - 1] = True
        ours[:-1] = lasts[full & (nth < expected[part_of] - 1)]
        dropped = marks[ours[:-1]]
        at_stretch = slot[whose] + stretch.flatten().to_numpy(zero_copy_only=False)
        begins = start[at_stretch] + np.minimum(offset.flatten().to_numpy(zero_copy_only=False), size[at_stretch])
        bare = np.delete(data, chars[dropped])
        byte = np.append(chars[begins] - np.searchsorted(dropped, begins), len(bare))
        runs = _lists(counts, pa.StructArray.from_arrays([places.flatten(), _strings(byte, bare)], ["seq", "s"]))
        if piece.null_count == len(piece):
            return runs
        return pa.array([x if e is None else _by_place(x, e) for x, e in zip(runs.to_pylist(), piece.to_pylist())], runs.type)

    def deal(cut: pa.Array, texts: pa.Array) -> pa.Array:
        some = [deal_some(*(x.slice(a, n) for x in (cut, texts))) for a, n in _pieces(pc.binary_length(texts))]
        kind = pa.list_(pa.struct([("seq", cut.type.field("s").type.value_type), ("s", pa.string())]))
        return pa.concat_arrays(some) if some else pa.array([], kind)

    return deal


def joined_runs(runs: DataFrame, keys: list[str], *, seq: str = "seq", text: str = "text", out: str = "line") -> DataFrame:
    """``keys, out``: the runs of each paragraph put together, by place and then by text."""

    def join(places: pa.Array, pieces: pa.Array, sizes: pa.Array, texts: pa.Array) -> pa.Array:
        at = _lists(pc.fill_null(pc.list_value_length(places), 0).to_numpy(zero_copy_only=False), _places(places, pieces))
        rows = zip(at.to_pylist(), sizes.to_pylist(), texts.to_pylist())
        return pa.array([None if t is None else "".join(r[1] or "" for r in _ordered(p, n, t)) for p, n, t in rows], pa.string())

    p = _stacked(runs, keys, seq, text)
    straight = (F.size("_p") == 1) & F.get("_p", F.lit(0))["_up"]
    p = p.select(*keys, "_p", straight.alias("_straight"))
    mixed = F.arrow_udf(join, "string")(*[F.when(~F.col("_straight"), c) for c in _put_together()])
    return p.select(*keys, F.coalesce(mixed, F.get("_p._t", F.lit(0))).alias(out))


# --- extract and insert ----------------------------------------------------------


def quoted(text: Column | str) -> Column:
    """A segment as one quoted line: only quotes, backslashes and newlines are escaped."""
    t = F.col(text) if isinstance(text, str) else text
    t = F.replace(t, F.lit("\\"), F.lit("\\\\"))
    t = F.replace(t, F.lit('"'), F.lit('\\"'))
    t = F.replace(t, F.lit("\n"), F.lit("\\n"))
    return F.concat(F.lit('"'), t, F.lit('"'))


def unquoted(line: Column | str) -> Column:
    c = F.col(line) if isinstance(line, str) else line
    body = F.substr(c, F.lit(2), F.length(c) - 2)
    body = F.replace(body, F.lit("\\\\"), F.lit("\x01"))
    body = F.replace(F.replace(body, F.lit('\\"'), F.lit('"')), F.lit("\\n"), F.lit("\n"))
    return F.replace(body, F.lit("\x01"), F.lit("\\"))


def insert_segments(segments: DataFrame, edited: DataFrame, keys: list[str]) -> DataFrame:
    """Put edited texts ``(keys, new_text)`` back in place of the originals.

    Every visible segment needs its edited text and no other may be given.
    """
    e = edited.select(*keys, "new_text", F.lit(True).alias("_given"))
    j = segments.withColumn("_have", F.lit(True)).join(e, keys, "full_outer")
    wrong = F.col("_have").isNull() | (F.col("_given").isNull() & ~F.col("hidden"))
    checked = j.filter(
        F.when(wrong, F.raise_error(F.lit("edited segments do not line up")).cast("boolean")).otherwise(True)
    )
    return checked.withColumn(
        "text", F.when(F.col("hidden"), F.col("text")).otherwise(F.coalesce("new_text", "text"))
    ).drop("new_text", "_given", "_have")


def convert_segments(segments: DataFrame, convert: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """Apply any text conversion to what a reader sees; hidden text stays."""
    cols = segments.columns
    d = segments.withColumn("_shown", F.when(~F.col("hidden"), F.col("text")))
    return convert(d, "_shown").withColumn("text", F.coalesce("_shown", "text")).select(*cols)


def main_files(members: DataFrame) -> DataFrame:
    """``doc, main_file, n``: the only page of a book that is not navigation, a title page
    or a notice. ``main_file`` is null when there is not exactly one."""
    base = F.regexp_extract("part", r"([^/]*)\.[^./]*$", 1)
    page = F.col("part").rlike(r"\.(html|xhtml)$") & ~base.isin("nav", "title", "about")
    return members.groupBy("doc").agg(
        F.count_if(page).alias("n"), F.min(F.when(page, F.col("part"))).alias("_f")
    ).select("doc", F.when(F.col("n") == 1, F.col("_f")).alias("main_file"), "n")
