import hashlib
import io
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphie.operators import respell as R
from graphie.operators import segments as S
from graphie.operators.dictionary import Dictionary
from graphie.plans import files as P
from graphie.plans.files import _W_NS, _pack


def interleave(spark, runs, entries):
    d = Dictionary.of(spark, entries)
    df = spark.createDataFrame([("p", i, t) for i, t in enumerate(runs)], "k string, seq int, text string")
    out = S.interleaved(df, ["k"], lambda x, c: R.respell(x, c, d, marker="s"))
    return [r.text for r in out.orderBy("seq").collect()]


@pytest.mark.parametrize(
    "runs, entries, expected",
    [
        (["mot ch", "at noir"], {"chat": "xat"}, ["mot xa", "t noir"]),
        (["mot cha", "ts noir"], {"chat": "xat"}, ["mot xat", "s noir"]),
        (["Il me", "t", " bien"], {"met": "mes"}, ["Il me", "s", " bien"]),
        (["p", "omme pomme"], {"pomme": "pome"}, ["p", "ome pome"]),
        (["a chat chat ch", "at"], {"chat": "xa"}, ["a xa xa xa", ""]),
        (["ch", "a", "t"], {"chat": "xyzuvw"}, ["xy", "z", "uvw"]),
    ],
)
def test_words_cut_by_formatting(spark, runs, entries, expected):
    assert interleave(spark, runs, entries) == expected


def test_hidden_text(spark):
    html = (
        "<html lang='fr'><head><title>T</title><style>s</style></head><body><p>a<br>b</p><script>x</script>"
        "<div class='x notranslate'>h<span>i</span></div><code>c</code><p contenteditable=true>e</p>"
        "<textarea>t</textarea><noscript>n</noscript><p>last &amp; end</body></html>"
    )
    df = spark.createDataFrame([(1, html)], "id int, html string")
    rows = S.html_segments(df, "html", "id").orderBy("seq").collect()
    assert [r.text for r in rows if not r.hidden] == ["T", "a", "b", "last & end"]
    assert {r.text for r in rows if r.hidden} == {"s", "x", "h", "i", "c", "e", "t", "n"}
    assert S.visible_text(df, "html").first().visible == "T\na\nb\nlast & end\n"


def zipped(**members):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in members.items():
            z.writestr(name.replace("__", "/"), data)
    return b.getvalue()


def test_docx_runs(spark):
    body = (
        '<w:p><w:r><w:t>Il me</w:t></w:r><w:proofErr w:type="s"><w:r><w:t>no</w:t></w:r></w:proofErr>'
        "<w:r><w:t>x</w:t></w:r></w:p><w:p><w:x>skip</w:x><w:t>b</w:t></w:p>"
    )
    doc = zipped(**{"word/document.xml": f'<w:d xmlns:w="{_W_NS}">{body}</w:d>', "word/other.xml": "<a/>"})
    df = spark.createDataFrame([("x.DOCX", doc)], "path string, content binary")
    seg = S.member_segments(S.container_members(df)).orderBy("seq").collect()
    assert [(r.para, r.text) for r in seg] == [(0, "Il me"), (0, "x"), (1, "b")]


def test_opendocument_breaks(spark):
    ns = "urn:oasis:names:tc:opendocument:xmlns:text:1.0"
    x = f'<o xmlns:text="{ns}">no<text:p>a<text:span>b</text:span>c<text:s/>d<other>no</other>e</text:p><text:h>f</text:h></o>'
    df = spark.createDataFrame([("x.odt", zipped(**{"content.xml": x}))], "path string, content binary")
    seg = S.member_segments(S.container_members(df)).orderBy("seq").collect()
    assert [(r.para, r.text) for r in seg] == [(0, "a"), (0, "b"), (0, "c"), (1, "d"), (1, "e"), (2, "f")]


def test_rejected_files(spark):
    bomb = zipped(**{"word/document.xml": "x" * 100_000})
    df = spark.createDataFrame(
        [("a.docx", bomb), ("b.docx", b"junk"), ("c.exe", b""), ("d.doc", b""), ("e.txt", "é".encode())], "path string, content binary"
    )
    rows = {r.doc: r.error for r in S.container_members(df, max_bytes=50_000).collect()}
    assert rows["a.docx"] == "files in zip too large" and rows["b.docx"].startswith("not a readable")
    assert rows["c.exe"] == "unsupported file format" and "too old" in rows["d.doc"] and rows["e.txt"] is None


def test_extract_and_insert(spark):
    texts = ['say "hi"', "back\\slash", "two\nlines", "\\n", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    back = df.select("i", S.unquoted(S.quoted("t")).alias("t")).orderBy("i").collect()
    assert [r.t for r in back] == texts
    seg = df.select(F.col("i"), F.col("t").alias("text"), F.lit(False).alias("hidden"))
    short = seg.filter("i > 0").select("i", F.lit("n").alias("new_text"))
    with pytest.raises(Exception, match="do not line up"):
        S.insert_segments(seg, short, ["i"]).collect()


def test_book_main_file(spark):
    one = zipped(**{"a__nav.xhtml": "", "a__book.xhtml": "<p>x</p>", "title.html": ""})
    two = zipped(**{"a.html": "", "b.html": ""})
    df = spark.createDataFrame([("1.epub", one), ("2.epub", two)], "path string, content binary")
    got = {r.doc: r.main_file for r in S.main_files(S.container_members(df)).collect()}
    assert got == {"1.epub": "a/book.xhtml", "2.epub": None}


class _Captured:
    """Stands for a DataFrame and gives back the function that would run in the tasks."""

    def __getattr__(self, name):
        return (lambda f, schema: f) if name == "mapInArrow" else (lambda *a: self)

    dtypes = [("id", "bigint")]


def test_small_files_share_batches():
    """A batch for each file cost more than its text: findings F2, F6 and F13."""
    files = pa.RecordBatch.from_pydict(
        {"doc": [f"{i}.docx" for i in range(900)], "kind": ["docx"] * 900, "content": [_pack("docx", "un mot\net deux")] * 900}
    )
    members = list(S.container_members(_Captured())(iter([files])))
    assert [b.num_rows for b in members] == [900]
    segments = list(S.member_segments(_Captured())(iter(members)))
    assert [b.num_rows for b in segments] == [900 * 2]
    assert segments[0].column("text").to_pylist()[:2] == ["un mot", "et deux"]


def test_batches_are_bounded_by_bytes():
    """Pages of a large batch were cut into segments all at once: findings F5 and F11."""
    page = "<p>" + "a" * 300_000 + "</p>"
    pages = pa.RecordBatch.from_pydict({"id": list(range(20)), "html": [page] * 20})
    out = list(S.html_segments(_Captured(), "html", "id")(iter([pages])))
    assert sum(b.num_rows for b in out) == 20
    assert max(b.nbytes for b in out) < 2 * S.PIECE_BYTES
    files = pa.RecordBatch.from_pydict({"doc": ["d.docx"] * 20, "kind": ["docx"] * 20, "content": [_pack("docx", "a" * 100_000)] * 20})
    members = list(S.container_members(_Captured())(iter([files])))
    assert sum(b.num_rows for b in members) == 20 and max(b.nbytes for b in members) < 2 * S.PIECE_BYTES


def test_rows_of_odd_files(spark):
    rows = [("a.txt", b"x"), ("b.exe", b"x"), ("c.docx", None), (None, b"x"), ("d.epub", _pack("epub", "")), ("e.docx", _pack("docx", ""))]
    m = S.container_members(spark.createDataFrame(rows, "path string, content binary"))
    got = {r.doc: (r.kind, r.part, r.n_bytes, r.error) for r in m.filter("part is null or part <> 'OEBPS/nav.xhtml'").collect()}
    assert got["a.txt"] == ("text", "", 1, None) and got["b.exe"][3] == got[None][3] == "unsupported file format"
    assert got["c.docx"][3].startswith("not a readable container") and got["d.epub"][1] == "OEBPS/book.xhtml"
    assert [r.text for r in S.member_segments(m.filter("doc in ('a.txt', 'e.docx')")).collect()] == ["x"]


def test_pages_without_text(spark):
    df = spark.createDataFrame([(1, None), (None, ""), (2, "<p>a</p>")], "id bigint, html string")
    assert [tuple(r) for r in S.html_segments(df, "html", "id").collect()] == [(2, 0, "p", False, "a")]
    assert [r.visible for r in S.visible_text(df, "html").collect()] == [None, "", "a\n"]


RUNS = [
    ["mot ch", "at noir"], ["mot cha", "ts noir"], ["p", "omme pomme"], ["a chat chat ch", "at"], ["ch", "a", "t"], [" ch", "at ", "", " ", "é chat"],
    ["", "", ""], ["é ch", "a", "t e", "́"], ["ch\x1fat ch", "at\x1f", "pomm", "e\x1f a"], ["𝒳 ch", "at𝒳", " cha", "t"], ["  chat  ", "  chat"],
]


def both_ways(spark, rows, kind="int"):
    d = Dictionary.of(spark, {"chat": "xa", "pomme": "pommé", "a": "abcdefgh", "e": ""})
    df = spark.createDataFrame(rows, f"k string, j int, seq {kind}, text string").repartition(3)
    convert = lambda x, c: R.respell(x, c, d, marker="s")
    return [sorted(map(str, S.interleaved(df, ["k", "j"], convert, **how).collect())) for how in ({}, {"mark": "\x1f"})]


def test_marks_give_the_rows_of_stretches(spark):
    rows = [(None if i == 3 else f"p{i}", i % 2, 5 * s - 7, t) for i, runs in enumerate(RUNS) for s, t in enumerate(runs)]
    was, now = both_ways(spark, rows)
    assert now == was and len(now) == len(rows)


def test_marks_where_places_repeat_or_are_null(spark):
    twice = [("p", 1, s, t) for runs in RUNS for s, t in enumerate(runs)]  # many runs for each place
    none = [(None, None, None, "b ch"), (None, None, 0, "at "), (None, None, None, "cha b")]
    nulls = [("n", 0, 0, "ch"), ("n", 0, 0, None), ("n", 0, 1, "ien"), ("m", 0, 0, None), ("o", 0, 1, None), ("o", 0, 2, "un")]
    for kind, change in (("int", lambda s: s), ("string", lambda s: s if s is None else f"{s:03}")):
        was, now = both_ways(spark, [(k, j, change(s), t) for k, j, s, t in twice + none + nulls], kind)
        assert now == was


def test_nothing_is_lost_after_a_null_run(spark):
    df = spark.createDataFrame([("p", 0, "un ch"), ("p", 1, None), ("p", 2, "chat un")], "k string, seq int, text string")
    d = Dictionary.of(spark, {"chat": "xa"})
    out = S.interleaved(df, ["k"], lambda x, c: R.respell(x, c, d), mark="\x1f").orderBy("seq").collect()
    assert [r.text for r in out] == ["un ch", "", "xa un"]


def test_marks_must_stay(spark):
    df = spark.createDataFrame([("p", 0, "un chat")], "k string, seq int, text string")
    with pytest.raises(Exception, match="must leave every mark"):
        S.interleaved(df, ["k"], lambda x, c: x.withColumn(c, F.translate(c, "\x1f", "")), mark="\x1f").collect()
    gone = S.interleaved(df, ["k"], lambda x, c: x.withColumn(c, F.lit(None).cast("string")), mark="\x1f").collect()
    assert [r.text for r in gone] == [""]


def test_joined_runs(spark):
    rows = [("p", 0, 2, "c"), ("p", 0, 1, "b"), ("p", 0, 1, "a"), ("p", 0, None, "0"), ("p", 1, 1, None), (None, None, 7, "x"), (None, None, 8, "y"), (None, None, 9, None)]
    for n in (1, 4):
        df = spark.createDataFrame(rows, "k string, j int, seq int, text string").repartition(n)
        assert {(r.k, r.j): r.line for r in S.joined_runs(df, ["k", "j"]).collect()} == {("p", 0): "0abc", ("p", 1): "", (None, None): "xy"}


def test_paragraphs_are_converted_whole(spark, tmp_path, monkeypatch):
    """Each stretch between two words was a row of the conversion, and a shuffle carried them: finding F1."""
    spark.createDataFrame([(1, "pour une eau qui est dans les eaux\n\nune elle"), (2, "pas que")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    respell = R.respell
    monkeypatch.setattr(P.R, "respell", lambda df, *a, **b: seen.append(df.count()) or respell(df, *a, **b))
    out = P.docx_respell_across_runs(spark, str(tmp_path))
    assert seen == [3] and out._jdf.queryExecution().executedPlan().toString().count("Generate explode") == 1
    lines = ["pur unne ô qi est dan les eaux", "unne ele", "pa qe"]
    assert {r.digest for r in out.collect()} == {hashlib.md5(x.encode()).hexdigest() for x in lines}


@pytest.mark.parametrize("body", [
    "<w:p><w:r><w:t>a</w:t><w:t/></w:r><w:proofErr w:type='s'/></w:p><w:p/><w:p><w:t>b&amp;c</w:t></w:p>",
    "<w:p><w:t>a<w:x/>b</w:t></w:p>", "<w:p><w:t>a</w:t></w:p><w:t>b</w:t><w:p><w:p><w:t>c</w:t></w:p></w:p>",
    "<w:p><w:t>a</w:t><w:p><w:t>b</w:t></w:p><w:t>c</w:t></w:p>", "<w:proofErr><w:p><w:t>a</w:t></w:p></w:proofErr><w:p><w:t>b<!-- x -->c</w:t></w:p>", "",
])
def test_flat_members_read_as_any_other(body, monkeypatch):
    data = f'<w:d xmlns:w="{_W_NS}">{body}</w:d>'.encode()
    now = S._office_runs(data, S._W)
    monkeypatch.setattr(S, "_flat_runs", lambda *a: None)
    assert now == S._office_runs(data, S._W)
