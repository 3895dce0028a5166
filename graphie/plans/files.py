"""Files and containers made from the tables, read back by the readers."""

from __future__ import annotations

import io
import re
import zipfile
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphie.operators import lexicon as X
from graphie.operators import respell as R
from graphie.operators import segments as S
from graphie.operators.dictionary import Dictionary, Metadata
from graphie.plans.dictionaries import ranked
from graphie.plans.registry import (
    DICTS_SQL, LEXICON_SQL, SMOKE_SQL, VOCAB_SQL, dict_eau, documents, lexicon, query, smoke_dictionary, table, vocabulary,
)
from graphie.plans.respelling import respell_sql
from graphie.sources import dictionary_io as IO
from graphie.sources import lexicon_io as LX
from graphie.sources.files import read_documents, work_folder


@query("dictionary_file_roundtrip", f"WITH {DICTS_SQL} SELECT old, new, 'fr' AS lang, '+' AS marker FROM d1")
def dictionary_file_roundtrip(spark, sf):
    path = work_folder(spark, "dict") + "/d"
    d = dict_eau(spark, sf).withColumn("rank", F.length("old"))
    IO.write_dictionary(d, Metadata(lang="fr", plurals_in_s="+"), path)
    back = IO.read_dictionary(spark, path)
    return back.df.select("old", "new", F.lit(back.meta.lang).alias("lang"), F.lit(back.meta.marker()).alias("marker"))


@query(
    "dictionary_file_all_words",
    f"WITH {VOCAB_SQL} SELECT word || ',' || replace(word, 'eau', 'ô') || ',' || CASE WHEN contains(word, 'eau') THEN 'M' ELSE '=' END AS line FROM vocab",
)
def dictionary_file_all_words(spark, sf):
    v = vocabulary(spark, sf)
    d = v.select(F.col("word").alias("old"), F.replace("word", F.lit("eau"), F.lit("ô")).alias("new"), F.col("n").alias("rank"))
    return IO.dictionary_lines(d, Metadata(), all_words=True).select("line")


@query(
    "keyboard_file",
    f"""WITH {LEXICON_SQL}, d AS (SELECT ortho AS old, replace(ortho, 'eau', 'ô') AS new FROM lexicon WHERE contains(ortho, 'eau')),
t AS (SELECT new, min(rank) AS rank FROM lexicon JOIN d ON d.old = ortho GROUP BY 1 ORDER BY 2, 1 LIMIT 1000)
SELECT 1 AS line_no, '# Gboard Dictionary version:1' AS line UNION ALL SELECT 2, ''
UNION ALL SELECT 2 + row_number() OVER (ORDER BY new), chr(9) || new || chr(9) || 'fr-FR' FROM t""",
)
def keyboard_file(spark, sf):
    """The keyboard list as written, in the order of its parts."""
    path = work_folder(spark, "keyboard") + "/k"
    IO.write_keyboard_list(X.keyboard_list(ranked(spark, sf), dict_eau(spark, sf)), path)
    return IO.numbered_lines(spark, path)


@query(
    "dictionary_file_lines",
    f"""WITH {VOCAB_SQL}, d AS (SELECT word, n, replace(word, 'eau', 'ô') AS new FROM vocab WHERE contains(word, 'e'))
SELECT 1 AS line_no, '{{"lang":"fr"}}' AS line UNION ALL SELECT 1 + row_number() OVER (ORDER BY n, word), word || ',' || new FROM d""",
)
def dictionary_file_lines(spark, sf):
    """A dictionary file of many parts, whose lines are in order over all of them."""
    path = work_folder(spark, "dict") + "/d"
    d = vocabulary(spark, sf).filter(F.contains("word", F.lit("e")))
    d = d.select(F.col("word").alias("old"), F.replace("word", F.lit("eau"), F.lit("ô")).alias("new"), F.col("n").alias("rank"))
    IO.write_dictionary(d, Metadata(lang="fr"), path)
    return IO.numbered_lines(spark, path)


@query("key_value_file", f"WITH {DICTS_SQL} SELECT old, new FROM d1")
def key_value_file(spark, sf):
    path = work_folder(spark, "kv") + "/d"
    d = dict_eau(spark, sf)
    # A second definition of each word comes later in the file and must lose.
    twice = d.withColumn("rank", F.lit(1)).unionByName(d.select("old", F.lit("x").alias("new"), F.lit(2).alias("rank")))
    IO.write_dictionary(twice, None, path)
    return IO.read_key_values(spark, path)


@query(
    "lexicon_file_roundtrip",
    f"WITH {LEXICON_SQL} SELECT ortho, phon, lemme, length(ortho) % 2 = 0 AS h_aspire FROM lexicon",
)
def lexicon_file_roundtrip(spark, sf):
    path = work_folder(spark, "lex") + "/l"
    flag = F.when(F.length("ortho") % 2 == 0, "t").otherwise("f").alias("h_aspire")
    out = lexicon(spark, sf).select("ortho", "phon", "lemme", flag)
    out.write.option("sep", "\t").option("header", True).option("quote", "").csv(path)
    return LX.read_lexicon(spark, path).drop("rank")


@query("frequency_file_roundtrip", f"WITH {VOCAB_SQL} SELECT word, n AS count FROM vocab")
def frequency_file_roundtrip(spark, sf):
    path = work_folder(spark, "freq") + "/f"
    vocabulary(spark, sf).write.option("sep", " ").option("quote", "").csv(path)
    return LX.read_frequencies(spark, path)


@query(
    "dump_file_roundtrip",
    f"""WITH {LEXICON_SQL} SELECT ortho AS word, phon AS ipa, CASE WHEN contains(ortho, 'h') THEN 'h aspiré' END AS tag FROM lexicon""",
)
def dump_file_roundtrip(spark, sf):
    path = work_folder(spark, "dump") + "/d"
    tags = F.when(F.contains("ortho", F.lit("h")), F.array(F.lit("h aspiré")))
    j = lexicon(spark, sf).select(
        F.to_json(F.struct(F.col("ortho").alias("word"), tags.alias("tags"), F.array(F.struct(F.col("phon").alias("ipa"))).alias("sounds"))).alias("value")
    )
    j.unionByName(spark.createDataFrame([("not json",)], "value string")).write.text(path)
    d = LX.read_dump(spark, path)
    return d.select("word", F.get(F.col("sounds"), F.lit(0))["ipa"].alias("ipa"), F.get(F.col("tags"), F.lit(0)).alias("tag"))


# --- pages -----------------------------------------------------------------------


@query(
    "page_titles",
    """SELECT page_id, replace(replace(replace(replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&amp;', '&') AS title FROM pages""",
)
def page_titles(spark, sf):
    s = S.html_segments(table(spark, sf, "pages", "page_id"), "html", "page_id")
    return s.filter("tag = 'title'").groupBy("page_id").agg(F.min_by("text", "seq").alias("title"))


@query("page_segments")
def page_segments(spark, sf):
    return S.html_segments(table(spark, sf, "pages", "page_id"), "html", "page_id")


@query(
    "page_hidden_segments",
    """WITH x AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<script[^>]*>(.*?)</script>', 1)) AS t, 'script' AS tag FROM pages
  UNION ALL SELECT page_id, unnest(regexp_extract_all(html, '(?is)<style[^>]*>(.*?)</style>', 1)), 'style' FROM pages)
SELECT page_id, tag, count(*) AS n, CAST(sum(length(t)) AS BIGINT) AS n_chars FROM x WHERE t <> '' GROUP BY 1, 2""",
)
def page_hidden_segments(spark, sf):
    s = S.html_segments(table(spark, sf, "pages", "page_id"), "html", "page_id").filter("hidden")
    return s.groupBy("page_id", "tag").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("n_chars"))


@query("page_respell_visible")
def page_respell_visible(spark, sf):
    """Hidden segments come out as they went in."""
    s = S.html_segments(table(spark, sf, "pages", "page_id"), "html", "page_id")
    d = smoke_dictionary(spark)
    return S.convert_segments(s, lambda df, c: R.respell(df, c, d))


# --- office files ----------------------------------------------------------------

_W_NS = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_T_NS = "urn:oasis:names:tc:opendocument:xmlns:text:1.0"
_O_NS = "urn:oasis:names:tc:opendocument:xmlns:office:1.0"
CHUNK = 7


_CONTROLS = re.compile(r"[\x00-\x08\x0b-\x1f]")


def _clean(text: str) -> str:
    return _CONTROLS.sub(" ", text)


def _pack(kind: str, text: str) -> bytes:
    """One document as a small container: a paragraph per line, cut into runs."""
    lines = _clean(text).split("\n")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        if kind == "docx":
            paras = []
            for line in lines:
                runs = [line[i : i + CHUNK] for i in range(0, len(line), CHUNK)]
                if any(c in line for c in "&<>"):
                    runs = map(escape, runs)
                body = line and f"<w:r><w:t>{'</w:t></w:r><w:r><w:t>'.join(runs)}</w:t></w:r>"
                paras.append(f'<w:p>{body}<w:proofErr w:type="spellEnd"/></w:p>')
            z.writestr("word/document.xml", f'<w:document xmlns:w="{_W_NS}"><w:body>{"".join(paras)}</w:body></w:document>')
            z.writestr("word/styles.xml", "<x>unread</x>")
        elif kind == "odt":
            body = "".join(f"<text:p>{escape(line)}</text:p>" for line in lines)
            z.writestr("content.xml", f'<office:d xmlns:office="{_O_NS}" xmlns:text="{_T_NS}">{body}</office:d>')
        else:
            body = "".join(f"<p>{escape(line)}</p>" for line in lines)
            z.writestr("OEBPS/book.xhtml", f"<html><body>{body}</body></html>")
            z.writestr("OEBPS/nav.xhtml", "<html><body>nav</body></html>")
    return out.getvalue()


def packed(spark, sf, kind: str):
    def pack(batches):
        for b in batches:
            paths = [f"{i}.{kind}" for i in b.column("doc_id").to_pandas()]
            for at in range(0, b.num_rows, 200):  # neither the texts nor a packed batch are ever held whole
                content = [_pack(kind, t) for t in b.column("text").slice(at, 200).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(paths[at : at + 200], pa.string()), pa.array(content, pa.binary())], ["path", "content"])

    return documents(spark, sf, "doc_id", "text").mapInArrow(pack, "path string, content binary")


LINES_SQL = """lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS para FROM documents)"""


@query(
    "docx_paragraphs",
    f"""WITH {LINES_SQL} SELECT doc_id || '.docx' AS doc, para, length(line) AS n_chars, CAST(ceil(length(line) / 7.0) AS BIGINT) AS n_runs,
  md5(regexp_replace(line, '[\\x00-\\x08\\x0b-\\x1f]', ' ', 'g')) AS digest FROM lines WHERE line <> ''""",
)
def docx_paragraphs(spark, sf):
    m = S.container_members(packed(spark, sf, "docx"))
    s = S.member_segments(m)
    g = s.groupBy("doc", F.col("para").cast("bigint").alias("para")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "").alias("line"),
        F.count(F.lit(1)).alias("n_runs"),
    )
    return g.select("doc", "para", F.length("line").alias("n_chars"), "n_runs", F.md5("line").alias("digest"))


@query(
    "opendocument_paragraphs",
    f"""WITH {LINES_SQL} SELECT doc_id || '.odt' AS doc, CAST(para AS BIGINT) AS para, md5(regexp_replace(line, '[\\x00-\\x08\\x0b-\\x1f]', ' ', 'g')) AS digest FROM lines WHERE line <> ''""",
)
def opendocument_paragraphs(spark, sf):
    s = S.member_segments(S.container_members(packed(spark, sf, "odt")))
    return s.select("doc", F.col("para").cast("bigint").alias("para"), F.md5("text").alias("digest"))


def _respelled_lines_sql(doc: str) -> str:
    lines = (
        "(SELECT doc_id || '." + doc + "' AS doc, unnest(string_split(text, chr(10))) AS text, "
        "generate_subscripts(string_split(text, chr(10)), 1) - 1 AS para FROM documents)"
    )
    base = respell_sql(f"(SELECT doc, para, regexp_replace(text, '[\\x00-\\x08\\x0b-\\x1f]', ' ', 'g') AS text FROM {lines} WHERE text <> '')", "doc, para", SMOKE_SQL)
    return f"SELECT doc, CAST(para AS BIGINT) AS para, md5(text) AS digest FROM ({base})"


@query("docx_respell_across_runs", _respelled_lines_sql("docx"))
def docx_respell_across_runs(spark, sf):
    """Runs of seven characters cut most words; the paragraph must read as if whole."""
    s = S.member_segments(S.container_members(packed(spark, sf, "docx")))
    d = smoke_dictionary(spark)
    r = S.interleaved(s, ["doc", "part", "para"], lambda df, c: R.respell(df, c, d), mark="\x1f")
    g = S.joined_runs(r, ["doc", "para"])
    return g.select("doc", F.col("para").cast("bigint").alias("para"), F.md5("line").alias("digest"))


@query(
    "interleaved_run_lengths",
    """WITH r AS (SELECT conv_id, turn, text, unnest(range(0, length(text), 7)) AS o FROM conversations)
SELECT conv_id, turn, CAST(floor(o / 7) AS BIGINT) AS seq, length(substr(text, o + 1, 7)) AS n_chars FROM r""",
)
def interleaved_run_lengths(spark, sf):
    """A conversion that changes nothing gives every run back as it was."""
    t = table(spark, sf, "conversations", "conv_id").select("conv_id", "turn", "text").filter("text <> ''")
    at = F.sequence(F.lit(0), F.length("text") - 1, F.lit(CHUNK))
    runs = t.select("conv_id", "turn", F.posexplode(F.transform(at, lambda i: F.substr("text", i + 1, F.lit(CHUNK)))).alias("seq", "text"))
    r = S.interleaved(runs, ["conv_id", "turn"], lambda df, c: df)
    return r.select("conv_id", "turn", F.col("seq").cast("bigint").alias("seq"), F.length("text").alias("n_chars"))


# Bytes of a packed book besides its text: markup of the page, of each paragraph, and the other page.
_PAGE, _PARAGRAPH, _NAV = len("<html><body></body></html>"), len("<p></p>"), len("<html><body>nav</body></html>")


def _count(x: str) -> str:
    return f"(length(text) - length(replace(text, {x}, '')))"


@query(
    "size_guard",
    f"""SELECT doc_id || '.epub' AS doc, octet_length(encode(text)) - {_count('chr(10)')} + 4 * {_count("'&'")} + 3 * ({_count("'<'")} + {_count("'>'")})
  + {_PARAGRAPH} * ({_count('chr(10)')} + 1) + {_PAGE + _NAV} > 4000 AS too_big FROM documents""",
)
def size_guard(spark, sf):
    """Which books are over the limit, and so reported instead of unpacked."""
    m = S.container_members(packed(spark, sf, "epub"), max_bytes=4000)
    return m.groupBy("doc").agg(F.max(F.coalesce(F.col("error") == "files in zip too large", F.lit(False))).alias("too_big"))


@query("book_main_files", "SELECT doc_id || '.epub' AS doc, 'OEBPS/book.xhtml' AS main_file, 1 AS n FROM documents")
def book_main_files(spark, sf):
    m = S.main_files(S.container_members(packed(spark, sf, "epub")))
    return m.withColumn("n", F.col("n").cast("int"))


_LINES_SQL = """(SELECT doc_id, i, regexp_replace(line, '[\\x00-\\x08\\x0b-\\x1f]', ' ', 'g') AS text FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents))"""


@query(
    "book_respell",
    f"""WITH r AS ({respell_sql(_LINES_SQL, 'doc_id, i', SMOKE_SQL)})
SELECT doc_id || '.epub' AS doc, i AS paragraph, text FROM r WHERE text <> ''""",
)
def book_respell(spark, sf):
    """The paragraphs of books after conversion, counted from 1; empty ones have no text to convert."""
    s = S.member_segments(S.container_members(packed(spark, sf, "epub")))
    d = smoke_dictionary(spark)
    r = S.convert_segments(s, lambda df, c: R.respell(df, c, d)).filter("part = 'OEBPS/book.xhtml'")
    lines = documents(spark, sf, "doc_id", "text").select(
        F.concat("doc_id", F.lit(".epub")).alias("doc"), F.posexplode(F.split("text", "\n")).alias("at", "line")
    )
    n = F.row_number().over(W.partitionBy("doc").orderBy("at"))
    place = lines.filter("line <> ''").select("doc", (F.col("at") + 1).cast("bigint").alias("paragraph"), n.alias("n"))
    seen = r.select("doc", "text", F.row_number().over(W.partitionBy("doc").orderBy("seq")).alias("n"))
    return seen.join(place, ["doc", "n"], "full_outer").select("doc", "paragraph", "text")


@query("document_files", "SELECT 'text' AS kind, CAST(sum(octet_length(encode(text)) + 1) AS BIGINT) AS n_bytes FROM documents")
def document_files(spark, sf):
    """A folder of text files and of files of a kind that is not supported, as read."""
    folder = work_folder(spark, "files")
    docs = documents(spark, sf, "doc_id", "text")
    docs.select("text").write.text(f"{folder}/text")
    docs.select("doc_id").write.csv(f"{folder}/csv")
    return read_documents(spark, f"{folder}/*").groupBy("kind").agg(F.sum("length").alias("n_bytes"))


@query(
    "document_kinds",
    """SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'docx' WHEN page_id % 3 = 1 THEN 'opendocument' END AS kind FROM pages""",
)
def document_kinds(spark, sf):
    p = table(spark, sf, "pages")
    ext = F.element_at(F.array(F.lit(".DOCX"), F.lit(".odp"), F.lit(".exe")), (F.col("page_id") % 3 + 1).cast("int"))
    return p.select("page_id", S.document_kind(F.concat("url", ext)).alias("kind"))


@query(
    "extract_lines",
    """SELECT doc_id, md5('"' || replace(replace(replace(text, '\\', '\\\\'), '"', '\\"'), chr(10), '\\n') || '"') AS digest FROM documents""",
)
def extract_lines(spark, sf):
    return documents(spark, sf, "doc_id", "text").select("doc_id", F.md5(S.quoted("text")).alias("digest"))


@query("extract_insert_roundtrip", "SELECT doc_id, md5(text || '!') AS digest FROM documents")
def extract_insert_roundtrip(spark, sf):
    docs = documents(spark, sf, "doc_id", "text").withColumn("hidden", F.lit(False))
    edited = docs.select("doc_id", S.unquoted(S.quoted(F.concat("text", F.lit("!")))).alias("new_text"))
    return S.insert_segments(docs, edited, ["doc_id"]).select("doc_id", F.md5("text").alias("digest"))


OVERRIDES = {"pour": "por", "LES": "lés", "de": ""}


@query(
    "curated_overrides",
    respell_sql(
        "documents", "doc_id",
        SMOKE_SQL.replace("d(old, new)", "d0(old, new)")
        + ", o(old, new) AS (VALUES ('pour', 'por'), ('LES', 'lés'), ('de', '')), d AS (SELECT coalesce(d0.old, o.old) AS old, coalesce(o.new, d0.new) AS new FROM d0 FULL JOIN o ON o.old = d0.old)",
    ),
)
def curated_overrides(spark, sf):
    """Corpus-specific entries, some of them exact upper-case words, over the dictionary."""
    from graphie.operators.dictionary import merge_dictionaries

    d = merge_dictionaries(smoke_dictionary(spark), Dictionary.of(spark, OVERRIDES))
    return R.respell(documents(spark, sf, "doc_id", "text"), "text", d, count_col="n_changed")
