"""Private data: surrogates that keep type, script, gender and format.

Entities are found in whole texts. A surrogate is the keyed image of the entity's canonical form
under a permutation of all forms of its format: letters go to letters of their alphabet and case,
digits to digits, punctuation stays. So the same entity gets the same surrogate in every document
(coreference) and two entities get two (distinctness), without a shared table. Check digits,
country codes, host endings and octet ranges stay valid.

A person is a name, whatever the title before it: ``Mr John Smith``, ``Dr John Smith`` and, in a
text that has one of them, ``John Smith`` are one entity. The gender of a name is that of most of
its titles over all documents, else that of its given name in the lists; the given name becomes
one of the same gender.

Where a format is not a pure permutation (given names from lists, check digits of account
numbers), a distributed count over the distinct entities finds equal surrogates; all but one of
them are drawn again with a salt until none are equal. Genders and salts that differ from the
default are a table. Up to ``MOST_HELD`` rows of it travel with the tasks; beyond, each row of the
documents gets its own entries by a join. Rows out are the same.
"""

from __future__ import annotations

import bisect
import hashlib
import hmac
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphie.llm.toxicity import pieces

KEY = "replace this key"  # used where neither an argument nor the setting below names a key
KEY_SETTING = "graphie.private.key"
MOST_HELD = 100_000

# Given names by gender (fixed values).
GIVEN = {
    "m": ["Adam", "Bruno", "Carlos", "David", "Emil", "Felix", "Georg", "Henri", "Ivan", "Jonas", "Karl", "Louis", "Mario", "Noah", "Oscar", "Paul"],
    "f": ["Alice", "Berta", "Clara", "Diana", "Emma", "Flora", "Greta", "Helena", "Irene", "Julia", "Klara", "Laura", "Maria", "Nora", "Olga", "Paula"],
}
# Titles by gender (fixed values); the empty one goes with either.
TITLES = {
    "m": ["Mr", "Mister", "Herr", "Monsieur", "Señor", "Don", "Sir"],
    "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Señorita", "Doña", "Lady"],
    "": ["Dr", "Prof"],
}
GENDER = {t: g for g, titles in TITLES.items() for t in titles}
LISTED = {name: g for g, names in GIVEN.items() for name in names}

# Alphabets as first and last code points (fixed values); a letter stays within its own.
ALPHABETS = [
    ("0", "9"), ("a", "z"), ("A", "Z"), ("à", "ö"), ("ø", "ÿ"), ("À", "Ö"), ("Ø", "Þ"), ("α", "ω"), ("а", "я"), ("А", "Я"),
    ("א", "ת"), ("ء", "غ"), ("अ", "ह"), ("ぁ", "ゖ"), ("ァ", "ヺ"), ("一", "鿿"), ("가", "힣"),
]
_RANGES = [(ord(a), ord(b)) for a, b in ALPHABETS]

# Every entity holds one of these.
TRIGGER = re.compile(r"[\d@]|A[KS]IA|(?:[spr]k|gh[po]|xox[abp])[-_]")
_CAP = r"[^\W\d_a-zß-öø-ÿ][\w'’-]+"
NAME = re.compile(rf"\b(?P<title>{'|'.join(sorted(GENDER, key=len, reverse=True))})(?:\.[ ]?|[ ])(?P<name>{_CAP}(?: {_CAP})?)")
ENTITY = re.compile(
    r"(?P<email>(?<![\w.%+-])[\w.%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})"
    r"|(?P<ip>(?<![\d.])(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?!\d|\.\d))"
    r"|(?P<account>\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?\b)"
    r"|(?P<secret>\b(?:AKIA|ASIA)[A-Z0-9]{16}\b|\b(?:sk|pk|rk|ghp|gho|xox[abp])[-_][A-Za-z0-9_-]{16,}|(?<![0-9A-Za-z])(?=[a-z]*[0-9])[0-9a-f]{32,128}(?![0-9A-Za-z]))"
    r"|(?P<card>(?<![\d.])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3})(?![\d]))"
    r"|(?P<social>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))"
    r"|(?P<phone>(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\w.])(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d))"
)
DIGITS = re.compile(r"\d")


def entities(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) in order, without overlaps. Only lines that the trigger meets are read closely, and names after titles."""
    found, at = [], 0
    if not text:
        return found
    while m := TRIGGER.search(text, at):
        start, end = text.rfind("\n", 0, m.start()) + 1, text.find("\n", m.start())
        end = len(text) if end < 0 else end
        found += [(e.start(), e.end(), e.lastgroup) for e in ENTITY.finditer(text, start, end)]
        at = end
    if any(t in text for t in GENDER):
        taken, people = _Spans(found), set()
        for m in NAME.finditer(text):
            if taken.add(*m.span("name")):
                found.append((*m.span("name"), "name" + GENDER[m["title"]]))
                people.add(m["name"])
        if people := sorted((p for p in people if " " in p), key=len, reverse=True):
            for m in re.finditer(rf"\b(?:{'|'.join(map(re.escape, people))})(?![\w’'-])", text):
                if taken.add(*m.span()):
                    found.append((*m.span(), "name"))
    return sorted(found)


class _Spans:
    """Spans without overlaps; ``add`` says whether there was room for one more."""

    def __init__(self, spans: list[tuple[int, int, str]]):
        self.spans = sorted((s, e) for s, e, _ in spans)

    def add(self, start: int, end: int) -> bool:
        i = bisect.bisect_left(self.spans, (start, end))
        if (i and self.spans[i - 1][1] > start) or (i < len(self.spans) and self.spans[i][0] < end):
            return False
        self.spans.insert(i, (start, end))
        return True


def _number(key: bytes, *parts: object) -> int:
    return int.from_bytes(hmac.new(key, "\x1f".join(map(str, parts)).encode("utf-8", "surrogatepass"), hashlib.blake2b).digest()[:32], "big")


def permuted(key: bytes, tweak: str, number: int, left: int, right: int) -> int:
    """A keyed permutation of the numbers below left * right: eight rounds that add to one half a keyed image of the other."""
    a, b = divmod(number, right)
    for r in range(8):
        if r % 2:
            b = (b + _number(key, tweak, left, right, r, a)) % right
        else:
            a = (a + _number(key, tweak, left, right, r, b)) % left
    return a * right + b


def _radix(ch: str) -> tuple[int, int] | None:
    c = ord(ch)
    return next(((a, b - a + 1) for a, b in _RANGES if a <= c <= b), (c - int(ch), 10) if ch.isdecimal() else None)


def respelled(key: bytes, tweak: str, text: str) -> str:
    """The text with each letter and digit replaced within its alphabet: a permutation of the texts of one format."""
    places = [(i, *r) for i, ch in enumerate(text) if (r := _radix(ch))]
    if not places:
        return text
    half, left, right, number = len(places) // 2, 1, 1, 0
    for j, (i, low, n) in enumerate(places):
        left, right = (left * n, right) if j < half else (left, right * n)
        number = number * n + ord(text[i]) - low
    shape = "".join(chr(low) for _, low, _ in places)
    number = permuted(key, f"{tweak}|{shape}", number, left, right)
    out = list(text)
    for i, low, n in reversed(places):
        number, d = divmod(number, n)
        out[i] = chr(low + d)
    return "".join(out)


def _check_digit(digits: str) -> int:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (2 if i % 2 == 0 else 1)
        total += n - 9 if n > 9 else n
    return -total % 10


def _account_digits(country: str, body: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in body + country + '00')) % 97:02d}"


def _plain(digits: str) -> str:
    """Decimal digits of any script as 0 to 9; other characters as they are."""
    return digits if digits.isascii() else "".join(str(int(ch)) if ch.isdecimal() else ch for ch in digits)


def _digit_like(ch: str, new: str) -> str:
    """A digit 0 to 9 in the script of the digit that it replaces."""
    return new if "0" <= ch <= "9" or not ch.isdecimal() else chr(ord(ch) - int(ch) + int(new))


def canonical(kind: str, found: str) -> str:
    """One form for all ways to write an entity."""
    if kind == "email":
        return found.lower()
    if kind == "ip":
        return ".".join(str(int(p)) for p in found.split("."))
    if kind in ("card", "social"):
        return _plain("".join(DIGITS.findall(found)))
    if kind == "account":
        return _plain(found.replace(" ", ""))
    if kind == "phone":
        digits = _plain("".join(DIGITS.findall(found)))
        return digits if found.startswith("+") else "1" + digits
    return found


def image(key: bytes, kind: str, form: str, salt: int = 0, gender: str = "") -> str:
    """The surrogate of a canonical form, itself in canonical form; ``gender`` is that of a name, if titles tell it."""
    tweak = f"{kind}|{salt}"
    if kind == "email":
        local, _, host = form.partition("@")
        body, _, end = host.rpartition(".")
        local, body = respelled(key, tweak, f"{local}@{body}").rsplit("@", 1)
        return f"{local}@{body}.{end}"
    if kind == "ip":
        n = 0
        for p in form.split("."):
            n = n * 256 + int(p)
        n = permuted(key, tweak, n, 1 << 16, 1 << 16)
        return ".".join(str(n >> s & 255) for s in (24, 16, 8, 0))
    if kind == "card":  # the first digit names the network; the last one stays as right or wrong as it was
        body = form[0] + respelled(key, tweak, form[1:-1])
        return body + str((_check_digit(body) + int(form[-1]) - _check_digit(form[:-1])) % 10)
    if kind == "account":
        country, check, body = form[:2], form[2:4], form[4:]
        new = respelled(key, tweak, body)
        return country + (_account_digits(country, new) if check == _account_digits(country, body) else check) + new
    if kind == "phone":  # the last ten digits are the number, what is before them the country
        return form[:-10] + respelled(key, tweak, form[-10:])
    if kind == "secret":
        m = re.match(r"AKIA|ASIA|(?:sk|pk|rk|ghp|gho|xox[abp])[-_]", form)
        head = m[0] if m else ""
        return head + (_hex(key, tweak, form) if not head and re.fullmatch("[0-9a-f]+", form) else respelled(key, tweak, form[len(head) :]))
    if kind == "name":
        given, _, family = form.partition(" ")
        if not family:
            return respelled(key, tweak, given)
        return f"{_given(key, tweak, given, salt, gender or LISTED.get(given, ''))} {respelled(key, 'name|0', family)}"
    return respelled(key, tweak, form)


def _given(key: bytes, tweak: str, given: str, salt: int, gender: str) -> str:
    """A given name of the gender. Listed names change places; others get a listed one, in the end with a permuted one behind it."""
    names, changed = GIVEN.get(gender, []), respelled(key, tweak, given)
    if not names or not given[0].isascii():  # the lists are Latin
        return changed
    if given in names and not salt:
        order = sorted(range(len(names)), key=lambda i: _number(key, tweak, "order", i))
        return names[order[names.index(given)]]
    pick = names[_number(key, tweak, given) % len(names)]
    return pick if not salt else f"{pick}-{changed}"


def _hex(key: bytes, tweak: str, form: str) -> str:
    half = len(form) // 2
    return f"{permuted(key, tweak, int(form, 16), 16 ** half, 16 ** (len(form) - half)):0{len(form)}x}"


def laid_out(kind: str, found: str, new: str) -> str:
    """A surrogate written in the way of the entity that it replaces."""
    if kind == "email":
        return "".join(n.upper() if f.isupper() else n for f, n in zip(found, new))
    if kind in ("card", "social", "phone"):
        new = new[-len(DIGITS.findall(found)) :]
        fill = iter(new)
        return "".join(_digit_like(ch, next(fill)) if ch.isdecimal() else ch for ch in found)
    if kind == "account":
        fill = iter(new)
        return "".join(ch if ch == " " else _digit_like(ch, next(fill)) for ch in found)
    return new


def key_of(docs: DataFrame, key: str | None = None) -> bytes:
    """The secret: the argument, else the session's ``graphie.private.key``, else the public default."""
    return (key or docs.sparkSession.conf.get(KEY_SETTING, KEY)).encode()


def distinct_entities(docs: DataFrame, text: str = "text") -> DataFrame:
    """``kind, form, n, gender``: distinct entities of all documents with their numbers, and the gender most titles of a name tell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n in pieces(batch.column(0)):
                kinds, forms, sides = [], [], []
                for t in batch.column(0).slice(at, n).to_pylist():
                    for s, e, kind in entities(t):
                        plain = plain_kind(kind)
                        kinds.append(plain)
                        forms.append(canonical(plain, t[s:e]))
                        sides.append({"namem": 1, "namef": -1}.get(kind, 0))
                columns = [pa.array(kinds, pa.string()), pa.array(forms, pa.string()), pa.array(sides, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=["kind", "form", "side"])

    found = docs.select(F.col(f"`{text}`")).mapInArrow(run, "kind string, form string, side int").groupBy("kind", "form")
    found = found.agg(F.count(F.lit(1)).alias("n"), F.sum("side").alias("side"))
    return found.select("kind", "form", "n", F.when(F.col("side") > 0, "m").when(F.col("side") < 0, "f").otherwise("").alias("gender"))


def plain_kind(kind: str) -> str:
    """The kind without the gender that the title of a name tells."""
    return kind[:4] if kind.startswith("name") else kind


def collision_salts(docs: DataFrame, text: str = "text", key: str | None = None) -> DataFrame:
    """``kind, form, salt, gender`` of the entities with a salt or with a gender that their given name does not tell; few rows.

    Equal surrogates are counted over all distinct entities; the first form keeps its own, the
    others draw again, until all differ. Nothing is collected.
    """
    from graphie.llm.shared import stored

    secret = key_of(docs, key)
    told = F.col("gender").isin(*GIVEN) & F.contains("form", F.lit(" "))
    found = distinct_entities(docs, text).select("kind", "form", F.lit(0).alias("salt"), F.when(told, F.col("gender")).otherwise("").alias("gender"))
    found = stored(found, "entities")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns))
            new = [image(secret, kind, form, salt, gender) for kind, form, salt, gender in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(new, pa.string())], names=["kind", "form", "new"])

    while True:
        images = found.mapInArrow(run, "kind string, form string, new string")
        twice = images.groupBy("kind", "new").agg(F.count(F.lit(1)).alias("c"), F.min("form").alias("first")).filter("c > 1")
        clash = images.join(twice, ["kind", "new"]).filter("form != first").select("kind", "form", F.lit(1).alias("again"))
        clash = stored(clash, "equal_surrogates")
        if clash.isEmpty():
            break
        salt = (F.col("salt") + F.coalesce("again", F.lit(0))).alias("salt")
        found = stored(found.join(clash, ["kind", "form"], "left").select("kind", "form", salt, "gender"), "entities")
    lists = F.create_map(*[F.lit(x) for pair in LISTED.items() for x in pair])
    default = F.coalesce(F.try_element_at(lists, F.substring_index("form", " ", 1)), F.lit(""))
    return found.filter((F.col("salt") > 0) | ((F.col("gender") != "") & (F.col("gender") != default)))


def anonymise(docs: DataFrame, salts: DataFrame | None, text: str = "text", key: str | None = None, most_held: int = MOST_HELD) -> DataFrame:
    """All columns, with surrogates in ``text``, and ``entities``: kind, and place and surrogate in the new text.

    ``salts`` comes from ``collision_salts`` over the same documents and key. Null and empty texts stay.
    A column of the table called ``entities`` is replaced. Column names can be any, a dot included.
    """
    held = salts.limit(most_held + 1).collect() if salts else []
    if len(held) <= most_held:
        return _replaced(docs, {(r["kind"], r["form"]): (r["salt"], r["gender"]) for r in held}, text, key)
    return _replaced(_with_own(docs, salts, text), None, text, key)


OWN = "_own_of_entities"


def _with_own(docs: DataFrame, salts: DataFrame, text: str) -> DataFrame:
    """The documents, each row with the entries of ``salts`` that its text asks for. A row has a digest of its text for a key;
    should two texts share one, both get the entries of both, of which they use their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n in pieces(batch.column(0)):
                rows = set()
                for t, digest in zip(batch.column(0).slice(at, n).to_pylist(), batch.column(1).slice(at, n).to_pylist()):
                    rows |= {(digest, plain_kind(kind), canonical(plain_kind(kind), t[s:e])) for s, e, kind in entities(t)}
                columns = list(zip(*rows)) or [(), (), ()]
                arrays = [pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.string(), pa.string()))]
                yield pa.RecordBatch.from_arrays(arrays, names=["digest", "kind", "form"])

    digest = F.xxhash64(F.col(f"`{text}`"))
    asked = docs.select(F.col(f"`{text}`"), digest).mapInArrow(run, "digest bigint, kind string, form string").distinct()
    own = asked.join(salts, ["kind", "form"]).groupBy("digest").agg(F.collect_list(F.struct("kind", "form", "salt", "gender")).alias(OWN))
    keyed = docs.withColumn("_digest_of_entities", digest)
    own = own.withColumnRenamed("digest", "_digest_of_entities")
    return keyed.join(own, "_digest_of_entities", "left").drop("_digest_of_entities")


def _replaced(docs: DataFrame, held: dict[tuple[str, str], tuple[int, str]] | None, text: str, key: str | None) -> DataFrame:
    """``anonymise`` with the entries given, or with those in a column ``OWN`` of each row."""
    secret = key_of(docs, key)
    order = [c for c in docs.columns if c not in ("entities", OWN)]
    keep = [f"c{i}" for i, c in enumerate(order) if c != text]
    kind_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("surrogate", pa.string())]))
    n_keep = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = batch.column(n_keep)
            for at, n in pieces(cells):
                texts, lists = [], []
                owns = batch.column(n_keep + 1).slice(at, n).to_pylist() if held is None else [held] * n
                for t, own in zip(cells.slice(at, n).to_pylist(), owns):
                    if held is None:
                        own = {(o["kind"], o["form"]): (o["salt"], o["gender"]) for o in own or []}
                    parts, done, size, last = [], [], 0, 0
                    for s, e, kind in entities(t):
                        kind = plain_kind(kind)
                        form = canonical(kind, t[s:e])
                        new = laid_out(kind, t[s:e], image(secret, kind, form, *own.get((kind, form), ())))
                        size += s - last
                        done.append({"kind": kind, "start": size, "end": size + len(new), "surrogate": new})
                        parts += [t[last:s], new]
                        size, last = size + len(new), e
                    texts.append("".join([*parts, t[last:]]) if parts else t)
                    lists.append(done)
                kept = [batch.column(i).slice(at, n) for i in range(n_keep)]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(texts, pa.string()), pa.array(lists, kind_type)], names=[*keep, "t", "e"])

    columns = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(order) if c != text]
    kinds = "".join(f"{k} {docs.schema[c].dataType.simpleString()}, " for k, c in zip(keep, [c for c in order if c != text]))
    shape = f"{kinds}t string, e array<struct<kind:string,start:bigint,end:bigint,surrogate:string>>"
    out = docs.select(*columns, F.col(f"`{text}`").alias("t"), *([OWN] if held is None else [])).mapInArrow(run, shape)
    return out.select(*[F.col("t" if c == text else f"c{i}").alias(c) for i, c in enumerate(order)], F.col("e").alias("entities"))
