"""The built-in respelling rules, and dictionaries generated from a lexicon.

Most rules are rows of steps for ``phonetics.fold_steps``. The others compute a whole
new spelling from the alignment of a word and are projections. Names are ours where
a rule is otherwise known by somebody's name.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphie.functions import graphemes as G
from graphie.functions import text as T
from graphie.functions.plan import computed_once
from graphie.operators import lexicon as X
from graphie.operators import phonetics as P
from graphie.operators import rulesets as RS
from graphie.operators.dictionary import Metadata, first_wins, simplify_mapping
from graphie.operators.phonetics import graphem, step, text
from graphie.sources.files import stored

Project = Callable[[Column], Column]


@dataclass(frozen=True)
class Rule:
    """``steps`` or ``project`` (state to state); ``prefilter``: regex of words it may touch,
    None for all of them."""

    name: str
    prefilter: str | None
    steps: tuple = ()
    project: Project | None = None
    repeatable: bool = True
    marker: str | None = "s"


# --- the flagship rule -----------------------------------------------------------

# Its steps, in order.
_CH = [text(a + "ch", b + c, need=r"ch.*\|.*k") for a, b in [("ec", "é"), ("ec", "è"), ("c", ""), ("", "")] for c in ("c", "qu")]
_OE = [
    text(a, b)
    for a, b in [
        ("cœu", "queu"), ("coeu", "queu"), ("œu", "eu"), ("oeu", "eu"), ("œ", "eu"), ("oe", "eu"), ("oest", "est"),
        ("œst", "est"), ("œ", "é"), ("oe", "é"),
    ]
]
_PH = [text("mph", "nf"), text("ph", "f")]
_X = [step("suffix", "x", "s"), step("all", "auxq", "ausq"), step("all", "auxd", "ausd"), step("prefix", "deuxi", "deusi")]
_Y = [
    graphem(("y", "i", "i"), start="1"),
    graphem(("y", "j", "i"), start="y"),
    graphem(("y", "ij", "i"), start="1"),
    graphem(("yn", "in", "in")),
    graphem(("yn", "5", "in")),
    graphem(("ym", "im", "im")),
    graphem(("ym", "5", "im")),
]
_H = [
    text("eh", "é"),
    text("eh", "è"),
    graphem(("th", "", "")),
    graphem(("h", "", ""), ("th", "", "t"), ("th", "t", "t"), ("désh", "dez", "dés"), start="h"),
]
_DOUBLES = [step("edouble", need="(bb|cc|dd|ff|gg|ll|mm|nn|pp|rr|nss|tt|zz).*\\|")] + [
    text(a, b, need=n)
    for a, b, n in [
        ("bb", "b", "bb"), ("cc", "c", "cc"), ("dd", "d", "dd"), ("ff", "f", "ff"), ("gg", "g", "gg"),
        ("ll", "l", r"ll.*\|.*l"), ("mm", "m", "mm"), ("cemment", "çament", "mm"), ("gemment", "geament", "mm"),
        ("emm", "am", "mm"), ("nn", "n", "nn"), ("enn", "an", "nn"), ("pp", "p", "pp"), ("rr", "r", "rr"),
        ("nss", "ns", "nss"), ("tt", "t", "tt"), ("zz", "z", "zz"),
    ]
]
_NEED = {"x": "x.*\\|", "y": "y.*\\|", "h": "h.*\\|"}
FLAGSHIP_FILTER = r"œ|oe|x$|auxq|auxd|deux|.y|h|nss|bb|cc|dd|ff|gg|ll|mm|nn|pp|rr|tt|zz"
# Alone, the flagship rule has a narrower filter that looks at the sound too.
FLAGSHIP_ALONE = r"^[^|]*(?:œ|oe|x|y|h|nss|bb|cc|dd|ff|gg|mm|nn|pp|rr|tt|zz)|^[^|]*ll.*\|.*l"


def flagship_steps(preserve: str = "") -> tuple:
    """``preserve`` is a regex of words (proper nouns, mostly) that may only turn into
    another word it matches."""
    groups = [("", _CH), ("", _OE), ("", _PH), (_NEED["x"], _X), (_NEED["y"], _Y), (_NEED["h"], _H), ("", _DOUBLES)]
    out = [step("begin", keep=preserve)]
    for need, steps in groups:
        out += [{**s, "need": s["need"] or need, "keep": preserve} for s in steps]
    return tuple(out)


def preserve_pattern(parts: list[str], words: list[str]) -> str:
    """One regex from pattern alternatives and exact words, each also with a final s."""
    exact = [f"^{w}s?$" for w in words]
    return "|".join(f"(?:{p})" for p in [*parts, *exact])


def mentions(df: DataFrame) -> dict[str, Column]:
    """What the flagship rule looks for, a column per pattern. ll only counts when an l
    is heard, ch when a k is."""
    o, p = F.col("ortho"), F.col("phon")
    cols = {c + c: F.contains(o, F.lit(c + c)) for c in "bcdfgmnprtz"}
    cols["ll"] = F.contains(o, F.lit("ll")) & F.contains(p, F.lit("l"))
    cols["nss"] = F.contains(o, F.lit("nss"))
    cols["ch"] = F.contains(o, F.lit("ch")) & F.contains(p, F.lit("k"))
    for c in ("ph", "h", "x", "y"):
        cols[c] = F.contains(o, F.lit(c))
    cols["oe"] = F.contains(o, F.lit("oe")) | F.contains(o, F.lit("œ"))
    return cols


# --- projections on the alignment ------------------------------------------------


def _with(st: Column, **new: Column) -> Column:
    for name, value in new.items():
        st = st.withField(name, value)
    return st


def _spelled(path: Column) -> Column:
    return F.regexp_replace(F.array_join(F.transform(path, lambda e: e["g"]), ""), r"\$$", "")


def _switch(value: Column, table: dict[str, str], default: Column | None = None) -> Column:
    out = default if default is not None else F.lit(None).cast("string")
    for k, v in table.items():
        out = F.when(value == k, v).otherwise(out)
    return out


def _chars(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


# How each system writes a sound.
_NET = {
    "a": "a", "e": "é", "E": "è", "2": "eu", "9": "eu", "°": "e", "@": "an", "5": "in", "§": "on", "1": "un", "i": "i",
    "y": "u", "8": "u", "u": "ou", "o": "o", "O": "o", "b": "b", "S": "ch", "d": "d", "f": "f", "g": "g", "N": "gn",
    "G": "ng", "Z": "j", "k": "k", "l": "l", "m": "m", "n": "n", "p": "p", "R": "r", "s": "s", "t": "t", "v": "v",
    "w": "ou", "j": "y", "z": "z",
}
_ALFONIC = {
    **_NET, "2": "œ̂", "9": "œ", "°": "œ̂", "@": "ä", "5": "ï", "§": "ö", "1": "ü", "u": "w", "o": "ô",
    "S": "h", "N": "ñ", "G": "¨g", "k": "c", "w": "w",
}
# Graphemes the first system keeps, or writes in a way of their own.
_NET_KEPT = ["i", "oi", "ç", "'", "-", " ", "ss"]
_NET_PAIRS = {
    ("b", "p"): "b", ("q", "k"): "q", ("qu", "k"): "q", ("qu", "ku"): "qou", ("qu", "kw"): "qou", ("en", "@"): "en",
    ("ent", "@"): "en", ("ent$", "@"): "en", ("em", "@"): "en", ("en", "@n"): "enn", ("enn", "@n"): "en",
    ("sc", "sk"): "sc", ("cc", "k"): "c", ("cc", "ks"): "cç", ("ch", "k"): "c", ("c", "k"): "c", ("c", "s"): "ç",
    ("x", "gz"): "x", ("x", "ks"): "x", ("e", ""): "e",
}
_NET_PLURALS = ["ces", "des", "les", "mes", "ses", "tes", "nous", "vous", "ils", "elles", "aux"]


def _written(path: Column, table: dict[str, str], kept: list[str], pairs: dict[tuple[str, str], str]) -> Column:
    """The graphemes that write a path in another system."""

    def one(e: Column) -> Column:
        out = F.transform(_chars(e["p"]), lambda c: _switch(c, table, c))
        for (g, p), to in pairs.items():
            out = F.when((e["g"] == g) & (e["p"] == p), F.array(F.lit(to))).otherwise(out)
        return F.when(e["g"].isin(kept), F.array(e["g"])).otherwise(out)

    return F.flatten(F.transform(path, one))


def _alfonic(st: Column) -> Column:
    ortho = F.array_join(_written(st["path"], _ALFONIC, ["i", "'", "-", " "], {("b", "p"): "b"}), "")
    return _with(st, ortho=ortho, path=P._empty(P.PATH), surprise=F.lit(0))


def _sound_net(st: Column) -> Column:
    vowel, weak = f"[{G.VOWELS}]", f"[{G.WEAK}]"
    digraphs = sorted({v for v in _NET.values()})

    def glue(gs: Column) -> Column:
        def one(g: Column, i: Column) -> Column:
            before, after = F.get(gs, i - 1), F.get(gs, i + 1)
            weak_next = F.coalesce(after.rlike("^" + weak), F.lit(False))
            vowel_next = F.coalesce(after.rlike("^" + vowel), F.lit(False))
            n = F.when(vowel_next, g).when(after.isNull(), F.concat(g, F.lit("e"))).otherwise(F.concat(F.lit("·"), g))
            clash = F.concat(before, F.substr(g, F.lit(1), F.lit(1))).isin(digraphs)
            return (
                F.when((g == "c") & weak_next, "k")
                .when(i == 0, g)
                .when((g == "n") & before.rlike(vowel + "$"), n)
                .when(clash, F.concat(F.lit("·"), g))
                .otherwise(g)
            )

        return F.array_join(F.transform(gs, one), "")

    body = P.let(_written(st["path"], _NET, _NET_KEPT, _NET_PAIRS), glue)
    plural = (F.endswith(st["ortho"], F.lit("s")) & (st["ortho"] == F.concat(st["lemme"], F.lit("s")))) | st["ortho"].isin(_NET_PLURALS)
    ortho = F.when(plural, F.concat(body, F.lit("+"))).otherwise(body)
    return _with(st, ortho=ortho, path=P._empty(P.PATH), surprise=F.lit(0))


def _ou_letter(letter: str) -> Project:
    def project(st: Column) -> Column:
        def one(e: Column) -> Column:
            sounded = e["p"].isin("w", "u")
            g = (
                F.when(e["g"].isin("ou", "oû") & sounded, letter)
                .when((e["g"] == "où") & sounded, letter + "̀")
                .when((e["g"] == "qu") & (e["p"] == "kw"), "q" + letter)
                .when((e["g"] == "gu") & (e["p"] == "gw"), "g" + letter)
                .otherwise(e["g"])
            )
            return e.withField("g", g)

        return P.let(
            P.reindexed(F.transform(st["path"], one)), lambda path: _with(st, ortho=_spelled(path), path=path)
        )

    return project


# Fixed values.
_IL_SOUNDS = {"i": "i", "j": "y", "E": "è", "e": "é"}
_IL_GRAPHEMES = ["il$", "ils$", "ill", "illi", "eil$", "eils$", "eill", "eilli"]
_MACRONS = [("à", "ā"), ("â", "ā"), ("é", "ē"), ("è", "ē"), ("ê", "ē"), ("ë", "ē"), ("î", "ī"), ("ô", "ō"), ("ù", "ū"), ("û", "ū")]


def _il_y(st: Column) -> Column:
    def one(e: Column) -> Column:
        sounds = F.array_join(F.transform(_chars(e["p"]), lambda c: _switch(c, _IL_SOUNDS)), "")
        tail = F.concat(
            F.when(e["g"].isin("il$", "ils$"), "e").otherwise(""), F.when(F.endswith(e["g"], F.lit("s$")), "s").otherwise("")
        )
        return F.when(
            e["g"].isin(_IL_GRAPHEMES) & ~F.contains(e["p"], F.lit("l")), F.concat(sounds, tail)
        ).otherwise(e["g"])

    return F.regexp_replace(F.array_join(F.transform(st["path"], one), ""), r"\$$", "")


def _accept(align: Callable[[Column, Column], Column], st: Column, ortho: Column, phon: Column, regardless: bool = False) -> Column:
    """The state with a new spelling if it is plausible, else as it was."""

    def judged(a: Column) -> Column:
        ok = a.isNotNull() if regardless else a["surprise"] <= st["surprise"]
        return F.when(
            F.coalesce(ok, F.lit(False)),
            _with(st, ortho=ortho, phon=phon, path=a["path"], surprise=a["surprise"]),
        ).otherwise(st)

    return P.let(align(ortho, phon), judged)


def _checked(new: Callable[[Column], Column], regardless: bool = False, phon: Callable[[Column], Column] | None = None) -> Project:
    def project(st: Column) -> Column:
        def go(align: Callable[[Column, Column], Column]) -> Column:
            pair = F.struct(new(st).alias("o"), (phon(st) if phon else st["phon"]).alias("p"))
            return P.let(
                pair,
                lambda x: F.when(
                    x["o"].isNull() | x["p"].isNull() | (x["o"] == st["ortho"]) | (F.size(st["path"]) == 0), st
                ).otherwise(_accept(align, st, x["o"], x["p"], regardless)),
            )

        return P.RuleTable(G.french_rules()).within(go)

    return project


def _als(st: Column) -> Column:
    applies = st["ortho"].rlike("au[xs]$") & st["lemme"].rlike("(al|ail)$") & F.endswith(st["phon"], F.lit("o"))
    return F.when(applies, F.concat(st["lemme"], F.lit("s")))


def _als_phon(st: Column) -> Column:
    end = F.when(F.endswith(st["lemme"], F.lit("al")), "al").otherwise("aj")
    return F.concat(F.substr(st["phon"], F.lit(1), F.length(st["phon"]) - 1), end)


def _plat(st: Column) -> Column:
    """Macrons on words another rule has already transliterated."""
    flat = F.translate(st["ortho"], "".join(a for a, _ in _MACRONS), "".join(b for _, b in _MACRONS))
    return F.when(F.size(st["path"]) == 0, _with(st, ortho=flat)).otherwise(st)


def builtin(preserve: str = "") -> dict[str, Rule]:
    """All named rules."""
    b = step("begin")
    rules = [
        Rule("flagship", FLAGSHIP_FILTER, flagship_steps(preserve)),
        Rule("circonflexe/", "[âêîôû]", (b, text("â", "a"), text("ê", "e"), step("ecirc"), text("î", "i"), text("ô", "o"), text("û", "u"))),
        Rule("qu/q", "qu", (b, text("qu", "q"))),
        Rule("qu/qou", "qu", (b, text("qu", "qou"))),
        Rule("ti/ci", "ti", (b, text("ti", "ci"))),
        Rule("emment/ament", "emment", (b, text("emment", "ament"), text("cemment", "çament"), text("gemment", "geament"))),
        Rule("oiement/oiment", "oiement", (b, text("oiement", "oiment"))),
        Rule("cq/q", "cq", (b, text("ecq", "éq"), text("ecq", "èq"), text("cq", "q"))),
        Rule("qua-o-u/ca-o-u", "qua|quo|qur|qûr", (b, text("qua", "ca"), text("quo", "co"), text("qur", "cur"), text("qûr", "cur"))),
        Rule("que/c", "que", (b, text("que", "c", start="last4", lemma="^(?!.*quer$)"))),
        Rule("sc-sch/c-ch", "sc", (b, text("esc", "éc"), text("esc", "èc"), text("sc", "c"), text("sc", "ch"), text("sch", "ch"))),
        Rule("en/an", "en", (b, text("en", "an"))),
        Rule("um/ome", "um", (b, text("um", "ome"))),
        Rule("gu/gh", "gu", (b, text("gu", "gh"))),
        Rule("g/j", "g", (b, text("gea", "ja"), text("geo", "jo"), text("g", "j"))),
        Rule(
            "gn/ni", "gn",
            (
                b, step("sound", "N", "nj"), text("gne", "nye"), text("gni", "nyi"), text("gn", "ny", lemma="gner$"),
                text("gn", "ni", lemma="^(?!.*gner$)"),
            ),
        ),
        Rule("ez/es", "ez", (b, text("ez", "és"))),
        Rule("ent/es", "ent", (b, text("ient", "is"), text("ent", "es"))),
        Rule("m-mbp/n-mbp", "m[mbp]", (b, text("mp", "np"), text("mb", "nb"), text("mm", "nm"))),
        Rule("aux/als", "aux|[aus]", project=_checked(_als, True, _als_phon)),
        Rule("il/y", "il", project=_checked(_il_y)),
        Rule("accent-plat", "[àâéèêëîôùû]", (b, *[text(x, y) for x, y in _MACRONS]), project=_plat),
        Rule("sound-net", None, project=_sound_net, repeatable=False, marker="+"),
        Rule("alfonic", None, project=_alfonic, repeatable=False, marker=""),
        Rule("ou/w", "ou|où|oû|qu|gu", project=_ou_letter("w")),
        Rule("ou/omega", "ou|où|oû|qu|gu", project=_ou_letter("ω")),
    ]
    return {r.name: r for r in rules}


def custom(spec: list[tuple[str, str]]) -> Rule:
    """A rule from pairs; exactly one E in the result stands for é or è."""
    steps = tuple(step("accent" if to.count("E") == 1 else "text", frm, to) for frm, to in spec)
    pattern = "|".join(r"\Q" + frm + r"\E" for frm, _ in spec)
    return Rule(" ".join(f"{a}/{b}" for a, b in spec), pattern, (step("begin"), *steps))


def ordered(rules: list[Rule]) -> list[Rule]:
    return sorted(rules, key=lambda r: RS.RANKS.get(r.name, 0))


def may_change(rules: list[Rule]) -> Column:
    """Words worth aligning. Placed before the alignment, so that it runs on few rows."""
    key = F.concat("ortho", F.lit("|"), "phon")
    if [r.name for r in rules] == ["flagship"]:
        return F.rlike(key, F.lit(FLAGSHIP_ALONE))
    if any(r.prefilter is None for r in rules):
        return F.lit(True)
    return F.col("ortho").rlike("|".join(["oe", *[r.prefilter for r in rules if r.prefilter]]))


def apply_rules(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Run rules on the ``st`` column of aligned rows. Neighbouring step rules share a fold."""
    pending: list[dict] = []
    for rule in ordered(rules):
        pending += rule.steps
        if rule.project is not None:
            if pending:
                df = P.fold_steps(df, pending)
                pending = []
            df = df.withColumn("st", computed_once(rule.project(F.col("st"))))
    return P.fold_steps(df, pending) if pending else df


def respell_ligatures(st: Column) -> Column:
    """oe is œ where it sounds as one letter; the lemma follows."""

    def one(e: Column) -> Column:
        g = (
            F.when((e["g"] == "oe") & e["p"].isin("e", "E", "2", "9"), "œ")
            .when((e["g"] == "oeu") & e["p"].isin("2", "9"), "œu")
            .when((e["g"] == "coe") & (e["p"] == "se"), "cœ")
            .otherwise(e["g"])
        )
        return e.withField("g", g)

    def renew(path: Column) -> Column:
        ortho = _spelled(path)
        oe, ae = F.lit("oe"), F.lit("œ")
        lemme = F.when(F.replace(st["ortho"], oe, ae) == ortho, F.replace(st["lemme"], oe, ae)).otherwise(st["lemme"])
        return _with(st, ortho=ortho, lemme=lemme, path=path)

    return F.when(F.contains(st["ortho"], F.lit("oe")), P.let(P.reindexed(F.transform(st["path"], one)), renew)).otherwise(st)


def not_usable(lexicon: DataFrame, stop: DataFrame | None) -> DataFrame:
    """Rows to respell: no single letters, no compounds, no word of the stop list nor its
    plural."""
    df = lexicon.filter((F.octet_length("ortho") > 1) & ~F.contains("ortho", F.lit("-")))
    if stop is None:
        return df
    words = stop.select(F.col("word").alias("ortho")).distinct()
    plurals = stop.select(F.col("word").alias("lemme"), F.concat("word", F.lit("s")).alias("ortho")).distinct()
    return df.join(words, "ortho", "left_anti").join(plurals, ["lemme", "ortho"], "left_anti")


def respell_lexicon(
    lexicon: DataFrame, rules: list[Rule], *, fix_oe: bool = False, stop: DataFrame | None = None
) -> DataFrame:
    """``old, new, sub, rank, outcome`` for every usable row of
    ``lexicon(ortho, phon, lemme, rank [, h_aspire])``.

    Words no rule can touch, or that cannot be aligned, are their own result. Where œ is
    the right spelling both spellings get an entry; ``fix_oe`` gives both the œ result.
    """
    usable = not_usable(lexicon, stop).withColumn("_m", may_change(rules))
    skipped = usable.filter(~F.col("_m")).select(
        F.col("ortho").alias("old"), F.col("ortho").alias("new"), F.lit(0).alias("sub"), "rank",
        F.lit("prefiltered_out").alias("outcome"),
    )
    aligned = P.with_state(P.align_lexicon(usable.filter("_m")))
    aligned = aligned.withColumn("_plain", F.col("st")).withColumn(
        "st", computed_once(F.when(F.col("path").isNotNull(), respell_ligatures(F.col("st"))))
    )
    oe = F.col("st.ortho")
    two = F.coalesce(oe != F.col("ortho"), F.lit(False))

    def start(old: Column, state: Column, sub: int) -> Column:
        return F.struct(old.alias("old"), state.alias("st"), F.lit(sub).alias("sub"))

    # Each spelling is a row of its own, so that the rules are run in one place.
    plain = F.col("st") if fix_oe else F.col("_plain")
    starts = F.when(
        two, F.array(start(F.col("ortho"), plain, 0), start(oe, F.col("st"), 1))
    ).otherwise(F.array(start(F.col("ortho"), F.col("st"), 0)))
    outcome = F.when(F.col("path").isNull(), "failed").otherwise("rewritten")
    rows = aligned.select(F.explode(starts).alias("x"), "rank", outcome.alias("outcome")).select("x.*", "rank", "outcome")
    out = apply_rules(rows, rules)
    return out.select(
        "old", F.coalesce("st.ortho", "old").alias("new"), "sub", "rank", "outcome"
    ).unionByName(skipped)


def generation_stats(lexicon: DataFrame, results: DataFrame) -> DataFrame:
    """One row: ``total, considered, prefiltered_out, failed``."""
    total = lexicon.agg(F.count(F.lit(1)).alias("total"))
    rest = results.filter("sub = 0").agg(
        F.count(F.lit(1)).alias("considered"),
        F.count_if(F.col("outcome") == "prefiltered_out").alias("prefiltered_out"),
        F.count_if(F.col("outcome") == "failed").alias("failed"),
    )
    return total.crossJoin(rest)  # one row each


def metadata_of(names: list[str], rules: list[Rule]) -> Metadata:
    marked = [r.marker for r in rules if r.marker != "s"]
    marker = marked[0] if marked else "s"
    return Metadata(
        desc=" ".join(sorted(names)), lang="fr", supports_repeated_rewrites=all(r.repeatable for r in rules),
        plurals_in_s=marker if marker == "s" else None,
    )


def build_dictionary(
    lexicon: DataFrame,
    names: list[str] | None = None,
    *,
    post90: DataFrame | None = None,
    custom_rules: list[tuple[str, str]] | None = None,
    stop: DataFrame | None = None,
    preserve: str = "",
    vocabulary: DataFrame | None = None,
    all_words: bool = False,
) -> tuple[DataFrame, Metadata]:
    """A ranked dictionary ``old, new, rank`` for a set of rules, and its metadata.

    With ``vocabulary(word)`` only words that occur in a corpus are worked on: the lexicon is
    cut by a semi-join before anything is aligned, and entries are those words'.
    """
    names = list(names or ([] if custom_rules else RS.DEFAULT_RULES))
    table = builtin(preserve)
    rules = [table[n] for n in names if n not in RS.LOOKUP_RULES]
    if custom_rules:
        rules.append(custom(custom_rules))
    meta = metadata_of([*names, *([rules[-1].name] if custom_rules else [])], rules)
    rect, oe, flagship = "1990" in names, "oe" in names, "flagship" in names
    lx = lexicon
    if vocabulary is not None:
        lx = _in_vocabulary(lx, vocabulary, post90)
    if post90 is not None:
        lx = X.build_lexicon_post90(lx, post90, replace=rect)
    # Everything after this reads the results several times.
    results = stored(respell_lexicon(lx, rules, fix_oe=oe, stop=stop), "respelled")
    order = F.struct("rank", "sub")
    base = first_wins(results.withColumn("_o", order), "old", "_o", "new").select("old", "new", F.col("_o.rank").alias("rank"))
    if rect and post90 is not None:
        base = X.add_post90_entries(base, post90, flagship)
    if not all_words:
        base = simplify_mapping(base, meta.marker())
    return base, meta


def _in_vocabulary(lx: DataFrame, vocabulary: DataFrame, post90: DataFrame | None) -> DataFrame:
    """Lexicon rows some corpus word can come from: itself, a part of a compound, its singular, with
    œ as oe, in lower case, or through its official spelling."""
    pieces = F.filter(T.split_hyphens(F.lower("word")), lambda p: p != "-")
    words = vocabulary.select(F.explode(F.array_distinct(F.concat(F.array(F.lower("word")), pieces))).alias("w"))
    forms = F.array(F.col("w"), F.regexp_replace("w", "s$", ""))
    plain = words.select(F.explode(forms).alias("ortho")).select(
        F.explode(F.array("ortho", F.replace("ortho", F.lit("œ"), F.lit("oe")))).alias("ortho")
    )
    if post90 is not None:
        back = post90.join(plain.select(F.col("ortho").alias("new")).distinct(), "new", "left_semi").select(F.col("old").alias("ortho"))
        forth = post90.join(plain.select(F.col("ortho").alias("old")).distinct(), "old", "left_semi").select(F.col("new").alias("ortho"))
        plain = plain.unionByName(back).unionByName(forth)
    return lx.join(plain.distinct(), "ortho", "left_semi")


def extend_dictionary(
    reference: DataFrame, lexicon: DataFrame, post90: DataFrame, *, stop: DataFrame | None = None, preserve: str = "",
    all_words: bool = False,
) -> DataFrame:
    """Entries to add to a ``reference(old, new)`` dictionary of the flagship rule.

    Its own entries take part (at rank -1) so that plurals of its words are inferred, and
    leave at the end.
    """
    rule = builtin(preserve)["flagship"]
    lx = X.build_lexicon_post90(lexicon, post90, replace=True)
    results = stored(respell_lexicon(lx, [rule], fix_oe=True, stop=stop), "respelled")
    ref = reference.select("old", "new", F.struct(F.lit(-1).cast("bigint").alias("rank"), F.lit(0).alias("sub")).alias("_o"))
    gen = results.select("old", "new", F.struct(F.col("rank").cast("bigint").alias("rank"), "sub").alias("_o"))
    base = first_wins(ref.unionByName(gen), "old", "_o", "new").select("old", "new", F.col("_o.rank").alias("rank"))
    base = X.add_post90_entries(base, post90, flagship=True)
    if all_words:
        return base
    return simplify_mapping(base, "s").filter("rank >= 0")


def describe_steps(rules: list[Rule]) -> list[dict]:
    """The steps of a rule set as rows: ``rule, step, kind, target, repl``."""
    rows = []
    for r in ordered(rules):
        for i, s in enumerate(r.steps):
            alts = " ".join(f"{a['g']}:{a['p']}>{a['to']}" for a in s["alts"])
            rows.append({"rule": r.name, "step": i, "kind": s["kind"], "target": s["target"] or alts, "repl": s["repl"]})
    return json.loads(json.dumps(rows))
