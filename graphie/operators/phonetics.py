"""Align spellings with sounds, and rewrite spellings that must keep their sound.

An alignment is a path through a small lattice: from each position of the word, a
grapheme leads to a later position and uses up some of the sound. The lattice is built,
searched backwards for the states that can still finish, and walked forwards always
taking the step that uses most sound, then most letters. All of it is array
expressions on the row of the word: no join, no shuffle, no Python. The work is
per distinct lexicon word.

A rule set is a table of steps run by one fold over the same expressions.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphie.functions import graphemes as G
from graphie.functions.plan import computed_once
from graphie.sources.files import stored

PATH = "array<struct<g:string,p:string,i:int,j:int,s:int>>"
_ENTRIES = "array<struct<g:string,gl:int,gb:int,core:boolean,ctx:int,sounds:array<struct<p:string,pl:int,imp:int>>>>"
_RULES = f"map<string,{_ENTRIES}>"
_EDGES = "array<struct<g:string,gl:int,p:string,pl:int,s:int>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Name a value inside an expression so that it is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


class RuleTable:
    """Grapheme rules by first letter, as a constant; a fixed, small size.

    Sounds of a grapheme in one context share an entry. Contexts are numbered, and
    tested by patterns that are part of the expression, so that they are compiled once.
    """

    def __init__(self, rows: list[dict]):
        if len(rows) > 10_000:
            raise ValueError("a grapheme table of this size is not a constant")
        self.contexts = sorted({(r["l"], r["r"]) for r in rows} - {("", "")})
        entries: dict[tuple, dict] = {}
        for r in rows:
            ctx = 1 + self.contexts.index((r["l"], r["r"])) if (r["l"], r["r"]) != ("", "") else 0
            e = entries.setdefault(
                (r["g"], ctx),
                {"g": r["g"], "gl": len(r["g"]), "gb": len(r["g"].encode()), "core": False, "ctx": ctx, "sounds": []},
            )
            e["core"] = e["core"] or r["imp"] == G.CORE
            e["sounds"].append({"p": r["p"], "pl": len(r["p"]), "imp": r["imp"]})
        by_first: dict[str, list[dict]] = {}
        for e in entries.values():
            by_first.setdefault(e["g"][0], []).append(e)
        # A map is read from its start: the most frequent letters go first.
        common = {c: i for i, c in enumerate("esaitnrulodcmpévqfbghjàxèyêzçûîôâœïùkw")}
        self._rows = dict(sorted(by_first.items(), key=lambda kv: common.get(kv[0], 99)))

    def within(self, build: Callable[[Callable[[Column, Column], Column]], Column]) -> Column:
        """``build(align)`` where ``align(word, phon)`` is the alignment by this table."""
        table = F.from_json(F.lit(json.dumps(self._rows, ensure_ascii=False)), _RULES)
        return let(table, lambda t: build(lambda w, p: align(t, self.contexts, w, p)))


def _in_context(contexts: list[tuple[str, str]], number: Column, before: Column, after: Column) -> Column:
    out = F.when(number == 0, True)
    for i, (left, right) in enumerate(contexts, 1):
        tests = [c for c in (before.rlike(left) if left else None, after.rlike(right) if right else None) if c is not None]
        out = out.when(number == i, tests[0] if len(tests) == 1 else tests[0] & tests[1])
    return out


def _empty(kind: str) -> Column:
    return F.from_json(F.lit("[]"), kind)


def _sub(s: Column, start: Column, n: Column) -> Column:
    """``n`` characters from the zero-based position ``start``."""
    return F.substr(s, start + 1, n)


def align(rules: Column, contexts: list[tuple[str, str]], word: Column, phon: Column) -> Column:
    """``struct<path, surprise>`` or null when the word cannot sound like that."""

    def inner(x: Column) -> Column:
        w, p = x["w"], x["p"]
        n, m = F.length(w), F.length(p)
        ended = F.concat(w, F.lit("$"))

        def edges(i: Column) -> Column:
            def from_here(rest: Column) -> Column:
                found = F.filter(
                    F.try_element_at(rules, F.substr(rest, F.lit(1), F.lit(1))),
                    lambda r: F.startswith(rest, r["g"])
                    & _in_context(contexts, r["ctx"], F.substr(w, F.lit(1), i), F.substr(w, i + r["gl"] + 1)),
                )
                return let(F.coalesce(found, _empty(_ENTRIES)), scored)

            def scored(c: Column) -> Column:
                core = F.transform(F.filter(c, lambda r: r["core"]), lambda r: r["gb"])

                def sounded(longest: Column) -> Column:
                    # Sounds that the word does not have anywhere are left out at once.
                    return F.flatten(
                        F.transform(
                            c,
                            lambda r: F.transform(
                                F.filter(r["sounds"], lambda s: F.contains(p, s["p"])),
                                lambda s: F.struct(
                                    r["g"].alias("g"), r["gl"].alias("gl"), s["p"].alias("p"), s["pl"].alias("pl"),
                                    F.when((s["imp"] == G.SURPRISING) | (r["gb"] < longest), 1).otherwise(0).alias("s"),
                                ),
                            ),
                        )
                    )

                return let(F.coalesce(F.array_max(core), F.lit(0)), sounded)

            return let(F.substr(ended, i + 1), from_here)

        def solve(e: Column) -> Column:
            # reach[k]: sound positions from which position n + 1 - k can finish.
            def back(acc: Column, i: Column) -> Column:
                here = F.transform(
                    F.get(e, i),
                    lambda r: F.transform(
                        F.filter(
                            F.get(acc, n + 1 - i - r["gl"]),
                            lambda j: (j >= r["pl"]) & (_sub(p, j - r["pl"], r["pl"]) == r["p"]),
                        ),
                        lambda j: j - r["pl"],
                    ),
                )
                return F.concat(acc, F.array(F.array_distinct(F.flatten(here))))

            reach = F.aggregate(
                F.sequence(n - 1, F.lit(0), F.lit(-1)), F.array(F.array(m), F.array(m)), back
            )

            def walk(r: Column) -> Column:
                start = F.struct(
                    F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("surprise"), _empty(PATH).alias("path")
                )

                def step(st: Column, k: Column) -> Column:
                    open_ = F.filter(
                        F.get(e, k),
                        lambda x: (_sub(p, st["j"], x["pl"]) == x["p"])
                        & F.array_contains(F.get(r, n + 1 - k - x["gl"]), st["j"] + x["pl"]),
                    )
                    best = F.array_max(
                        F.transform(
                            open_,
                            lambda x: F.struct(
                                (st["j"] + x["pl"]).alias("j"), (k + x["gl"]).alias("i"),
                                x["g"].alias("g"), x["p"].alias("p"), x["s"].alias("s"),
                            ),
                        )
                    )
                    taken = let(
                        best,
                        lambda b: F.struct(
                            b["i"].alias("i"),
                            b["j"].alias("j"),
                            (st["surprise"] + b["s"]).alias("surprise"),
                            F.concat(
                                st["path"],
                                F.array(
                                    F.struct(
                                        b["g"].alias("g"), b["p"].alias("p"), k.alias("i"), st["j"].alias("j"), b["s"].alias("s")
                                    )
                                ),
                            ).alias("path"),
                        ),
                    )
                    return F.when(st["i"] == k, taken).otherwise(st)

                done = F.aggregate(F.sequence(F.lit(0), n - 1), start, step)
                return F.when(
                    F.array_contains(F.get(r, n + 1), F.lit(0)),
                    let(done, lambda d: F.struct(d["path"].alias("path"), d["surprise"].alias("surprise"))),
                )

            return let(reach, walk)

        lattice = F.transform(F.sequence(F.lit(0), n - 1), edges)
        return F.when(n > 0, let(lattice, solve))

    return let(F.struct(word.alias("w"), phon.alias("p")), inner)


def accent_aigu(right: Column) -> Column:
    """Is e written é (rather than è) before this much sound? By the syllable it closes."""
    v = G.SOUND_VOWELS
    opens = right.rlike(f"^.(?:[{v}]|[j8w][{v}])")
    return (
        F.when(F.length(right) <= 1, right == "")
        .when(opens, ~right.rlike("^.°"))
        .when(right.rlike(f"[{v.replace('°', '')}]"), right.rlike("^[bptdkgvf][Rlwj8]"))
        .otherwise(False)
    )


def _accented(right: Column, body: Callable[[Column, Column], Column]) -> Column:
    """``body(sound, letter)`` for the e before ``right``."""
    return let(accent_aigu(right), lambda a: body(F.when(a, "e").otherwise("E"), F.when(a, "é").otherwise("è")))


# --- steps -----------------------------------------------------------------------

_STEP = (
    "struct<kind:string,target:string,repl:string,start:string,need:string,lemma:string,keep:string,"
    "alts:array<struct<g:string,p:string,to:string>>>"
)
_STATE = f"struct<ortho:string,phon:string,lemme:string,h:boolean,path:{PATH},surprise:int,w0:string,kept:boolean>"
_CAND = "array<struct<ortho:string,phon:string,at:int>>"


def step(kind: str, target: str = "", repl: str = "", **more) -> dict:
    base = {"kind": kind, "target": target, "repl": repl, "start": "", "need": "", "lemma": "", "keep": "", "alts": []}
    return {**base, **more}


def text(target: str, repl: str, **more) -> dict:
    """Replace occurrences left to right, each only if the word still sounds the same."""
    return step("text", target, repl, **more)


def graphem(*alts: tuple[str, str, str], **more) -> dict:
    """Replace graphemes that have a given sound, until none can be."""
    return step("graphem", alts=[{"g": g, "p": p, "to": to} for g, p, to in alts], **more)


def _cand(ortho: Column, phon: Column, at: Column | None = None) -> Column:
    at = F.lit(0) if at is None else at
    return F.struct(ortho.alias("ortho"), phon.alias("phon"), at.cast("int").alias("at"))


def _joined(parts: Column) -> Column:
    return F.regexp_replace(F.array_join(parts, ""), r"\$$", "")


def _positions(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(_empty("array<int>"))


DOUBLE = "^(?:bb|cc|dd|ff|gg|ll|mm|nn|pp|rr|tt|zz)$"


def _candidates(st: Column, sp: Column, pos: Column) -> Column:
    w, p, path = st["ortho"], st["phon"], st["path"]
    none = _empty(_CAND)
    size = F.size(path)

    # text: the first occurrence from pos on
    at = F.call_function("locate", sp["target"], w, pos)
    start = F.when(sp["start"] == "last4", F.length(w) - 4).otherwise(F.lit(0))
    by_text = F.when(
        (at > 0) & (start >= 0),
        F.array(
            _cand(
                F.concat(F.substr(w, F.lit(1), at - 1), sp["repl"], F.substr(w, at + F.length(sp["target"]))), p, at
            )
        ),
    ).otherwise(none)

    # graphem: every path element an alternative applies to
    from_ = (
        F.when(sp["start"] == "1", 1)
        .when(sp["start"] == "y", F.when(w.isin("yeus", "yeuse"), 0).otherwise(1))
        .when(
            sp["start"] == "h",
            F.when(F.startswith(w, F.lit("déh")), 3).when(F.startswith(w, F.lit("éh")), 2).otherwise(st["h"].cast("int")),
        )
        .otherwise(0)
    )

    def alternative(e: Column) -> Column:
        hit = F.filter(sp["alts"], lambda a: (a["g"] == e["g"]) & (a["p"] == e["p"]))
        return F.when(e["i"] >= from_, F.get(hit, F.lit(0))["to"])

    marked = F.transform(path, lambda e, k: F.struct(k.alias("k"), alternative(e).alias("to")))
    by_graphem = F.transform(
        F.filter(marked, lambda x: x["to"].isNotNull()),
        lambda x: _cand(
            _joined(F.transform(path, lambda e, k: F.when(k == x["k"], x["to"]).otherwise(e["g"]))), p
        ),
    )

    # edouble: e before a doubled consonant takes an accent and the consonant is single
    def double(k: Column) -> Column:
        a, b = F.get(path, k), F.get(path, k + 1)
        pair = (a["g"] == "e") & a["p"].isin("e", "E") & b["g"].rlike(DOUBLE) & (F.length(b["p"]) == 1)
        nasal = a["g"].isin("enn", "emm") & a["p"].isin("en", "En", "em", "Em")
        right = F.substr(p, a["j"] + 2)

        def built(sound: Column, letter: Column) -> Column:
            one = _cand(
                F.concat(F.substr(w, F.lit(1), a["i"]), letter, F.substr(b["g"], F.lit(1), F.lit(1)), F.substr(w, b["i"] + 3)),
                F.concat(F.substr(p, F.lit(1), a["j"]), sound, F.substr(p, b["j"] + 1)),
            )
            consonant = F.substr(a["g"], F.lit(2), F.lit(1))
            two = _cand(
                F.concat(F.substr(w, F.lit(1), a["i"]), letter, consonant, F.substr(w, a["i"] + 4)),
                F.concat(F.substr(p, F.lit(1), a["j"]), sound, consonant, F.substr(p, a["j"] + 3)),
            )
            return F.when(pair, one).when(nasal, two)

        return F.when(F.coalesce(pair, F.lit(False)) | nasal, _accented(right, built))

    some = lambda xs: F.filter(xs, lambda c: c.isNotNull())
    by_double = some(F.transform(_positions(size), double))

    # ecirc: ê with the sound of é or è
    def circumflex(e: Column) -> Column:
        return F.when(
            (e["g"] == "ê") & e["p"].isin("e", "E"),
            _accented(
                F.substr(p, e["j"] + 2),
                lambda sound, letter: _cand(
                    F.concat(F.substr(w, F.lit(1), e["i"]), letter, F.substr(w, e["i"] + 2)),
                    F.concat(F.substr(p, F.lit(1), e["j"]), sound, F.substr(p, e["j"] + 2)),
                ),
            ),
        )

    by_circumflex = some(F.transform(path, circumflex))

    # accent: custom rule whose E stands for é or è, on each occurrence of its target
    def custom(i: Column) -> Column:
        end = i + F.length(sp["target"])
        over = F.filter(path, lambda e: (e["i"] + F.length(e["g"]) > i) & (e["i"] < end))
        here = F.substr(w, i + 1, F.length(sp["target"])) == sp["target"]

        def at_e(o: Column) -> Column:
            sounds = F.array_join(F.transform(o, lambda e: e["p"]), "")
            only = sounds.rlike("^[^eE]*[eE][^eE]*$")
            j = F.get(o, F.lit(0))["j"] + F.length(F.regexp_replace(sounds, "[eE].*$", ""))
            return F.when(
                only,
                _accented(
                    F.substr(p, j + 2),
                    lambda sound, letter: _cand(
                        F.concat(
                            F.substr(w, F.lit(1), i), F.replace(sp["repl"], F.lit("E"), letter), F.substr(w, end + 1)
                        ),
                        F.concat(F.substr(p, F.lit(1), j), sound, F.substr(p, j + 2)),
                    ),
                ),
            )

        return F.when(here, let(over, at_e))

    by_custom = some(F.transform(_positions(F.length(w)), custom))

    # whole: one candidate; suffix: the word without its end must sound right as well
    stem = F.substr(w, F.lit(1), F.length(w) - F.length(sp["target"]))
    ends = F.endswith(w, sp["target"]) & (F.length(stem) > 0)
    by_suffix = F.when(ends, F.array(_cand(stem, p), _cand(F.concat(stem, sp["repl"]), p))).otherwise(none)
    by_prefix = F.when(
        F.startswith(w, sp["target"]),
        F.array(_cand(F.concat(sp["repl"], F.substr(w, F.length(sp["target"]) + 1)), p)),
    ).otherwise(none)
    by_all = F.when(F.contains(w, sp["target"]), F.array(_cand(F.replace(w, sp["target"], sp["repl"]), p))).otherwise(none)
    by_sound = F.when(F.contains(p, sp["target"]), F.array(_cand(w, F.replace(p, sp["target"], sp["repl"])))).otherwise(none)

    kind = sp["kind"]
    return (
        F.when(kind == "text", by_text)
        .when(kind == "graphem", by_graphem)
        .when(kind == "edouble", by_double)
        .when(kind == "ecirc", by_circumflex)
        .when(kind == "accent", by_custom)
        .when(kind == "suffix", by_suffix)
        .when(kind == "prefix", by_prefix)
        .when(kind == "all", by_all)
        .when(kind == "sound", by_sound)
        .otherwise(none)
    )


def _wanted(st: Column, sp: Column) -> Column:
    key = F.concat(st["ortho"], F.lit("|"), st["phon"])
    return (
        ((sp["need"] == "") | F.rlike(st["w0"], sp["need"]))
        & ((sp["lemma"] == "") | F.rlike(st["lemme"], sp["lemma"]))
        & ((sp["target"] == "") | F.contains(key, sp["target"]))
        & (F.size(st["path"]) > 0)
    )


def _first_position(st: Column, sp: Column) -> Column:
    return F.when(sp["start"] == "last4", F.greatest(F.length(st["ortho"]) - 3, F.lit(1))).otherwise(1)


def _rounds(align_: Callable[[Column, Column], Column], st: Column, sp: Column, pos: Column) -> Column:
    """``struct<st, pos, go>`` after a number of rounds of one step. ``go``: it has not come to its end.

    Every round passes at least one letter that was there before, or uses one up, unless the result of
    the step holds its target again. So without such a result ``go`` is always false in the end.
    """
    rounds = F.sequence(F.lit(1), F.length(st["ortho"]) + F.length(sp["repl"]) + 1)
    first = F.struct(st.alias("st"), pos.cast("int").alias("pos"), F.lit(True).alias("go"))

    def round_(acc: Column, _: Column) -> Column:
        cur = acc["st"]

        def tried(cands: Column) -> Column:
            def judged(c: Column) -> Column:
                return F.struct(c.alias("c"), align_(c["ortho"], c["phon"]).alias("a"))

            def good(x: Column) -> Column:
                free = sp["kind"].isin("all", "sound")
                quiet = x["a"]["surprise"] <= cur["surprise"]
                allowed = ~cur["kept"] | (sp["kind"] == "sound") | F.rlike(x["c"]["ortho"], sp["keep"])
                return x["a"].isNotNull() & (free | quiet) & F.coalesce(allowed, F.lit(True))

            passed = F.filter(F.transform(cands, judged), good)

            def settle(ok: Column) -> Column:
                pick = F.when(
                    sp["kind"] == "suffix", F.when(F.size(ok) == 2, F.get(ok, F.lit(1)))
                ).otherwise(F.get(ok, F.lit(0)))

                def next_(x: Column) -> Column:
                    new = F.struct(
                        x["c"]["ortho"].alias("ortho"), x["c"]["phon"].alias("phon"),
                        cur["lemme"].alias("lemme"), cur["h"].alias("h"),
                        x["a"]["path"].alias("path"), x["a"]["surprise"].alias("surprise"),
                        cur["w0"].alias("w0"), cur["kept"].alias("kept"),
                    )
                    is_text = sp["kind"] == "text"
                    again = F.when(is_text, F.size(cands) > 0).otherwise(
                        sp["kind"].isin("graphem", "edouble", "ecirc", "accent") & x.isNotNull()
                    )
                    return F.struct(
                        F.when(x.isNotNull(), new).otherwise(cur).alias("st"),
                        F.when(is_text, F.coalesce(F.get(cands, F.lit(0))["at"] + 1, acc["pos"])).otherwise(acc["pos"]).alias("pos"),
                        F.coalesce(again, F.lit(False)).alias("go"),
                    )

                return let(pick, next_)

            return let(passed, settle)

        return F.when(acc["go"], let(_candidates(cur, sp, acc["pos"]), tried)).otherwise(acc)

    return F.aggregate(rounds, first, round_)


def _run_steps(align_: Callable[[Column, Column], Column], state: Column, steps: Column) -> Column:
    def one_step(st: Column, sp: Column) -> Column:
        begun = F.struct(
            *[st[c].alias(c) for c in ("ortho", "phon", "lemme", "h", "path", "surprise")],
            F.concat(st["ortho"], F.lit("|"), st["phon"]).alias("w0"),
            F.when(sp["keep"] == "", F.lit(False)).otherwise(F.rlike(st["ortho"], sp["keep"])).alias("kept"),
        )
        done = _rounds(align_, st, sp, _first_position(st, sp))["st"]
        return F.when(sp["kind"] == "begin", begun).when(_wanted(st, sp), done).otherwise(st)

    return F.aggregate(steps, state, one_step)


def grows(sp: dict) -> bool:
    """Can the step find its target again inside its own result?"""
    inner = [sp["repl"].replace("E", e) for e in "éè"] if sp["kind"] == "accent" else [sp["repl"][1:]]
    return sp["kind"] in ("text", "accent") and any(sp["target"] in x for x in inner)


def _folded(df: DataFrame, table: RuleTable, steps: list[dict]) -> DataFrame:
    data = F.from_json(F.lit(json.dumps(steps, ensure_ascii=False)), f"array<{_STEP}>")
    return df.withColumn(
        "st", computed_once(table.within(lambda a: let(data, lambda s: _run_steps(a, F.col("st"), s))))
    )


MOST_GROWTH = 50  # letters


def _to_fixpoint(df: DataFrame, table: RuleTable, sp: dict) -> DataFrame:
    """Run one growing step until it finds nothing more in any row.

    A pass does as many rounds as the word is long, and rows that have not ended go on in the next
    one where they stopped; every pass is written, so it is done once. A step that makes a word longer
    by more than ``MOST_GROWTH`` letters, all of them plausible, is taken to have no fixpoint.
    """
    step_ = F.from_json(F.lit(json.dumps(sp, ensure_ascii=False)), _STEP)
    first = _first_position(F.col("st"), step_).cast("int")
    df = df.withColumn("_run", F.struct(F.col("st"), first.alias("pos"), F.col("st").isNotNull().alias("go")))
    df = df.withColumn("_long", F.length("st.ortho") + MOST_GROWTH)

    def pass_(a: Callable[[Column, Column], Column]) -> Column:
        def run(s: Column) -> Column:
            cur = F.col("_run")
            ended = F.struct(cur["st"].alias("st"), cur["pos"].alias("pos"), F.lit(False).alias("go"))
            return F.when(cur["go"] & _wanted(cur["st"], s), _rounds(a, cur["st"], s, cur["pos"])).otherwise(ended)

        return let(step_, run)

    while True:
        df = stored(df.withColumn("_run", computed_once(table.within(pass_))), "fixpoint")
        going = df.filter("_run.go")
        if going.isEmpty():
            return df.withColumn("st", F.col("_run.st")).drop("_run", "_long")
        if row := going.filter(F.length("_run.st.ortho") > F.col("_long")).select("st.ortho").first():
            raise ValueError(f"{sp['target']!r} -> {sp['repl']!r} never ends on {row[0]!r}")


def fold_steps(df: DataFrame, steps: list[dict], rules: list[dict] | None = None) -> DataFrame:
    """Run a table of steps on the ``st`` column. The table is data: the expression has
    the same size for one step or a hundred. Steps that can grow a word without bound are run by
    themselves, to their fixpoint."""
    table = RuleTable(rules or G.french_rules())
    pending: list[dict] = []
    for sp in [*steps, None]:
        if sp is not None and not grows(sp):
            pending.append(sp)
            continue
        df = _folded(df, table, pending) if pending else df
        pending = []
        df = df if sp is None else _to_fixpoint(df, table, sp)
    return df


def spread_words(lexicon: DataFrame) -> DataFrame:
    """Words over all cores. A lexicon is small in bytes, so adaptive planning would put it
    into a task or two, but each word costs far more than moving it."""
    spark = lexicon.sparkSession
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return lexicon.repartition(n, "ortho", "phon")


def align_lexicon(lexicon: DataFrame, rules: list[dict] | None = None) -> DataFrame:
    """Add ``path`` and ``surprise``; both null for rows that cannot be explained."""
    table = RuleTable(rules or G.french_rules())
    a = spread_words(lexicon).withColumn("_a", computed_once(table.within(lambda a: a(F.col("ortho"), F.col("phon")))))
    return a.select(*lexicon.columns, F.col("_a.path").alias("path"), F.col("_a.surprise").alias("surprise"))


def with_state(aligned: DataFrame) -> DataFrame:
    """Pack an aligned lexicon row into the state the steps work on."""
    h = F.col("h_aspire") if "h_aspire" in aligned.columns else F.lit(False)
    st = F.struct(
        "ortho", "phon", "lemme", F.coalesce(h, F.lit(False)).alias("h"), "path", "surprise",
        F.lit("").alias("w0"), F.lit(False).alias("kept"),
    ).cast(_STATE)
    return aligned.withColumn("st", st)


def path_text(path: Column) -> Column:
    """Graphemes and sounds of a path, readable: ``ch|a|t$ S|a|``."""
    return F.concat_ws(
        " ",
        F.array_join(F.transform(path, lambda e: e["g"]), "|"),
        F.array_join(F.transform(path, lambda e: e["p"]), "|"),
    )


def reindexed(path: Column) -> Column:
    """Recompute letter positions after graphemes were replaced in place."""
    return F.aggregate(
        path,
        F.struct(F.lit(0).alias("at"), _empty(PATH).alias("out")),
        lambda acc, e: F.struct(
            (acc["at"] + F.length(e["g"])).alias("at"),
            F.concat(
                acc["out"],
                F.array(F.struct(e["g"].alias("g"), e["p"].alias("p"), acc["at"].alias("i"), e["j"].alias("j"), e["s"].alias("s"))),
            ).alias("out"),
        ),
        lambda acc: acc["out"],
    )
