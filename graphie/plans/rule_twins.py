"""SQL twins of alignment and of the phonetic rules.

A twin works on sets of pairs (spelling, sound). Alignment is a lattice of edges, the states that can
still finish (backwards, a recursive query) and the best edge out of each (an aggregate), followed
from the start (another one). Rules need alignments of spellings that only come up on the way, and
SQL cannot nest recursions, so a twin first closes the words under every replacement a step could
make, accepted or not; aligns all of that at once; then runs the steps with the alignments at hand.
"""

from __future__ import annotations

import re

from graphie.functions import graphemes as G
from graphie.operators import rules as R
from graphie.operators.phonetics import DOUBLE

_V, _W = f"[{G.VOWELS}]", f"[{G.WEAK}]"


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _rx(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {quoted(pattern)})"


_TWIN = f"(substr(a, 1, 1) = substr(a, 2, 1) AND length(a) > 1 AND NOT {_rx('a', '^' + _V)})"
_PLAIN = f"(NOT {_TWIN} AND NOT {_rx('a', '^' + _V)} AND NOT {_rx('a', '^s?$')})"
_CLOSED = (
    f"(NOT {_rx('a', '^[bcdfgjkpqstvwz][rl]')} AND NOT {_rx('a', '^(?:ch|th)' + _V)} "
    f"AND {_rx('a', f'^(?:x|[^{G.VOWELS}](?:[^{G.VOWELS}]|$))')})"
)
# Contexts that need a look around, said without; b and a are what stands before and after.
_SAID = {
    "not_weak": f"NOT {_rx('a', '^' + _W)}",
    "not_vowel": f"NOT {_rx('a', '^' + _V)}",
    "not_bp": "NOT regexp_matches(a, '^[bp]')",
    "after_tran": "ends_with(b, 'tran') AND NOT starts_with(a, 'm')",
    "after_vowel_only": f"{_rx('b', _V + '$')} AND NOT {_rx('a', '^' + _V)} AND NOT starts_with(a, 'm')",
    "after_other": f"NOT {_rx('b', _V + '$')} AND NOT ends_with(b, 'tran') AND NOT starts_with(a, 'm')",
    "not_after_ac": "NOT ends_with(b, 'ac')",
    "no_vowel_before": f"NOT {_rx('b', _V + '$')}",
    "e_twin": _TWIN,
    "e_closed": f"{_PLAIN} AND {_CLOSED}",
    "e_open": f"{_PLAIN} AND NOT {_CLOSED}",
    "no_consonant_after": f"b <> '' AND {_rx('a', f'^(?:$|{_V})')}",
}
_BY_REGEX = {lr: _SAID[name] for name, lr in G.CONTEXTS.items() if name in _SAID}


def _condition(left: str, right: str) -> str:
    if (left, right) in _BY_REGEX:
        return _BY_REGEX[left, right]
    return " AND ".join(_rx(x, p) for x, p in (("b", left), ("a", right)) if p) or "true"


def grapheme_tables(rows: list[dict]) -> tuple[str, str]:
    """The grapheme table as a CTE ``rules``, and the CASE that tests a context by its number."""
    contexts = sorted({(r["l"], r["r"]) for r in rows})
    values = ", ".join(f"({quoted(r['g'])}, {quoted(r['p'])}, {r['imp']}, {contexts.index((r['l'], r['r']))})" for r in rows)
    table = f"""rules AS (SELECT DISTINCT g, p, imp, ctx, substr(g, 1, 1) AS f, length(g) AS gl, length(p) AS pl, octet_length(encode(g)) AS gb
  FROM (VALUES {values}) t(g, p, imp, ctx))"""
    case = "CASE ctx " + " ".join(f"WHEN {i} THEN {_condition(l, r)}" for i, (l, r) in enumerate(contexts)) + " END"
    return table, case


def alignment(name: str, pairs: str, case: str) -> str:
    """CTEs for the alignment ``name(ortho, phon, surprise, path)`` of the distinct rows of ``pairs``; needs ``rules``."""
    n = name
    return f"""
{n}_pairs AS MATERIALIZED (SELECT DISTINCT ortho, phon FROM {pairs} WHERE length(ortho) > 0),
{n}_words AS (SELECT DISTINCT ortho FROM {n}_pairs),
{n}_fits AS MATERIALIZED (SELECT ortho, i, g, gl, gb, p, pl, imp FROM (
    SELECT ortho, i, g, gl, gb, p, pl, imp, ctx, substr(ortho, 1, i) AS b, substr(ortho, i + gl + 1) AS a
    FROM (SELECT ortho, unnest(range(0, length(ortho)))::INTEGER AS i FROM {n}_words) w JOIN rules ON f = substr(ortho, i + 1, 1)
    WHERE starts_with(substr(ortho || '$', i + 1), g)) x WHERE {case}),
{n}_core AS (SELECT ortho, i, max(gb) AS longest FROM {n}_fits WHERE imp = 0 GROUP BY ortho, i),
{n}_edges AS MATERIALIZED (SELECT f.ortho, q.phon, f.i, f.g, f.gl, f.p, f.pl, max(CASE WHEN f.imp = 2 OR f.gb < coalesce(c.longest, 0) THEN 1 ELSE 0 END) AS s
  FROM {n}_fits f JOIN {n}_pairs q ON q.ortho = f.ortho LEFT JOIN {n}_core c ON c.ortho = f.ortho AND c.i = f.i
  WHERE contains(q.phon, f.p) GROUP BY ALL),
{n}_reach AS (SELECT ortho, phon, (length(ortho) + k)::INTEGER AS i, length(phon)::INTEGER AS j FROM {n}_pairs, (VALUES (0), (1)) t(k)
  UNION SELECT e.ortho, e.phon, e.i, (r.j - e.pl)::INTEGER FROM {n}_reach r JOIN {n}_edges e ON e.ortho = r.ortho AND e.phon = r.phon AND e.i + e.gl = r.i
  WHERE r.j >= e.pl AND substr(r.phon, (r.j - e.pl + 1)::INTEGER, e.pl) = e.p),
{n}_next AS MATERIALIZED (SELECT e.ortho, e.phon, e.i, r.j - e.pl AS j, max({{'j': r.j, 'i': r.i, 'g': e.g, 'p': e.p, 's': e.s}}) AS b
  FROM {n}_reach r JOIN {n}_edges e ON e.ortho = r.ortho AND e.phon = r.phon AND e.i + e.gl = r.i
  WHERE r.j >= e.pl AND substr(r.phon, (r.j - e.pl + 1)::INTEGER, e.pl) = e.p GROUP BY ALL),
{n}_walk AS (SELECT ortho, phon, 0 AS i, 0 AS j, 0 AS surprise, CAST([] AS STRUCT(g VARCHAR, p VARCHAR, i INTEGER, j INTEGER)[]) AS path FROM {n}_pairs
  UNION ALL SELECT w.ortho, w.phon, x.b.i::INTEGER, x.b.j::INTEGER, (w.surprise + x.b.s)::INTEGER,
    list_append(w.path, {{'g': x.b.g, 'p': x.b.p, 'i': w.i, 'j': w.j}})
  FROM {n}_walk w JOIN {n}_next x ON x.ortho = w.ortho AND x.phon = w.phon AND x.i = w.i AND x.j = w.j WHERE w.i < length(w.ortho)),
{n} AS MATERIALIZED (SELECT ortho, phon, surprise, path FROM {n}_walk WHERE i >= length(ortho) AND j = length(phon))"""


def _java_to_re2(x: str, pattern: str) -> str:
    """A test of a step; the only look-around in them is at the beginning and negative."""
    if m := re.fullmatch(r"\^\(\?!\.\*(.*)\)", pattern):
        return f"NOT {_rx(x, m[1])}"
    return _rx(x, pattern)


_ACUTE = (
    "CASE WHEN length({r}) <= 1 THEN {r} = '' "
    f"WHEN regexp_matches({{r}}, '^.(?:[{G.SOUND_VOWELS}]|[j8w][{G.SOUND_VOWELS}])') THEN NOT regexp_matches({{r}}, '^.°') "
    f"WHEN regexp_matches({{r}}, '[{G.SOUND_VOWELS.replace('°', '')}]') THEN regexp_matches({{r}}, '^[bptdkgvf][Rlwj8]') ELSE false END"
)


def _replaced(target: str, repl: str) -> str:
    """Every single replacement of a target in ``ortho``, as a list."""
    n = len(target)
    return (
        f"list_transform(list_filter(range(1, length(ortho) + 1), lambda i: substr(ortho, i, {n}) = {quoted(target)}), "
        f"lambda i: substr(ortho, 1, i - 1) || {quoted(repl)} || substr(ortho, i + {n}))"
    )


def _flips() -> str:
    """``phon`` with any one e taken for the other."""
    return (
        "list_concat([phon], list_transform(list_filter(range(1, length(phon) + 1), lambda i: substr(phon, i, 1) IN ('e', 'E')), "
        "lambda i: substr(phon, 1, i - 1) || CASE substr(phon, i, 1) WHEN 'e' THEN 'E' ELSE 'e' END || substr(phon, i + 1)))"
    )


def _closure_step(sp: dict) -> str:
    """Rows ``id, o, f`` (spelling, sound) a step could make of a row; more than it makes does no harm."""
    t, r = sp["target"], sp["repl"]
    kind = sp["kind"]
    lists, sounds = [], "[phon]"
    if kind == "text":
        lists = [_replaced(t, r)]
    elif kind == "graphem":
        lists = [_replaced(a["g"].removesuffix("$"), a["to"]) for a in sp["alts"]]
    elif kind == "accent":
        lists, sounds = [_replaced(t, r.replace("E", e)) for e in "éè"], _flips()
    elif kind == "ecirc":
        lists, sounds = [_replaced("ê", e) for e in "éè"], _flips()
    elif kind == "edouble":  # é with e and è with E, before the sound of the consonant
        lists = []
        for d in re.findall("[a-z]{2}", DOUBLE):
            heard = {"r": "R", "c": "k"}.get(d[0], d[0])
            for letter, e in (("é", "e"), ("è", "E")):
                at = f"list_filter(range(1, length(phon) + 1), lambda j: regexp_matches(substr(phon, j, 2), '[eE]{heard}'))"
                said = f"list_transform({at}, lambda j: substr(phon, 1, j - 1) || '{e}' || substr(phon, j + 1))"
                lists.append(f"flatten(list_transform({_replaced('e' + d, letter + d[0])}, lambda w: list_transform({said}, lambda q: {{{{'o': w, 'f': q}}}})))")
        return f"SELECT id, ortho, x.o AS o, x.f AS f FROM (SELECT id, ortho, unnest(flatten([{', '.join(lists)}])) AS x FROM {{source}} WHERE regexp_matches(ortho, 'e({DOUBLE.strip('^$(?:)')})'))"
    elif kind == "suffix":
        cut = f"substr(ortho, 1, length(ortho) - {len(t)})"
        lists = [f"CASE WHEN ends_with(ortho, {quoted(t)}) THEN [{cut}, {cut} || {quoted(r)}] ELSE [] END"]
    elif kind == "prefix":
        lists = [f"CASE WHEN starts_with(ortho, {quoted(t)}) THEN [{quoted(r)} || substr(ortho, {len(t) + 1})] ELSE [] END"]
    elif kind == "all":
        lists = [f"[replace(ortho, {quoted(t)}, {quoted(r)})]"]
    elif kind == "sound":
        lists, sounds = ["[ortho]"], f"[replace(phon, {quoted(t)}, {quoted(r)})]"
    both = lists[0] if len(lists) == 1 else f"flatten([{', '.join(lists)}])"
    return f"SELECT id, ortho, o, unnest({sounds}) AS f FROM (SELECT id, phon, ortho, unnest({both}) AS o FROM {{source}})"


def _first_of(sp: dict) -> str:
    """When a step is tried at all, apart from tests of the word it began with."""
    first = "len(path) > 0"
    if sp["target"]:
        first += f" AND (contains(ortho, {quoted(sp['target'])}) OR contains(phon, {quoted(sp['target'])}))"
    return first


def _text_sql(r: str, before: str, al: str, sp: dict, first: str) -> str:
    """The run of a text step: rounds from left to right."""
    t, n = quoted(sp["target"]), len(sp["target"])
    start = "greatest(length(ortho) - 3, 1)" if sp["start"] == "last4" else "1"
    can = "length(ortho) >= 4 AND " if sp["start"] == "last4" else ""
    return f"""
{r}_run AS (SELECT *, ({start})::INTEGER AS pos FROM {before} WHERE {first}
  UNION ALL SELECT id, coalesce(x.ortho, c.ortho), c.phon, coalesce(x.surprise, c.surprise), coalesce(x.path, c.path), (c.at + 1)::INTEGER
  FROM (SELECT *, pos + strpos(substr(ortho, pos), {t}) - 1 AS at FROM {r}_run WHERE {can}strpos(substr(ortho, pos), {t}) > 0) c
  LEFT JOIN {al} x ON x.ortho = substr(c.ortho, 1, (c.at - 1)::INTEGER) || {quoted(sp['repl'])} || substr(c.ortho, (c.at + {n})::INTEGER) AND x.phon = c.phon AND x.surprise <= c.surprise),
{r} AS MATERIALIZED (SELECT id, arg_max(ortho, pos) AS ortho, any_value(phon) AS phon, arg_max(surprise, pos) AS surprise, arg_max(path, pos) AS path FROM {r}_run GROUP BY id
  UNION ALL SELECT * FROM {before} WHERE NOT ({first}))"""


def _choices(r: str, sp: dict) -> str:
    """Candidates ``ortho2, phon2`` with their order ``n``, from the path of a row; ``e`` is an element, ``x`` the next one."""
    kind = sp["kind"]
    left_o, left_p = "substr(ortho, 1, e.i)", "substr(phon, 1, e.j)"
    acute = _ACUTE.format(r="substr(phon, e.j + 2)")
    if kind == "graphem":
        starts = {
            "1": "1",
            "y": "CASE WHEN ortho IN ('yeus', 'yeuse') THEN 0 ELSE 1 END",
            "h": "CASE WHEN starts_with(ortho, 'déh') THEN 3 WHEN starts_with(ortho, 'éh') THEN 2 ELSE h::INTEGER END",
        }
        to = "CASE " + " ".join(f"WHEN e.g = {quoted(a['g'])} AND e.p = {quoted(a['p'])} THEN {quoted(a['to'])}" for a in sp["alts"]) + " END"
        whole = f"regexp_replace({left_o} || to_ || array_to_string(list_transform(path[n + 1:], lambda y: y.g), ''), '\\$$', '')"
        return f"SELECT *, {whole} AS ortho2, phon AS phon2 FROM (SELECT *, {to} AS to_ FROM {r}_el WHERE e.i >= {starts.get(sp['start'], '0')}) WHERE to_ IS NOT NULL"
    if kind == "ecirc":
        return f"""SELECT *, {left_o} || CASE WHEN u THEN 'é' ELSE 'è' END || substr(ortho, e.i + 2) AS ortho2,
      {left_p} || CASE WHEN u THEN 'e' ELSE 'E' END || substr(phon, e.j + 2) AS phon2 FROM (SELECT *, {acute} AS u FROM {r}_el WHERE e.g = 'ê' AND e.p IN ('e', 'E'))"""
    if kind == "edouble":
        return f"""SELECT *, CASE WHEN pair THEN {left_o} || letter || substr(x.g, 1, 1) || substr(ortho, x.i + 3) ELSE {left_o} || letter || substr(e.g, 2, 1) || substr(ortho, e.i + 4) END AS ortho2,
      CASE WHEN pair THEN {left_p} || sound || substr(phon, x.j + 1) ELSE {left_p} || sound || substr(e.g, 2, 1) || substr(phon, e.j + 3) END AS phon2
    FROM (SELECT *, CASE WHEN u THEN 'é' ELSE 'è' END AS letter, CASE WHEN u THEN 'e' ELSE 'E' END AS sound FROM (SELECT *, {acute} AS u,
      coalesce(e.g = 'e' AND e.p IN ('e', 'E') AND {_rx("coalesce(x.g, '')", DOUBLE)} AND length(x.p) = 1, false) AS pair FROM {r}_el)
      WHERE pair OR (e.g IN ('enn', 'emm') AND e.p IN ('en', 'En', 'em', 'Em')))"""
    # accent: the target in the spelling, with one e or E in the sounds of the elements it overlaps
    t, n = quoted(sp["target"]), len(sp["target"])
    acute = _ACUTE.format(r="substr(phon, j + 2)")
    return f"""SELECT *, substr(ortho, 1, n - 1) || replace({quoted(sp['repl'])}, 'E', CASE WHEN u THEN 'é' ELSE 'è' END) || substr(ortho, n + {n}) AS ortho2,
      substr(phon, 1, j) || CASE WHEN u THEN 'e' ELSE 'E' END || substr(phon, j + 2) AS phon2
    FROM (SELECT *, {acute} AS u FROM (SELECT *, (over_[1].j + length(regexp_replace(sounds, '[eE].*$', '')))::INTEGER AS j FROM (
      SELECT *, array_to_string(list_transform(over_, lambda y: y.p), '') AS sounds FROM (
        SELECT id, ortho, phon, surprise, path, h, n, list_filter(path, lambda y: y.i + length(y.g) > n - 1 AND y.i < n - 1 + {n}) AS over_
        FROM (SELECT *, unnest(range(1, length(ortho) + 1)) AS n FROM {r}_live) WHERE substr(ortho, n, {n}) = {t}))
      WHERE regexp_matches(sounds, '^[^eE]*[eE][^eE]*$')))"""


def _repeat_sql(r: str, before: str, al: str, closed: str, started: str, sp: dict, first: str) -> str:
    """Steps that take the first acceptable candidate of the path until there is none: the choice for all
    pairs the closure knows, then the chain of choices."""
    return f"""
{r}_open AS MATERIALIZED (SELECT id, h FROM {before} JOIN (SELECT id, h FROM {started}) USING (id) WHERE {first}),
{r}_live AS MATERIALIZED (SELECT c.id, c.ortho, c.phon, al.surprise, al.path, o.h FROM {closed} c JOIN {r}_open o ON o.id = c.id JOIN {al} al ON al.ortho = c.ortho AND al.phon = c.phon),
{r}_el AS (SELECT *, path[n] AS e, path[n + 1] AS x FROM (SELECT *, unnest(range(1, len(path) + 1)) AS n FROM {r}_live)),
{r}_one AS MATERIALIZED (SELECT c.id, c.ortho, c.phon, arg_min({{'o': y.ortho, 'p': y.phon, 's': y.surprise, 'path': y.path}}, c.n) AS b
  FROM ({_choices(r, sp)}) c JOIN {al} y ON y.ortho = c.ortho2 AND y.phon = c.phon2 AND y.surprise <= c.surprise GROUP BY c.id, c.ortho, c.phon),
{r}_run AS (SELECT id, ortho, phon, surprise, path, 0 AS pos FROM {before} WHERE {first}
  UNION ALL SELECT r.id, b.o, b.p, b.s, b.path, r.pos + 1 FROM {r}_run r JOIN {r}_one o ON o.id = r.id AND o.ortho = r.ortho AND o.phon = r.phon),
{r} AS MATERIALIZED (SELECT id, arg_max(ortho, pos) AS ortho, arg_max(phon, pos) AS phon, arg_max(surprise, pos) AS surprise, arg_max(path, pos) AS path FROM {r}_run GROUP BY id
  UNION ALL SELECT * FROM {before} WHERE NOT ({first}))"""


def _once_sql(r: str, before: str, al: str, sp: dict, first: str) -> str:
    t, to = quoted(sp["target"]), quoted(sp["repl"])
    n, kind = len(sp["target"]), sp["kind"]
    phon2, more, free = "phon", "", kind in ("all", "sound")
    if kind == "suffix":
        ortho2 = f"CASE WHEN ends_with(ortho, {t}) AND length(ortho) > {n} THEN substr(ortho, 1, length(ortho) - {n}) || {to} END"
        more = f" JOIN {al} z ON z.ortho = substr(c.ortho, 1, length(c.ortho) - {n}) AND z.phon = c.phon AND z.surprise <= c.surprise"
    elif kind == "prefix":
        ortho2 = f"CASE WHEN starts_with(ortho, {t}) THEN {to} || substr(ortho, {n + 1}) END"
    elif kind == "all":
        ortho2 = f"CASE WHEN contains(ortho, {t}) THEN replace(ortho, {t}, {to}) END"
    else:
        ortho2, phon2 = f"CASE WHEN contains(phon, {t}) THEN ortho END", f"replace(phon, {t}, {to})"
    quiet = "" if free else " AND x.surprise <= c.surprise"
    return f"""
{r}_new AS MATERIALIZED (SELECT c.id, x.ortho, x.phon, x.surprise, x.path FROM (SELECT *, {ortho2} AS ortho2, {phon2} AS phon2 FROM {before} WHERE {first}) c
  JOIN {al} x ON x.ortho = c.ortho2 AND x.phon = c.phon2{quiet}{more}),
{r} AS MATERIALIZED (SELECT * FROM {r}_new UNION ALL SELECT * FROM {before} WHERE id NOT IN (SELECT id FROM {r}_new))"""


def steps_sql(s: str, source: str, steps: list[dict], case: str, started: str, grown: int | None = None) -> str:
    """CTEs from the states ``source(id, ortho, phon, surprise, path)`` to the states ``s`` after some steps.

    ``started(id, lemme, h, w0)`` has what the rules began with. ``grown``: how much longer than in the
    beginning a spelling can become, for steps that could go on without end.
    """
    todo = [sp for sp in steps if sp["kind"] != "begin"]
    out, n, last = [f"{s}_c0 AS MATERIALIZED (SELECT id, ortho, phon FROM {source})"], 0, source
    owns = [
        " AND ".join([_java_to_re2("w0", sp["need"])] * bool(sp["need"]) + [_java_to_re2("lemme", sp["lemma"])] * bool(sp["lemma"]))
        for sp in todo
    ]
    for sp, own in zip(todo, owns):
        new = _closure_step(sp)
        n += 1
        limit = "" if grown is None else f" AND length(ortho) <= length(split_part(id, '|', 1)) + {grown}"
        allowed = f" AND id IN (SELECT id FROM {started} WHERE {own})" if own else ""
        out.append(
            f"{s}_c{n} AS MATERIALIZED (WITH RECURSIVE c AS (SELECT id, ortho, phon FROM {s}_c{n - 1} UNION "
            f"SELECT id, o, f FROM ({new.format(source='c')}) WHERE o <> ''{limit}{allowed}) SELECT * FROM c)"
        )
    out.append(alignment(f"{s}_al", f"{s}_c{n}", case).strip())
    for k, (sp, own) in enumerate(zip(todo, owns), 1):
        first = _first_of(sp) + (f" AND id IN (SELECT id FROM {started} WHERE {own})" if own else "")
        r = s if k == len(todo) else f"{s}_r{k}"
        if sp["kind"] == "text":
            out.append(_text_sql(r, last, f"{s}_al", sp, first).strip())
        elif sp["kind"] in ("graphem", "edouble", "ecirc", "accent"):
            out.append(_repeat_sql(r, last, f"{s}_al", f"{s}_c{n}", started, sp, first).strip())
        else:
            out.append(_once_sql(r, last, f"{s}_al", sp, first).strip())
        last = r
    return ",\n".join(out)


# --- rules that work on the alignment as a whole -----------------------------------


def _spelled(path: str) -> str:
    return f"regexp_replace(array_to_string(list_transform({path}, lambda e: e.g), ''), '\\$$', '')"


def _cases(value: str, table: dict[str, str], default: str) -> str:
    return f"CASE {value} " + " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in table.items()) + f" ELSE {default} END"


_LETTERS = "list_filter(string_split({x}, ''), lambda c: c <> '')"


def _written(table: dict[str, str], kept: list[str], pairs: dict[tuple[str, str], str]) -> str:
    own = " ".join(f"WHEN e.g = {quoted(g)} AND e.p = {quoted(p)} THEN [{quoted(to)}]" for (g, p), to in pairs.items())
    letters = f"list_transform({_LETTERS.format(x='e.p')}, lambda c: {_cases('c', table, 'c')})"
    return f"flatten(list_transform(path, lambda e: CASE WHEN e.g IN ({', '.join(map(quoted, kept))}) THEN [e.g] {own} ELSE {letters} END))"


def _emptied(ortho: str, source: str) -> str:
    return f"SELECT id, {ortho} AS ortho, phon, 0 AS surprise, path[1:0] AS path FROM {source}"


def _alfonic(s: str, source: str, case: str, started: str) -> str:
    return f"{s} AS MATERIALIZED ({_emptied(f"array_to_string({_written(R._ALFONIC, ['i', "'", '-', ' '], {('b', 'p'): 'b'})}, '')", source)})"


def _sound_net(s: str, source: str, case: str, started: str) -> str:
    digraphs = ", ".join(quoted(v) for v in sorted(set(R._NET.values())))
    weak, vowel = f"^[{G.WEAK}]", f"[{G.VOWELS}]"
    after, before = "coalesce(gs[i + 1], '')", "gs[i - 1]"
    glued = f"""CASE WHEN gs[i] = 'c' AND {_rx(after, weak)} THEN 'k' WHEN i = 1 THEN gs[i]
    WHEN gs[i] = 'n' AND {_rx(before, vowel + '$')} THEN CASE WHEN {_rx(after, '^' + vowel)} THEN gs[i] WHEN i = len(gs) THEN gs[i] || 'e' ELSE '·' || gs[i] END
    WHEN {before} || substr(gs[i], 1, 1) IN ({digraphs}) THEN '·' || gs[i] ELSE gs[i] END"""
    plural = f"(ends_with(ortho, 's') AND ortho = lemme || 's') OR ortho IN ({', '.join(map(quoted, R._NET_PLURALS))})"
    return f"""{s}_gs AS (SELECT *, {_written(R._NET, R._NET_KEPT, R._NET_PAIRS)} AS gs FROM {source} JOIN (SELECT id, lemme FROM {started}) USING (id)),
{s} AS MATERIALIZED ({_emptied(f"array_to_string(list_transform(range(1, len(gs) + 1), lambda i: {glued}), '') || CASE WHEN {plural} THEN '+' ELSE '' END", s + "_gs")})"""


def _ou(letter: str):
    def sql(s: str, source: str, case: str, started: str) -> str:
        g = (
            f"CASE WHEN e.g IN ('ou', 'oû') AND e.p IN ('w', 'u') THEN '{letter}' WHEN e.g = 'où' AND e.p IN ('w', 'u') THEN '{letter}̀' "
            f"WHEN e.g = 'qu' AND e.p = 'kw' THEN 'q{letter}' WHEN e.g = 'gu' AND e.p = 'gw' THEN 'g{letter}' ELSE e.g END"
        )
        return f"""{s}_g AS (SELECT id, phon, surprise, {_regraphed(g)} AS path FROM {source}),
{s} AS MATERIALIZED (SELECT id, {_spelled('path')} AS ortho, phon, surprise, path FROM {s}_g)"""

    return sql


def _regraphed(g: str) -> str:
    """The path with other graphemes, places counted anew."""
    gs = f"list_transform(path, lambda e: {g})"
    return (
        f"list_transform(list_zip(path, {gs}, range(0, len(path))), lambda z: {{'g': z[2], 'p': z[1].p, "
        f"'i': coalesce(list_sum(list_transform(({gs})[1:z[3]], lambda y: length(y))), 0)::INTEGER, 'j': z[1].j}})"
    )


def _realigned(s: str, source: str, case: str, started: str, ortho2: str, phon2: str, where: str, quiet: bool) -> str:
    return f"""{s}_cand AS MATERIALIZED (SELECT id, {ortho2} AS ortho, {phon2} AS phon, surprise AS before FROM {source} JOIN (SELECT id, lemme FROM {started}) USING (id)
  WHERE len(path) > 0 AND {where}),
{alignment(s + '_al', s + '_cand', case).strip()},
{s}_new AS MATERIALIZED (SELECT c.id, x.ortho, x.phon, x.surprise, x.path FROM {s}_cand c JOIN {s}_al x ON x.ortho = c.ortho AND x.phon = c.phon{' AND x.surprise <= c.before' * quiet}),
{s} AS MATERIALIZED (SELECT * FROM {s}_new UNION ALL SELECT * FROM {source} WHERE id NOT IN (SELECT id FROM {s}_new))"""


def _als(s: str, source: str, case: str, started: str) -> str:
    where = "regexp_matches(ortho, 'au[xs]$') AND regexp_matches(lemme, '(al|ail)$') AND ends_with(phon, 'o')"
    phon2 = "substr(phon, 1, length(phon) - 1) || CASE WHEN ends_with(lemme, 'al') THEN 'al' ELSE 'aj' END"
    return _realigned(s, source, case, started, "lemme || 's'", phon2, where, quiet=False)


def _il(s: str, source: str, case: str, started: str) -> str:
    sounds = f"array_to_string(list_filter(list_transform({_LETTERS.format(x='e.p')}, lambda c: {_cases('c', R._IL_SOUNDS, 'NULL')}), lambda c: c IS NOT NULL), '')"
    g = (
        f"CASE WHEN e.g IN ({', '.join(map(quoted, R._IL_GRAPHEMES))}) AND NOT contains(e.p, 'l') THEN {sounds} || "
        "CASE WHEN e.g IN ('il$', 'ils$') THEN 'e' ELSE '' END || CASE WHEN ends_with(e.g, 's$') THEN 's' ELSE '' END ELSE e.g END"
    )
    ortho2 = f"regexp_replace(array_to_string(list_transform(path, lambda e: {g}), ''), '\\$$', '')"
    return _realigned(s, source, case, started, ortho2, "phon", f"{ortho2} <> ortho", quiet=True)


def _plat(s: str, source: str, case: str, started: str) -> str:
    flat = f"translate(ortho, {quoted(''.join(a for a, _ in R._MACRONS))}, {quoted(''.join(b for _, b in R._MACRONS))})"
    return f"{s} AS MATERIALIZED (SELECT id, CASE WHEN len(path) = 0 THEN {flat} ELSE ortho END AS ortho, phon, surprise, path FROM {source})"


_PROJECTIONS = {
    "aux/als": _als, "il/y": _il, "accent-plat": _plat, "sound-net": _sound_net, "alfonic": _alfonic, "ou/w": _ou("w"), "ou/omega": _ou("ω"),
}


def _prefilter(rules: list[R.Rule]) -> str:
    if [r.name for r in rules] == ["flagship"]:
        return _rx("ortho || '|' || phon", R.FLAGSHIP_ALONE)
    if any(r.prefilter is None for r in rules):
        return "true"
    return _rx("ortho", "|".join(["oe", *[r.prefilter for r in rules if r.prefilter]]))


_OE = """CASE WHEN e.g = 'oe' AND e.p IN ('e', 'E', '2', '9') THEN 'œ' WHEN e.g = 'oeu' AND e.p IN ('2', '9') THEN 'œu' WHEN e.g = 'coe' AND e.p = 'se' THEN 'cœ' ELSE e.g END"""


def rules_sql(lexicon: str, rules: list[R.Rule], fix_oe: bool = False) -> str:
    """CTEs from ``lexicon(ortho, phon, lemme, h, rank)`` to ``respelled(old, new, sub, rank, outcome)`` of all usable rows."""
    table, case = grapheme_tables(G.french_rules())
    out = [
        table,
        f"usable AS MATERIALIZED (SELECT ortho, phon, lemme, h, rank, {_prefilter(rules)} AS m FROM {lexicon} WHERE octet_length(encode(ortho)) > 1 AND NOT contains(ortho, '-'))",
        "words AS (SELECT * FROM usable WHERE m)",
        alignment("plain", "words", case).strip(),
        f"""oe AS MATERIALIZED (SELECT *, {_spelled('path')} AS ortho2, CASE WHEN replace(ortho, 'oe', 'œ') = {_spelled('path')} THEN replace(lemme, 'oe', 'œ') ELSE lemme END AS lemme2
  FROM (SELECT ortho, phon, lemme, h, rank, surprise, {_regraphed(_OE)} AS path FROM words JOIN plain USING (ortho, phon) WHERE contains(ortho, 'oe')))""",
        f"""started AS MATERIALIZED (
  SELECT w.ortho || '|' || w.rank || '|0' AS id, w.ortho AS old, 0 AS sub, w.rank, {"coalesce(oe.ortho2, w.ortho)" if fix_oe else "w.ortho"} AS ortho, w.phon,
    {"coalesce(oe.lemme2, w.lemme)" if fix_oe else "CASE WHEN oe.ortho2 = w.ortho THEN oe.lemme2 ELSE w.lemme END"} AS lemme, w.h, p.surprise, {"coalesce(oe.path, p.path)" if fix_oe else "p.path"} AS path
  FROM words w JOIN plain p ON p.ortho = w.ortho AND p.phon = w.phon LEFT JOIN oe ON oe.ortho = w.ortho AND oe.rank = w.rank
  UNION ALL SELECT ortho || '|' || rank || '|1', ortho2, 1, rank, ortho2, phon, lemme2, h, surprise, path FROM oe WHERE ortho2 <> ortho)""",
        "begun AS MATERIALIZED (SELECT id, lemme, h, ortho || '|' || phon AS w0 FROM started)",
        "s0 AS MATERIALIZED (SELECT id, ortho, phon, surprise, path FROM started)",
    ]
    last, pending, n = "s0", [], 0
    for rule in [*R.ordered(rules), None]:
        if rule is not None:
            pending += rule.steps
        if rule is None or rule.project is not None:
            if any(sp["kind"] != "begin" for sp in pending):
                n += 1
                out.append(steps_sql(f"s{n}", last, pending, case, "begun"))
                last = f"s{n}"
            pending = []
            if rule is not None:
                n += 1
                out.append(_PROJECTIONS[rule.name](f"s{n}", last, case, "begun"))
                last = f"s{n}"
    out.append(
        f"""respelled AS MATERIALIZED (SELECT old, f.ortho AS new, sub, rank, 'rewritten' AS outcome FROM {last} f JOIN started USING (id)
  UNION ALL SELECT ortho, ortho, 0, rank, CASE WHEN m THEN 'failed' ELSE 'prefiltered_out' END FROM usable WHERE NOT m OR ortho || '|' || rank || '|0' NOT IN (SELECT id FROM started))"""
    )
    return ",\n".join(out)
