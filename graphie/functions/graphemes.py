"""French spelling-to-sound rules as a table.

Each line gives a grapheme and the sounds it can have. Marks: ``?`` before a sound makes
it usual but never preferred over a shorter grapheme, ``!`` makes it surprising, ``-`` is
silence; ``$`` in a grapheme is the end of the word. ``@name`` restricts the line
to a context.
"""

from __future__ import annotations

WEAK = "eéèêēiîīyȳ"
VOWELS = WEAK + "aàâäāëïoôöōuûùüūÿ"
SOUND_VOWELS = "aeEē29°@5§1iyuoO"
CORE, OPTIONAL, SURPRISING = 0, 1, 2

# Contexts as (what stands before, what stands after), regexes.
_V, _W = f"[{VOWELS}]", f"[{WEAK}]"
_TWIN = rf"([^{VOWELS}])\1"
_ONSET = "(?![bcdfgjkpqstvwz][rl])(?!(?:ch|th)" + _V + ")"
_CLOSED = rf"{_ONSET}(?:x|[^{VOWELS}](?:[^{VOWELS}]|$))"
_PLAIN_E = rf"(?!{_TWIN})(?!{_V})(?!s?$)"
CONTEXTS = {
    "stc": ("", "^[stc]"),
    "weak": ("", f"^{_W}"),
    "not_weak": ("", f"^(?!{_W})"),
    "vowel": ("", f"^{_V}"),
    "not_vowel": ("", f"^(?!{_V})"),
    "i": ("", "^i"),
    "bp": ("", "^[bp]"),
    "not_bp": ("", "^(?![bp])"),
    "between_vowels": (f"{_V}$", f"^{_V}"),
    "before_m": ("", "^m"),
    "after_tran": ("tran$", "^(?!m)"),
    "after_vowel_only": (f"{_V}$", f"^(?!{_V}|m)"),
    "after_other": (f"(?<!{_V})(?<!tran)$", "^(?!m)"),
    "after_ac": ("ac$", ""),
    "not_after_ac": ("(?<!ac)$", ""),
    "no_vowel_before": (f"(?<!{_V})$", ""),
    "vowel_before": (f"{_V}$", ""),
    "e_twin": ("", f"^{_TWIN}"),
    "e_final": ("", "^s?$"),
    "e_closed": ("", f"^{_PLAIN_E}{_CLOSED}"),
    "e_open": ("", f"^{_PLAIN_E}(?!{_CLOSED})"),
    "first": ("^$", ""),
    "no_consonant_after": ("(?<=.)$", f"^(?:$|{_V})"),
    "inner_glide": (f"[^{VOWELS}]$", f"^(?:$|{_V})"),
}

# Graphemes and their sounds.
TABLE = """
' -
- -
_ -
b b
b p @stc
ç s
sç s
h -
j Z
k k
ck k
ph f
qu k !kw
cqu k !kw
q k
cq k
v v
w w !v
x gz ks !s !z
z z !s
c s @weak
c k !g @not_weak
ch k S
cch k
sch S
sc s @weak
sc sk @not_weak
cc ks @weak
cc k @not_weak
xc ks @weak
xc k @not_weak
gu g !gw @vowel
gu gy @not_vowel
g Z @weak
g g @not_weak
guë gy
gn N nj
ign !N
gni N
ni ?N
ng G
ong ?§G
il$ il ij j
ils$ il ij j
ill il ij j
illi ?il ?ij ?j
il il !ij !j
eil$ ej Ej
eils$ ej Ej
eill ej Ej
eilli ej Ej
s z !s @between_vowels
s z s @before_m
s z s @after_tran
s s !z @after_vowel_only
s s !z @after_other
sh S
désh dez
t t
t s @i
t$ -
t$ t @after_ac
t$ !t @not_after_ac
ts$ -
ts$ t @after_ac
ts$ !t @not_after_ac
th t !-
p !-
l !-
l$ !-
aul !o
g !- @not_vowel
x$ -
s$ -
t !-
s !-
c !-
coe !se
cœ !se
sc !S
iz$ !i
az$ !a
mn mn !n
au o
aux oks ogz @weak
aux o @not_weak
ai e E !° !2
aî e E
ay aj e E ej Ej ei Ei
aou !u
è E !e
é e !E
e e E !° !2 @e_twin
e - @vowel
e 2 ° - @e_final
e e E !° !2 @e_closed
e ° 2 - !e !E !9 @e_open
ei e E
ey e E ej Ej ei Ei
ez$ e E
es !e !E
ess es Es
eau o
eaux o
et$ E
est$ Est e
ests$ Est
i i
i j @first
i j @no_consonant_after
i ij @inner_glide
ï i j
o o O
ō o O
ô o
ö o
oo oo oO !O !o
oi wa
oî wa
oix$ wa
oy oj Oj wa waj wai
oux$ u
oell wal
oê !wa
u y
u 8 !w !9 @no_vowel_before
ü y 8
us$ y !ys
um !om !Om
ums$ !om !Om
ue !2 !9
y ij j i
en 2n °n !@n !5n @vowel
en 5 @ !5n @not_vowel
enn en En @n !an
em @ @bp
em 2m °m m @not_bp
emm @m am em Em
ent$ !- @
ont$ §
onts$ §
anc$ @
and$ @
ands$ @
ant$ @
ants$ @
ans$ @
"""
# Letters that sound the same, doubled consonants, silent endings.
SAME = {
    "a": ("à â ä a ā", "a"), "e": ("ë ê ē", "e E"), "i": ("î ī", "i"), "y": ("û ù ū", "y"),
    "eu": ("eu eû eux", "2 9 !y"), "er": ("er$ ers$", "e Er"), "ou": ("ou oû où oū", "u w"),
    "oeu": ("oeu œu", "9 2"), "oe": ("oe œ", "?e ?2 ?9"),
}
DOUBLED = {"b": "b", "d": "d", "f": "f", "k": "k", "l": "l", "m": "m", "n": "n", "p": "p", "r": "R", "s": "s", "t": "t", "z": "z"}
SINGLE = ["d", "f", "l", "m", "n", "p", "r"]
SILENT_ENDINGS = ["ct", "c", "d", "f", "b"]
# Vowel letters, their sounds before a spoken consonant, their nasal sound.
NASAL_M = [("a", "a", "@"), ("ai", "e E", "5"), ("i", "i", "5"), ("o", "o O", "§"), ("u", "y", "1"), ("y", "i", "5")]
NASAL_N = [
    ("a", "a", "@"), ("ai", "e E", "5"), ("ao", "a", "@"), ("ei", "e E", "5"), ("i", "i", "5"), ("î", "i", "5"),
    ("ï", "i", "5"), ("o", "o O", "§"), ("oi", "wa", "w5"), ("u", "y", "1"), ("y", "i", "5"),
]
OPTIONAL_NASALS = {"ao"}


def _entry(grapheme: str, sound: str, context: str | None) -> dict:
    importance = CORE
    if len(sound) > 1 and sound[0] in "?!":
        importance = OPTIONAL if sound[0] == "?" else SURPRISING
        sound = sound[1:]
    left, right = CONTEXTS[context] if context else ("", "")
    return {"g": grapheme, "p": "" if sound == "-" else sound, "imp": importance, "l": left, "r": right}


def french_rules() -> list[dict]:
    """Rows ``g, p, imp, l, r`` of the whole table."""
    rows = []
    for line in TABLE.strip().splitlines():
        grapheme, *rest = line.split()
        grapheme = " " if grapheme == "_" else grapheme
        context = rest.pop()[1:] if rest[-1][0] == "@" and rest[-1][1:] in CONTEXTS else None
        rows += [_entry(grapheme, s, context) for s in rest]
    for graphemes, sounds in SAME.values():
        rows += [_entry(g, s, None) for g in graphemes.split() for s in sounds.split()]
    rows += [_entry(c + c, s, None) for c, s in DOUBLED.items()]
    rows += [_entry(c, DOUBLED[c], None) for c in SINGLE]
    rows += [_entry(c + plural + "$", "!-", None) for c in SILENT_ENDINGS for plural in ("", "s")]
    for g, spoken, nasal in NASAL_M:
        rows += [_entry(g + "mm", s + "m", None) for s in spoken.split()]
        rows += [_entry(g + "m", s + "m", "not_bp") for s in spoken.split()]
        rows += [_entry(g + "m", nasal, "bp"), _entry(g + "m", "!" + nasal, "not_bp")]
    for g, spoken, nasal in NASAL_N:
        mark = "?" if g in OPTIONAL_NASALS else ""
        rows += [_entry(g + "nn", mark + s + "n", None) for s in spoken.split()]
        rows += [_entry(g + "n", mark + s + "n", "vowel") for s in spoken.split()]
        rows += [_entry(g + "n", mark + nasal, "not_vowel")]
    return rows
