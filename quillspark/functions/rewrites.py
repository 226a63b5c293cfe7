"""String rewrites as SQL expressions: f(dialect, expression) gives a string."""

from __future__ import annotations

from quillspark.functions.predicates import folded  # noqa: F401

PARTICLES = "de del al a en con por para sin sobre la el los las y o u que se su sus".split()  # stay small in a title but for its first word
_PLANETS = dict(zip("Moon Mercury Venus Earth Mars Jupiter Saturn Uranus Neptune Pluto".split(), "☽☿♀⊕♂♃♄♅♆♇")) | {"Sun": "☉", "Fortune": "⊗", "Ascendant": "Asc", "Retrograde": "℞"}
_SIGNS = {name: chr(0x2648 + k) for k, name in enumerate("Aries Taurus Gemini Cancer Leo Virgo Libra Scorpio Sagittarius Capricorn Aquarius Pisces".split())}
_ASPECTS = dict(zip(["Conjunction", "Opposition", "Trine", "Square", "Sextile"], "☌☍△□⚹")) | {a + "Node": c for a, c in (("Asc", "☊"), ("Desc", "☋"))} | {a + "node": c for a, c in (("Asc", "☊"), ("Desc", "☋"))}
TEX = _PLANETS | _SIGNS | _ASPECTS


def chain(d, x, *steps):
    for p, to in steps:
        x = d.rep(x, p, to)
    return x


def slug(d, x, most=80, lower=False, fallback="section", ascii_only=False):  # R1
    s = d.plain(x) if ascii_only else d.composed(x)
    s = f"lower({s})" if lower else s
    s = chain(d, s, (r"[^\p{L}\p{N}\p{M}_\s-]", ""), (r"^\s+|\s+$", ""), (r"[\s_]+", "_"))
    return d.let(d.rep(f"substr({s}, 1, {most})", r"^[_-]+|[_-]+$", ""), lambda s: f"CASE WHEN {s} = '' THEN {d.lit(fallback)} ELSE {s} END")


DOTLESS = [("ı\\s*[€¨\u0308]", "ï"), ("ı\\s*[´\u0301]", "í"), ("ı\\s*[`\u0300]", "ì"), ("ı\\s*\u0302", "î"), ("ı", "i")]


def diacritics(d, x):  # R5: dotless i and what stands behind it, the umlaut that became a euro sign, marks behind their letters
    y = chain(d, x, *DOTLESS)
    for v, u in zip("aouAOU", "äöüÄÖÜ"):
        y = d.rep(y, rf"€\s?{v}", u)
    if d.name == "spark":
        return d.let(x, lambda v: d.composed(accents_behind(d, f"CASE WHEN {d.like(v, '[ı€]')} THEN {umlauts(d, chain(d, v, *DOTLESS))} ELSE {v} END")))
    return d.composed(accents_behind(d, f"CASE WHEN {d.like(x, '[ı€]')} THEN {y} ELSE {x} END"))


def umlauts(d, x):  # Spark: the euro sign that was an umlaut, brought to its letter, then both to one
    x = d.rep(x, r"€\s?([aouAOU])", r"€\1")
    for v, u in zip("aouAOU", "äöüÄÖÜ"):
        x = f"replace({x}, '€{v}', '{u}')"
    return x


ACCENTS = {"´\u0301": ("aeiouAEIOU", "áéíóúÁÉÍÓÚ"), "`\u0300": ("aeiouAEIOU", "àèìòùÀÈÌÒÙ"), "¨\u0308": ("aeiouAEIOU", "äëïöüÄËÏÖÜ"), "\u0302": ("aeiouAEIOU", "âêîôûÂÊÎÔÛ"), "¸\u0327": ("cC", "çÇ")}


def accents_behind(d, x):  # a mark behind its letter, a space between them at most
    if d.name == "spark":  # each kind of mark where it occurs: brought to its letters as a combining one, then both to one
        kinds = ", ".join(
            f"named_struct('m', {d.lit(marks[0])}, 'c', {d.lit(marks[-1])}, 'p', {d.pat(f'([{plain}]) ?[{marks}]')}, 'to', {d.to(chr(92) + '1' + marks[-1])}, 'l', array({', '.join(f'named_struct({chr(39)}a{chr(39)}, {d.lit(a + marks[-1])}, {chr(39)}b{chr(39)}, {d.lit(b)})' for a, b in zip(plain, with_mark))}))"
            for marks, (plain, with_mark) in ACCENTS.items()
        )
        one = "aggregate(f.l, regexp_replace(t, f.p, f.to), (u, g) -> replace(u, g.a, g.b))"
        return d.let(x, lambda v: f"CASE WHEN {d.like(v, '[' + ''.join(ACCENTS) + ']')} THEN aggregate(array({kinds}), {v}, (t, f) -> CASE WHEN contains(t, f.m) OR contains(t, f.c) THEN {one} ELSE t END) ELSE {v} END")
    done = x
    for marks, (plain, with_mark) in ACCENTS.items():
        for a, b in zip(plain, with_mark):
            done = d.rep(done, f"{a} ?[{marks}]", b)
    return f"CASE WHEN {d.like(x, '[' + ''.join(ACCENTS) + ']')} THEN {done} ELSE {x} END"


def docling(d, x):  # R6: accents, spaces, ligatures that stand alone
    x = f"replace({accents_behind(d, x)}, 'ı€', 'ï')"
    if d.name == "spark":  # what is rare is searched where a string that it needs is there; what is replaced by itself isn't
        x = d.let(x, lambda v: f"CASE WHEN contains({v}, '€') THEN {umlauts(d, v)} ELSE {v} END")
        x = d.rewrite(x, ("R ", r"R(?<![\p{L}\p{N}_]R) ([a-z])", r"R\1"))
        x = chain(d, x, (r"([0-9]) (st|nd|rd|th)([^\p{L}\p{N}_]|$)", r"\1\2\3"))
        x = d.rewrite(x, (":", r"([0-9]) ?: ?([0-9])", r"\1:\2"), ("-", r"([0-9]) ?- ?([0-9])", r"\1-\2"))
        x = chain(d, x, (r" (?<=[\p{L}\p{N}_] )([\].:;,)])", r"\1"), (r"([\[(]) ([\p{L}\p{N}_])", r"\1\2"), ("  +", " "))
        return d.rewrite(x, *[(f" {c} ", f"([a-zA-Z]) {c} ([a-z]+)", rf"\1{to}\2") for _ in range(2) for c, to in LIGATURES.items()])
    for v, u in zip("aouAOU", "äöüÄÖÜ"):
        x = d.rep(x, rf"€\s?{v}", u)
    edge = r"(^|[^\p{L}\p{N}_])"
    x = chain(
        d, x, (edge + "R ([a-z])", r"\1R\2"), (r"([0-9]) (st|nd|rd|th)([^\p{L}\p{N}_]|$)", r"\1\2\3"), (r"([0-9]) ?: ?([0-9])", r"\1:\2"), (r"([0-9]) ?- ?([0-9])", r"\1-\2"),
        (r"([\p{L}\p{N}_]) ([\].:;,)])", r"\1\2"), (r"([\[(]) ([\p{L}\p{N}_])", r"\1\2"), (" +", " "),
    )
    for _ in range(2):  # some follow upon each other
        for c, to in LIGATURES.items():
            x = d.rep(x, f"([a-zA-Z]) {c} ([a-z]+)", rf"\1{to}\2")
    return x


CAPITALS = "(?<![A-Za-z])[A-Ua-z]*+[V-Z][A-Za-z]*+"  # Spark: a run of letters with a capital that may stand for a ligature
LIGATURES = {"V": "ff", "W": "fi", "X": "fl", "Y": "ffi", "Z": "ffl"}


def ordinals(d, x):  # R7: days of a month and houses; the ending follows from the number
    junk = r"(?:nd|rd|st|th|l\s*h|[,\x27’]\s*h|,\s*t|t\s*[\x27’]?\s*I|\}\s*,|v|h)"
    y = chain(d, x, (r"(^|[^\p{L}\p{N}_])ll(\s*[\x27’,]?\s*[h}])", r"\1#11#\2"), (r"(^|[^\p{L}\p{N}_])I\s*1\s*[\x27’]", r"\1#1st#"))
    y = f"replace(replace({y}, '#11#', '11'), '#1st#', '1st')"
    y = d.rep(y, r"(^|[^\p{L}\p{N}_])(0?[1-9]|[12][0-9]|3[01])\s*[\x27’,]?\s*" + junk + r"([\])\s:;,.]|$)", r"\1<ord \2>\3")
    y = chain(d, y, (r"<ord 0?([23]?1)>", r"\1st"), (r"<ord 0?(2?2)>", r"\1nd"), (r"<ord 0?(2?3)>", r"\1rd"), (r"<ord 0?([0-9]+)>", r"\1th"))
    # lines without a number or what is read for one are let through
    return f"CASE WHEN {d.like(x, '[0-9]|ll')} THEN {y} ELSE {x} END"


# what follows the pronoun I: auxiliaries, then regular and irregular verbs of writing and thinking with their past
FIRST_PERSON = {
    "auxiliaries": "am have had do did can cannot could may might must shall should will would ll ve m won don",
    "regular": "believe intend intended suggest suggested publish published translate translated note noted use used want wanted call called hope consider assume argue present",
    "irregular": "think write wrote read say said see saw find found know knew give gave take took make made mean meant",
}


def pronoun(d, x):  # R9
    verbs = "|".join(sorted({f for own in FIRST_PERSON.values() for f in own.split()}))
    return d.rep(x, rf"(^|[\s(])[Tl|](\s+)({verbs})([^\p{{L}}]|$)", r"\1I\2\3\4")


def join_lines(d, x):  # R10
    return chain(d, x, ("\u00ad\\s*\n\\s*", ""), (r"-[ \t]*\n[ \t]*(\p{Ll})", r"\1"), (r"\s*\n\s*", " "))


def join_paragraph(d, x):  # R11
    return f"trim({chain(d, x, (r'([0-9A-Za-zÀ-ÿ])-\n([0-9A-Za-zÀ-ÿ])', chr(92) + '1' + chr(92) + '2'), (chr(92) + 's*\n' + chr(92) + 's*', ' '), ('[ ]{2,}', ' '))})"


def dehyphenate(d, a, b):  # R12
    return f"CASE WHEN {d.like(a, '[A-Za-zÀ-ÿ]-$')} THEN substr({a}, 1, length({a}) - 1) || {b} ELSE {a} || ' ' || {b} END"


def leading_number(d, x):  # R13: a folio glued to the first word, junk before it, and a folio within a broken word
    letter = r"[\p{L}¡«¿]"
    if d.name == "spark":  # a broken word is sought from its last letter on, where a hyphen and a number are
        start = chain(d, x, (rf"^[\s-]*[0-9]{{1,3}}({letter})", r"\1"), (rf"^[\s*+.·•-]+({letter})", r"\1"))
        broken = [(rf"([\p{{L}}\p{{N}}_])-\s+[0-9]{{1,3}}{middle}\s+([a-záéíóúüñ])", r"\1\2") for middle in (r"\.?\s+[0-9]{0,3}", "")]
        return d.let(start, lambda v: f"CASE WHEN {d.like(v, '-' + chr(92) + 's+[0-9]')} THEN {chain(d, v, *broken)} ELSE {v} END")
    return chain(d, x, (rf"^[\s-]*[0-9]{{1,3}}({letter})", r"\1"), (rf"^[\s*+.·•-]+({letter})", r"\1"), (r"([\p{L}\p{N}_]+)-\s+[0-9]{1,3}\.?\s+[0-9]{0,3}\s+([a-záéíóúüñ])", r"\1\2"), (r"([\p{L}\p{N}_]+)-\s+[0-9]{1,3}\s+([a-záéíóúüñ])", r"\1\2"))


def fixes(d, x, pairs=(("tbe", "the"), ("aud", "and"), ("rn([aeiou])", r"m\1"))):  # R14
    return chain(d, x, *pairs)


def title_case(d, x, minor=tuple(PARTICLES)):  # R15, R16: signs around a word stay, particles behind the first word are small
    words = d.keep(d.split(f"lower({x})", r"\s+"), "w", "w <> ''")
    listed = d.array(*(d.lit(w) for w in minor))
    # what comes before a word's first letter stays; a sharp s has no capital of one letter, a ligature none at all
    def raised(x):
        lead, core = d.ext(x, r"^[^\p{L}]*", 0), d.rep(x, r"^[^\p{L}]+", "")
        return f"{lead} || CASE WHEN {d.like(core, '^[ﬀﬁﬂﬃﬄ]')} THEN {core} ELSE replace(upper(substr({core}, 1, 1)), 'ẞ', 'SS') || substr({core}, 2) END"

    done = d.each(words, "w", f"CASE WHEN {d.has(listed, 'w')} THEN w ELSE {raised('w')} END")
    return raised(d.join(done, " "))


def soft_hyphens(d, x):  # R20
    return f"replace(replace({x}, '\u00ad ', ''), '\u00ad', '')"


def collapse_spaces(d, x):  # R21, a line
    inner = d.rep(x, r"(\S)[ \t]{2,}", r"\1 ")
    return f"CASE WHEN {d.like(x, r'^(\s*[|#>]|!\[|<!--|```)')} THEN {x} ELSE {d.rep(inner, r'[ \t]+$', '')} END"


def tidy(d, x):  # R22
    return f"{chain(d, x, ('[ \t]+\n', chr(10)), (chr(10) + '{3,}', chr(10) * 2), ('^[\n \t]+|[\n \t]+$', ''))} || {d.lit(chr(10))}"


def bracket_refs(d, x):  # R24: a reference, not a link, a definition or a year
    return f"replace({chain(d, x, (r'\[([0-9]{1,3})\]([(:])', '[=' + chr(92) + '1]' + chr(92) + '2'), (r'\[([0-9]{1,3})\]', '[^' + chr(92) + '1]'))}, '[=', '[')"


def glyph(d, x):  # R29
    return d.char(f"upper({d.ext(x, r'_img_([0-9A-Fa-f]{4})[.]', 1)})")


def tex_symbols(d, x):  # R30: commands of the astronomical sets, with braces, a space or nothing behind them
    y = x
    for name in sorted(TEX, key=lambda n: (-len(n), n)):
        y = chain(d, y, (rf"\\{name}(?:\{{\}}|([^A-Za-z]|$))", rf"{TEX[name]}\1"))
    return f"CASE WHEN contains({x}, {d.lit(chr(92))}) THEN {y} ELSE {x} END"


def caption(d, x):  # R32
    s = chain(d, x, (r"<[0-9:.]+>", ""), (r"</?[a-zA-Z][^>]*>", ""))
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        s = f"replace({s}, {d.lit(a)}, {d.lit(b)})"
    return f"trim({d.rep(s, r'[ \t\n\r]+', ' ')})"


def seconds(d, x):  # R33
    p = [f"coalesce({d.num(d.ext(x, r'^(?:([0-9]+):)?([0-9]+):([0-9]+)$', g))}, 0)" for g in (1, 2, 3)]
    return f"CASE WHEN contains({x}, ':') THEN {p[0]} * 3600 + {p[1]} * 60 + {p[2]} ELSE {d.num(x)} END"


def tex_escape(d, x):  # R34
    s = f"replace({x}, {d.lit(chr(92))}, {d.lit(chr(1))})"
    for c in "&%$#_{}":
        s = f"replace({s}, {d.lit(c)}, {d.lit(chr(92) + c)})"
    for c, name in (("~", "textasciitilde"), ("^", "textasciicircum"), (chr(1), "textbackslash")):
        s = f"replace({s}, {d.lit(c)}, {d.lit(chr(92) + name + '{}')})"
    return s


def reference_text(d, x):  # R35
    return chain(d, soft_hyphens(d, x), (r"\n[ \t]*[0-9]{1,4}[ \t]*(\n|$)", "\n"), (r"([\p{L}])-\n([\p{Ll}])", r"\1\2"), (r"\s+", " "))


def index_key(d, x):  # R36
    return d.rep(d.fold(x), "^a[dlrstz]-", "")


def first_title(d, x, stem="'untitled'"):  # R38
    own = d.ext(x, r"(?m)^# +(.*)$", 1)
    any_ = d.ext(x, r"(?m)^#+ +(.*)$", 1)
    clean = lambda s: f"substr(trim({d.rep(s, r'[*_`]', '')}), 1, 60)"
    return f"CASE WHEN {own} <> '' THEN {clean(own)} WHEN {any_} <> '' THEN {clean(any_)} ELSE {stem} END"


def match_case(d, old, new):  # R39
    return f"CASE WHEN {old} = upper({old}) AND length({old}) > 1 THEN upper({new}) WHEN {d.like(old, '^' + chr(92) + 'p{Lu}')} THEN upper(substr({new}, 1, 1)) || substr({new}, 2) ELSE {new} END"


def resolve_href(d, x, base):  # R40: no fragment, joined, dot segments folded however many there are
    parts = d.keep(d.split(f"{base} || '/' || {d.rep(x, '#.*$', '')}", "/"), "v", "v <> '' AND v <> '.'")
    if d.name == "spark":
        fold = f"aggregate({parts}, cast(array() as array<string>), (a, v) -> CASE WHEN v <> '..' THEN concat(a, array(v)) WHEN size(a) > 0 THEN slice(a, 1, size(a) - 1) ELSE a END)"
    else:
        fold = f"list_reduce(list_prepend([]::VARCHAR[], list_transform({parts}, lambda v: [v])), lambda a, v: CASE WHEN v[1] <> '..' THEN list_concat(a, v) WHEN len(a) > 0 THEN list_slice(a, 1, len(a) - 1) ELSE a END)"
    return d.rep(d.join(fold, "/"), r"^[./]+", "")


def tokens(d, x, kind="word"):  # R41
    pattern = {"word": r"[\p{L}\p{N}]+", "latin": "[À-ÿA-Za-z]{2,}", "ascii": "[A-Za-z]+", "apostrophe": r"[A-Za-z][A-Za-z\x27’]*"}[kind]
    return d.all(x if kind == "apostrophe" else f"lower({x})", pattern)


def body(d, x):  # R42
    return d.join(d.keep(d.split(x, "\n"), "l", "NOT starts_with(l, '#')" if d.name == "duckdb" else "NOT startswith(l, '#')"), "\n")


def numbered_notes(d, x):  # R43: texts behind [^N] markers
    return d.all(x, r"\[\^[0-9]{1,3}\]([^\[]*)", 1)


def numbered_marks(d, x):
    return d.all(x, r"\[\^([0-9]{1,3})\]", 1)


def srt_time(d, x):  # K7: milliseconds are cut, not rounded
    ms = f"CAST(floor({x} * 1000) AS BIGINT)"
    p = lambda v, w: f"lpad(CAST({v} AS {'STRING' if d.name == 'spark' else 'VARCHAR'}), {w}, '0')"
    whole = "div" if d.name == "spark" else "//"
    return f"{p(f'({ms} {whole} 3600000)', 2)} || ':' || {p(f'(({ms} {whole} 60000) % 60)', 2)} || ':' || {p(f'(({ms} {whole} 1000) % 60)', 2)} || ',' || {p(f'({ms} % 1000)', 3)}"


def strip_chapter(d, x):  # M2
    return d.rep(x, r"(?m)^(# )(?:Capítulo|Chapter) [0-9IVXLC]+ *[—:.-] *", r"\1")


def star_sections(d, x):  # M4
    return d.rep(x, r"\\(section|subsection|subsubsection)\{", r"\\1*{")


def centre_images(d, x):  # M6
    return d.rep(x, r"(\\includegraphics(?:\[[^]]*[]])?[{][^}]*[}])", r"\begin{center}\1\end{center}")


def star_first_chapter(d, x):  # M3: one level of nested braces
    return d.rep(x, r"(?s)\A(.*?)\\chapter[{]((?:[{][^{}]*[}]|[^{}])*)[}]", r"\1\chapter*{\2}\addcontentsline{toc}{chapter}{\2}")
