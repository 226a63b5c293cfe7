"""What users call: whole conversions of a section, each step an array expression within the row.

f(dialect, relation with doc_id and text, ...) gives the text of a query; no step shuffles, as a section is a row.
"""

from __future__ import annotations

from quillspark.functions import predicates as P
from quillspark.functions import rewrites as R
from quillspark.operators import relations as O


def steps(rel, keep, *columns):
    """Nested selections, each of which may use the columns of those before."""
    for k, (name, expression) in enumerate(columns):
        rel = f"SELECT {keep}, {expression} AS {name} FROM ({rel}) _s{k}" if k == 0 else f"SELECT *, {expression} AS {name} FROM ({rel}) _s{k}"
    return rel


def cut_runs(d, array, opens):
    """(starts, runs) of an array cut where opens(before, this) holds; runs refers to starts by the name _at."""
    flag = opens(d.at(array, "i - 1"), d.at(array, "i"))
    starts = d.keep(d.places(array), "i", f"i = 1 OR {flag}")
    runs = d.each(d.places("_at"), "k", d.part(array, d.at("_at", "k"), f"coalesce({d.at('_at', 'k + 1')}, {d.size(array)} + 1) - {d.at('_at', 'k')}"))
    return starts, runs


def behind(d, array, match):
    """The array without the matching elements at its start."""
    first = lambda a: d.at(d.keep(d.places(a), "i", f"NOT ({match(d.at(a, 'i'))})"), "1")
    # else Spark makes the array again for each of its elements
    return d.let(array, lambda a: d.part(a, f"coalesce({first(a)}, {d.size(a)} + 1)", d.size(a)))


def book_section(d, docs, title, heads=("RUNNING HEAD",), fixes=(("tbe", "the"),)):  # C2: pages between form feeds to a Markdown section
    """title: an expression over the row. Page furniture goes, paragraphs are joined within and across pages, garbage and an echoed title or preface go,
    fixes are applied before and behind the joining of broken paragraphs, and capitals become headings."""
    blank = lambda x: f"trim({x}) = ''"
    furniture = lambda x: f"({P.page_number(d, f'trim({x})')} OR {P.roman_heading(d, f'trim({x})')} OR {P.running_head(d, f'trim({x})', heads)} OR {P.garbage_line(d, x)})"
    lines = d.keep(d.split("text", "[\n\f]"), "l", f"{blank('l')} OR NOT {furniture('l')}")
    starts, runs = cut_runs(d, "_lines", lambda before, line: f"{blank(before)} OR {blank(line)} OR {d.like(line, '^ {3,}')}")
    joined = d.keep(d.each("_runs", "r", R.join_paragraph(d, R.join_lines(d, d.join(d.each("r", "l", "trim(l)"), "\n")))), "p", "p <> ''")
    # a page that ends within a sentence goes on, unless a heading stands there
    plain = lambda x: d.rep(f"lower(trim({x}))", r"\s+", " ")
    short = lambda x: d.rep(x, r"^(x{1,3}|ix|iv|v?i{1,3}|v|x)\.?\s*", "")
    echo = lambda x: f"{plain(x)} IN ({plain(title)}, {short(plain(title))})"
    preface = r"^(prefacio|introducci[oó]n|pr[oó]logo)"
    stray = lambda x: f"{d.like(f'lower(trim({x}))', preface + '[.]?$')} AND {d.like(f'lower({title})', preface[1:])}"
    repaired = lambda a: d.each(a, "p", R.fixes(d, "p", fixes))
    starts2, runs2 = cut_runs(d, "_clean", lambda before, text: O.opens_paragraph(d, before, text))
    glue = lambda r: f"replace({d.rep(d.join(r, chr(1)), '[-' + chr(173) + ']' + chr(1), '')}, {d.lit(chr(1))}, ' ')"
    promoted = d.each("_merged", "p", f"CASE WHEN {P.caps_heading(d, 'p')} THEN '## ' || {R.title_case(d, d.rep('trim(p)', '[.]+$', ''))} ELSE p END")
    rel = steps(docs, "doc_id, text", ("_lines", lines))
    for name, expression in (
        ("_at", starts), ("_runs", runs), ("_paras", joined), ("_own", behind(d, "_paras", echo)),
        ("_good", d.each(d.keep("_own", "p", f"NOT {P.garbage_paragraph(d, 'p')}"), "p", R.leading_number(d, "p"))), ("_clean", behind(d, repaired("_good"), stray)),
    ):
        rel = f"SELECT *, {expression} AS {name} FROM ({rel}) _r"
    rel = f"SELECT doc_id, text, _clean, {starts2} AS _at FROM ({rel}) _r"
    rel = f"SELECT doc_id, text, {repaired(d.each(runs2, 'r', glue('r')))} AS _merged FROM ({rel}) _r"
    return f"SELECT doc_id, '# ' || {title} || {d.lit(chr(10) * 2)} || {d.join(promoted, chr(10) * 2)} || {d.lit(chr(10))} AS md FROM ({rel}) _r"


def ocr_section(d, docs, title):  # C9: OCR pages to a section, its notes behind a line NOTES
    number = lambda x: P.ocr_page_number(d, x)
    lines = d.keep(d.split("text", "[\n\f]"), "l", f"NOT {number('l')}")
    cut = d.at(d.keep(d.places("_all"), "i", f"trim({d.at('_all', 'i')}) IN ('NOTES', 'Notes')"), "1")
    starts, runs = cut_runs(d, "_body", lambda before, line: f"trim({before}) = '' OR trim({line}) = ''")
    flow = d.keep(d.each("_runs", "r", R.chain(d, d.join(d.each("r", "l", "trim(l)"), "\n"), ("([A-Za-z])-\n", r"\1"), ("\n", " "))), "p", "p <> ''")
    started = lambda p: f"NOT ({P.ocr_heading(d, p)} OR {d.n(p, '[^ ]+')} >= 15)"
    shown = d.each(behind(d, "_paras", started), "p", f"CASE WHEN {P.ocr_heading(d, 'p')} THEN '## ' || p ELSE p END")
    note = r"^([0-9]{1,3})\.\s+(.*)$"
    starts_n, runs_n = cut_runs(d, "_notes", lambda before, line: d.like(line, r"^[0-9]{1,3}\.\s"))
    entry = R.chain(d, d.join(d.keep(d.each("r", "l", "trim(l)"), "l", "l <> ''"), "\n"), ("([A-Za-z])-\n", r"\1"), ("\n", " "), (note, r"[^\1]: \2"))
    rel = f"SELECT doc_id, text, {lines} AS _all FROM ({docs}) _r"
    rel = f"SELECT *, coalesce({cut}, {d.size('_all')} + 1) AS _cut FROM ({rel}) _r"
    rel = f"SELECT doc_id, text, {d.part('_all', '1', '_cut - 1')} AS _body, {d.part('_all', '_cut + 1', d.size('_all'))} AS _notes FROM ({rel}) _r"
    rel = f"SELECT *, {starts} AS _at FROM ({rel}) _r"
    rel = f"SELECT doc_id, text, _notes, {runs} AS _runs FROM ({rel}) _r"
    rel = f"SELECT doc_id, text, _notes, {flow} AS _paras, {starts_n} AS _at FROM ({rel}) _r"
    rel = f"SELECT doc_id, text, {d.join(shown, chr(10) * 2)} AS _md, {d.join(d.keep(d.each(runs_n, 'r', entry), 'e', d.like('e', '^' + chr(92) + '[' + chr(92) + '^')), chr(10))} AS _foot FROM ({rel}) _r"
    return f"SELECT doc_id, '# ' || {title} || {d.lit(chr(10) * 2)} || _md || CASE WHEN _foot = '' THEN '' ELSE {d.lit(chr(10) * 2 + '## Notes' + chr(10) * 2)} || _foot END || {d.lit(chr(10))} AS md FROM ({rel}) _r"


def docling_section(d, docs, title=None):  # C10: what a layout converter leaves, and rows of empty cells
    text = R.chain(d, R.docling(d, "text"), (r"(?m)^[ \t]*\|( ?\|)?[ \t]*(\n|\z)", ""))
    if title is None:
        return f"SELECT doc_id, {text} AS md FROM ({docs}) _d"
    # the first heading gives way to the title
    head = r"(?m)^#+[ \t]+[\p{L}\p{N}_][^\n]*\n"
    def rest(text, found):
        place = f"{'instr' if d.name == 'spark' else 'strpos'}({text}, {found})"
        return f"CASE WHEN {found} = '' THEN {text} ELSE substr({text}, 1, {place} - 1) || substr({text}, {place} + length({found})) END"

    whole = f"SELECT doc_id, {text} AS text FROM ({docs}) _d"
    cut = d.let(d.ext("text", head, 0), lambda found: rest("text", found))
    return f"SELECT doc_id, {title} || {d.lit(chr(10) * 2)} || {d.rep(cut, '^' + chr(92) + 'n+', '')} AS md FROM ({whole}) _e"


def translation_findings(d, pairs, glossary=()):  # G11: pairs with doc_id, o and t, the texts of the original and the translation
    """doc_id, kind: what the translation lacks, has too much of or has broken."""
    local = d.name == "spark"
    none = "CAST(array() AS ARRAY<STRING>)"
    where = lambda x, mark, found, other=none: f"CASE WHEN contains({x}, {d.lit(mark)}) THEN {found} ELSE {other} END" if local else found  # noqa: E731 - a text without the mark isn't searched
    bare = lambda x: where(x, "```", d.rep(x, r"(?ms)^[ \t]*```.*?(^[ \t]*```[^\n]*$|\z)", ""), x)
    # what follows a mark or stands before a link isn't taken with it, as marks and links may touch
    refs = lambda x: where(x, "[^", d.uniq(d.each(d.keep(d.all(x, r"\[\^[^\]]+\]:?", 0), "m", "m NOT LIKE '%:'"), "m", "substring(m, 3, length(m) - 3)")))
    defs = lambda x: where(x, "]:", d.uniq(d.all(x, r"(?m)^\[\^([^\]]+)\]:", 1)))
    heads = lambda x: where(x, "#", d.all(x, r"(?m)^(#{1,6})[ \t]", 1))
    target = "substring(m, instr(m, '](') + 2, length(m) - instr(m, '](') - 2)"
    links = lambda x: where(x, "](", d.sort(d.each(d.keep(d.all(x, r"!?\[[^\]]*\]\([^)]*\)", 0), "m", "m NOT LIKE '!%'"), "m", target)))
    images = lambda x: where(x, "](", d.sort(d.all(x, r"!\[[^\]]*\]\(([^)]*)\)", 1)))
    # words as marks put in their place, quicker than an array of them; spaces go from a paragraph that has them at its ends
    words = lambda x: d.let(d.rep(x, r"\S+", "x"), lambda v: f"length({v}) - length(replace({v}, 'x', ''))") if local else d.n(x, r"[^\s]+")
    fences = lambda x: where(x, "```", d.n(x, r"(?m)^[ \t]*```"), "0")
    ends = lambda p: f"CASE WHEN {d.like(f'substr({p}, 1, 1)', chr(92) + 's')} OR {d.like(f'substr({p}, -1)', chr(92) + 's')} THEN {d.strip(p)} ELSE {p} END" if local else d.strip(p)
    paras = lambda x: d.keep(d.each(d.split(x, r"\n[ \t]*\n"), "p", ends("p")), "p", "p <> ''")
    numbers = lambda x: d.all(x, "[0-9]+")
    named = {"refs": refs, "defs": defs, "heads": heads, "links": links, "images": images, "words": words, "paras": paras, "numbers": numbers}
    base = f"SELECT doc_id, o, t, {bare('o')} AS bo, {bare('t')} AS bt FROM ({pairs}) _p"
    base = f"SELECT doc_id, o, t, bt, {', '.join(f'{f(b)} AS {k}_{s}' for k, f in named.items() for s, b in (('o', 'bo'), ('t', 'bt')))} FROM ({base}) _q"
    lacks = lambda a, b: f"size(array_except({a}, {b})) > 0" if local else d.some(a, "v", f"NOT {d.has(b, 'v')}")
    times = lambda a: d.size(d.keep(a, "w", "w = v"))
    kinds = {
        "refs_missing": lacks("refs_o", "refs_t"), "refs_extra": lacks("refs_t", "refs_o"), "refs_without_note": lacks("refs_t", "defs_t"), "notes_without_ref": lacks("defs_t", "refs_t"),
        "short": "words_t < 0.85 * greatest(1, words_o)", "long": "words_t > 1.30 * greatest(1, words_o)",
        "heading_count": f"{d.size('heads_o')} <> {d.size('heads_t')}", "heading_levels": f"{d.size('heads_o')} = {d.size('heads_t')} AND {d.join('heads_o', ' ')} <> {d.join('heads_t', ' ')}",
        "links": f"{d.join('links_o', ' ')} <> {d.join('links_t', ' ')}", "images": f"{d.join('images_o', ' ')} <> {d.join('images_t', ' ')}", "fences": f"floor({fences('o')} / 2) <> floor({fences('t')} / 2)",
        "left_as_it_was": d.some("paras_t", "v", f"length(v) > 40 AND NOT {d.like('v', '^#{1,6}[ ]')} AND {d.has('paras_o', 'v')}"),
        "numbers_lost": d.some(d.uniq("numbers_o"), "v", f"{times('numbers_o')} > {times('numbers_t')}"),
    }
    if local:  # sets meet by their hashes; numbers are counted where they differ
        kinds["left_as_it_was"] = f"arrays_overlap({d.keep('paras_t', 'v', 'length(v) > 40 AND NOT ' + d.like('v', '^#{1,6}[ ]'))}, paras_o)"
        kinds["numbers_lost"] = f"sort_array(numbers_o) <> sort_array(numbers_t) AND {kinds['numbers_lost']}"
    wordy = r"[^\p{L}\p{N}_]"
    if glossary and local:
        leak = lambda v, g: (f"contains({v}, {d.lit(g)}) AND " if g.isalnum() else "") + d.like(v, f"(^|{wordy}){g}({wordy}|$)")
        kinds["glossary_leak"] = d.let("lower(bt)", lambda v: "(" + " OR ".join(leak(v, g) for g in glossary) + ")")
    elif glossary:
        kinds["glossary_leak"] = "(" + " OR ".join(d.like("lower(bt)", f"(^|{wordy}){g}({wordy}|$)") for g in glossary) + ")"
    listed = d.keep(d.array(*(f"CASE WHEN {v} THEN '{k}' END" for k, v in kinds.items())), "k", "k IS NOT NULL")
    if d.name == "spark":  # a column of the kinds would be filtered for what it holds, and all of it built again below the projections for that
        return f"SELECT doc_id, kind FROM ({base}) _b LATERAL VIEW explode({listed}) _k AS kind"
    return f"SELECT doc_id, kind FROM ({d.rows(f'SELECT doc_id, {listed} AS _k FROM ({base}) _b', '_k', 'pos', 'kind')}) _e"


def clean_chapters(d, docs, fixes):  # C1: ligatures by a map of tokens, diacritics, openings
    """fixes: w and fixed, the tokens whose capitals stand for ligatures and what they are, as a join with a dictionary finds them."""
    toks = d.rows(docs, d.uniq(d.all("text", R.CAPITALS if d.name == "spark" else "[A-Za-z]+")), "pos", "w")
    pair = d.struct_named(("w", "f.w"), ("fixed", "f.fixed"))
    own = f"SELECT k.doc_id, {d.listed(pair)} AS _f FROM (SELECT doc_id, w FROM ({toks}) _t WHERE {d.like('w', '[VWXYZ]')}) k JOIN ({fixes}) f ON k.w = f.w GROUP BY k.doc_id"
    word = lambda w: f"'(^|[^A-Za-z])' || {w} || '([^A-Za-z]|$)'"
    if d.name == "spark":
        done = "aggregate(coalesce(_f, array()), text, (t, f) -> regexp_replace(t, concat('(?<![A-Za-z])', f.w, '(?![A-Za-z])'), f.fixed))"
    else:
        once = lambda t: f"regexp_replace({t}, {word('f.w')}, chr(92) || '1' || f.fixed || chr(92) || '2', 'g')"
        done = f"list_reduce(list_prepend({d.struct_named(('w', 'text'), ('fixed', chr(39) * 2))}, coalesce(_f, [])), lambda a, f: {d.struct_named(('w', once(once('a.w'))), ('fixed', chr(39) * 2))}).w"
    whole = f"SELECT doc_id, {done} AS text FROM (SELECT b.doc_id, b.text, _f FROM ({docs}) b LEFT JOIN ({own}) o ON b.doc_id = o.doc_id) _j"
    return O.openings(d, f"SELECT doc_id, {R.diacritics(d, 'text')} AS text FROM ({whole}) _k")
