"""Ordered and relational operators as SQL: f(dialect, relation, ...) gives the text of a query.

Order is always a column; every window is partitioned by document, so nothing spans the table but
what is global by meaning (frequencies, search statistics, citation keys).
"""

from __future__ import annotations

from quillspark.functions import predicates as P
from quillspark.functions import rewrites as R


def lines(d, rel, text="text"):  # D5
    return d.rows(rel, d.split(text, "\n"), "line_no", "line")


def pages(d, rel, text="text", drop_last=True):  # S2, S13
    parts = d.split(text, "\f")
    out = d.rows(rel, parts, "pos", "page")
    cut = f" WHERE NOT (pos + 1 = n_pages AND trim(page) = '' AND {'true' if drop_last else 'false'})"
    return f"SELECT doc_id, pos + 1 AS page_no, page FROM (SELECT *, max(pos) OVER (PARTITION BY doc_id) + 1 AS n_pages FROM ({out}) _p) _q{cut}"


def page_range(d, pages_, first, last):  # S3, J3
    return f"SELECT * FROM ({pages_}) _p WHERE page_no BETWEEN {first} AND {last}"


def outside(text):
    """Spark: the lines outside code fences as array<struct<no, line>>, within the row. A text splits at its fences into parts of which every other is outside."""
    parts = f"split({text}, '(?md)^[ \\\\t]*```[^\\n]*$', -1)"
    before = "aggregate(slice(_p, 1, k), 0, (n, q) -> n + length(q) - length(replace(q, '\\n', '')))"
    own = f"""transform(filter(sequence(0, size(_p) - 1), k -> k % 2 = 0), k -> named_struct('from', {before}, 'cut', split(_p[k], '\\n', -1), 'head', CASE WHEN k = 0 THEN 0 ELSE 1 END, 'tail', CASE WHEN k = size(_p) - 1 THEN 0 ELSE 1 END))"""
    rows = "flatten(transform(_own, g -> transform(slice(g.cut, 1 + g.head, greatest(size(g.cut) - g.head - g.tail, 0)), (l, i) -> named_struct('no', g.from + g.head + i, 'line', l))))"
    return parts, own, rows


def outside_lines(docs):
    """Spark: doc_id and _o, its lines outside fences; no shuffle, as a document is a row."""
    parts, own, rows = outside("text")
    return f"SELECT doc_id, {rows} AS _o FROM (SELECT doc_id, {own} AS _own FROM (SELECT doc_id, {parts} AS _p FROM ({docs}) _d) _e) _f"


def each_row(rel, array, pos, *fields):
    """Spark: one row for each element of an array of structs."""
    named = ", ".join(f"_z.{f} AS {f}" for f in fields)
    return f"SELECT doc_id, {pos}, {named} FROM ({rel}) _r LATERAL VIEW posexplode({array}) _e AS {pos}, _z"


def without_head(d, lines_):  # S4: the first line that isn't blank goes
    return f"""SELECT doc_id, line_no, line FROM (SELECT *, min(CASE WHEN trim(line) <> '' THEN line_no END) OVER (PARTITION BY doc_id) AS head FROM ({lines_}) _l) _m
      WHERE line_no <> coalesce(head, -1)"""


def islands(d, lines_, breaks, sep=" ", keep="trim(line) <> ''", unit="para_no"):  # D6, W1, W4
    """Runs of lines between breaks, joined in order."""
    return f"""SELECT doc_id, {unit}, min(line_no) AS first_line, {d.gather('trim(line)', 'line_no', sep)} AS text FROM (
      SELECT *, sum(CASE WHEN {breaks} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS {unit} FROM ({lines_}) _l) _m
      WHERE {keep} GROUP BY doc_id, {unit}"""


def paragraphs(d, lines_):  # D6, numbered from 0
    return f"SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY first_line) - 1 AS INT) AS para_no, first_line, text FROM ({islands(d, lines_, 'trim(line) = ' + chr(39) * 2, chr(10))}) _i"


# == the same within the row: Spark alone, no shuffle, as a document is a row ==


def _paragraph_array(lines_, blank, join):
    """Runs of lines that aren't blank as array<struct<first_line, text>>."""
    first = f"filter(sequence(0, size({lines_}) - 1), i -> NOT {blank(f'{lines_}[i]')} AND (i = 0 OR {blank(f'{lines_}[i - 1]')}))"
    last = f"filter(sequence(0, size({lines_}) - 1), i -> NOT {blank(f'{lines_}[i]')} AND (i = size({lines_}) - 1 OR {blank(f'{lines_}[i + 1]')}))"
    return f"zip_with({first}, {last}, (a, z) -> named_struct('first_line', a, 'text', array_join(transform(slice({lines_}, a + 1, z - a + 1), x -> trim(x)), '{join}')))"


def local_paragraphs(docs):  # D6
    rows = f"SELECT doc_id, split(text, '\\n', -1) AS _l FROM ({docs}) _d"
    return each_row(rows, _paragraph_array("_l", lambda x: f"trim({x}) = ''", "\\n"), "para_no", "first_line", "text")


def _runs(array, breaks):
    """The array cut where breaks(i) holds."""
    starts = f"filter(slice(sequence(0, size({array})), 1, size({array})), i -> i = 0 OR {breaks})"
    return starts, f"transform(_s, (a, k) -> slice({array}, a + 1, coalesce(try_element_at(_s, k + 2), size({array})) - a))"


def local_merged(docs):  # W3
    from quillspark.plans.dialect import SPARK as d

    # no filter on the paragraphs: Spark would build them a second time for it, below the projections
    own = "array_join(filter(transform(split(b, '\\n', -1), x -> trim(x)), x -> x <> ''), '\\n')"
    paras = f"SELECT doc_id, filter(transform(split(text, '\\n *(?=\\n|\\\\z)', -1), b -> {own}), b -> b <> '') AS _p FROM ({docs}) _d"
    starts, groups = _runs("_p", opens_paragraph(d, "_p[i - 1]", "_p[i]"))
    joined = f"transform({groups}, g -> named_struct('text', {merged_text(d, 'g')}, 'n_parts', CAST(size(g) AS BIGINT)))"
    return each_row(f"SELECT doc_id, _p, {starts} AS _s FROM ({paras}) _f", joined, "grp", "text", "n_parts")


def local_passages(docs):  # W7: a heading holds for what follows up to the next
    heads = "regexp_extract_all(text, '(?md)^#+ [^\\n]*$', 0)"
    texts = "filter(transform(split(p, '\\n[ ]*(?=\\n|$)', -1), b -> array_join(filter(transform(split(b, '\\n', -1), x -> trim(x)), x -> x <> ''), ' ')), b -> b <> '')"
    rows = f"SELECT doc_id, {heads} AS _h, split(text, '(?md)^#+ [^\\n]*$', -1) AS _p FROM ({docs}) _d"
    array = f"flatten(transform(_p, (p, k) -> transform({texts}, b -> named_struct('heading', CASE WHEN k > 0 THEN regexp_replace(_h[k - 1], '^#+ +', '') END, 'body', b))))"
    return f"SELECT doc_id, _i + 1 AS passage_no, heading, body FROM ({each_row(rows, array, '_i', 'heading', 'body')}) _q"


def local_split(docs, level=2):  # W8
    mark = f"(?md)^{'#' * level} [^\\n]*$"
    rows = f"SELECT doc_id, regexp_extract_all(text, '{mark}', 0) AS _h, split(text, '{mark}', -1) AS _p FROM ({docs}) _d"
    # what is left of the heading's own line, and the line break before the next, go
    body = "regexp_replace(CASE WHEN k > 0 THEN substr(p, 2) ELSE p END, CASE WHEN k < size(_p) - 1 THEN '\\n\\\\z' ELSE '(?!)' END, '')"
    array = f"filter(transform(_p, (p, k) -> named_struct('title', CASE WHEN k > 0 THEN regexp_replace(_h[k - 1], '^#+ +', '') ELSE 'front' END, 'body', {body})), z -> trim(z.body) <> '')"
    return f"SELECT doc_id, _i + 1 AS seq, title, body FROM ({each_row(rows, array, '_i', 'title', 'body')}) _q"


def local_fences(docs):  # W27
    return f"SELECT doc_id, line_no, line FROM ({each_row(outside_lines(docs), 'transform(_o, o -> named_struct(' + chr(39) + 'line_no' + chr(39) + ', o.no, ' + chr(39) + 'line' + chr(39) + ', o.line))', '_i', 'line_no', 'line')}) _q"


def page_paragraphs(d, lines_):  # W1: furniture goes, an indent opens a paragraph too
    good = f"NOT {P.page_number(d, 'line')} AND NOT {P.garbage_line(d, 'line')}"
    kept = f"SELECT * FROM ({lines_}) _k WHERE trim(line) = '' OR ({good})"
    return f"SELECT doc_id, para_no, first_line, {R.join_lines(d, 'text')} AS text FROM ({islands(d, kept, 'trim(line) = ' + chr(39) * 2 + ' OR ' + d.like('line', '^ {3,}'), chr(10))}) _p"


def reflow(d, lines_):  # W4
    joined = islands(d, lines_, "trim(line) = ''", "\n")
    text = R.chain(d, "text", (r"(\p{L})-\n", r"\1"), (r"\n", " "))
    return f"SELECT doc_id, para_no, {text} AS text FROM ({joined}) _p"


def opens_paragraph(d, before, text):  # W3: what doesn't go on the paragraph before; a heading is gone on from by nothing
    ends = d.like(before, "[.!?”»…)\\x27\"]$")
    hyphen = d.like(before, "[-\u00ad]$")
    return f"NOT ({d.like(text, '^' + chr(92) + 'p{Ll}')} AND NOT {P.caps_heading(d, before)} AND ({hyphen} OR NOT {ends}))"


def merged_text(d, array):
    """Spark: the parts of a paragraph; behind a hyphen without it or a space."""
    return f"regexp_replace(regexp_replace(array_join({array}, '\\u0001'), '[-\\u00ad]\\u0001', ''), '\\u0001', ' ')"


def merged(d, paras):  # W3: a sentence that goes on joins its paragraph
    flag = f"CASE WHEN before IS NULL OR {opens_paragraph(d, 'before', 'text')} THEN 1 ELSE 0 END"
    joined = d.gather("text", "para_no", "\x01")
    return f"""SELECT doc_id, CAST(grp - 1 AS INT) AS grp, replace({d.rep(joined, '[-\u00ad]\x01', '')}, {d.lit(chr(1))}, ' ') AS text, count(*) AS n_parts FROM (
      SELECT *, sum({flag}) OVER (PARTITION BY doc_id ORDER BY para_no ROWS UNBOUNDED PRECEDING) AS grp FROM (
        SELECT *, lag(text) OVER (PARTITION BY doc_id ORDER BY para_no) AS before FROM ({paras}) _a) _b) _c GROUP BY doc_id, grp"""


def passages(d, lines_):  # W7
    head = f"CASE WHEN {d.like('line', '^#+ ')} THEN {d.rep('line', '^#+ +', '')} END"
    marked = f"SELECT *, {d.last('h')} OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS heading, sum(CASE WHEN trim(line) = '' OR h IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS grp FROM (SELECT *, {head} AS h FROM ({lines_}) _l) _m"
    return f"""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY first_line) AS passage_no, heading, body FROM (
      SELECT doc_id, grp, min(line_no) AS first_line, max(heading) AS heading, {d.gather('trim(line)', 'line_no', ' ')} AS body FROM ({marked}) _n WHERE trim(line) <> '' AND h IS NULL GROUP BY doc_id, grp) _o"""


def split_headings(d, lines_, level=2):  # W8: chunks numbered after the empty ones are gone
    mark = d.like("line", "^" + "#" * level + " ")
    return f"""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY chunk) AS seq, title, body FROM (
      SELECT doc_id, chunk, coalesce(max(CASE WHEN is_head THEN {d.rep('line', '^#+ +', '')} END), 'front') AS title, {d.gather('CASE WHEN is_head THEN NULL ELSE line END' if d.name == 'duckdb' else 'CASE WHEN is_head THEN NULL ELSE line END', 'line_no', chr(10))} AS body FROM (
        SELECT *, sum(CASE WHEN is_head THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS chunk FROM (SELECT *, {mark} AS is_head FROM ({lines_}) _l) _m) _n
      GROUP BY doc_id, chunk) _o WHERE trim(coalesce(body, '')) <> ''"""


def plan_starts(d, lines_, plan):  # W9, J15: first exact heading of each planned section, its end, and whether the plan is in order
    return f"""SELECT doc_id, pos, title, start_line, lead(start_line) OVER (PARTITION BY doc_id ORDER BY pos) AS end_line,
      coalesce(start_line <= lead(start_line) OVER (PARTITION BY doc_id ORDER BY pos), true) AS in_order FROM (
      SELECT l.doc_id, p.pos, p.title, min(l.line_no) AS start_line FROM ({lines_}) l JOIN ({plan}) p ON l.line = p.heading GROUP BY l.doc_id, p.pos, p.title) _s"""


def sections_by_number(d, lines_):  # W10: a lone number, then a line of capitals
    solid = f"SELECT doc_id, line_no, trim(line) AS line, lead(trim(line)) OVER (PARTITION BY doc_id ORDER BY line_no) AS following FROM ({lines_}) _l WHERE trim(line) <> ''"
    title = R.title_case(d, "following")
    return f"""SELECT doc_id, line_no, {d.num('line')} AS n, line || '. ' || {title} AS title, lead(line_no) OVER (PARTITION BY doc_id ORDER BY line_no) AS next_line FROM ({solid}) _s
      WHERE {d.like('line', '^[0-9]{1,3}$')} AND {P.caps_heading(d, 'following')}"""


def rtf_body(d, lines_):  # W11: a tab among the first six characters opens a paragraph
    return islands(d, lines_, d.like("line", r"^.{0,5}\t"), " ")


def note_pool(d, lines_):  # W12: groups begin where the number is 1 again
    n = f"CASE WHEN {d.like('trim(line)', r'^\[[0-9]{1,3}\]$')} THEN {d.num(d.ext('line', '([0-9]{1,3})', 1))} END"
    return f"""SELECT doc_id, grp, n, {d.rep(d.gather('trim(line)', 'line_no', ' '), r'\s*<<\s*', '')} AS body FROM (
      SELECT *, {d.last('m')} OVER w AS n, sum(CASE WHEN m = 1 THEN 1 ELSE 0 END) OVER w AS grp, count(m) OVER w AS k FROM (SELECT *, {n} AS m FROM ({lines_}) _l) _m
      WINDOW w AS (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING)) _n
      WHERE n IS NOT NULL AND m IS NULL AND trim(line) <> '' GROUP BY doc_id, grp, k, n"""


def foot_zone(d, lines_):  # W13: notes stand behind the last blank line that a numbered line follows
    after = "lead(line) OVER (PARTITION BY doc_id ORDER BY line_no)"
    note = f"CASE WHEN {d.like('line', '^[0-9]{1,3}[ ]+[^ ]')} AND {d.num(d.ext('line', '^([0-9]{1,3})', 1))} <= 200 THEN {d.num(d.ext('line', '^([0-9]{1,3})', 1))} END"
    zone = f"SELECT *, max(CASE WHEN trim(line) = '' AND {d.like('following', '^[0-9]{1,3}[ ]+[^ ]')} THEN line_no END) OVER (PARTITION BY doc_id) AS zone FROM (SELECT *, {after} AS following FROM ({lines_}) _l) _m"
    return f"""SELECT doc_id, n, row_number() OVER (PARTITION BY doc_id ORDER BY first_line) AS global_no, body FROM (
      SELECT doc_id, k, max(n) AS n, min(line_no) AS first_line, {d.rep(d.gather('trim(line)', 'line_no', ' '), '^[0-9]{1,3}[ ]+', '')} AS body FROM (
        SELECT *, count(n) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS k FROM (SELECT *, {note} AS n FROM ({zone}) _z WHERE line_no > zone) _y) _x
      WHERE k > 0 AND trim(line) <> '' GROUP BY doc_id, k) _w"""


def end_notes(d, lines_):  # W14
    n = f"CASE WHEN {d.like('line', '^[0-9]{1,3}[.] +')} THEN {d.num(d.ext('line', '^([0-9]{1,3})[.]', 1))} END"
    tail = f"SELECT *, {n} AS m FROM (SELECT *, min(CASE WHEN trim(line) IN ('NOTES', 'NOTAS') THEN line_no END) OVER (PARTITION BY doc_id) AS z FROM ({lines_}) _l) _m WHERE line_no > z"
    return f"""SELECT doc_id, n, {d.rep(d.gather('trim(line)', 'line_no', ' '), '^[0-9]{1,3}[.] +', '')} AS body FROM (
      SELECT *, {d.last('m')} OVER w AS n, count(m) OVER w AS k FROM ({tail}) _t WINDOW w AS (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING)) _u
      WHERE k > 0 AND trim(line) <> '' GROUP BY doc_id, k, n"""


def body_start(d, paras):  # W15: from the first heading or paragraph of 15 words
    return f"SELECT doc_id, para_no, text FROM (SELECT *, min(CASE WHEN {P.ocr_heading(d, 'text')} OR {d.n('text', '[^ ]+')} >= 15 THEN para_no END) OVER (PARTITION BY doc_id) AS s FROM ({paras}) _p) _q WHERE para_no >= s"


def note_definitions(d, lines_):  # W16, definitions and blocks
    n = f"{d.num(d.ext('line', '^([0-9]{1,3})[.] ', 1))}"
    return f"""SELECT doc_id, line_no, n, 1 + sum(CASE WHEN n <= before THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS block FROM (
      SELECT *, lag(n) OVER (PARTITION BY doc_id ORDER BY line_no) AS before FROM (SELECT doc_id, line_no, {n} AS n FROM ({lines_}) _l WHERE {d.like('line', '^[0-9]{1,3}[.] [^ ]')}) _m) _n"""


def merge_split_definitions(d, lines_):  # W31: a lone number takes the next line that isn't blank
    solid = f"SELECT doc_id, line_no, trim(line) AS line, lead(trim(line)) OVER w AS following, lag({d.like('trim(line)', '^[0-9]{1,3}[.]?$')}) OVER w AS used FROM ({lines_}) _l WHERE trim(line) <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)"
    return f"SELECT doc_id, line_no, CASE WHEN {d.like('line', '^[0-9]{1,3}[.]?$')} AND following IS NOT NULL THEN {d.rep('line', '[.]$', '')} || '. ' || following ELSE line END AS line FROM ({solid}) _s WHERE NOT coalesce(used, false)"


def consecutive_cues(d, cues):  # W18, without overlap: drop repeats of the cue before
    return f"SELECT doc_id, line_no, line FROM (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS before FROM ({cues}) _c) _d WHERE before IS NULL OR line <> before"


def fences(d, lines_):  # W27: lines outside code fences; outside_lines does the same within the row
    return f"SELECT doc_id, line_no, line FROM (SELECT *, {d.like('line', '^ *```')} AS fence, sum(CASE WHEN {d.like('line', '^ *```')} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS k FROM ({lines_}) _l) _m WHERE k % 2 = 0 AND NOT fence"


def context(d, lines_, hit, n=1):  # W28: hits with the lines around them
    return f"""SELECT doc_id, line_no, line FROM (SELECT *, max(CASE WHEN {hit} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN {n} PRECEDING AND {n} FOLLOWING) AS near FROM ({lines_}) _l) _m WHERE near = 1"""


def leading_run(d, paras, match):  # R18, R19: matching paragraphs at the start go
    return f"SELECT doc_id, para_no, text FROM (SELECT *, min(CASE WHEN NOT ({match}) THEN para_no END) OVER (PARTITION BY doc_id) AS s FROM ({paras}) _p) _q WHERE para_no >= s"


def openings(d, docs):  # R23: debris between the title and a split capital goes, unless prose comes first; an orphaned first line is joined
    head = d.ext("text", r"\A(#[^\n]*)", 1)
    debris = r"(?ms)\A#[^\n]*\n(.*?)^[A-Z] [a-z]"
    between = d.ext("text", debris, 1)
    found = f"({d.like('text', debris)} AND NOT {d.like(between, '[a-zàáéíóúüñ]{4}')})"
    cut = f"SELECT doc_id, text, {found} AS found, {head} AS head, {d.rep(f'substr(text, length({head}) + 2 + length({between}))', r'^([A-Z]) ', r'{}1'.format(chr(92)))} AS rest FROM ({docs}) _d"
    first = d.ext("rest", r"(?s)\A(.*?)\n\n", 1)
    joined = f"CASE WHEN {d.like(first, r'[a-z,]{}s*$'.format(chr(92)))} THEN {d.rep(first, r'{}s+$'.format(chr(92)), '')} || ' ' || {d.rep(f'substr(rest, length({first}) + 3)', r'^{}s+'.format(chr(92)), '')} ELSE rest END"
    return f"SELECT doc_id, CASE WHEN found THEN head || {d.lit(chr(10) * 2)} || {joined} ELSE text END AS text FROM ({cut}) _c"


def page_runs(d, numbers):  # R37: 5,6,7,12 to 5-7, 12
    return f"""SELECT doc_id, {d.gather("CASE WHEN a = b THEN CAST(a AS " + ('STRING' if d.name == 'spark' else 'VARCHAR') + ") ELSE a || '-' || b END", 'a', ', ')} AS runs FROM (
      SELECT doc_id, min(n) AS a, max(n) AS b FROM (SELECT doc_id, n, n - row_number() OVER (PARTITION BY doc_id ORDER BY n) AS g FROM ({numbers}) _n) _m GROUP BY doc_id, g) _o GROUP BY doc_id"""


def word_map(d, docs):  # G1
    return f"""SELECT doc_id, {R.first_title(d, 'text')} AS title, {d.n('text', '[^ ' + chr(92) + 't' + chr(92) + 'n' + chr(92) + 'r' + chr(92) + 'f]+')} AS words, {d.n('text', '(?m)^#+ ')} AS headings,
      {d.n('text', r'(^|[^\]])\[\^[^\]]+\]([^:]|$)')} AS note_refs FROM ({docs}) _d"""


def word_counts(d, docs, kind="ascii"):  # G2
    return f"SELECT word, count(*) AS n FROM ({d.rows(docs, R.tokens(d, 'text', kind), 'pos', 'word')}) _w GROUP BY word"


def fts_tokens(d, passages_):
    return d.rows(f"SELECT doc_id, passage_no, body FROM ({passages_}) _p WHERE length(body) > 15", d.all(d.fold("body"), r"[\p{L}\p{N}]+"), "pos", "term")


def fts_postings(d, passages_):  # Q1
    toks = fts_tokens(d, passages_)
    return f"SELECT doc_id, passage_no, term, count(*) AS tf FROM ({toks}) _t GROUP BY doc_id, passage_no, term"


def local_postings(docs):  # Q1
    """Spark: the terms of a passage, sorted and counted by runs within the row. Rows of one doc_id add up, as in SQL; a table without such rows needs no shuffle."""
    from quillspark.plans.dialect import SPARK as d

    def counted(docs_):
        toks = d.all(d.fold("body"), r"[\p{L}\p{N}]+")
        rel = f"SELECT doc_id, passage_no, sort_array({toks}) AS _s FROM ({local_passages(docs_)}) _p WHERE length(body) > 15"
        rel = f"SELECT *, filter(slice(sequence(0, size(_s)), 1, size(_s)), i -> i = 0 OR _s[i] <> _s[i - 1]) AS _a FROM ({rel}) _q"
        runs = "transform(_a, (a, k) -> named_struct('term', _s[a], 'tf', CAST(coalesce(try_element_at(_a, k + 2), size(_s)) - a AS BIGINT)))"
        return f"SELECT doc_id, passage_no, _z.term AS term, _z.tf AS tf FROM ({rel}) _r LATERAL VIEW explode({runs}) _e AS _z"

    again = f"(SELECT count(*) > count(DISTINCT doc_id) FROM ({docs}) _n)"
    own, all_ = (f"SELECT * FROM ({docs}) _c WHERE {sign}{again}" for sign in ("NOT ", ""))
    return f"{counted(own)} UNION ALL SELECT doc_id, passage_no, term, sum(tf) AS tf FROM ({counted(all_)}) _t GROUP BY doc_id, passage_no, term"


def bm25(d, postings, terms):  # Q2: the postings once; of the corpus, two numbers and a frequency for each term asked for
    listed = ", ".join(d.lit(t) for t in terms)
    idf = "ln((n - df + 0.5) / (df + 0.5))"
    score = f"round(-sum(CASE WHEN {idf} <= 0 THEN 1e-6 ELSE {idf} END * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 8)"
    if d.name == "duckdb":
        return f"""WITH _p AS MATERIALIZED ({postings}) SELECT t.doc_id, t.passage_no, {score} AS score FROM _p t
          JOIN (SELECT term, count(*) AS df FROM _p GROUP BY term) f ON t.term = f.term
          JOIN (SELECT doc_id, passage_no, sum(tf) AS dl FROM _p GROUP BY doc_id, passage_no) l ON t.doc_id = l.doc_id AND t.passage_no = l.passage_no
          CROSS JOIN (SELECT count(*) AS n, avg(dl) AS avgdl FROM (SELECT sum(tf) AS dl FROM _p GROUP BY doc_id, passage_no) _e) g
          WHERE t.term IN ({listed}) GROUP BY t.doc_id, t.passage_no"""
    # one row a passage: its length and the counts of the terms asked for
    counts = ", ".join(f"count_if(term = {d.lit(t)}) AS _t{k}" for k, t in enumerate(terms))
    sums = ", ".join(f"count_if(_t{k} > 0) AS _d{k}" for k in range(len(terms)))
    tf = ", ".join(f"named_struct('tf', _t{k}, 'df', _d{k})" for k in range(len(terms)))
    own = f"SELECT doc_id, passage_no, count(*) AS dl, {counts} FROM ({postings}) _q GROUP BY doc_id, passage_no"
    each = f"SELECT doc_id, passage_no, dl, n, avgdl, x.tf AS tf, x.df AS df FROM _h LATERAL VIEW explode(filter(array({tf}), z -> z.tf > 0)) _x AS x"
    return f"""WITH _own AS ({own}), _h AS (SELECT * FROM _own CROSS JOIN (SELECT /*+ BROADCAST(_g) */ count(*) AS n, avg(dl) AS avgdl, {sums} FROM _own) _g WHERE {' + '.join(f'_t{k}' for k in range(len(terms)))} > 0)
      SELECT doc_id, passage_no, {score} AS score FROM ({each}) _e GROUP BY doc_id, passage_no"""


def _artifact_kinds(d, s, following):
    listed = "[#|]|[*][*]|> |\\[\\^|[*]|- "
    glued = r"(?:[.’—\]] |(?:^|[^a-z ()\x27,-])[ ()\x27,-]*\x27 )[a-z][-a-z ()\x27,]{2,40}:\s+[a-zāēīōūáéíóú]"
    return {
        "garbage": P.garbage_block(d, s), "dash": d.like(s, "^- [a-z]"), "pagenum": d.like(s, r"^(1[0-9]{1,2}|[1-9][0-9]?) [a-z]"),
        "bracket": f"({d.like(s, r'(^|\s)[()\[\]]$')} AND NOT {d.like(s, '^[#|]')})",
        "stray": f"({d.like(s, r'[!?.”\"\x27]\s+[()\[\]]?\s?[A-Z][a-z]?$')} AND {d.like(s, r'(^|\s)[^\s]{1,3}$')})",
        "glued": f"({d.like(s, glued[glued.rindex(':') :])} AND {d.like(s, glued)})" if d.name == "spark" else d.like(s, glued),  # most blocks have no such colon
        "split": f"(NOT {d.like(s, f'^({listed})')} AND NOT {d.like(s, r'[.?!:;\"”)\]]$')} AND {d.like(following, '^' + chr(92) + 'p{Ll}')})",
    }


def artifacts(d, docs):  # P18, G6: kinds of each block; blocks are what an empty line parts
    if d.name == "spark":
        block = "named_struct('s', regexp_replace(b, '^\\\\s+|\\\\s+$', ''), 'following', regexp_replace(coalesce(try_element_at(_b, i + 2), ''), '^\\\\s+|\\\\s+$', ''))"
        rows = each_row(f"SELECT doc_id, split(text, '\\n\\n', -1) AS _b FROM ({docs}) _d", f"transform(_b, (b, i) -> {block})", "block_no", "s", "following")
        found = ", ".join(f"CASE WHEN {v} THEN '{k}' END" for k, v in _artifact_kinds(d, "s", "following").items())
        return f"SELECT doc_id, block_no, kind FROM ({rows}) _x LATERAL VIEW explode(filter(array({found}), k -> k IS NOT NULL)) _k AS kind WHERE s <> ''"
    rows = d.rows(docs, d.split("text", "\n\n"), "block_no", "b")
    blocks = f"SELECT doc_id, block_no, {d.strip('b')} AS s, coalesce(lead({d.strip('b')}) OVER (PARTITION BY doc_id ORDER BY block_no), '') AS following FROM ({rows}) _a"
    each = " UNION ALL ".join(f"SELECT doc_id, block_no, '{k}' AS kind FROM _b WHERE s <> '' AND {v}" for k, v in _artifact_kinds(d, "s", "following").items())
    return f"WITH _b AS MATERIALIZED ({blocks}) {each}"


def proofread(d, docs):  # P19: code, addresses and link targets aside
    clean = lambda x: R.chain(d, x, ("`[^`]*`", ""), (r"https?://[^\s]+|\]\([^)]*\)", ""))
    allowed = ", ".join(d.lit(w) for w in P.TWICE)
    if d.name == "spark":
        third = "CASE WHEN trim(o.line) = '' AND i > 1 AND trim(_o[i - 1].line) = '' AND trim(_o[i - 2].line) = '' AND NOT coalesce(i > 2 AND trim(_o[i - 3].line) = '', false) THEN 1 ELSE 0 END"
        lines_ = each_row(outside_lines(docs), f"filter(transform(_o, (o, i) -> named_struct('line_no', o.no, 'c', {clean('o.line')}, 'third', CASE WHEN i = 0 THEN 0 ELSE {third} END, 'blank', trim(o.line) = '')), z -> z.third = 1 OR NOT z.blank)", "_i", "line_no", "c", "third")
        found = ", ".join(f"CASE WHEN {d.like('c', p)} THEN '{k}' END" for k, p in P.PROSE.items())
        twice = r"(?iU)\b(\w{2,})\s+\1\b"
        words = f"filter(regexp_extract_all(c, {d.pat(twice)}, 1), w -> lower(w) NOT IN ({allowed}))"
        kinds = f"CASE WHEN third = 1 THEN array('third_blank') WHEN trim(c) = '' THEN array() ELSE concat(filter(array({found}), k -> k IS NOT NULL), CASE WHEN size({words}) > 0 THEN array('repeated_word') ELSE array() END) END"
        return f"SELECT doc_id, line_no, kind FROM ({lines_}) _x LATERAL VIEW explode({kinds}) _k AS kind"
    base = f"SELECT doc_id, line_no, line FROM ({fences(d, lines(d, docs))}) _f"
    each = " UNION ALL ".join(f"SELECT doc_id, line_no, '{k}' AS kind FROM _c WHERE trim(line) <> '' AND {d.like('line', p)}" for k, p in P.PROSE.items())
    # words with what parts each from the next; a pair of equal ones that only space parts isn't begun again by its second
    pieces = d.rows("SELECT doc_id, line_no, line FROM _c", d.all("line", r"[\p{L}\p{M}\p{N}_]+|\s+|[^\p{L}\p{M}\p{N}_\s]+"), "pos", "w")
    twice = f"SELECT DISTINCT doc_id, line_no, 'repeated_word' AS kind FROM (SELECT *, lag(w, 1) OVER z AS gap, lag(w, 2) OVER z AS b FROM ({pieces}) _w WINDOW z AS (PARTITION BY doc_id, line_no ORDER BY pos)) _x WHERE lower(w) = lower(b) AND trim(gap) = '' AND length(w) > 1 AND {d.like('w', r'^[' + chr(92) + 'p{L}' + chr(92) + 'p{N}_]')} AND lower(w) NOT IN ({allowed})"
    w = "OVER (PARTITION BY doc_id ORDER BY line_no)"
    blank = f"SELECT doc_id, line_no, 'third_blank' AS kind FROM (SELECT *, lag(trim(line), 1) {w} AS a, lag(trim(line), 2) {w} AS b, coalesce(lag(trim(line), 3) {w}, 'x') AS c FROM _l) _y WHERE trim(line) = '' AND a = '' AND b = '' AND c <> ''"
    return f"WITH _l AS MATERIALIZED ({base}), _c AS MATERIALIZED (SELECT doc_id, line_no, {clean('line')} AS line FROM _l) {each} UNION ALL {twice} UNION ALL {blank}"


def citations(d, lines_):  # P29
    outside = f"SELECT doc_id, {d.gather('line', 'line_no', chr(10))} AS text FROM ({fences(d, lines_)}) _f GROUP BY doc_id"
    text = R.chain(d, "text", ("`[^`]*`", ""), (r"[A-Za-z0-9._-]+@[A-Za-z0-9-]+\.[A-Za-z.]+", ""))
    return f"SELECT DISTINCT doc_id, key FROM ({d.rows(f'SELECT doc_id, {text} AS text FROM ({outside}) _o', d.all('text', r'(?:^|[^A-Za-z0-9_])-?@([A-Za-z0-9_][A-Za-z0-9_:-]*)', 1), 'pos', 'key')}) _k"


def local_citations(docs):  # P29
    """Spark: the same within the row; a text without the sign isn't searched. What stands outside fences is every other part of the text."""
    from quillspark.plans.dialect import SPARK as d

    outside_ = "CASE WHEN contains(text, '```') THEN array_join(filter(split(text, '(?md)^ *```[^\\n]*(?:\\n|\\\\z)', -1), (x, i) -> i % 2 = 0), '') ELSE text END"
    text = R.chain(d, outside_, ("`[^`]*`", ""), (r"[A-Za-z0-9._-]+@[A-Za-z0-9-]+\.[A-Za-z.]+", ""))
    keys = d.all(text, r"(?:^|[^A-Za-z0-9_])-?@([A-Za-z0-9_][A-Za-z0-9_:-]*)", 1)
    return f"SELECT DISTINCT doc_id, key FROM ({docs}) _d LATERAL VIEW explode(CASE WHEN contains(text, '@') THEN {keys} END) _k AS key"


def note_balance(d, docs):  # G8, J8
    refs = f"SELECT DISTINCT doc_id, m FROM ({d.rows(docs, d.all('text', r'\[[\^]([^]]+)[]](?:[^:]|$)', 1), 'pos', 'm')}) _r"
    defs = f"SELECT DISTINCT doc_id, m FROM ({d.rows(docs, d.all('text', r'(?m)^\[[\^]([^]]+)[]]:', 1), 'pos', 'm')}) _d"
    return f"""SELECT doc_id, count(r) AS n_refs, count(f) AS n_defs, count(CASE WHEN f IS NULL THEN 1 END) AS no_def, count(CASE WHEN r IS NULL THEN 1 END) AS no_ref FROM (
      SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, a.m AS r, b.m AS f FROM ({refs}) a FULL JOIN ({defs}) b ON a.doc_id = b.doc_id AND a.m = b.m) _x GROUP BY doc_id"""


def missing_numbers(d, numbers):  # G14
    span = d.rows(f"SELECT doc_id, max(n) AS m FROM ({numbers}) _n GROUP BY doc_id", d.upto("1", "m"), "pos", "n")
    return f"SELECT s.doc_id, s.n FROM (SELECT doc_id, CAST(n AS BIGINT) AS n FROM ({span}) _s) s LEFT ANTI JOIN ({numbers}) x ON s.doc_id = x.doc_id AND s.n = x.n" if d.name == "spark" else f"SELECT s.doc_id, s.n FROM (SELECT doc_id, CAST(n AS BIGINT) AS n FROM ({span}) _s) s ANTI JOIN ({numbers}) x ON s.doc_id = x.doc_id AND s.n = x.n"


def relocated_notes(d, lines_):  # W30: notes of headings go to the next line of prose
    mark = r"\[\^[0-9]+\]"
    own = f"CASE WHEN {d.like('line', '^#')} THEN {d.join(d.all('line', mark), '')} ELSE '' END"
    place = f"SELECT *, {own} AS moved, min(CASE WHEN NOT {d.like('line', '^([#|>]|$)')} THEN line_no END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS target FROM ({lines_}) _l"
    return f"""SELECT p.doc_id, p.line_no, CASE WHEN {d.like('p.line', '^#')} AND p.target IS NOT NULL THEN {d.rep('p.line', mark, '')} ELSE p.line END || coalesce(g.notes, '') AS line FROM ({place}) p
      LEFT JOIN (SELECT doc_id, target, {d.gather('moved', 'line_no', '')} AS notes FROM ({place}) _g WHERE moved <> '' AND target IS NOT NULL GROUP BY doc_id, target) g ON p.doc_id = g.doc_id AND p.line_no = g.target"""


def roles(d, heads):  # M1: chapters are the numbered ones; before the first of them front matter, what has no number later an appendix
    number = d.like("lower(title)", r"^((cap[ií]tulo|chapter)\s+[^\s]+|[0-9]{1,3})\s*(—|–|-{1,3}|\.)")
    front = d.like("lower(coalesce(title, ''))", r"^($|prefa(ce|cio)|pr[oó]logo|proemio|introduc(tion|ci[oó]n)|agradecimientos|acknowledg|dedicatoria|nota\s+(preliminar|del|de)([^\p{L}]|$))")
    return f"""SELECT doc_id, pos, title, CASE WHEN first_no IS NOT NULL THEN CASE WHEN pos < first_no THEN 'front' WHEN {number} THEN 'chapter' ELSE 'appendix' END WHEN pos < coalesce(first_body, pos + 1) THEN 'front' ELSE 'appendix' END AS role FROM (
      SELECT *, min(CASE WHEN {number} THEN pos END) OVER (PARTITION BY doc_id) AS first_no, min(CASE WHEN NOT {front} THEN pos END) OVER (PARTITION BY doc_id) AS first_body FROM ({heads}) _h) _i"""


def batches(d, pages_, size=20):  # Z1: batch of each page
    return f"SELECT doc_id, page_no, CAST(floor((page_no - 1) / {float(size)}) AS BIGINT) AS batch FROM ({pages_}) _p"


def resume(d, segments):  # Z2: where a log of segments ends
    return f"SELECT doc_id, max(e) AS resume_at, count(*) AS n FROM ({segments}) _s GROUP BY doc_id"
