"""Queries of the document-conversion operators and their SQL twins.

The supplied texts carry hardly any of the markup that the operators act on, so most queries first
add the same damage to every document on both sides, in SQL. Every query runs over its whole table.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspark.functions import predicates as P
from quillspark.functions import rewrites as R
from quillspark.operators import books as B
from quillspark.operators import folds
from quillspark.operators import relations as O
from quillspark.plans.dialect import DUCK, SPARK

TABLES = ("documents", "pages", "conversations", "benchmark", "labels", "events", "customer", "orders")

DAMAGE = [
    "\n\n12\n• 47 •\nxiv\nIV\nRUNNING HEAD OF A BOOK\nThe Running Head\n88 | A Title\nCHAPTER IV\nINTRODUCTION\nTHE WAY OF GOLD:\n# Title one\n## Part `one`\nProse of the first part is here[^1] and goes on-\nward to the next line[^2].\n\n- such a manner the effects\n\n|♄☿| a | Venus |\n|■ t?| £ | Mars |\n[^1]: first note\n[^3]: third note\nSee @smith2001 and mail me@example.org or [-@jones:99].\n```\n@code in a fence\n```\n12 go on with it\n\n  \nthe  the text has  two spaces ,and more..\n``x`` http://a.b/c",
    "\n\n3\nJUDIO DE GALILEA\n\tA paragraph with a note[1] by the way\n     and more of it\n4\nLA VIA DEL ORO\n\tAnother one[1].\nNotas\n[1]\nNote of one. <<\n[2]\nNote of two.\n[1]\nNote of the next. <<\n\n## Dos\n07 QX Ra zu Oel Ib wuuQX ru QX zo 7 XX FZ zu k\nxcvbnm qwrtp l0ve m1x h3re ~~~ ###\n1. first definition\n2. second\n1. again first\n7\n\nthe lone number's text\nT E X T S P A C E D O U T\n00:01:02.500 --> 00:01:04.000\nhello and <c>welcome</c>\nhello and <c>welcome</c>\n<00:00:01.000>welcome to &amp; fro",
    "\n\n# Front `x`\nTITLE DEBRIS\nT he chapter begins with a split capital\n## Title two[^4]\n\nof prose after it.\n\nNOTES\n1. A note that runs\nover two lines\n2. Another note\n\n45 A page note that\ncontinues here\n46 Second page note\n\n(  )empty and word( ] \nHe went. A\nended. head: entry\n\n\n\nand lower case goes on\n— - \n....,,,;;\n_img_2644.gif\n\nsaid it. the second house: oikos. A place.\n\n35 texto que sigue.\n\nas said by Ptolemy. ] Bt\n\nends with a bracket [\n\nthe cut paragraph goes\n\non over here.\n\nmuy muy de de ¿por qué - \"so\"... [^1] x , y",
]
SENTENCES = [
    " the 4 lh house, the 12 ,h house; the 9' h house. Venus in the 4' v house and the ll' h house, in 2015 th",
    " In Volume IT T will publish ; where T reads differently ; ( l believe it",
    " nota[3] aqui, ano[2024], link[1](url), def[1]: x",
    " cafe´ ni€os a¨b `e ¸c naı´ve ­soft­ hyphen ofﬁce ﬂow ( x ) , y",
    " R&B 50% #2_try $y a\\b {a}~b^c \\ldots{} and \\alpha{} \\S{}",
    " Title   with    wide  spaces\t and end  ",
]


def _case(d, items) -> str:
    return "CASE doc_id % " + str(len(items)) + " " + " ".join(f"WHEN {k} THEN {d.lit(x)}" for k, x in enumerate(items)) + " END"


def dirty(d) -> str:
    """Documents with structural damage."""
    return f"SELECT doc_id, coalesce(text, '') || {_case(d, DAMAGE)} AS text FROM documents"


def damaged_lines(d) -> str:
    return O.lines(d, dirty(d))


def sentences(d) -> str:
    """Every line of every document with character damage, that follows document and line."""
    damage = "CASE (doc_id + line_no) % " + str(len(SENTENCES)) + " " + " ".join(f"WHEN {k} THEN {d.lit(x)}" for k, x in enumerate(SENTENCES)) + " END"
    return f"SELECT doc_id, line_no, line || {damage} AS s FROM ({O.lines(d, 'SELECT doc_id, coalesce(text, ' + chr(39) * 2 + ') AS text FROM documents')}) _l"


def feeds(d) -> str:
    """Documents as pages: a form feed behind every second line."""
    return f"SELECT doc_id, {R.chain(d, 'coalesce(text, ' + chr(39) * 2 + ')', (chr(10), chr(12)))} || {d.lit(chr(12))} AS text FROM documents"


def _flag(f, **how):
    return lambda d: f"SELECT doc_id, line_no, {f(d, 'line', **how)} AS hit FROM ({damaged_lines(d)}) _q"


def _rewrite(f, **how):
    return lambda d: f"SELECT doc_id, line_no, {f(d, 's', **how)} AS s FROM ({sentences(d)}) _q"


def _whole(f, **how):
    return lambda d: f"SELECT doc_id, {f(d, 'text', **how)} AS s FROM ({dirty(d)}) _q"


def _lines(f, *a):
    return lambda d: f(d, damaged_lines(d), *a)


def _local(within, otherwise):
    """Within the row where Spark runs it; DuckDB's text is another one, with windows over lines."""
    return lambda d: within(dirty(d)) if d.name == "spark" else otherwise(d)


def _paras(d):
    return O.local_paragraphs(dirty(d)) if d.name == "spark" else O.paragraphs(d, damaged_lines(d))


def _passages(d):
    return O.local_passages(dirty(d)) if d.name == "spark" else O.passages(d, damaged_lines(d))


def _numbers(d):
    return f"SELECT DISTINCT doc_id, CAST(length(line) AS BIGINT) AS n FROM ({damaged_lines(d)}) _l WHERE length(line) BETWEEN 1 AND 60"


def _plan(d):
    return "SELECT 0 AS pos, '# Title one' AS heading, 'one' AS title UNION ALL SELECT 1, '## Part `one`', 'part' UNION ALL SELECT 2, '## Dos', 'dos'"


def _heads(d):
    return f"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS pos, {R.fixes(d, 'line')} AS title FROM ({damaged_lines(d)}) _l WHERE {P.caps_heading(d, 'line')} OR {d.like('line', '^#')} OR {P.page_number(d, 'line')}"


def _opened(d):
    """Documents as chapters: a title, in some of them debris before a split capital, or prose at once."""
    start = ["# A title\nCHAPTER\nTHE TITLE\n\nT he text begins,\n\nand goes on: ", "# A title\nProse at once, no\nT he capital. ", "No title\nT he text "]
    return f"SELECT doc_id, {_case(d, start)} || coalesce(text, '') AS text FROM documents"


def _urls(d):
    return "SELECT page_id AS doc_id, url FROM pages"


def _translation(d):  # G10, G11
    t = R.fixes(d, "text", (("the", "thee"), (r"[0-9]+", "7")))
    row = lambda x: f"{d.n(x, '(?m)^```')} / 2 AS fences, {d.n(x, r'\[\^[0-9]+\]')} AS refs, {d.n(x, '(?m)^#+ ')} AS headings, {d.n(x, r'\]\(')} AS links, {d.n(x, '[0-9]+')} AS numbers, {d.n(x, '[^ ' + chr(92) + 'n]+')} AS words"
    whole = "div" if d.name == "spark" else "//"
    fix = lambda s: s.replace(" / 2 ", f" {whole} 2 ")
    return f"""SELECT o.doc_id, o.fences AS fences, t.fences AS fences_t, o.refs AS refs, t.refs AS refs_t, o.headings AS headings, t.headings AS headings_t, o.numbers AS numbers, o.words AS words, t.words AS words_t,
      CASE WHEN t.words < 0.85 * o.words THEN 'short' WHEN t.words > 1.3 * o.words THEN 'long' ELSE 'fine' END AS verdict FROM (SELECT doc_id, {fix(row('text'))} FROM ({dirty(d)}) _a) o JOIN (SELECT doc_id, {fix(row(t))} FROM ({dirty(d)}) _b) t ON o.doc_id = t.doc_id"""


def _completeness(d, hint=""):  # L2: four-word runs of the benchmark passages that no document has
    grams = lambda rel, key: f"SELECT DISTINCT {key}, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 AS g FROM (SELECT {key}, w AS w1, lead(w, 1) OVER z AS w2, lead(w, 2) OVER z AS w3, lead(w, 3) OVER z AS w4 FROM ({d.rows(rel, R.tokens(d, 'text'), 'pos', 'w')}) _t WINDOW z AS (PARTITION BY {key} ORDER BY pos)) _u WHERE w4 IS NOT NULL"
    if d.name == "spark":  # runs of a document within the row; what no passage has is left at once
        toks = f"SELECT {R.tokens(d, 'text')} AS _w FROM documents"
        own = "transform(slice(sequence(0, size(_w)), 1, greatest(size(_w) - 3, 0)), i -> concat_ws(' ', _w[i], _w[i + 1], _w[i + 2], _w[i + 3]))"
        asked = grams("SELECT item_id, text FROM benchmark", "item_id")
        found = f"SELECT {hint} DISTINCT g FROM (SELECT g FROM ({toks}) _t LATERAL VIEW explode({own}) _e AS g) _d LEFT SEMI JOIN (SELECT DISTINCT g FROM ({asked}) _a) a ON _d.g = a.g"
        return f"SELECT b.item_id, count(*) AS runs, count(CASE WHEN k.g IS NULL THEN 1 END) AS missing FROM ({asked}) b LEFT JOIN ({found}) k ON b.g = k.g GROUP BY b.item_id"
    return f"SELECT b.item_id, count(*) AS runs, count(CASE WHEN k.g IS NULL THEN 1 END) AS missing FROM ({grams('SELECT item_id, text FROM benchmark', 'item_id')}) b LEFT JOIN (SELECT DISTINCT g FROM ({grams('SELECT doc_id, text FROM documents', 'doc_id')}) _d) k ON b.g = k.g GROUP BY b.item_id"


def _multiset(d):  # E2, G12: numbers lost
    nums = lambda t: f"SELECT doc_id, n FROM ({d.rows(f'SELECT doc_id, {t} AS text FROM documents', d.all('text', '[0-9]+'), 'pos', 'n')}) _n"
    return f"SELECT doc_id, n, count(*) AS times FROM ({nums('text')} EXCEPT ALL {nums(R.fixes(d, 'text', (('1[0-9]', 'x'),)))}) _e GROUP BY doc_id, n"


def _glossary(d):  # J10: terms that stayed in a translation, as whole words
    terms = " UNION ALL ".join(f"SELECT '{w}' AS src" for w in ("the", "der", "les", "que", "license", "token"))
    return f"SELECT DISTINCT d.doc_id, t.src FROM ({d.rows('SELECT doc_id, text FROM documents', R.tokens(d, 'text'), 'pos', 'w')}) d JOIN ({terms}) t ON d.w = t.src"


def _spelling(d):  # L6, J13: an unknown word goes to the most frequent known one an edit away, else two; edits are of one letter or a swap
    words = O.word_counts(d, "SELECT text FROM documents", "ascii")
    upto = d.upto("1", "length(word)")
    one = d.each(upto, "i", "substr(word, 1, i - 1) || substr(word, i + 1)")
    two = f"flatten({d.each(upto, 'i', d.each(d.upto('1', 'i'), 'j', 'substr(word, 1, j - 1) || substr(word, j + 1, i - j - 1) || substr(word, i + 1)'))})"
    both = f"array_distinct(concat(array(word), {one}, {two}))" if d.name == "spark" else f"list_distinct(list_concat([word], {one}, {two}))"
    cut = lambda rel: d.rows(f"SELECT word, n FROM ({rel}) _v", both, "pos", "v")
    swaps = lambda w: d.each(d.upto("1", f"length({w}) - 1"), "i", f"substr({w}, 1, i - 1) || substr({w}, i + 1, 1) || substr({w}, i, 1) || substr({w}, i + 2)")
    if d.name == "spark":
        return _spelling_by_steps(d, one, two, swaps)
    near = f"CASE WHEN levenshtein(a, b) <= 1 OR length(a) = length(b) AND {d.has(swaps('a'), 'b')} THEN 1 WHEN levenshtein(a, b) = 2 OR {d.some(swaps('a'), 's', 'levenshtein(s, b) <= 1')} OR {d.some(swaps('b'), 's', 'levenshtein(a, s) <= 1')} THEN 2 ELSE 3 END"
    rare = f"SELECT * FROM ({words}) _w WHERE n < 3 AND length(word) BETWEEN 4 AND 12"
    known = f"SELECT * FROM ({words}) _w WHERE n >= 3 AND length(word) >= 2"
    pairs = f"SELECT DISTINCT r.word AS a, c.word AS b, c.n FROM ({cut(rare)}) r JOIN ({cut(known)}) c ON r.v = c.v"
    best = f"SELECT a, {d.pick('b', d.struct('-edits', 'n', 'length(b)', 'b'))} AS fix, {d.pick('n', d.struct('-edits', 'n', 'length(b)', 'b'))} AS n FROM (SELECT a, b, n, {near} AS edits FROM ({pairs}) _p) _q WHERE edits <= 2 GROUP BY a"
    return f"SELECT a AS word, fix FROM ({best}) _b WHERE n >= 8"


def _spelling_by_steps(d, one, two, swaps):
    """Spark: words an edit away first; two edits are asked only of the words without one, and of known words that may be given. All words are counted once: no condition
    goes below their count, and each side of the second step asks for all of the first, so that its shuffles are used again."""
    words = f"SELECT word, count(*) AS n, max(length(word)) AS l FROM ({d.rows('SELECT text FROM documents', R.tokens(d, 'text', 'ascii'), 'pos', 'word')}) _w WHERE word IS NOT NULL GROUP BY word"
    rare = f"SELECT word, n FROM ({words}) _v WHERE n < 3 AND l BETWEEN 4 AND 12"
    known = lambda least: f"SELECT word, n FROM ({words}) _v WHERE n >= {least} AND l BETWEEN 2 AND 14"  # noqa: E731 - longer ones are three edits from all
    cut = lambda rel, more: f"SELECT word, n, v FROM ({rel}) _c LATERAL VIEW explode(array_distinct(concat(array(word), {more}))) _e AS v"
    best = lambda r, c, more, near: f"SELECT a, max_by(b, struct(n, length(b), b)) AS fix, max(n) AS n FROM (SELECT r.word AS a, c.word AS b, c.n FROM ({cut(r, more)}) r JOIN ({cut(c, more)}) c ON r.v = c.v) _p WHERE {near} GROUP BY a"
    first = best(rare, known(3), one, f"levenshtein(a, b, 1) >= 0 OR length(a) = length(b) AND levenshtein(a, b, 2) = 2 AND {d.has(swaps('a'), 'b')}")
    rest = f"SELECT word, n FROM ({rare}) _r LEFT ANTI JOIN ({first}) _f ON _r.word = _f.a AND _f.fix IS NOT NULL AND _f.n > 0"
    swapped = f"{d.some(swaps('a'), 's', 'levenshtein(s, b, 1) >= 0')} OR {d.some(swaps('b'), 's', 'levenshtein(a, s, 1) >= 0')}"
    second = best(rest, known(8), f"{one}, {two}", f"levenshtein(a, b, 2) >= 0 OR abs(length(a) - length(b)) <= 1 AND levenshtein(a, b, 3) = 3 AND ({swapped})")
    return f"SELECT a AS word, fix FROM ({first}) _b WHERE n >= 8 AND fix IS NOT NULL UNION ALL SELECT a AS word, fix FROM ({second}) _s"


def _html_text(d):  # S10, by patterns
    s = R.chain(d, "html", (r"(?is)<(script|style)[^>]*>.*?</(script|style)>", ""), (r"(?s)<!--.*?-->", ""), (r"(?i)<(p|br|div|li|h[1-4])[^>]*>", "\n"), (r"<[^>]*>", ""))
    return f"SELECT page_id, {R.caption(d, s)} AS text FROM pages"


def _tags(d):  # H1, counts
    return "SELECT page_id, " + ", ".join(f"{d.n('html', f'(?i)<{t}[ >]')} AS n_{t}" for t in ("p", "b", "li", "a", "h1", "br", "nav")) + " FROM pages"


def _index(d):  # Q6, K6: pages of each word of the terms; words meet words, so nothing is searched by nested loops
    terms = f"SELECT DISTINCT w AS term FROM ({d.rows('SELECT item_id, text FROM benchmark', R.tokens(d, 'text', 'latin'), 'pos', 'w')}) _t"
    found = f"SELECT DISTINCT w, page_no FROM ({d.rows(O.pages(d, feeds(d)), R.tokens(d, 'page', 'latin'), 'pos', 'w')}) _p"
    hits = f"SELECT b.term, p.page_no FROM ({found}) p JOIN ({terms}) b ON p.w = b.term"
    return f"SELECT doc_id AS term, replace(upper(substr({R.index_key(d, 'doc_id')}, 1, 1)), 'ẞ', 'SS') AS letter, runs FROM ({O.page_runs(d, f'SELECT term AS doc_id, CAST(page_no AS BIGINT) AS n FROM ({hits}) _h')}) _r"


def _spread(d, ratio=1.05, none_below=2, all_pages=False):  # P25: which pages of a book are spreads, and the page numbers that come of it
    act = f"CASE WHEN i <= {none_below} THEN 'keep' WHEN {'true' if all_pages else 'false'} OR w >= CAST({ratio} AS DOUBLE) * h THEN 'split' ELSE 'keep' END"
    sized = "SELECT page_id % 25 AS book, page_id, CAST(400 + page_id % 7 * 50 AS DOUBLE) AS w, CAST(600 AS DOUBLE) AS h FROM pages"
    own = f"SELECT *, {act} AS act FROM (SELECT *, row_number() OVER (PARTITION BY book ORDER BY page_id) AS i FROM ({sized}) _p) _q"
    return f"SELECT book, page_id, w, h, act, sum(CASE WHEN act = 'split' THEN 2 ELSE 1 END) OVER (PARTITION BY book ORDER BY page_id ROWS UNBOUNDED PRECEDING) AS last_page FROM ({own}) _r"


def _sizes(d):  # W23: font sizes, in tenths of a point, linked while the gap to the last is small
    lines = f"SELECT doc_id, line_no, CAST(90 + length(line) % 23 * 3 AS BIGINT) AS size FROM ({damaged_lines(d)}) _l"
    return f"""SELECT doc_id, grp, dense_rank() OVER (PARTITION BY doc_id ORDER BY grp) AS level, count(*) AS n, CAST(sum(size) AS DOUBLE) / (10 * count(*)) AS mean FROM (SELECT x.doc_id, x.size, g.grp FROM ({lines}) x JOIN (
      SELECT doc_id, size, sum(CASE WHEN before - size > 6 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY size DESC ROWS UNBOUNDED PRECEDING) AS grp FROM (
        SELECT doc_id, size, lag(size) OVER (PARTITION BY doc_id ORDER BY size DESC) AS before FROM (SELECT DISTINCT doc_id, size FROM ({lines}) _a) _b) _c) g ON x.doc_id = g.doc_id AND x.size = g.size) _d GROUP BY doc_id, grp HAVING count(*) >= 3"""


def _quotes(d):  # W24: runs of indented small lines
    small = "(x0 >= 20 AND size <= CAST(10.1 AS DOUBLE))"
    return f"""SELECT doc_id, grp, {d.gather('line', 'line_no', ' ')} AS quote FROM (SELECT *, sum(CASE WHEN {small} THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS grp FROM (
      SELECT *, length(line) % 3 * 10 AS x0, CAST(10 + length(line) % 2 AS DOUBLE) AS size FROM ({damaged_lines(d)}) _l WHERE trim(line) <> '') _m) _n WHERE {small} GROUP BY doc_id, grp HAVING sum(length(line)) >= 60"""


def _segments(d):  # Z2 over events
    secs = "CAST(unix_timestamp(ts) % 3600 AS DOUBLE)" if d.name == "spark" else "CAST(CAST(floor(epoch(ts)) AS BIGINT) % 3600 AS DOUBLE)"
    return f"SELECT user_id AS doc_id, {secs} AS s, {secs} + 2.25 AS e FROM events"


def _mode(d):  # G3: the commonest length, the least among equals
    return f"SELECT doc_id, {d.pick('v', d.struct('n', '-v'))} AS mode FROM (SELECT doc_id, v, count(*) AS n FROM (SELECT doc_id, CAST(length(line) AS BIGINT) AS v FROM ({damaged_lines(d)}) _l WHERE length(line) > 45) _m GROUP BY doc_id, v) _n GROUP BY doc_id"


def _median(d):  # G4: the upper median
    return f"SELECT doc_id, max(CASE WHEN i = n {'div' if d.name == 'spark' else '//'} 2 + 1 THEN v END) AS median FROM (SELECT doc_id, v, row_number() OVER (PARTITION BY doc_id ORDER BY v) AS i, count(*) OVER (PARTITION BY doc_id) AS n FROM (SELECT doc_id, CAST(length(line) AS BIGINT) AS v FROM ({damaged_lines(d)}) _l) _m) _n GROUP BY doc_id"


def _fingerprint(d):  # G18, Q4: a sum of the files' digests, so their order doesn't matter and no task sees all names
    part = f"md5(CAST(doc_id AS {'STRING' if d.name == 'spark' else 'VARCHAR'}) || ':' || n_chars)"
    number = f"CAST(conv(substr({part}, 1, 12), 16, 10) AS DECIMAL(38, 0))" if d.name == "spark" else f"CAST(('0x' || substr({part}, 1, 12))::BIGINT AS DECIMAL(38, 0))"
    return f"SELECT source, CAST(sum({number}) AS {'STRING' if d.name == 'spark' else 'VARCHAR'}) || '/' || count(*) AS print FROM documents GROUP BY source"


def _sample(d):  # G16: every k-th page by a fixed step
    return f"SELECT doc_id, page_no FROM (SELECT *, max(page_no) OVER (PARTITION BY doc_id) AS n FROM ({O.pages(d, feeds(d))}) _p) _q WHERE (page_no - 1) * 3 % n < 3"


def _garbled_cells(d):  # P17
    cells = d.rows(f"SELECT doc_id, line_no, line FROM ({damaged_lines(d)}) _l WHERE {d.like('line', r'^\|')} AND NOT {d.like('line', r'^[|: -]+$')}", d.split("line", r"\|"), "cell_no", "cell")
    return f"SELECT doc_id, line_no, min(cell_no) AS first_cell FROM ({cells}) _c WHERE {P.garbled_cell(d, 'cell')} GROUP BY doc_id, line_no"


def _markers(d):  # P12
    hits = f"SELECT doc_id, page_no, trim(line) AS marker, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY line_no) AS i FROM (SELECT doc_id, line_no, line, line_no {'div' if d.name == 'spark' else '//'} 10 AS page_no FROM ({damaged_lines(d)}) _l) _m WHERE {P.chapter_marker(d, 'line')}"
    return f"SELECT doc_id, CAST(page_no AS BIGINT) AS page_no, marker FROM ({hits}) _h WHERE i = 1"


def _anchor(d):  # P27: the first ten words of a page's prose
    ok = f"{d.n('line', '[^ ]+')} >= 3"
    words = d.all(d.gather("line", "line_no", " "), r"[\p{L}\p{N}]+")
    return f"SELECT doc_id, {d.join(d.cut('w', 1, 10), ' ')} AS anchor FROM (SELECT doc_id, {words} AS w FROM ({damaged_lines(d)}) _l WHERE {ok} GROUP BY doc_id) _m WHERE {d.size('w')} >= 5"


def _noise(d):  # G9, S16, J12, R3: tokens outside a dictionary of the corpus
    known = f"SELECT word FROM ({O.word_counts(d, 'SELECT text FROM documents', 'latin')}) _k WHERE n >= 3"
    return f"SELECT t.doc_id, count(*) AS tokens, count(CASE WHEN k.word IS NULL THEN 1 END) AS unknown FROM ({d.rows(dirty(d), R.tokens(d, 'text', 'latin'), 'pos', 'word')}) t LEFT JOIN ({known}) k ON t.word = k.word GROUP BY t.doc_id"


def _ratio(d):  # G7
    return f"SELECT doc_id, a, b, CASE WHEN a < 0.85 * b THEN 'red' WHEN a < 0.93 * b THEN 'yellow' ELSE 'green' END AS flag FROM (SELECT doc_id, {d.n(R.chain(d, 'text', ('[a-z]*tion', '')), r'[\p{L}]+')} AS a, {d.n('text', r'[\p{L}]+')} AS b FROM documents) _r"


def _corruption(d):  # G13
    return f"SELECT doc_id, count(*) AS n, sum(CASE WHEN score >= 0.35 THEN 1 ELSE 0 END) AS flagged, sum(CASE WHEN score >= 0.35 THEN 1 ELSE 0 END) > 0.25 * count(*) AS again FROM (SELECT doc_id, round({P.corruption_score(d, 'line')}, 4) AS score FROM ({damaged_lines(d)}) _l) _s GROUP BY doc_id"


def _cited(d):  # J7, S17, E1
    bib = "SELECT 'smith2001' AS key UNION ALL SELECT 'smith2001' UNION ALL SELECT 'brown1999'"
    cites = O.citations(d, damaged_lines(d))
    anti = "LEFT ANTI JOIN" if d.name == "spark" else "ANTI JOIN"
    if d.name == "spark":  # the citations once
        cited, listed = f"SELECT DISTINCT key FROM ({O.local_citations(dirty(d))}) _c", f"SELECT DISTINCT key FROM ({bib}) _b"
        return f"""SELECT coalesce(c.key, b.key) AS key, CASE WHEN b.key IS NULL THEN 'no entry' ELSE 'not cited' END AS what FROM ({cited}) c FULL JOIN ({listed}) b ON c.key = b.key WHERE c.key IS NULL OR b.key IS NULL
      UNION ALL SELECT key, 'twice' FROM ({bib}) _x GROUP BY key HAVING count(*) > 1"""
    return f"""SELECT DISTINCT c.key, 'no entry' AS what FROM ({cites}) c {anti} ({bib}) b ON c.key = b.key UNION ALL SELECT DISTINCT b.key, 'not cited' FROM ({bib}) b {anti} ({cites}) c ON b.key = c.key
      UNION ALL SELECT key, 'twice' FROM ({bib}) _x GROUP BY key HAVING count(*) > 1"""


def _notes_join(d):  # J4, H3: notes numbered by first use, a placeholder where a body is missing
    refs = d.rows(dirty(d), d.all("text", r"\[\^([0-9]+)\](?:[^:]|$)", 1), "pos", "m")
    defs = d.rows(dirty(d), d.all("text", r"(?m)^\[\^([0-9]+\]: .*)$", 1), "pos", "b")
    return f"""SELECT r.doc_id, r.m, dense_rank() OVER (PARTITION BY r.doc_id ORDER BY r.first_use) AS no, coalesce(x.body, '(missing note)') AS body FROM (SELECT doc_id, m, min(pos) AS first_use FROM ({refs}) _r GROUP BY doc_id, m) r
      LEFT JOIN (SELECT doc_id, {d.ext('b', '^([0-9]+)', 1)} AS m, min({d.ext('b', '^[0-9]+[]]: (.*)$', 1)}) AS body FROM ({defs}) _d GROUP BY doc_id, {d.ext('b', '^([0-9]+)', 1)}) x ON r.doc_id = x.doc_id AND r.m = x.m"""


def _pools(d):  # E4: later pools win, collisions are counted
    pool = "SELECT conv_id, turn % 3 AS n, turn AS pool_no, text FROM conversations"
    return f"SELECT conv_id, n, {d.pick('text', 'pool_no')} AS body, count(DISTINCT text) > 1 AS collides FROM ({pool}) _p GROUP BY conv_id, n"


def _cues(d):
    return "SELECT conv_id AS doc_id, turn AS line_no, coalesce(text, '') AS line FROM conversations UNION ALL SELECT conv_id, turn + 1000, coalesce(text, '') FROM conversations"


def _overlap(d):  # W18: the longest suffix of what is out that the cue begins with isn't said again; a cue of the second half follows each turn
    half = d.join("slice(_w, CAST(size(_w) / 2 AS INT) + 1, size(_w))" if d.name == "spark" else "list_slice(_w, CAST(floor(len(_w) / 2) AS INT) + 1, len(_w))", " ")
    turns = f"SELECT conv_id, turn, text, {d.split('text', ' ')} AS _w FROM conversations WHERE text IS NOT NULL"
    words = f"SELECT doc_id, {d.collect('line', 'line_no')} AS cues FROM (SELECT conv_id AS doc_id, turn * 2 AS line_no, text AS line FROM ({turns}) _t UNION ALL SELECT conv_id, turn * 2 + 1, {half} || ' and on' FROM ({turns}) _u) _c GROUP BY doc_id"
    if d.name == "spark":
        fold = "aggregate(transform(cues, c -> filter(split(c, ' '), w -> w <> '')), cast(array() as array<string>), (a, c) -> concat(a, slice(c, 1 + array_max(filter(sequence(0, least(size(a), size(c))), k -> k = 0 OR (a[size(a) - k] = c[0] AND slice(a, size(a) - k + 1, k) = slice(c, 1, k)))), greatest(size(c), 1))))"
    else:
        fold = "list_reduce(list_transform(cues, lambda c: list_filter(string_split(c, ' '), lambda w: w <> '')), lambda a, c: list_concat(a, list_slice(c, 1 + list_max(list_filter(range(0, least(len(a), len(c)) + 1), lambda k: k = 0 OR (a[len(a) - k + 1] = c[1] AND list_slice(a, len(a) - k + 1, len(a)) = list_slice(c, 1, k)))), len(c))))"
    return f"SELECT doc_id, {d.join(fold, ' ')} AS text FROM ({words}) _w"


def _search(d):  # Q5, G5
    hit = f"contains({d.fold('line')}, 'erung')"
    return f"SELECT doc_id, count(*) AS hits FROM ({damaged_lines(d)}) _l WHERE {hit} GROUP BY doc_id"


BUILDERS: dict[str, Callable[..., str]] = {
    "s2_pages": lambda d: O.pages(d, feeds(d)),
    "s3_page_range": lambda d: O.page_range(d, O.pages(d, feeds(d)), 2, 5),
    "s4_without_running_head": _lines(O.without_head),
    "s10_html_text": _html_text,
    "s14_cues": lambda d: f"SELECT doc_id, line_no, {R.caption(d, 'line')} AS line FROM ({damaged_lines(d)}) _l WHERE NOT contains(line, '-->')",
    "s18_glossary_leaks": _glossary,
    "k7_srt": lambda d: f"SELECT doc_id, s, {R.srt_time(d, 's')} AS t0, {R.srt_time(d, 'e')} AS t1 FROM ({_segments(d)}) _s",
    "k12_combined": lambda d: f"SELECT conv_id, {d.gather('text', 'turn', chr(10) * 2 + '---' + chr(10) * 2)} AS md FROM conversations GROUP BY conv_id",
    "p1_page_numbers": _flag(P.page_number), "p2_ocr_page_numbers": _flag(P.ocr_page_number), "p3_roman_headings": _flag(P.roman_heading),
    "p4_running_heads": _flag(P.running_head), "p4_running_heads_at_start": _flag(P.running_head, start=True), "p5_folded_heads": _flag(P.running_head_folded),
    "p6_heads_with_folio": _flag(P.head_with_folio), "p7_garbage_lines": _flag(P.garbage_line),
    "p8_garbage_paragraphs": lambda d: f"SELECT doc_id, para_no, {P.garbage_paragraph(d, 'text')} AS hit FROM ({_paras(d)}) _q",
    "p9_caps_headings": _flag(P.caps_heading), "p10_ocr_headings": _flag(P.ocr_heading), "p11_layout_headings": _flag(P.layout_heading), "p12_chapter_markers": _markers,
    "p13_skippable_units": _flag(P.skippable_unit), "p13_skippable_titles": _flag(P.skippable_title), "p14_garbled_tokens": lambda d: f"SELECT doc_id, pos, w, {P.garbled_token(d, 'w')} AS hit FROM ({d.rows(dirty(d), d.all('text', '[A-Za-z]+'), 'pos', 'w')}) _q",
    "p15_garbage_blocks": _flag(P.garbage_block), "p16_corruption": lambda d: f"SELECT doc_id, line_no, round({P.corruption_score(d, 'line')}, 4) AS score FROM ({damaged_lines(d)}) _q",
    "p17_garbled_cells": _garbled_cells, "p18_artifacts": lambda d: O.artifacts(d, dirty(d)), "p19_proofread": lambda d: O.proofread(d, dirty(d)), "p20_index_heads": _flag(P.plausible_head),
    "p21_terminal": _flag(P.ends_terminal), "p22_only": lambda d: "SELECT doc_id, source FROM documents WHERE contains(lower(source), 'c1')", "p23_latin": _flag(P.latin), "p25_spreads": _spread, "p26_leaked_notes": _flag(P.leaked_note),
    "p27_anchors": _anchor, "p28_unquotable": _flag(P.unquotable), "p28_backmatter": _flag(P.backmatter), "p29_citations": _local(O.local_citations, lambda d: O.citations(d, damaged_lines(d))),
    "r1_slugs": _rewrite(R.slug), "r1_slugs_lower": _rewrite(R.slug, most=20, lower=True), "r2_fold": _rewrite(R.folded), "r5_diacritics": _rewrite(R.diacritics), "r6_docling": _rewrite(R.docling), "r7_ordinals": _rewrite(R.ordinals),
    "r9_pronoun": _rewrite(R.pronoun), "r10_join_lines": _whole(R.join_lines), "r11_join_paragraph": _whole(R.join_paragraph), "r12_dehyphenate": lambda d: f"SELECT doc_id, line_no, {R.dehyphenate(d, 's || ' + chr(39) + '-' + chr(39), chr(39) + 'end' + chr(39))} AS s FROM ({sentences(d)}) _q",
    "r13_leading_numbers": lambda d: f"SELECT doc_id, line_no, {R.leading_number(d, 'line')} AS s FROM ({damaged_lines(d)}) _q",
    "r14_fixes": _rewrite(R.fixes), "r15_title_case": _rewrite(R.title_case), "r17_promoted_headings": lambda d: f"SELECT doc_id, line_no, CASE WHEN {P.caps_heading(d, 'line')} THEN '## ' || {R.title_case(d, 'line')} ELSE line END AS s FROM ({damaged_lines(d)}) _q",
    "r18_echoed_title": lambda d: O.leading_run(d, _paras(d), d.like("lower(text)", "^(the|der|la|le)")), "r20_soft_hyphens": _rewrite(R.soft_hyphens), "r21_collapse": lambda d: f"SELECT doc_id, line_no, {R.collapse_spaces(d, 'line')} AS s FROM ({damaged_lines(d)}) _q",
    "r22_tidy": _whole(R.tidy), "r23_openings": lambda d: O.openings(d, _opened(d)), "r24_bracket_refs": _rewrite(R.bracket_refs), "r29_glyphs": lambda d: f"SELECT doc_id, line_no, {R.glyph(d, 'line')} AS s FROM ({damaged_lines(d)}) _q WHERE contains(line, '_img_')",
    "r30_tex_symbols": _rewrite(R.tex_symbols), "r32_captions": lambda d: f"SELECT doc_id, line_no, {R.caption(d, 'line')} AS s FROM ({damaged_lines(d)}) _q",
    "r33_seconds": lambda d: f"SELECT doc_id, {R.seconds(d, 't')} AS secs FROM (SELECT doc_id, (CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN '1:' ELSE '12:' END) || (n_chars % 60) || (CASE WHEN doc_id % 5 = 0 THEN '' ELSE ':' || (doc_id % 60) END) AS t FROM documents) _q",
    "r34_tex_escape": _rewrite(R.tex_escape), "r35_reference_text": _whole(R.reference_text), "r36_index_keys": _rewrite(R.index_key), "r37_page_runs": lambda d: O.page_runs(d, _numbers(d)), "r38_first_titles": _whole(R.first_title),
    "r39_match_case": lambda d: f"SELECT doc_id, pos, {R.match_case(d, 'w', chr(39) + 'word' + chr(39))} AS s FROM ({d.rows(dirty(d), d.all('text', '[A-Za-z]+'), 'pos', 'w')}) _q",
    "r40_hrefs": lambda d: f"SELECT doc_id, {R.resolve_href(d, 'url', chr(39) + 'OEBPS/text/..' + chr(39))} AS href FROM ({_urls(d)}) _u",
    **{f"r41_tokens_{k}": (lambda k: lambda d: f"SELECT doc_id, {d.size(R.tokens(d, 'text', k))} AS n, {d.join(R.tokens(d, 'text', k), ' ')} AS s FROM ({dirty(d)}) _q")(k) for k in ("word", "latin", "ascii", "apostrophe")},
    "r42_body": _whole(R.body), "r43_numbered_notes": lambda d: f"SELECT doc_id, {d.join(R.numbered_marks(d, 'text'), ',')} AS marks, {d.join(R.numbered_notes(d, 'text'), '|')} AS notes FROM ({dirty(d)}) _q",
    "w1_page_paragraphs": _lines(O.page_paragraphs), "w3_merged_paragraphs": _local(O.local_merged, lambda d: O.merged(d, _paras(d))), "w4_reflow": _lines(O.reflow), "d6_paragraphs": _paras, "w7_passages": _passages, "w8_split_by_heading": _local(O.local_split, lambda d: O.split_headings(d, damaged_lines(d))),
    "w9_plan_starts": lambda d: O.plan_starts(d, damaged_lines(d), _plan(d)), "w10_numbered_sections": _lines(O.sections_by_number), "w11_rtf_body": _lines(O.rtf_body), "w12_note_pool": _lines(O.note_pool), "w13_foot_zone": _lines(O.foot_zone), "w14_end_notes": _lines(O.end_notes),
    "w15_body_start": lambda d: O.body_start(d, _paras(d)), "w16_note_definitions": _lines(O.note_definitions), "w18_consecutive_cues": lambda d: O.consecutive_cues(d, _cues(d)), "w18_overlap": _overlap, "w23_size_tiers": _sizes, "w24_quotes": _quotes,
    "w27_outside_fences": _local(O.local_fences, lambda d: O.fences(d, damaged_lines(d))), "w28_context": lambda d: O.context(d, damaged_lines(d), "contains(line, 'the ')", 1), "w30_relocated_notes": _lines(O.relocated_notes), "w31_split_definitions": _lines(O.merge_split_definitions),
    "j4_notes": _notes_join, "j7_citation_keys": _cited, "g1_word_map": lambda d: O.word_map(d, dirty(d)), "g2_word_counts": lambda d: O.word_counts(d, "SELECT text FROM documents"), "g3_mode": _mode, "g4_median": _median, "g5_hits": _search,
    "g7_ratio": _ratio, "g8_note_balance": lambda d: O.note_balance(d, dirty(d)), "g9_noise": _noise, "g10_translation": _translation, "g12_lost_numbers": _multiset, "g13_corruption": _corruption, "g14_missing_numbers": lambda d: O.missing_numbers(d, _numbers(d)),
    "g16_page_sample": _sample, "g18_fingerprint": _fingerprint, "e4_note_pools": _pools, "l2_completeness": _completeness, "l6_spelling": _spelling, "q1_postings": _local(O.local_postings, lambda d: O.fts_postings(d, _passages(d))),
    "q2_bm25": lambda d: O.bm25(d, (O.fts_tokens if d.name == "spark" else O.fts_postings)(d, _passages(d)), ("the", "token", "ersh", "license")), "q6_index": _index, "h1_tags": _tags,
    "m1_roles": lambda d: O.roles(d, _heads(d)), "m2_chapter_titles": lambda d: f"SELECT doc_id, {R.strip_chapter(d, chr(39) + '# Chapter 4 — ' + chr(39) + ' || text')} AS s FROM documents",
    "m3_first_chapter": lambda d: f"SELECT doc_id, {R.star_first_chapter(d, chr(39) + 'x ' + chr(92) * (2 if d.name == 'spark' else 1) + 'chapter{A {b} c} y ' + chr(39) + ' || text')} AS s FROM documents",
    "m4_star_sections": lambda d: f"SELECT doc_id, {R.star_sections(d, chr(39) + 'x ' + chr(92) * (2 if d.name == 'spark' else 1) + 'section{A} ' + chr(39) + ' || text')} AS s FROM documents",
    "m6_centred_images": lambda d: f"SELECT doc_id, {R.centre_images(d, chr(39) + 'x ' + chr(92) * (2 if d.name == 'spark' else 1) + 'includegraphics[w]{a.png} ' + chr(39) + ' || text')} AS s FROM documents",
    "z1_batches": lambda d: O.batches(d, O.pages(d, feeds(d))), "z2_resume": lambda d: O.resume(d, _segments(d)),
}


def _ligature_map(d):  # R3, R4, J12: tokens whose capitals stand for ligatures, by a dictionary join
    known = f"SELECT word FROM ({O.word_counts(d, 'SELECT text FROM documents', 'ascii')}) _k WHERE n >= 3 UNION SELECT w FROM (SELECT 'final' AS w UNION ALL SELECT 'office' UNION ALL SELECT 'flow' UNION ALL SELECT 'waffle') _l"
    fixed = "replace(replace(replace(replace(replace(w, 'W', 'fi'), 'V', 'ff'), 'X', 'fl'), 'Y', 'ffi'), 'Z', 'ffl')"
    words = d.rows(f"SELECT doc_id, s || ' Wnal oYce Xow WWF waVle' AS s FROM ({sentences(d)}) _s", d.all("s", R.CAPITALS if d.name == "spark" else "[A-Za-z]+"), "pos", "w")
    if d.name == "spark":  # counted before the join, which else brings all rows of a frequent token to one task
        tokens = f"SELECT w, lower({fixed}) AS f, count(*) AS n FROM ({words}) _w WHERE w <> upper(w) GROUP BY w"
        return f"SELECT t.w, k.word AS fixed, t.n FROM ({tokens}) t JOIN ({known}) k ON t.f = k.word"
    return f"SELECT t.w, k.word AS fixed, count(*) AS n FROM (SELECT w, lower({fixed}) AS f FROM ({words}) _w WHERE {d.like('w', '[VWXYZ]')} AND w <> upper(w)) t JOIN ({known}) k ON t.f = k.word GROUP BY t.w, k.word"


def _heights(d):
    return f"SELECT doc_id, line_no, line, CAST(800 - sum(CASE WHEN length(line) % 7 = 0 THEN 24 ELSE 12 END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS BIGINT) AS y FROM ({damaged_lines(d)}) _l"


def _vertical(d):  # W5: a gap beyond 1.4 leads opens a paragraph; the lead is the upper median of the gaps below 60
    gaps = f"SELECT *, lag(y) OVER (PARTITION BY doc_id ORDER BY line_no) - y AS gap FROM ({_heights(d)}) _h"
    whole = "div" if d.name == "spark" else "//"
    lead = f"SELECT doc_id, max(CASE WHEN i = n {whole} 2 + 1 THEN gap END) AS lead FROM (SELECT doc_id, gap, row_number() OVER (PARTITION BY doc_id ORDER BY gap) AS i, count(*) OVER (PARTITION BY doc_id) AS n FROM ({gaps}) _g WHERE gap > 0 AND gap < 60) _i GROUP BY doc_id"
    return f"SELECT doc_id, grp, {d.gather('trim(line)', 'line_no', ' ')} AS text FROM (SELECT g.*, sum(CASE WHEN g.gap * 10 > 14 * coalesce(m.lead, 16) THEN 1 ELSE 0 END) OVER (PARTITION BY g.doc_id ORDER BY g.line_no ROWS UNBOUNDED PRECEDING) AS grp FROM ({gaps}) g LEFT JOIN ({lead}) m ON g.doc_id = m.doc_id) _p WHERE trim(line) <> '' GROUP BY doc_id, grp"


def _levels(d):  # W25, O5: heading levels by the rank of the sizes present
    return f"SELECT doc_id, line_no, substr('######', 1, CAST(least(rank + 1, 6) AS INT)) || ' ' || trim(line) AS heading FROM (SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY length(line) % 9 DESC) AS rank FROM ({damaged_lines(d)}) _l WHERE {P.layout_heading(d, 'line')}) _m"


def _across_pages(d):  # W2: a page that ends within a sentence takes the next page's text
    flag = f"CASE WHEN before IS NULL OR {d.like('rtrim(before)', '[.!?”»)' + chr(92) + 'x27' + chr(34) + ']$')} THEN 1 ELSE 0 END"
    return f"""SELECT doc_id, grp, min(page_no) AS first_page, {d.gather('trim(page)', 'page_no', ' ')} AS text FROM (SELECT *, sum({flag}) OVER (PARTITION BY doc_id ORDER BY page_no ROWS UNBOUNDED PRECEDING) AS grp FROM (
      SELECT *, lag(page) OVER (PARTITION BY doc_id ORDER BY page_no) AS before FROM ({O.pages(d, feeds(d))}) _p) _q) _r GROUP BY doc_id, grp"""


def _spine(d):  # J1, J2: reading order with files and titles
    manifest = "SELECT 'user' AS id, 'a.html' AS href UNION ALL SELECT 'assistant', 'b.html'"
    return f"SELECT s.conv_id, s.turn AS pos, m.href, t.title FROM conversations s JOIN ({manifest}) m ON s.role = m.id LEFT JOIN (SELECT 'a.html' AS href, 'Question' AS title) t ON m.href = t.href"


def _sections_of_spine(d):  # W29: a titled unit opens a section, later ones join it
    units = "SELECT conv_id, turn AS pos, role || turn AS href, CASE WHEN turn % 3 = 1 THEN 'Section ' || turn END AS title FROM conversations"
    return f"SELECT conv_id, sec, max(title) AS title, {d.gather('href', 'pos', ',')} AS files FROM (SELECT *, count(title) OVER (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS sec FROM ({units}) _u) _v WHERE sec > 0 GROUP BY conv_id, sec"


def _local_notes(d):  # J5: anchors that point to ids of their own page
    refs = d.rows("SELECT page_id, html || '<a href=\"#fn1\">1</a><a href=\"#top\">x</a><p id=\"fn1\">note</p>' AS html FROM pages", d.all("html", r'href="#([A-Za-z0-9_-]+)"', 1), "pos", "target")
    return f"SELECT DISTINCT r.page_id, r.target FROM ({refs}) r WHERE {d.like('r.target', '^(fn|note|nota|n)[0-9]+$')} AND contains(r.html, 'id=\"' || r.target || '\"')"


def _pool_join(d):  # J6: notes of a section's group
    return f"SELECT p.doc_id, p.grp, p.n, p.body FROM ({O.note_pool(d, damaged_lines(d))}) p JOIN (SELECT 1 AS grp, 1 AS n UNION ALL SELECT 2, 1) s ON p.grp = s.grp AND p.n = s.n"


def _same_paragraphs(d):  # J9: paragraphs that a translation left as they were
    changed = f"SELECT doc_id, {R.fixes(d, 'text', (('the', 'de'),))} AS text FROM ({dirty(d)}) _x"
    return f"SELECT a.doc_id, a.para_no FROM ({_paras(d)}) a LEFT SEMI JOIN ({O.paragraphs(d, O.lines(d, changed))}) b ON a.doc_id = b.doc_id AND a.text = b.text WHERE length(a.text) > 40 AND NOT {d.like('a.text', '^#')}".replace("LEFT SEMI JOIN", "LEFT SEMI JOIN" if d.name == "spark" else "SEMI JOIN")


def _variants(d):  # J11: of a term's variants the first that any page has
    terms = "SELECT 'x' AS term, 1 AS rank, 'zzzz' AS v UNION ALL SELECT 'x', 2, 'the' UNION ALL SELECT 'x', 3, 'of' UNION ALL SELECT 'y', 1, 'der' UNION ALL SELECT 'y', 2, 'und'"
    hits = f"SELECT DISTINCT t.term, t.rank, t.v, p.doc_id, p.page_no FROM ({d.rows(O.pages(d, feeds(d)), R.tokens(d, 'page'), 'pos', 'w')}) p JOIN ({terms}) t ON p.w = t.v"
    return f"SELECT doc_id, term, v, count(*) AS pages FROM (SELECT *, min(rank) OVER (PARTITION BY doc_id, term) AS first FROM ({hits}) _h) _i WHERE rank = first GROUP BY doc_id, term, v"


def _without_titles(d):  # J16: headings whose folded text is a section's title go
    titles = "SELECT 'titleone' AS f UNION ALL SELECT 'dos'"
    anti = "LEFT ANTI JOIN" if d.name == "spark" else "ANTI JOIN"
    return f"SELECT l.doc_id, l.line_no, l.line FROM (SELECT *, CASE WHEN {d.like('line', '^#')} THEN {R.folded(d, 'line')} ELSE '' END AS f FROM ({damaged_lines(d)}) _l) l {anti} ({titles}) t ON l.f = t.f"


def _top(d):  # O1: the eight best passages
    return f"SELECT * FROM ({BUILDERS['q2_bm25'](d)}) _q ORDER BY score, doc_id, passage_no LIMIT 8"


def _first_hits(d):  # O2: at most five hits a document
    return f"SELECT doc_id, line_no FROM (SELECT doc_id, line_no, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS i FROM ({damaged_lines(d)}) _l WHERE contains(line, 'e')) _m WHERE i <= 5"


def _number_order(d):  # O4: numbers as strings, by length, then value
    return f"SELECT doc_id, m, row_number() OVER (PARTITION BY doc_id ORDER BY length(m), m) AS i FROM (SELECT DISTINCT doc_id, m FROM ({d.rows(dirty(d), d.all('text', '[0-9]+'), 'pos', 'm')}) _n) _o"


def _neighbours(d):  # O6: the lines before and after that aren't blank
    w = "(PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN "
    solid = "CASE WHEN trim(line) <> '' THEN line END"
    return f"SELECT doc_id, line_no, {d.last(solid)} OVER {w}UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, {d.first(solid)} OVER {w}1 FOLLOWING AND UNBOUNDED FOLLOWING) AS behind FROM ({damaged_lines(d)}) _l"


def _seen(d):  # O7: headings seen within the last sixty lines
    return f"SELECT doc_id, line_no, line, line_no - lag(line_no) OVER (PARTITION BY doc_id, line ORDER BY line_no) <= 60 AS again FROM ({O.lines(d, f'SELECT doc_id, text || text AS text FROM ({dirty(d)}) _t')}) _l WHERE {d.like('line', '^#')}"


def _first_success(d):  # E5: of a key's rows the first that succeeded
    return "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS i FROM events WHERE value > 50) _e WHERE i = 1"


def _kinds(d):  # G6
    return f"SELECT kind, count(*) AS n FROM ({O.artifacts(d, dirty(d))}) _a GROUP BY kind"


def _changes(d):  # G17: what a rewrite changed, and how often
    old, new = d.rows(f"SELECT doc_id, s FROM ({sentences(d)}) _s", d.split("s", " "), "pos", "w"), R.fixes(d, "w", (("an", "AN"), ("er$", "ER")))
    return f"SELECT w, fixed, count(*) AS n FROM (SELECT w, {new} AS fixed FROM ({old}) _w) _x WHERE w <> fixed GROUP BY w, fixed"


def _line_diff(d):  # L5: lines that only one side has
    new = f"SELECT doc_id, {R.collapse_spaces(d, 'line')} AS line FROM ({damaged_lines(d)}) _l"
    old = f"SELECT doc_id, line FROM ({damaged_lines(d)}) _l"
    return f"SELECT doc_id, '-' AS side, line FROM ({old} EXCEPT ALL {new}) _a UNION ALL SELECT doc_id, '+', line FROM ({new} EXCEPT ALL {old}) _b"


def _pool_file(d):  # P24: of a book's units whose names say notes the one with most of them, the first among equals, and how its notes are marked
    name = f"{d.ext('url', '([^/]*)/?$', 1)} || CASE page_id % 4 WHEN 0 THEN '_endnotes.xhtml' WHEN 1 THEN ' notas.xhtml' WHEN 2 THEN '_Footnote.html' ELSE '.xhtml' END"
    more = "CASE page_id % 5 WHEN 0 THEN '<p class=\"a footnote\" id=\"fn1\">x</p>' WHEN 1 THEN '<p id=\"nt3\">y</p><p id=\"note4\">z</p>' ELSE '' END"
    units = f"SELECT page_id % 25 AS book, page_id, {name} AS name, html || {more} AS html FROM pages"
    wordy = r"[^\p{L}\p{N}_]"
    named = d.like("lower(name)", f"footnote|endnote|(^|{wordy})(notas?|notes?)({wordy}|$)")
    score = "2 * " + d.n("html", 'class="[^"]*footnote') + " + " + d.n("html", '(?i)id="[^"]*(fn|nt|note)[0-9]')
    by_p = f"{d.like('html', '(?i)<p[^>]*id=' + chr(34) + '[^' + chr(34) + ']*(nt|note)[0-9]')} AND NOT {d.like('html', '<p[^>]*class=' + chr(34) + '[^' + chr(34) + ']*footnote')}"
    scored = f"SELECT book, page_id, {score} AS score, CASE WHEN {by_p} THEN 'by_p_id' ELSE 'by_a_id' END AS style FROM ({units}) _u WHERE {named}"
    best = lambda x: d.pick(x, d.struct("score", "-page_id"))
    return f"SELECT book, {best('page_id')} AS pool, {best('style')} AS style, max(score) AS score FROM ({scored}) _s GROUP BY book"


BUILDERS |= {
    "r3_ligature_map": _ligature_map, "w5_vertical_gaps": _vertical, "w25_heading_levels": _levels, "w2_across_pages": _across_pages, "j1_spine": _spine, "w29_spine_sections": _sections_of_spine, "j5_local_notes": _local_notes, "j6_pool_notes": _pool_join,
    "j9_left_as_they_were": _same_paragraphs, "j11_variants": _variants, "j16_without_titles": _without_titles, "o1_top_passages": _top, "o2_first_hits": _first_hits, "o4_number_order": _number_order, "o6_neighbours": _neighbours, "o7_seen_lately": _seen,
    "e1_array_difference": lambda d: f"SELECT doc_id, {d.join(d.sort(d.uniq(d.keep(d.all('text', '[0-9]+'), 'w', 'NOT ' + d.has(d.array(chr(39) + '1' + chr(39), chr(39) + '12' + chr(39)), 'w')))), ',')} AS rest FROM ({dirty(d)}) _d",
    "e3_dictionary": lambda d: f"SELECT word FROM ({O.word_counts(d, 'SELECT text FROM documents', 'latin')}) _w WHERE n >= 5 UNION SELECT lower(source) FROM documents",
    "e5_first_success": _first_success, "e6_distinct_in_order": lambda d: f"SELECT doc_id, {d.join(d.uniq(d.all('text', '[A-Z]{2,}')), ' ')} AS s FROM ({dirty(d)}) _d",
    "g6_kinds": _kinds, "g17_changes": _changes, "l5_line_diff": _line_diff, "p24_note_pools": _pool_file, "r19_stray_preface": lambda d: O.leading_run(d, _paras(d), d.like("lower(trim(text))", "^(prefacio|introducci[oó]n|pr[oó]logo)$")),
    "r44_file_titles": lambda d: f"SELECT doc_id, {R.slug(d, R.first_title(d, 'text'), lower=True)} AS name FROM ({dirty(d)}) _d",
    "k2_report": lambda d: f"SELECT doc_id, count(*) AS changed FROM ({_line_diff(d)}) _c WHERE side = '-' GROUP BY doc_id",
}


def _scanned_pages(d):
    """Documents as OCR pages, with furniture, capitals, broken words and paragraphs, and notes."""
    one = "\f12\nRUNNING HEAD\nPREFACIO\n\nTHE PART IN CAPITALS\n\nTbe text is bro-\nken here and tbe rest of the para-\n\ngraph goes on behind the break, as it does in\n   An indented paragraph of the book\f\nthat goes on upon the next page. 54facil.\n\n• 47 •\n"
    two = "\nNOTES\n1. A note that runs\nover two lines\n2. Another note\n"
    return f"SELECT doc_id, {R.chain(d, 'coalesce(text, ' + chr(39) * 2 + ')', (chr(10), chr(10) * 2))} || {d.lit(one)} || CASE WHEN doc_id % 2 = 0 THEN {d.lit(two)} ELSE '' END AS text FROM documents"


def _pairs_of_translation(d):
    changed = R.fixes(d, "text", (("the", "thee"), (r"[0-9]+", "7"), (r"\[\^3\]", "[^9]"), ("(?m)^## ", "# ")))
    return f"SELECT doc_id, text AS o, CASE WHEN doc_id % 4 = 0 THEN text ELSE {changed} END AS t FROM ({dirty(d)}) _d"


BUILDERS |= {
    "c1_academic_clean": lambda d: B.clean_chapters(d, f"SELECT doc_id, text || ' Wnal oYce Xow WWF waVle Wnal.' AS text FROM ({_opened(d)}) _o", f"SELECT w, min(fixed) AS fixed FROM ({_ligature_map(d)}) _m GROUP BY w"),
    "c2_book_sections": lambda d: B.book_section(d, _scanned_pages(d), "'Prefacio'"),
    "c9_ocr_sections": lambda d: B.ocr_section(d, _scanned_pages(d), "'Section ' || doc_id"),
    "c10_docling_clean": lambda d: B.docling_section(d, f"SELECT doc_id, text || {d.lit(chr(10) + '|' + chr(10) + '| |' + chr(10) + 'Acade ´mie, 5 th , O Y cina')} AS text FROM ({dirty(d)}) _d", "'# Notes'"),
    "g11_translation_verdicts": lambda d: B.translation_findings(d, _pairs_of_translation(d), ("token", "thee")),
}


def run_sql(spark: SparkSession, sf_dir: str, builder: Callable[..., str]) -> DataFrame:
    """The query over the tables of a folder; they are bound by value, so no view of the session is replaced."""
    text = builder(SPARK)
    named = {name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in TABLES if re.search(rf"(FROM|JOIN) {name}\b", text)}
    for name in named:
        text = re.sub(rf"\b(FROM|JOIN) {name}\b", rf"\1 {{{name}}}", _braced(text) if name == next(iter(named)) else text)
    return spark.sql(text, **named) if named else spark.sql(text)


def _braced(text: str) -> str:
    """Braces of the text itself, doubled for the formatter that binds the tables."""
    return text.replace("{", "{{").replace("}", "}}")


def _folded(function: Callable[[str], str], table: Callable[..., str] = dirty) -> Callable[[SparkSession, str], DataFrame]:
    """A fold over every damaged document; no SQL twin, tests hold the fold to its rules."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return folds.text_map(run_sql(spark, sf_dir, table), function)

    return run


def _html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return folds.rows_map(pages, folds.html_blocks, "page_id long, block_no int, kind string, md string", "page_id", "html")


def _gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark passage against a copy from which words were taken."""
    pairs = spark.read.parquet(f"{sf_dir}/benchmark.parquet").selectExpr("item_id", "text", "array_join(filter(split(text, ' '), (w, i) -> i < 4 OR i > 8), ' ') AS got")
    return folds.rows_map(pairs, lambda a, b: folds.gaps(a, b), "item_id long, tag string, place int, span string", "item_id", "text", "got")


def _completeness_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 10 MB at most go to every executor, so that no run of a document is shuffled for them."""
    size = spark.read.parquet(f"{sf_dir}/benchmark.parquet").selectExpr("coalesce(sum(length(text)), 0)").first()[0]
    return run_sql(spark, sf_dir, lambda d: _completeness(d, "/*+ BROADCAST(a) */" if size <= 10_000_000 else ""))


FOLDS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "w6_running_headers": _folded(folds.drop_running_headers),
    "w17_rebuilt_notes": _folded(folds.rebuild_notes),
    "r25_glued_marks": _folded(lambda t: folds.glued_marks(t, {1, 2, 3, 4, 11})),
    "r26_split_marks": _folded(lambda t: folds.split_marks(t, set(range(10, 60)))),
    "r8_romans": _folded(folds.fix_romans, lambda d: f"SELECT doc_id, coalesce(text, '') || {_case(d, SENTENCES)} AS text FROM documents"),
    "q3_snippets": _folded(lambda t: folds.snippet(t, {"the", "ersh", "der"})),
    "r31_strip_command": _folded(lambda t: folds.strip_command(t, "chapter")),
    "h2_html_blocks": _html_blocks,
    "l1_gaps": _gaps,
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = FOLDS | {name: (lambda b: lambda spark, sf_dir: run_sql(spark, sf_dir, b))(b) for name, b in BUILDERS.items()} | {"l2_completeness": _completeness_of}
SQL: dict[str, str] = {name: b(DUCK) for name, b in BUILDERS.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full-text ranking over the passages of all documents."""
    return QUERIES["q2_bm25"](spark, sf_dir)
