"""One relational expression, two engines: Spark SQL to run, DuckDB SQL to check against.

Patterns are regular expressions that Java and RE2 read alike: Unicode classes instead of \\w, no
look-around, \\x27 for an apostrophe. Replacements refer to groups as \\1.
"""

from __future__ import annotations

import itertools
import re
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

ACCENTED = "áàâäãåāăąéèêëēĕėęěíìîïīĭįóòôöõōŏőúùûüũūŭůűñńňçćčýÿžźżšśşťţďłŕřğ"
PLAIN = "aaaaaaaaaeeeeeeeeeiiiiiiioooooooouuuuuuuuunnncccyyzzzsssttdlrrg"
COMPOSED: dict[str, list[tuple[str, str]]] = {}
for _c in ACCENTED + ACCENTED.upper():
    _parts = unicodedata.normalize("NFD", _c)
    if len(_parts) == 2:
        COMPOSED.setdefault(_parts[1], []).append((_parts[0], _c))


_NAMES = itertools.count()


class SparkDialect:
    name = "spark"

    def let(self, x: str, body: Callable[[str], str]) -> str:
        """body of a name for x. Spark evaluates an expression again in each place of a CASE; what a lambda is called with it evaluates once."""
        v = f"_v{next(_NAMES)}"
        return f"transform(array({x}), {v} -> {body(v)})[0]"

    def rewrite(self, x: str, *rules: tuple[str, str, str]) -> str:
        """Replacements in turn, each of (a string that every match holds, pattern, to); a text without that string isn't searched."""
        each = ", ".join(f"named_struct('m', {self.lit(m)}, 'p', {self.pat(p)}, 'to', {self.to(to)})" for m, p, to in rules)
        t, f = f"_t{next(_NAMES)}", f"_f{next(_NAMES)}"
        return f"aggregate(array({each}), {x}, ({t}, {f}) -> CASE WHEN contains({t}, {f}.m) THEN regexp_replace({t}, {f}.p, {f}.to) ELSE {t} END)"

    def to(self, to: str) -> str:
        return self.lit(re.sub(r"\\(\d)", lambda m: "\x01" + m[1], to).replace("\\", "\\\\").replace("$", "\\$").replace("\x01", "$"))

    def lit(self, s: str) -> str:
        return "'" + s.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\t", "\\t").replace("\f", "\\u000C") + "'"

    def pat(self, p: str) -> str:
        return self.lit(p.replace(r"\p{Latin}", r"\p{IsLatin}"))

    def rep(self, x: str, p: str, to: str) -> str:
        return f"regexp_replace({x}, {self.pat(p)}, {self.to(to)})"

    def like(self, x: str, p: str) -> str:
        return f"({x} RLIKE {self.pat(p)})"

    def n(self, x: str, p: str) -> str:
        return f"CAST(regexp_count({x}, {self.pat(p)}) AS BIGINT)"

    def chars(self, x: str, one: str) -> str:
        """How many characters match a pattern of one character; runs of them go at once."""
        return f"CAST(length({x}) - length(regexp_replace({x}, {self.pat(one + '+')}, '')) AS BIGINT)"

    def strip(self, x: str) -> str:
        return self.rep(x, r"^\s+|\s+$", "")

    def all(self, x: str, p: str, g: int = 0) -> str:
        return f"regexp_extract_all({x}, {self.pat(p)}, {g})"

    def ext(self, x: str, p: str, g: int = 0) -> str:
        return f"regexp_extract({x}, {self.pat(p)}, {g})"

    def split(self, x: str, p: str) -> str:
        return f"split({x}, {self.pat(p)}, -1)"

    def each(self, a: str, v: str, e: str) -> str:
        return f"transform({a}, {v} -> {e})"

    def keep(self, a: str, v: str, e: str) -> str:
        return f"filter({a}, {v} -> {e})"

    def some(self, a: str, v: str, e: str) -> str:
        return f"exists({a}, {v} -> {e})"

    def join(self, a: str, sep: str) -> str:
        return f"array_join({a}, {self.lit(sep)})"

    def size(self, a: str) -> str:
        return f"CAST(size({a}) AS BIGINT)"

    def at(self, a: str, i: str) -> str:
        return f"try_element_at({a}, CAST({i} AS INT))"

    def cut(self, a: str, first: int, n: int) -> str:
        return f"slice({a}, {first}, {n})"

    def part(self, a: str, first: str, n: str) -> str:
        return f"slice({a}, CAST({first} AS INT), CAST(greatest({n}, 0) AS INT))"

    def places(self, a: str) -> str:
        """1 to the size of an array; nothing, where it is empty."""
        return f"slice(sequence(1, greatest(size({a}), 1)), 1, size({a}))"

    def struct_named(self, *pairs: tuple[str, str]) -> str:
        return f"named_struct({', '.join(f'{chr(39)}{k}{chr(39)}, {v}' for k, v in pairs)})"

    def listed(self, item: str) -> str:
        """All items of a group, in their own order."""
        return f"array_sort(collect_list({item}))"

    def uniq(self, a: str) -> str:
        return f"array_distinct({a})"

    def sort(self, a: str) -> str:
        return f"array_sort({a})"

    def has(self, a: str, v: str) -> str:
        return f"array_contains({a}, {v})"

    def array(self, *xs: str) -> str:
        return f"array({', '.join(xs)})"

    def largest(self, a: str) -> str:
        return f"array_max({a})"

    def rows(self, rel: str, a: str, pos: str, item: str) -> str:
        return f"SELECT _r.*, {pos}, {item} FROM ({rel}) _r LATERAL VIEW posexplode({a}) _e AS {pos}, {item}"

    def gather(self, item: str, pos: str, sep: str) -> str:
        return f"array_join(transform(array_sort(collect_list(struct({pos} AS p, {item} AS s))), z -> z.s), {self.lit(sep)})"

    def collect(self, item: str, pos: str) -> str:
        return f"transform(array_sort(collect_list(struct({pos} AS p, {item} AS s))), z -> z.s)"

    def last(self, x: str) -> str:
        return f"last_value({x}) IGNORE NULLS"

    def first(self, x: str) -> str:
        return f"first_value({x}) IGNORE NULLS"

    def composed(self, x: str) -> str:
        """Letters with combining marks as one character (NFC), for the letters of ACCENTED and their capitals."""

        def done(v: str) -> str:
            for mark, pairs in COMPOSED.items():
                for a, b in pairs:
                    v = f"replace({v}, '{a}{mark}', '{b}')"
            return v

        # the chain is for lines with such a mark alone
        return self.let(x, lambda v: f"CASE WHEN {self.like(v, '[' + ''.join(COMPOSED) + ']')} THEN {done(v)} ELSE {v} END")

    def plain(self, x: str) -> str:
        """ASCII alone: accented letters without their marks, everything else outside ASCII gone."""
        return self.rep(f"translate({self.composed(x)}, '{ACCENTED}{ACCENTED.upper()}', '{PLAIN}{PLAIN.upper()}')", r"[^\x00-\x7f]", "")

    def fold(self, x: str) -> str:
        return f"translate(lower({x}), '{ACCENTED}', '{PLAIN}')"

    def upto(self, a: str, b: str) -> str:
        return f"sequence(CAST({a} AS INT), CAST({b} AS INT))"

    def num(self, x: str) -> str:
        return f"try_cast({x} AS BIGINT)"

    def char(self, hexa: str) -> str:
        return f"decode(unhex({hexa}), 'UTF-16BE')"

    def pick(self, what: str, by: str, most: bool = True) -> str:
        return f"{'max' if most else 'min'}_by({what}, {by})"

    def struct(self, *xs: str) -> str:
        return f"struct({', '.join(xs)})"


class DuckDialect(SparkDialect):
    name = "duckdb"

    def let(self, x: str, body: Callable[[str], str]) -> str:
        return body(x)

    def lit(self, s: str) -> str:
        parts = re.split("([\n\t\f])", s)
        out = [f"chr({ord(x)})" if x in "\n\t\f" else "'" + x.replace("'", "''") + "'" for x in parts if x]
        return "(" + " || ".join(out) + ")" if len(out) > 1 else (out or ["''"])[0]

    def pat(self, p: str) -> str:
        return self.lit(p)

    def rep(self, x: str, p: str, to: str) -> str:
        to = re.sub(r"\\(\d)", lambda m: "\x01" + m[1], to).replace("\\", "\\\\").replace("\x01", "\\")
        return f"regexp_replace({x}, {self.pat(p)}, {self.lit(to)}, 'g')"

    def like(self, x: str, p: str) -> str:
        return f"regexp_matches({x}, {self.pat(p)})"

    def n(self, x: str, p: str) -> str:
        return f"CAST(len(regexp_extract_all({x}, {self.pat(p)})) AS BIGINT)"

    def chars(self, x: str, one: str) -> str:
        return f"CAST(length({x}) - length(regexp_replace({x}, {self.pat(one)}, '', 'g')) AS BIGINT)"

    def split(self, x: str, p: str) -> str:
        return f"string_split_regex({x}, {self.pat(p)})"

    def each(self, a: str, v: str, e: str) -> str:
        return f"list_transform({a}, lambda {v}: {e})"

    def keep(self, a: str, v: str, e: str) -> str:
        return f"list_filter({a}, lambda {v}: {e})"

    def some(self, a: str, v: str, e: str) -> str:
        return f"(len(list_filter({a}, lambda {v}: {e})) > 0)"

    def join(self, a: str, sep: str) -> str:
        return f"coalesce(array_to_string({a}, {self.lit(sep)}), '')"

    def size(self, a: str) -> str:
        return f"CAST(len({a}) AS BIGINT)"

    def at(self, a: str, i: str) -> str:
        return f"({a})[{i}]"

    def cut(self, a: str, first: int, n: int) -> str:
        return f"list_slice({a}, {first}, {first + n - 1})"

    def part(self, a: str, first: str, n: str) -> str:
        return f"list_slice({a}, CAST({first} AS INT), CAST({first} AS INT) + CAST({n} AS INT) - 1)"

    def places(self, a: str) -> str:
        return f"range(1, len({a}) + 1)"

    def struct_named(self, *pairs: tuple[str, str]) -> str:
        return "{" + ", ".join(f"'{k}': {v}" for k, v in pairs) + "}"

    def listed(self, item: str) -> str:
        return f"list_sort(list({item}))"

    def uniq(self, a: str) -> str:
        # list_distinct has no order; keep the first of each
        return f"list_filter({a}, lambda q, i: list_position({a}, q) = i)"

    def sort(self, a: str) -> str:
        return f"list_sort({a})"

    def has(self, a: str, v: str) -> str:
        return f"list_contains({a}, {v})"

    def array(self, *xs: str) -> str:
        return f"[{', '.join(xs)}]"

    def largest(self, a: str) -> str:
        return f"list_max({a})"

    def rows(self, rel: str, a: str, pos: str, item: str) -> str:
        return f"SELECT * EXCLUDE (_a), CAST(generate_subscripts(_a, 1) - 1 AS INT) AS {pos}, unnest(_a) AS {item} FROM (SELECT *, {a} AS _a FROM ({rel}) _r)"

    def gather(self, item: str, pos: str, sep: str) -> str:
        return f"string_agg({item}, {self.lit(sep)} ORDER BY {pos})"

    def collect(self, item: str, pos: str) -> str:
        return f"list({item} ORDER BY {pos})"

    def last(self, x: str) -> str:
        return f"last_value({x} IGNORE NULLS)"

    def first(self, x: str) -> str:
        return f"first_value({x} IGNORE NULLS)"

    def fold(self, x: str) -> str:
        return f"strip_accents(lower({x}))"

    def upto(self, a: str, b: str) -> str:
        return f"range(CAST({a} AS INT), CAST({b} AS INT) + 1)"

    def composed(self, x: str) -> str:
        return f"nfc_normalize({x})"

    def char(self, hexa: str) -> str:
        return f"chr(('0x' || {hexa})::INT)"

    def pick(self, what: str, by: str, most: bool = True) -> str:
        return f"arg_{'max' if most else 'min'}({what}, {by})"

    def struct(self, *xs: str) -> str:
        return f"row({', '.join(xs)})"


SPARK, DUCK = SparkDialect(), DuckDialect()


def column(function, *names: str, **params) -> Column:
    """A function of this package as a Column over the named columns: column(page_number, "line")."""
    return F.expr(function(SPARK, *names, **params))
