"""Operator 8: secret scans by dictionary-primed zstandard novelty.

A candidate is a string in a sensitive context: a value assigned to a name such as password, token or
api_key, a bearer header, a token with a well-known prefix, or a private key block. Its novelty is the
number of bytes by which it lengthens the compressed form of its surroundings (the `around` characters on either side), with a compressor
primed with two dictionaries: placeholders and the words of ordinary code, and the identifiers that most documents of the corpus use (`identifiers`,
at most `most` of them). What reads like code or prose costs little, what was drawn at random costs nearly its entropy. Candidates whose marginal
bytes reach `least_bytes` and `least_share` of their length are reported, but for assigned values that split into
ordinary words.

Defined results: null or empty texts have no findings. Repeated rows give repeated findings; a null
doc_id stays null in them. Findings of one document come in the order of their places and don't
overlap. An empty table gives no rows. Whole texts are scanned, at any length. Identifiers that as many documents use are taken in
alphabetical order. Extra columns are left aside by `find` and kept by `redacted`, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.shared import flat, slices, trimmed

IDENTIFIERS = (
    "null None undefined true false example sample changeme change_me your_password_here your-token-here "
    "insert_key_here placeholder dummy default secret password passwd token api_key apikey access_key private_key client_secret "
    "credential authorization bearer username user admin root localhost config settings environment getenv os.environ process.env "
    "def class return import from public private static final void string const let var function lambda self this new int float bool "
    "get_password set_token read_secret load_credentials access_token refresh_token session_token auth_token csrf_token "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 1234567890 123456 qwerty letmein xxxxxxxxxxxxxxxx ****************  "
    "/usr/local/bin /etc/ssl/private /home/user https://www.example.com/index.html http://localhost:8080/api/v1/ .json .yaml .txt .py .env "
).encode()

#: Words that an assigned value may consist of without being a secret, besides those of IDENTIFIERS.
ORDINARY = frozenset(
    re.findall("[a-z]{3,}", re.sub("abcdef[a-z]+|x{4,}", "", IDENTIFIERS.decode().lower()))
    + """
    about above access account action active address after again against all already also always among and another any application are array authentication
    authorized available back base basic because been before begin being below between binary block body both boolean buffer build button byte call can cannot
    case change character check child class clear client close cloud code column command common company complete connection constant container content context
    control cookie copy correct could count create current custom data database date day decode delete demo deploy description development different directory
    disabled document does domain done down each element email empty enabled encode end ensure entry enum environment error event every execute expected expired
    field file filter find first following for format forgotten found from full general generate given global good great group hash have header hello help here
    hidden host how http https identifier implementation important include index info input instance integer internal into invalid item its javascript json
    just keep key known language last length level library line link list load local log login long lookup made main make manager many map master matching
    message method missing mode model module more most must name need needed network never next node none not nothing null number object offer one only open
    operation option optional order other our output over owner package page parameter parse part path person please point policy possible previous principal
    process production project property provider public query random read ready received record reference register regular remote remove replace request required
    reset resource response result right role root rule same sample save schema scope search section see select send server service session should show sign
    signature simple since single size some source special standard start state status still stored string strong such super support system table tag take
    temporary test testing text than that the their them then there these they this those through time timeout true type undefined under unique unknown until update
    upload url used user username using valid validate value variable verify version very view want was web welcome well were what when where which while will window
    with within without word words world would write written wrong your
    """.split()
)
_NAMES = r"pass(?:word|wd|phrase)|(?<![a-z])(?:db|user|root|admin)?pass(?![a-z])|pwd|secrets?|tokens?|api[ _-]?keys?|access[ _-]?keys?|auth(?:orization)?|bearer|credentials?|private[ _-]?keys?|signing[ _-]?keys?|encryption[ _-]?keys?"
_KEYS = re.compile(_NAMES + r"|AKIA|ASIA|AIza|gh[pousr]_|xox[abprs]-|sk_live_|sk-|glpat-|eyJ|-----BEGIN", re.I)
# every match of _KEYS holds one of these in lower case; most texts hold none
_HINTS = ("pass", "pwd", "secret", "token", "key", "auth", "bearer", "credential", "akia", "asia", "aiza", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xox", "sk_live_", "sk-", "glpat-", "eyj", "-----begin")
_ASSIGNED = re.compile(r"""[\w.-]{0,40}["'\]]{0,2}[ \t]{0,4}(?::=|=>|=|:|[ \t])[ \t]{0,4}(?:bearer[ \t]{1,4}|basic[ \t]{1,4})?["'`]?([A-Za-z0-9+/_~.!@#$%^&*=-]{8,})""", re.I)
_SHAPES = [
    ("access_key_id", re.compile(r"A(?:KIA|SIA)[0-9A-Z]{16}(?![0-9A-Za-z])")),
    ("api_key", re.compile(r"AIza[0-9A-Za-z_-]{30,}|sk_live_[0-9A-Za-z]{16,}|sk-[0-9A-Za-z_-]{20,}|glpat-[0-9A-Za-z_-]{16,}")),
    ("forge_token", re.compile(r"gh[pousr]_[0-9A-Za-z]{20,}|xox[abprs]-[0-9A-Za-z-]{10,}")),
    ("web_token", re.compile(r"eyJ[\w-]{8,}\.[\w-]{8,}\.[\w-]{4,}")),
    ("private_key", re.compile(r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----[A-Za-z0-9+/=\s]+(?:-----END [A-Z ]{0,40}PRIVATE KEY-----)?")),
]
SCHEMA = "doc_id long, begin long, end long, kind string, digest string, n_chars long, marginal_bytes long, share double"


def ordinary(value: str) -> bool:
    """Whether a value is made of letters and splits into ordinary words, joined or parted by _ . or -"""
    if not re.fullmatch(r"[A-Za-z]+(?:[_.-][A-Za-z]+)*", value):
        return False
    for part in re.split("[_.-]", value.lower()):
        ends = {0}
        for k in range(3, len(part) + 1):
            if any(part[j:k] in ORDINARY for j in ends if k - j <= 14):
                ends.add(k)
        if len(part) not in ends:
            return False
    return True


class Scanner:
    def __init__(self, least_bytes: int = 8, least_share: float = 0.45, around: int = 1024, mined: tuple[str, ...] = ()):
        self.least_bytes, self.least_share, self.around = least_bytes, least_share, around
        words = zstandard.ZstdCompressionDict(" ".join([*reversed(mined), ""]).encode() + IDENTIFIERS, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.zstd = zstandard.ZstdCompressor(level=12, dict_data=words, write_checksum=False, write_content_size=False, write_dict_id=False)

    def candidates(self, text: str) -> Iterator[tuple[int, int, str]]:
        """begin, end and kind; the next one begins behind the last."""
        low = text.lower()
        if not any(x in low for x in _HINTS):
            return
        past = 0
        for hit in _KEYS.finditer(text):
            if hit.start() < past:
                continue
            for kind, shape in _SHAPES:
                m = shape.match(text, hit.start())
                if m:
                    past = m.end()
                    yield m.start(), m.end(), kind
                    break
            else:
                m = _ASSIGNED.match(text, hit.end())
                # without an operator, only these two names have values
                if m and (re.search("[=:]", text[hit.end() : m.start(1)]) or hit.group().lower() in ("bearer", "authorization")):
                    end = m.end(1)
                    while end > m.start(1) and text[end - 1] in ".!,":
                        end -= 1
                    if end - m.start(1) >= 8:
                        past = end
                        yield m.start(1), end, "password" if re.search("pass|pwd", hit.group(), re.I) else "token"

    def novelty(self, text: str, begin: int, end: int) -> int:
        """Bytes that the string adds to the compressed form of what stands around it, without other copies of itself."""
        value = text[begin:end]
        near = (text[max(0, begin - self.around) : begin] + text[end : end + self.around]).replace(value, "").encode("utf-8", "replace")
        return len(self.zstd.compress(near + value.encode("utf-8", "replace"))) - len(self.zstd.compress(near))

    def scan(self, text: str) -> list[tuple]:
        """begin, end, kind, digest, n_chars, marginal_bytes, share of each finding."""
        out = []
        for begin, end, kind in self.candidates(text):
            value = text[begin:end]
            cost = self.novelty(text, begin, end)
            share = cost / len(value)
            plain = kind in ("password", "token") and ordinary(value)
            if cost >= self.least_bytes and share >= self.least_share and not plain:
                out.append((begin, end, kind, hashlib.sha256(value.encode("utf-8", "replace")).hexdigest()[:16], len(value), cost, round(share, 4)))
        return out


_IDENTIFIER = re.compile(r"(?<![\w-])(?:[A-Za-z]{2,14}(?:_[A-Za-z]{2,14})+|[a-z]{2,14}(?:[A-Z][a-z]{1,14})+)(?![\w-])")
_HUMP = re.compile("[a-z][A-Z]")


def identifiers(docs: DataFrame, most: int = 2000) -> tuple[str, ...]:
    """The `most` names like snake_case or camelCase that most documents use, in that order, of those that several use.

    All documents are counted. Names with a digit, and what stands where a secret would, don't count, so copies of one don't get into the dictionary.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scanner()
        for batch in batches:
            text = flat(batch.column("text"))
            for a, b in slices(text):
                times: Counter[str] = Counter()
                for t in text.slice(a, b - a).to_pylist():
                    if t and ("_" in t or _HUMP.search(t)):
                        spans = [(x, y) for x, y, _ in s.candidates(t)]
                        times.update({m.group() for m in _IDENTIFIER.finditer(t) if not any(x < m.end() and m.start() < y for x, y in spans)})
                if times:
                    yield pa.RecordBatch.from_arrays([pa.array(list(times), pa.string()), pa.array(list(times.values()), pa.int64())], ["name", "n"])

    found = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(trimmed(run), "name string, n long").groupBy("name").agg(F.sum("n").alias("n")).filter("n > 1")
    return tuple(r.name for r in found.orderBy(F.desc("n"), "name").limit(most).collect())


def find(docs: DataFrame, mined: tuple[str, ...] | None = None, **how) -> DataFrame:
    """One row a finding, in one narrow map behind the count of identifiers. The secret itself isn't returned, a digest is."""
    mined = identifiers(docs) if mined is None else mined

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scanner(mined=mined, **how)
        for batch in batches:
            text, ids = flat(batch.column("text")), batch.column("doc_id").to_pylist()
            for a, b in slices(text):
                rows = [(d, *x) for d, t in zip(ids[a:b], text.slice(a, b - a).to_pylist()) if t for x in s.scan(t)]
                if rows:
                    cols = list(zip(*rows))
                    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.float64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], [x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(trimmed(run), SCHEMA)


def redact(text: str, found: list[tuple]) -> str:
    out, past = [], 0
    for begin, end, *_ in found:
        out += [text[past:begin], "[SECRET]"]
        past = end
    return "".join([*out, text[past:]])


def redacted(docs: DataFrame, mined: tuple[str, ...] | None = None, **how) -> DataFrame:
    """The same rows and columns; each secret in text is replaced by [SECRET] and n_chars, if there, follows."""
    where = docs.columns.index("text")
    counted = docs.columns.index("n_chars") if "n_chars" in docs.columns else None
    mined = identifiers(docs) if mined is None else mined

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scanner(mined=mined, **how)
        for whole in batches:
            for a, b in slices(flat(whole.column(where))):
                batch = whole.slice(a, b - a)
                texts = batch.column(where).to_pylist()
                sizes = None if counted is None else batch.column(counted).to_pylist()
                changed = False
                for k, t in enumerate(texts):
                    found = s.scan(t) if t else []
                    if found:
                        texts[k] = redact(t, found)
                        changed = True
                        if sizes:
                            sizes[k] = len(texts[k])
                if changed:
                    cols = batch.columns
                    cols[where] = pa.array(texts, batch.schema.field(where).type)
                    if sizes:
                        cols[counted] = pa.array(sizes, batch.schema.field(counted).type)
                    batch = pa.RecordBatch.from_arrays(cols, schema=batch.schema)
                yield batch

    return docs.mapInArrow(trimmed(run), docs.schema)
