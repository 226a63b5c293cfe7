import itertools
import random

from pyspark.sql import functions as F

from quillspark.llm import urls

PAGES = "page_id long, url string, html string, rule string, n_rules int, t string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, "h", "r", 9, "t") for i, u in rows], PAGES)


def test_tokens(spark):
    df = pages(spark, [(1, "HTTPS://m.cheap-pills.example.net:80/en/12/a.html?x=1&y=2#top"), (2, "no scheme/at"), (3, ""), (4, None)])
    got = {r.page_id: set(r.t2) for r in df.withColumn("t2", urls.tokens(F.col("url"))).collect()}
    assert got[1] == {"scheme=https", "host=m.cheap-pills.example.net", "sub=m", "domain=example.net", "top=net", "word=cheap", "word=pills", "ext=html", "path=en", "path=99", "path=a", "path=html", "query=x", "query=y", "frag=top"}
    assert got[3] == got[4] == set()


def test_rules_against_brute_force(spark):
    r = random.Random(4)
    rows, labels = [], []
    for k in range(600):
        host, lang, tail = r.choice(["a", "b", "casino-win", "ads"]), r.choice(["en", "de"]), r.choice(["", "?ref=1"])
        rows.append((k, f"http://{host}.example.org/{lang}/x{tail}"))
        bad = (host == "casino-win" and r.random() < 0.95) or (host == "ads" and lang == "de" and tail and r.random() < 0.9) or r.random() < 0.05
        labels.append((k, 0 if bad else 1, 0, "z"))
    df, lab = pages(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, url string")
    bad = {k for k, q, *_ in labels if q == 0}
    rules = by_counting(tokens_of(df), {k: k in bad for k, *_ in labels}, 0.4)
    mined = urls.mine(df, lab)
    assert {tuple(x.rule): (x.confidence, x.sure) for x in mined.collect()} == rules and {s for _, s in rules.values()} == {True, False}
    check_matches(df, mined, rules)


def tokens_of(df):
    return {x.page_id: frozenset(x.t2) for x in df.withColumn("t2", urls.tokens(F.col("url"))).collect()}


def by_counting(sets, bad, least, longest=99):
    """Rules of every combination of tokens, with their confidence and whether they are sure."""
    sets = {k: s for k, s in sets.items() if k in bad and s}
    n = len(sets)
    base = sum(bad[k] for k in sets) / n
    own: dict = {}
    for k, s in sets.items():
        for size in range(1, min(len(s), longest) + 1):
            for c in itertools.combinations(sorted(s), size):
                own.setdefault(c, []).append(bad[k])
    rules = {}
    for c, hits in own.items():
        share = sum(hits) / len(hits)
        if sum(hits) >= max(0.002 * n, 5) and share >= least:
            rules[c] = (round(share, 6), (share - base) / (base * (1 - base) / len(hits)) ** 0.5 >= 4)
    return {c: v for c, v in rules.items() if not any(set(d) < set(c) and w[0] >= v[0] and (w[1] or not v[1]) for d, w in rules.items())}


def check_matches(df, mined, rules):
    sets = tokens_of(df)
    for x in urls.match(df, mined).collect():
        hits = [v for c, v in rules.items() if set(c) <= sets[x.page_id]]
        assert x.n_rules == len(hits) and x.block == any(s for _, s in hits) and x.confidence == max((v for v, _ in hits), default=None)


def test_rules_on_the_supplied_pages_against_brute_force(spark):
    df, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("pages", "labels"))
    bad = {r.doc_id: bool(r.quality == 0 or r.toxic == 1) for r in labels.collect()}
    owner = {r.page_id: r.d for r in df.select("page_id", urls.document(F.col("url"), F.col("page_id")).alias("d")).collect()}
    rules = by_counting(tokens_of(df), {k: bad[d] for k, d in owner.items() if d in bad}, 0.2)
    mined = urls.mine(df, labels, least_confidence=0.2)
    assert {tuple(x.rule): (x.confidence, x.sure) for x in mined.collect()} == rules and rules
    check_matches(df, mined, rules)


def test_awkward_rows(spark):
    df = pages(spark, [(1, None), (2, ""), (None, "http://a.b/c"), (3, "http://a.b/c"), (3, "http://a.b/c"), (4, "x" * 100_000)])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    lab = spark.createDataFrame([(3, None, None), (3, 0, None), (None, 0, 1), (3, 1, 0), (9, 0, 0)], "doc_id long, quality int, toxic int")
    for labels in (none, lab):
        got = urls.screen(df, labels).collect()
        assert len(got) == 6 and not any(r.block for r in got) and all(r.n_rules == 0 for r in got)
    assert urls.screen(df.limit(0), lab).count() == 0


def test_labels_of_the_document_in_the_url(spark):
    rows = [(k, f"http://{'casino' if d % 4 == 0 else 'fine'}.example.org/en/{d}{('', '/', '.html', '?page=2', '#top')[k % 5]}") for k in range(400) for d in [(k * 7 + 3) % 400]]
    lab = spark.createDataFrame([(d, 0 if d % 4 == 0 else 1, 0) for d in range(400)], "doc_id long, quality int, toxic int")
    got = urls.screen(pages(spark, rows), lab).collect()
    assert len(got) == 400 and all(r.block == ("casino" in r.url) for r in got)
    some = pages(spark, [(7, "http://a.b/en/12.html"), (7, "http://a.b/12/x"), (7, "http://a.b?p=12"), (7, None), (7, "a.b/c/00012/#3")])
    assert [r[0] for r in some.select(urls.document(F.col("url"), F.col("page_id"))).collect()] == [12, 7, 7, 7, 12]
