"""Operator 9: mixing sources to target weights.

Documents fall in cells (source, language, topic). Iterative proportional fitting rakes the cells'
token weights until the three marginals meet their targets; a cell's ratio is its raked tokens over its
own. Raking stops where no marginal is off by more than `close` of the total, or after `sweeps` rounds. The inclusion probability of a document is min(1, c * ratio) of its cell, with the c at which
the expected tokens meet the budget. Documents are drawn by a hash of doc_id against it.

Targets not given are the table's own marginals raised to the power `temper` and normalised, which
takes weight from the hot categories. Given targets are normalised over the categories that occur; a
category that isn't named there has the target 0.

Defined results: null source or language is a category of its own, "(none)"; null or empty text
has no tokens and the topic "empty", its cell's probability is 1 where no cell weighs anything. Repeated
rows have one hash, so they are drawn or left together; a null doc_id hashes as the empty string. An
empty table gives an empty result. Very long texts count whole. Cells of one ratio have one probability. Extra columns, whatever their names, are
left aside by `mix` and kept by `kept`.

Up to `on_driver` cells, a counted number, are raked on the driver; beyond it, where a source is a web domain, by Spark, with one aggregation of
the cells for each marginal. Either way gives the same ratios.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.shared import checkpoint, fresh

KEYS = ("source_key", "lang_key", "topic")
SWEEPS, TEMPER, BUDGET, CLOSE = 20, 0.7, 0.9, 1e-12


def topic(text: Column) -> Column:
    """A topic by what a text carries: license terms, credentials, contact data, tables or prose alone."""
    low = F.lower(text)
    return (
        F.when(F.coalesce(F.length(F.trim(text)), F.lit(0)) == 0, "empty")
        .when(low.contains("licens") | low.contains("copyright") | low.contains("rights reserved"), "legal")
        .when(low.contains("password") | low.contains("token") | low.contains("secret") | low.contains("api_key"), "credentials")
        .when(text.contains("@") | text.rlike(r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"), "contact")
        .when(text.contains(" | "), "table")
        .otherwise("prose")
    )


def _with_keys(docs: DataFrame, *more: str) -> DataFrame:
    none = F.lit("(none)")
    return docs.select(
        *more,
        F.coalesce(F.col("source").cast("string"), none).alias("source_key"),
        F.coalesce(F.col("lang").cast("string"), none).alias("lang_key"),
        topic(F.col("text").cast("string")).alias("topic"),
        F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(r"[^ \t\n\r\f]+")), F.lit(0)).cast("long").alias("n_tokens"),
    )


def rake(cells: pd.DataFrame, targets: dict[str, dict[str, float]] | None = None, temper: float = TEMPER, sweeps: int = SWEEPS) -> np.ndarray:
    """Ratio of raked to own tokens of each cell (rows with KEYS and tokens)."""
    own = cells["tokens"].to_numpy(float)
    total = own.sum()
    if total <= 0:
        return np.ones(len(cells))
    w = own / total
    sides = []
    for key in KEYS:
        code, names = pd.factorize(cells[key])
        mass = np.bincount(code, own, len(names))
        given = (targets or {}).get(key)
        goal = np.array([float(given.get(x, 0)) for x in names]) if given else np.where(mass > 0, mass, 0) ** temper * (mass > 0)
        goal = np.where(mass > 0, goal, 0)
        if goal.sum() <= 0:
            raise ValueError(f"no target of {key} names a category that has tokens")
        sides.append((code, goal / goal.sum(), len(names)))
    for _ in range(sweeps):
        if max(np.abs(np.bincount(code, w, n) - goal).max() for code, goal, n in sides) <= CLOSE:
            break
        for code, goal, n in sides:
            now = np.bincount(code, w, n)
            w = w * np.divide(goal, now, out=np.zeros(n), where=now > 0)[code]
    return np.divide(w * total, own, out=np.ones(len(own)), where=own > 0)


def calibrate(tokens: np.ndarray, ratio: np.ndarray, budget: float = BUDGET) -> np.ndarray:
    """min(1, c * ratio) with the c at which the expected tokens are budget * sum(tokens), if any is."""
    at = np.argsort(-ratio, kind="stable")
    t, r = tokens[at].astype(float), ratio[at]
    goal = budget * t.sum()
    capped = np.concatenate(([0.0], np.cumsum(t)))[:-1]
    rest = np.cumsum((t * r)[::-1])[::-1]
    c = np.divide(goal - capped, rest, out=np.full(len(t), np.inf), where=rest > 0)
    good = np.flatnonzero(c * r <= 1 + 1e-12)
    c = c[good[0]] if len(good) else np.inf
    return np.where(ratio > 0, np.minimum(1.0, c * np.maximum(ratio, 1e-300)), 0.0)


def probabilities(docs: DataFrame, targets=None, temper: float = TEMPER, budget: float = BUDGET, sweeps: int = SWEEPS, on_driver: int = 100_000) -> DataFrame:
    """The cells with their ratio and probability: sources times languages times topics, whatever the number of documents."""
    counted = checkpoint(_with_keys(docs).groupBy(*KEYS).agg(F.sum("n_tokens").cast("double").alias("tokens")))
    if counted.count() > on_driver:
        return calibrated(raked(counted, targets, temper, sweeps), budget)
    cells = counted.toPandas().sort_values(list(KEYS)).reset_index(drop=True)
    cells["ratio"] = rake(cells, targets, temper, sweeps)
    cells["probability"] = calibrate(cells["tokens"].to_numpy(float), cells["ratio"].to_numpy(float), budget)
    schema = "source_key string, lang_key string, topic string, ratio double, probability double"
    return docs.sparkSession.createDataFrame(cells[[*KEYS, "ratio", "probability"]].values.tolist(), schema)


def raked(cells: DataFrame, targets=None, temper: float = TEMPER, sweeps: int = SWEEPS) -> DataFrame:
    """As `rake`, in Spark: the cells with their ratio. A marginal is one row a category, joined back to the cells."""
    spark, total = cells.sparkSession, cells.agg(F.sum("tokens")).first()[0] or 0.0
    if total <= 0:
        return cells.withColumn("ratio", F.lit(1.0))
    now = cells.withColumn("w", F.col("tokens") / F.lit(total))
    goals = {}
    for key in KEYS:
        mass = cells.groupBy(key).agg(F.sum("tokens").alias("m"))
        given = (targets or {}).get(key)
        if given:
            named = spark.createDataFrame([(k, float(v)) for k, v in given.items()], f"{key} string, g double")
            goal = mass.join(named, key, "left").select(key, F.when(F.col("m") > 0, F.coalesce("g", F.lit(0.0))).otherwise(0.0).alias("g"))
        else:
            goal = mass.select(key, F.when(F.col("m") > 0, F.pow("m", F.lit(temper))).otherwise(0.0).alias("g"))
        goal = checkpoint(goal)
        whole = goal.agg(F.sum("g")).first()[0] or 0.0
        if whole <= 0:
            raise ValueError(f"no target of {key} names a category that has tokens")
        goals[key] = goal.withColumn("g", F.col("g") / F.lit(whole))
    for _ in range(sweeps):
        now = now.withColumn("off", F.lit(0.0))
        for key in KEYS:
            factor = now.groupBy(key).agg(F.sum("w").alias("s")).join(goals[key], key).select(key, F.when(F.col("s") > 0, F.col("g") / F.col("s")).otherwise(0.0).alias("f"), F.abs(F.col("s") - F.col("g")).alias("d"))
            now = now.join(factor, key).select(*KEYS, "tokens", (F.col("w") * F.col("f")).alias("w"), F.greatest("off", "d").alias("off"))
        now = checkpoint(now)
        if (now.agg(F.max("off")).first()[0] or 0.0) <= CLOSE:
            break
    return now.withColumn("ratio", F.when(F.col("tokens") > 0, F.col("w") * F.lit(total) / F.col("tokens")).otherwise(1.0)).drop("w", "off")


def calibrated(cells: DataFrame, budget: float = BUDGET) -> DataFrame:
    """As `calibrate`, in Spark: cells beyond probability 1 are set to it until no more go beyond."""
    cells = checkpoint(cells)
    goal = budget * (cells.agg(F.sum("tokens")).first()[0] or 0.0)
    c, over, known = float("inf"), F.lit(False), -1
    while True:
        n, capped, rest = (x or 0.0 for x in cells.agg(F.count_if(over), F.sum(F.when(over, F.col("tokens"))), F.sum(F.when(~over, F.col("tokens") * F.col("ratio")))).first())
        if n == known or rest <= 0:
            break
        c, known = (goal - capped) / rest, n
        over = over | (F.col("ratio") * F.lit(c) > 1)
    chance = F.least(F.lit(1.0), F.lit(c) * F.col("ratio")) if c != float("inf") else F.lit(1.0)
    return cells.select(*KEYS, "ratio", F.when(F.col("ratio") > 0, chance).otherwise(0.0).alias("probability"))


def draw(doc_id: Column) -> Column:
    """A number in [0, 1) from the id's md5, the same in any SQL engine."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def mix(docs: DataFrame, **how) -> DataFrame:
    """One row a document: its cell, ratio, probability and whether it is drawn.

    Two scans: one for the cells' counts, one that joins them. Text never leaves its partition where Spark
    broadcasts the cells, which it does by their measured size; else only the keys would be shuffled.
    """
    cells = probabilities(docs, **how)
    rows = _with_keys(docs, "doc_id")
    return rows.join(cells, list(KEYS)).select(
        "doc_id", "source_key", "lang_key", "topic", "n_tokens", F.round("ratio", 4).alias("ratio"), F.round("probability", 4).alias("probability"),
        (draw(F.col("doc_id")) < F.col("probability")).alias("drawn"),
    )


def kept(docs: DataFrame, **how) -> DataFrame:
    """The documents drawn, with all their columns. The row's own key columns are made in place, so clashing names in docs are safe."""
    cell, p = fresh(docs, "_cell"), fresh(docs, "_p")
    cells = probabilities(docs, **how).select(F.struct("source_key", "lang_key", "topic").alias(cell), F.col("probability").alias(p))
    none = F.lit("(none)")
    key = F.struct(
        F.coalesce(F.col("source").cast("string"), none).alias("source_key"), F.coalesce(F.col("lang").cast("string"), none).alias("lang_key"), topic(F.col("text").cast("string")).alias("topic")
    )
    return docs.withColumn(cell, key).join(cells, cell).filter(draw(F.col("doc_id")) < F.col(p)).select(*docs.columns)


def sql(temper: float = TEMPER, budget: float = BUDGET, sweeps: int = SWEEPS) -> str:
    """The same result in SQL: every raking step is a common table expression."""
    topic_ = """CASE WHEN coalesce(length(trim(text)), 0) = 0 THEN 'empty'
      WHEN contains(lower(text), 'licens') OR contains(lower(text), 'copyright') OR contains(lower(text), 'rights reserved') THEN 'legal'
      WHEN contains(lower(text), 'password') OR contains(lower(text), 'token') OR contains(lower(text), 'secret') OR contains(lower(text), 'api_key') THEN 'credentials'
      WHEN contains(text, '@') OR regexp_matches(text, '[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}') THEN 'contact'
      WHEN contains(text, ' | ') THEN 'table' ELSE 'prose' END"""
    parts = [f"""d AS MATERIALIZED (SELECT doc_id, coalesce(source, '(none)') AS source_key, coalesce(lang, '(none)') AS lang_key, {topic_} AS topic,
      coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\r\\f]+')), 0)::BIGINT AS n_tokens FROM documents)""",
      "c AS MATERIALIZED (SELECT source_key, lang_key, topic, sum(n_tokens)::DOUBLE AS t FROM d GROUP BY ALL)",
      "w0 AS MATERIALIZED (SELECT *, t / (SELECT sum(t) FROM c) AS w FROM c)"]
    for key in KEYS:
        parts.append(f"g_{key} AS MATERIALIZED (SELECT {key}, m / sum(m) OVER () AS g FROM (SELECT {key}, CASE WHEN sum(t) > 0 THEN pow(sum(t), {temper}) ELSE 0 END AS m FROM c GROUP BY 1))")
    n = 0
    for _ in range(sweeps):
        for key in KEYS:
            parts.append(f"w{n + 1} AS MATERIALIZED (SELECT source_key, lang_key, topic, t, CASE WHEN s > 0 THEN w * g / s ELSE 0 END AS w FROM (SELECT w{n}.*, sum(w) OVER (PARTITION BY {key}) AS s FROM w{n}) x JOIN g_{key} USING ({key}))")
            n += 1
    order = "ORDER BY r DESC, source_key, lang_key, topic"
    parts += [
        f"r AS MATERIALIZED (SELECT source_key, lang_key, topic, t, CASE WHEN t > 0 THEN w * (SELECT sum(t) FROM c) / t ELSE 1 END AS r FROM w{n})",
        f"k AS MATERIALIZED (SELECT *, coalesce(sum(t) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped, sum(t * r) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest, row_number() OVER ({order}) AS i FROM r)",
        f"b AS (SELECT arg_min(({budget} * (SELECT sum(t) FROM c) - capped) / rest, i) AS c FROM k WHERE rest > 0 AND ({budget} * (SELECT sum(t) FROM c) - capped) / rest * r <= 1 + 1e-12)",
        "p AS MATERIALIZED (SELECT source_key, lang_key, topic, r, CASE WHEN r > 0 THEN least(1.0, coalesce((SELECT c FROM b) * r, 1.0)) ELSE 0 END AS p FROM r)",
    ]
    return "WITH " + ",\n".join(parts) + """
    SELECT doc_id, source_key, lang_key, topic, n_tokens, round(r, 4) AS ratio, round(p, 4) AS probability,
      ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296.0 < p AS drawn
    FROM d JOIN p USING (source_key, lang_key, topic)"""
