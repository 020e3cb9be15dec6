"""Operator 4: temperature mixing of sources.

Source token shares (of words, or of tokens where a column has their numbers) are raised to an exponent and normalised.  The exponent, between 0 (all sources alike) and 1 (as they are), is found
by bisection: the least that keeps every source's repetition within the limit or, where an entropy is asked for, the greatest that
reaches it without breaking the limit.  The budget is the least with which every source is used once at least, unless one is given.

The weights are realised by block permutations.  A source's documents are dealt to blocks by a keyed hash, and a block has its
share of the budget: every document as often as whole passes fit, then documents in the order of the block's permutation until
the rest is used.  So no source is ordered as a whole, and a source with most of the rows is spread over many blocks.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lagstone.llm import common

REPEAT_LIMIT = 2.0
#: Documents in a block, about.
BLOCK_DOCS = 1024
#: Sources whose sums are collected and whose plan is broadcast; of more only sums over all of them are.
MAX_SOURCES = 10_000
_WORD = r"[^ \t\n\x0B\f\r]+"


def weights(tokens: dict, exponent: float) -> dict:
    top = max(tokens.values())
    raw = {s: (n / top) ** exponent for s, n in tokens.items()}
    total = sum(raw.values())
    return {s: w / total for s, w in raw.items()}


def entropy(w: dict) -> float:
    return -sum(x * math.log(x) for x in w.values() if x > 0)


def repetitions(tokens: dict, w: dict, budget: float | None) -> dict:
    """How often each source is used: with the given budget, or with the least that uses each once."""
    budget = max(tokens[s] / w[s] for s in tokens) if budget is None else budget
    return {s: w[s] * budget / tokens[s] for s in tokens}


def temperature(tokens: dict, *, repeat_limit: float, target_entropy: float | None = None, budget: float | None = None) -> float:
    """The exponent, by bisection; ValueError if the limit can't be kept with the budget."""
    if not tokens:
        return 1.0

    def bisect(fits) -> float:
        """The least exponent that fits, where all greater ones do."""
        if fits(0.0):
            return 0.0
        if not fits(1.0):
            raise ValueError("no exponent keeps the repetition limit")
        low, high = 0.0, 1.0
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (low, mid) if fits(mid) else (mid, high)
        return high

    least = bisect(lambda a: max(repetitions(tokens, weights(tokens, a), budget).values()) <= repeat_limit * (1 + 1e-12))
    if target_entropy is None:
        return least
    low, high = least, 1.0
    if entropy(weights(tokens, high)) >= target_entropy:
        return high
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if entropy(weights(tokens, mid)) >= target_entropy else (low, mid)
    return low


def _distributed(sums: DataFrame, *, repeat_limit: float, target_entropy: float | None, budget: float | None) -> tuple[float, float, float]:
    """The exponent, the greatest n and the sum of (n / greatest) ** exponent over a table of sources too many to collect: one row a step."""
    some = sums.where("n > 0")
    least, greatest, total = some.agg(F.min("n"), F.max("n"), F.sum("n")).first()

    def at(a: float) -> tuple[float, float]:
        x = F.pow(F.col("n") / F.lit(float(greatest)), F.lit(a))
        z, e = some.agg(F.sum(x), F.sum(x * F.lit(a) * F.log(F.col("n") / F.lit(float(greatest))))).first()
        return z, math.log(z) - e / z

    def most(a: float) -> float:
        used = 1.0 if budget is None else budget / (greatest * at(a)[0])
        return max(used, used * (least / greatest) ** (a - 1))

    def bisect(fits, low: float, high: float) -> float:
        for _ in range(40):
            mid = (low + high) / 2
            low, high = (low, mid) if fits(mid) else (mid, high)
        return high

    limit = repeat_limit * (1 + 1e-12)
    if most(1.0) > limit:
        raise ValueError("no exponent keeps the repetition limit")
    exponent = 0.0 if most(0.0) <= limit else bisect(lambda a: most(a) <= limit, 0.0, 1.0)
    if target_entropy is not None:
        exponent = 1.0 if at(1.0)[1] >= target_entropy else bisect(lambda a: at(a)[1] < target_entropy, exponent, 1.0)
    return exponent, float(greatest), at(exponent)[0]


def _plan(sums: DataFrame, *, repeat_limit: float, target_entropy: float | None, budget: float | None, most: int) -> DataFrame:
    """__source, __rep and __blocks of every source.  Few sources are collected; of very many only sums are, and their table stays distributed."""
    few = sums.limit(most + 1).collect()
    how = {"repeat_limit": repeat_limit, "target_entropy": target_entropy, "budget": budget}
    if len(few) <= most:
        tokens = {r.source: r.n for r in few if r.n}
        reps = repetitions(tokens, weights(tokens, temperature(tokens, **how)), budget) if tokens else {}
        plan = [(r.source, float(reps.get(r.source, 1.0)), 1 + r.docs // BLOCK_DOCS) for r in few]
        # as an Arrow table: from a list of rows Spark starts Python workers of another kind on all executors, only to pass them on
        columns = [pa.array([x[k] for x in plan], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.int64()))]
        return F.broadcast(sums.sparkSession.createDataFrame(pa.table(columns, names=["__source", "__rep", "__blocks"])))
    if sums.where("n > 0").limit(1).count():
        exponent, greatest, z = _distributed(sums, **how)
        used = F.lit(greatest * z if budget is None else float(budget)) / F.lit(greatest * z)
        rep = F.when(F.col("n") > 0, used * F.pow(F.col("n") / F.lit(greatest), F.lit(exponent - 1))).otherwise(1.0)
    else:
        rep = F.lit(1.0)
    return sums.select(F.col("source").alias("__source"), rep.alias("__rep"), (1 + F.floor(F.col("docs") / BLOCK_DOCS)).alias("__blocks"))


def mix(
    docs: DataFrame, *, repeat_limit: float = REPEAT_LIMIT, target_entropy: float | None = None, budget: float | None = None, tokens: str | None = None, seed: str = "mix", max_sources: int = MAX_SOURCES
) -> DataFrame:
    """The columns of ``docs`` and n_words, repetition (double), copies, block and place (long) of every document; these replace columns
    of ``docs`` of the same names.

    ``copies`` is how often the document stands in the mixture, ``place`` its place in the permutation of its block.  ``tokens`` names a
    column with the documents' numbers of tokens (null: none); without it the words of the whole text are counted.  A null source is a
    source of its own; a source without tokens is used once; a null doc_id takes part; repeated rows are separate documents, of which
    the permutation may take one more than another.
    """
    names = [c for c in docs.columns if c not in ("n_words", "repetition", "copies", "block", "place")]
    words = F.regexp_count(F.col("text").cast("string"), F.lit(_WORD)) if tokens is None else F.col(tokens)
    rows = docs.withColumn("__words", F.coalesce(words, F.lit(0)).cast("long"))
    sums = rows.groupBy("source").agg(F.sum("__words").alias("n"), F.count(F.lit(1)).alias("docs"))
    sums = common.stage(sums, "sources")
    plan = _plan(sums, repeat_limit=repeat_limit, target_entropy=target_entropy, budget=budget, most=max_sources)
    # very many rows can have no doc_id: their texts tell them apart
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null|"), F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))))
    rows = rows.join(plan, F.col("source").eqNullSafe(F.col("__source"))).withColumn("__draw", F.md5(F.concat(key, F.lit(f"|{seed}"))))
    rows = rows.withColumn("__block", F.pmod(F.conv(F.substring("__draw", 21, 12), 16, 10).cast("long"), F.col("__blocks")))
    block = Window.partitionBy("source", "__block")
    ordered = block.orderBy("__draw", "__words")
    before = F.coalesce(F.sum("__words").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # 1e-9: a repetition that is whole but for rounding
    whole = F.floor(F.col("__rep") + 1e-9)
    rest = (F.col("__rep") - whole) * F.sum("__words").over(ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    extra = (F.greatest(rest, F.lit(0.0)) > 1e-6) & (before + F.col("__words") / 2 <= rest)
    place = F.row_number().over(ordered).cast("long").alias("place")
    return rows.select(*names, F.col("__words").alias("n_words"), F.col("__rep").alias("repetition"), (whole + extra.cast("long")).cast("long").alias("copies"), F.col("__block").alias("block"), place)


def realise(mixed: DataFrame, names: list[str]) -> DataFrame:
    """The mixture itself: each document ``copies`` times."""
    return mixed.where("copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*names)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document stands in a mixture in which no source is repeated more than twice."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "source", "n_words", F.round("repetition", 6).alias("repetition"), "copies", "block", "place")


OP4_SQL = f"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+')) AS BIGINT) AS n_words,
             md5(coalesce(CAST(doc_id AS VARCHAR), 'null|' || md5(coalesce(text, ''))) || '|mix') AS draw FROM documents),
s AS (SELECT source, sum(n_words) AS n, count(*) AS docs FROM d GROUP BY source),
x AS (SELECT max(n) AS hi, min(n) AS lo FROM s WHERE n > 0),
e AS (SELECT greatest(0.0, CASE WHEN hi > lo THEN 1 - ln({REPEAT_LIMIT}) / ln(hi / lo) ELSE 0.0 END) AS exponent, hi FROM x),
r AS (SELECT source, CASE WHEN n > 0 THEN pow(n / hi, exponent - 1) ELSE 1.0 END AS rep, 1 + docs // {BLOCK_DOCS} AS blocks FROM s, e),
b AS (SELECT doc_id, d.source, n_words, draw, rep, CAST(('0x' || substr(draw, 21, 12)) AS BIGINT) % blocks AS block FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source),
w AS (SELECT *, floor(rep + 1e-9) AS passes, coalesce(sum(n_words) OVER (PARTITION BY source, block ORDER BY draw, n_words ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
        sum(n_words) OVER (PARTITION BY source, block) AS total, row_number() OVER (PARTITION BY source, block ORDER BY draw, n_words) AS place FROM b)
SELECT doc_id, source, n_words, round(rep, 6) AS repetition,
  CAST(passes + CASE WHEN (rep - passes) * total > 1e-6 AND before + n_words / 2.0 <= (rep - passes) * total THEN 1 ELSE 0 END AS BIGINT) AS copies, CAST(block AS BIGINT) AS block, place
FROM w
"""
