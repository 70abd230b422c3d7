"""Quality rules whose thresholds follow each language and source.

Per document a few counts are taken. Their distribution per language and source goes into
a mergeable quantile sketch: counts by bucket, where a bucket is as wide as 1/32 of its
values. Sketches of sources add up to that of a language, and those to that of all
documents. A fence around the middle half of a sketch replaces a fixed cutoff; a group
with fewer than ``MIN_DOCS`` documents takes the fence of its language, or of all.

A word is a run without ASCII white space. Null counts as a text without words. Documents
without words fail the base rules. A null language or source is a group of its own.
Repeated rows count, and are judged, each for itself. Only built-in functions run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import saved, without

#: Base rules: fewest words, and most words in repeated windows in percent.
MIN_WORDS, MAX_REPEATED = 10, 20
WINDOW = 5

#: Smaller groups take the fence of a larger one.
MIN_DOCS = 50
#: Fences stand so many times the width of the middle half away from it.
REACH = 3
#: Rates in whole numbers, and how much beyond its fence a rate may go. Symbols per 1000
#: words, length of words in hundredths, repeated lines per 1000 lines.
SLACK = {"symbol_rate": 100, "word_length": 300, "line_rate": 200}

COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
RATES = list(SLACK)


def _let(value: str, name: str, body: str) -> str:
    """SQL: body, in which name stands for a value that is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


_WORDS = r"array_remove(split(text, '[\\x20\\x09-\\x0D]+', -1), '')"
_LINES = r"filter(split(text, '\n', -1), l -> length(translate(l, ' \t\n\u000b\u000c\r', '')) > 0)"

_HASHES = ", ".join(f"h[i + {k}]" for k in range(WINDOW))
_PLACES = (
    "sort_array(transform(filter(p, (e, j) -> e.x = get(p, j - 1).x OR e.x = get(p, j + 1).x), e -> e.i))"
)
_COVERED = (
    f"aggregate(transform(r, (a, j) -> least({WINDOW}, coalesce(get(r, j + 1) - a, {WINDOW}))), 0L, (s, x) -> s + x)"
)
#: Words in windows found twice: places of equal windows side by side, then their union.
_REPEATED = _let(
    "transform(words, x -> xxhash64(x))",
    "h",
    f"CASE WHEN size(h) <= {WINDOW} THEN 0L ELSE "
    + _let(
        f"transform(sequence(0, size(h) - {WINDOW}), i -> xxhash64({_HASHES}))",
        "g",
        "CASE WHEN size(array_distinct(g)) = size(g) THEN 0L ELSE "
        + _let("sort_array(transform(g, (x, i) -> struct(x, i)))", "p", _let(_PLACES, "r", _COVERED))
        + " END",
    )
    + " END",
)


def with_counts(docs: DataFrame) -> DataFrame:
    """docs with the counts that the rules look at."""
    text = "coalesce(text, '')"
    counted = _let(
        _WORDS.replace("text", text),
        "words",
        "struct(cast(size(words) as bigint) AS n_words, "
        f"cast(length(translate({text}, ' \\t\\n\\u000b\\u000c\\r', '')) as bigint) AS word_chars, "
        f"cast(length({text}) - length(translate({text}, '#*$%&|<>', '')) as bigint) AS n_symbols, "
        + _let(
            _LINES.replace("text", text),
            "lines",
            "struct(cast(size(lines) as bigint) AS n, cast(size(lines) - size(array_distinct(lines)) as bigint) AS d)",
        )
        + f" AS lines, {_REPEATED} AS n_repeat_words)",
    )
    kept = without(docs, COUNTS)
    return kept.select("*", F.expr(counted).alias("_c")).select(
        *[F.col(f"`{c}`") for c in kept.columns],
        *[F.col(f"_c.{c}").alias(c) for c in COUNTS[:3]],
        F.col("_c.lines.n").alias("n_lines"),
        F.col("_c.lines.d").alias("n_dup_lines"),
        F.col("_c.n_repeat_words").alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return F.expr(f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words")


def _rates() -> dict[str, Column]:
    return {
        "symbol_rate": F.expr("1000 * n_symbols DIV greatest(n_words, 1)"),
        "word_length": F.expr("100 * word_chars DIV greatest(n_words, 1)"),
        "line_rate": F.expr("1000 * n_dup_lines DIV greatest(n_lines, 1)"),
    }


def sketches(counted: DataFrame) -> DataFrame:
    """Sketch of each rate per language and source: documents by bucket."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("rate"), v.alias("v")) for k, v in _rates().items()]))
    width = F.expr("greatest(0, length(bin(v)) - 6)")
    return (
        counted.where(~base_failed())
        .select("lang", "source", pairs.alias("p"))
        .select("lang", "source", "p.rate", "p.v")
        .select("lang", "source", "rate", (width * 32 + F.expr(f"shiftright(v, {'greatest(0, length(bin(v)) - 6)'})")).alias("bucket"))
        .groupBy("lang", "source", "rate", "bucket")
        .agg(F.count("*").alias("n"))
    )


def fences(sketch: DataFrame) -> DataFrame:
    """Lower and upper bound of each rate for each language and source."""
    sketch.createOrReplaceTempView(view := f"sketch_{id(sketch)}")
    slack = " ".join(f"WHEN '{k}' THEN {v}" for k, v in SLACK.items())
    spark = sketch.sparkSession
    own = spark.sql(f"""
        WITH merged AS (
          SELECT 2 * grouping(lang) + grouping(source) AS level, lang, source, rate, bucket, sum(n) AS n
          FROM {view} GROUP BY GROUPING SETS ((lang, source, rate, bucket), (lang, rate, bucket), (rate, bucket))),
        summed AS (
          SELECT *, sum(n) OVER (PARTITION BY level, lang, source, rate ORDER BY bucket) AS upto,
                 sum(n) OVER (PARTITION BY level, lang, source, rate) AS total,
                 CASE WHEN bucket < 64 THEN bucket
                      ELSE shiftleft(bucket - (bucket DIV 32 - 1) * 32, cast(bucket DIV 32 - 1 AS int)) END AS v
          FROM merged),
        middle AS (
          SELECT level, lang, source, rate, max(total) AS total,
                 min(v) FILTER (WHERE upto * 4 >= total) AS q1, min(v) FILTER (WHERE upto * 4 >= total * 3) AS q3
          FROM summed GROUP BY level, lang, source, rate)
        SELECT level, lang, source, rate, total, q1 - {REACH} * (q3 - q1) - (CASE rate {slack} END) AS lo,
               q3 + {REACH} * (q3 - q1) + (CASE rate {slack} END) AS hi
        FROM middle""")
    spark.catalog.dropTempView(view)
    own = saved(own, "fences")
    level = lambda k: own.where(f"level = {k}").drop("level").alias(f"f{k}")
    enough = lambda k: F.col(f"f{k}.total") >= MIN_DOCS
    chosen = lambda c: F.when(enough(0), F.col(f"f0.{c}")).when(enough(1), F.col(f"f1.{c}")).otherwise(F.col(f"f3.{c}"))
    joined = (
        level(0)
        .join(level(1), (F.col("f0.rate") == F.col("f1.rate")) & F.col("f0.lang").eqNullSafe(F.col("f1.lang")))
        .join(level(3), F.col("f0.rate") == F.col("f3.rate"))
    )
    bounds = [F.col("f0.lang").alias("lang"), F.col("f0.source").alias("source"), F.col("f0.rate").alias("rate")]
    rows = joined.select(*bounds, chosen("lo").alias("lo"), chosen("hi").alias("hi"))
    side = lambda k, c: F.max(F.when(F.col("rate") == k, F.col(c))).alias(f"{k}_{c}")
    return rows.groupBy("lang", "source").agg(*[side(k, c) for k in RATES for c in ("lo", "hi")])


def judged(counted: DataFrame, bounds: DataFrame) -> DataFrame:
    """counted with ``base_failed`` and ``kept``: within every fence of its group."""
    kept = without(counted, ["base_failed", "kept"])
    names = kept.columns
    b = bounds.alias("b")
    same = F.col("d.lang").eqNullSafe(F.col("b.lang")) & F.col("d.source").eqNullSafe(F.col("b.source"))
    within = F.lit(True)
    for k, v in _rates().items():
        within = within & F.coalesce(v.between(F.col(f"b.{k}_lo"), F.col(f"b.{k}_hi")), F.lit(True))
    return (
        kept.alias("d")
        .join(b, same, "left")
        .withColumn("base_failed", base_failed())
        .withColumn("kept", ~F.col("base_failed") & within)
        .select(*[F.col(f"d.`{c}`") for c in names], "base_failed", "kept")
    )


def verdicts(docs: DataFrame) -> DataFrame:
    """Per document: the counts, the base verdict and the final one."""
    counted = saved(with_counts(docs.select("doc_id", "lang", "source", "text")).drop("text"), "counts")
    return judged(counted, saved(fences(sketches(counted)), "bounds")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def passing(docs: DataFrame) -> DataFrame:
    """The documents that are kept, as they came."""
    held = docs.select(F.struct("*").alias("doc"), "lang", "source", "text")
    # Written once: a filter on the counts would be pushed below them and count each text again.
    counted = saved(with_counts(held).drop("text"), "counted")
    found = judged(counted, saved(fences(sketches(counted)), "bounds")).where("kept")
    return found.select(*[F.col(f"doc.`{c}`").alias(c) for c in docs.columns])
