"""Personal data: seed entities by form, and more identifiers by the words around them.

Seeds are e-mail addresses, IP addresses, card and phone numbers of fixed form. The words
before and after them are patterns, and so is the word before together with the shape of
the identifier (runs of letters and digits shortened), so that a label found often is
enough, whatever follows. Patterns and the identifiers they surround form a graph. In each round a pattern's score is the share of its identifiers that are known, and
an identifier is known as far as its patterns are good. What good patterns surround and no
form has matched is added. Tables of the graph grow with the identifiers, not the texts.

Positions are code points, ends exclusive. A null text is empty. Rows that repeat id and
text get equal results. Seeds never go. Only built-in functions run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import saved

KINDS = ["email", "ip", "card", "phone"]

#: Rounds over the graph; score from which a pattern or identifier counts; fewest
#: different seeds of a pattern.
ROUNDS, GOOD, SUPPORT = 3, 0.8, 3

# Each form matches just where the plain form of the same name does, leftmost first, but
# starts at the beginning of a run only, so that long runs cost no more than their length.
_PART = "[A-Za-z0-9._%+-]"
_FORMS = {
    "email": rf"(?:(?<!{_PART})|\\G){_PART}++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}+(?![ -]?[0-9])",
    "phone": r"\\+[0-9][ ().0-9-]+[0-9]",
}
_OCTET = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_DIGITS = "regexp_replace({m}, '[^0-9]', '')"
_CHECKS = {
    "email": "true",
    "ip": rf"{{m}} rlike '^(?:{_OCTET}|0++)(?:\\.(?:{_OCTET}|0++)){{{{3}}}}\\z'",
    "card": f"luhn_check({_DIGITS})",
    "phone": f"length({_DIGITS}) between 9 and 15",
}
#: Text without one of these holds no entity of the kind.
_SIGNS = {"email": "@", "phone": "+"}
#: Anything with a digit or @, after white space or the separator of a label; its edges are
#: trimmed to letters, digits, + and @.
_TOKEN = r"(?<![^\\s=:])[^\\s0-9@=:]*+[0-9@]\\S*+"


#: Numbers that are summed up together.
_BLOCK = 512


def _before(numbers: str) -> str:
    """SQL: for each of an array's numbers the sum of those before it.

    Growing an array copies it, so sums are made in blocks, and each block starts from the
    sum of those before: a text of very many matches takes no time in their square.
    """
    grown = "struct(array_append(s.at, s.upto) AS at, s.upto + {v} AS upto)"
    blocks = f"transform(sequence(0, size({numbers}) DIV {_BLOCK}), b -> slice({numbers}, cast(b AS int) * {_BLOCK} + 1, {_BLOCK}))"
    starts = (
        "aggregate(k, struct(cast(array() AS array<int>) AS at, 0 AS upto), (s, v) -> "
        + grown.format(v="aggregate(v, 0, (p, q) -> p + q)")
        + ").at"
    )
    inside = f"aggregate(v, struct(cast(array() AS array<int>) AS at, st[b] AS upto), (s, q) -> {grown.format(v='q')}).at"
    return f"transform(array({blocks}), k -> transform(array({starts}), st -> flatten(transform(k, (v, b) -> {inside})))[0])[0]"


def _matches(text: str, form: str, body: str) -> str:
    """SQL: body for each match m of a form, with g and n, the gaps before and after, and at, its place."""
    return (
        f"transform(array(struct(split({text}, '{form}', -1) AS g, regexp_extract_all({text}, '{form}', 0) AS m)), x -> "
        "transform(array(transform(x.m, (m, i) -> length(x.g[i]) + length(m))), d -> "
        f"transform(array({_before('d')}), a -> transform(x.m, (m, i) -> "
        f"{body.format(m='m', g='x.g[i]', n='x.g[i + 1]', at='(a[i] + length(x.g[i]))')})))[0][0])[0]"
    )


_LEFT = r"lower(regexp_extract(right({g}, 80), '(\\S++\\s++)?\\S++\\s*+\\z', 0))"
_RIGHT = r"lower(regexp_extract(left({n}, 60), '^\\s*+(\\S++)', 1))"


def _seeds(kind: str) -> str:
    body = (
        f"struct({{at}} AS a, {KINDS.index(kind)} AS k, {{at}} + length({{m}}) AS b, {{m}} AS v, "
        f"{_LEFT} AS l, {_RIGHT} AS r, {_CHECKS[kind]} AS ok)"
    )
    sign = _SIGNS.get(kind)
    given = f"contains(text, '{sign}')" if sign else "text rlike '[0-9]'"
    found = f"filter({_matches('text', _FORMS[kind], body)}, e -> e.ok)"
    return f"CASE WHEN {given} THEN {found} END"


_CORE = r"regexp_extract({m}, '[\\p{{L}}0-9+@](?:.*[\\p{{L}}0-9@])?', 0)"
_LEAD = r"length(regexp_extract({m}, '^[^\\p{{L}}0-9+@]*+', 0))"
_TOKENS = (
    "CASE WHEN text rlike '[0-9@]' THEN filter("
    + _matches(
        "text",
        _TOKEN,
        f"struct({{at}} + {_LEAD} AS a, {{at}} + {_LEAD} + length({_CORE}) AS b, {_CORE} AS v, {_LEFT} AS l, {_RIGHT} AS r)",
    )
    + ", e -> length(e.v) >= 5 AND (contains(e.v, '@') OR length(regexp_replace(e.v, '[^0-9]', '')) >= 3)) END"
)


def _patterns() -> Column:
    """Words before; the word before and the word after; the word before and the shape.

    In the last, marks that end the word (as in ``mail:``) and a leading + do not count.
    """
    two = F.expr(r"CASE WHEN l rlike '\\S\\s+\\S' THEN concat('2:', regexp_replace(trim(l), '\\s+', ' ')) END")
    around = F.expr(r"CASE WHEN l <> '' AND r <> '' THEN concat('1:', regexp_extract(l, '(\\S+)\\s*$', 1), '_', r) END")
    label = r"regexp_extract(l, '([\\p{L}0-9](?:\\S*[\\p{L}0-9])?)[^\\p{L}0-9\\s]*+\\s*+\\z', 1)"
    shape = r"regexp_replace(regexp_replace(regexp_replace(v, '^\\+', ''), '[0-9]++', '9'), '\\p{L}++', 'a')"
    shaped = F.expr(f"CASE WHEN {label} <> '' THEN concat('0:', {label}, ' ', cast(xxhash64({shape}) AS string)) END")
    return F.array_compact(F.array(two, around, shaped))


def found_by_form(docs: DataFrame) -> DataFrame:
    """doc_id, a digest of the text, seed entities, and other tokens that may identify someone."""
    seeds = ", ".join(f"coalesce({_seeds(k)}, array())" for k in KINDS)
    return (
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        .select(
            "doc_id",
            F.xxhash64("text").alias("of"),
            *[F.expr(_seeds(k)).alias(f"_{k}") for k in KINDS],
            F.expr(_TOKENS).alias("tokens"),
        )
        .withColumn("seeds", F.expr("flatten(array_compact(array(_email, _ip, _card, _phone)))"))
        .select("doc_id", "of", "seeds", "tokens")
    )


def bootstrapped(found: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Tokens that good patterns surround: doc_id, text digest, place and kind."""
    seeds = found.select("doc_id", "of", F.explode("seeds").alias("e")).select(
        F.xxhash64("e.v").alias("who"), F.col("e.k").alias("k"), "e.v", "e.l", "e.r"
    )
    seeds = seeds.select("who", "k", F.explode(_patterns()).alias("pattern"))
    free = "filter(tokens, t -> NOT exists(seeds, s -> s.a < t.b AND t.a < s.b))"
    tokens = found.select("doc_id", "of", F.explode(F.expr(free)).alias("t")).select("doc_id", "of", "t.a", "t.b", "t.v", "t.l", "t.r")
    tokens = tokens.select("doc_id", "of", "a", "b", F.xxhash64("v").alias("who"), F.explode(_patterns()).alias("pattern"))
    # Only patterns with enough different seeds can ever become good.
    first = seeds.groupBy("pattern", "k").agg(F.count_distinct("who").alias("known")).where(F.col("known") >= SUPPORT)
    tokens = saved(tokens.join(first.select("pattern").distinct(), "pattern"), "tokens")
    edges = tokens.select("pattern", "who").distinct()
    of_pattern = saved(first.join(edges.groupBy("pattern").agg(F.count("*").alias("others")), "pattern", "left"), "patterns")
    score = (F.col("known") + F.coalesce("gained", F.lit(0.0))) / (F.col("known") + F.coalesce("others", F.lit(0)))
    good = of_pattern.withColumn("gained", F.lit(0.0)).withColumn("score", score)
    for _ in range(rounds):
        # A token is known as far as one of its patterns at least is right.
        sure = F.least(F.col("score"), F.lit(0.999999))
        known = (
            edges.join(good.where(F.col("score") >= GOOD).select("pattern", "k", "score"), "pattern")
            .groupBy("who", "k")
            .agg((1 - F.exp(F.sum(F.log(1 - sure)))).alias("belief"))
        )
        gained = edges.join(known, "who").groupBy("pattern", "k").agg(F.sum("belief").alias("gained"))
        good = saved(of_pattern.join(gained, ["pattern", "k"], "left").withColumn("score", score), "scores")
    best = good.where(F.col("score") >= GOOD).groupBy("pattern").agg(F.max_by("k", F.struct("score", -F.col("k"))).alias("k"))
    return tokens.join(best, "pattern").select("doc_id", "of", "a", "b", "k").distinct()


def _joined(spans: str) -> Column:
    """Kind, start and end of each span, in order."""
    kinds = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(
        f"array_join(transform(sort_array({spans}), s -> concat_ws(':', array({kinds})[s.k], cast(s.a AS string), cast(s.b AS string))), ',')"
    )


def entities(docs: DataFrame) -> DataFrame:
    """Per document: seeds by kind, and all spans with those that the patterns add."""
    found = saved(found_by_form(docs), "entities")
    more = (
        bootstrapped(found)
        .groupBy("doc_id", "of")
        .agg(F.collect_list(F.struct("a", "k", "b")).alias("added"))
        .withColumnsRenamed({"doc_id": "_id", "of": "_of"})
    )
    base = F.expr("transform(seeds, s -> struct(s.a AS a, s.k AS k, s.b AS b))")
    count = lambda k: F.expr(f"cast(size(filter(base, s -> s.k = {KINDS.index(k)})) AS bigint)").alias(f"n_{k}")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("of") == F.col("_of"))
    return (
        found.join(more, same, "left")
        .select("doc_id", base.alias("base"), F.coalesce("added", F.expr("cast(array() AS array<struct<a:int,k:int,b:int>>)")).alias("added"))
        .select(
            "doc_id",
            *[count(k) for k in KINDS],
            F.sha2(_joined("base"), 256).alias("base_sha256"),
            _joined("concat(base, added)").alias("spans"),
        )
    )
