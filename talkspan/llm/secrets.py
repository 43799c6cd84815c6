"""Secret scans with DataFrame functions only: fixed patterns, and a randomness test battery.

Tokens of MIN_TOKEN or more characters of a key encoding's alphabet are tested against randomness: chi-squared
uniformity over the inferred alphabet, its values pooled into cells of PER_CELL expected characters or more; the number
of runs of one kind of character (capital, small, digit); and serial correlation of neighbouring characters. Fisher's
method joins the three p-values: -h is their logarithms' sum, small for keys, and grows with length for words.

Findings are held to a false-discovery rate. Their null hypothesis is "ordinary": an empirical null, taken by class of
length from decoys, which are stretches of the same length of the same documents' words, written as names and paths are.
A token's p-value is the chance that a decoy looks as random, log(h / n) being near normal among decoys.
Benjamini-Hochberg over all tokens of the corpus, within classes of length, rejects "ordinary"; the rejected are the
findings, and `fdr` bounds the share of ordinary tokens among them. P-values are rounded up to a grid, so that the
procedure needs only counts per grid step.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkspan.llm.common import stored

#: Fixed patterns and least lengths. Each kind's group `value` must have `least` characters.
KINDS = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8),
    ("access", r"(AKIA[A-Z0-9]+)", 16),
    ("hex", r"([0-9a-f]+)", 32),
)
#: What must occur for a kind to be looked for: a cheaper test than the pattern itself.
HINTS = (r"(?i)passw|secret|token|api_?key", r"AKIA[A-Z0-9]{12}", r"[0-9a-f]{32}")

#: Encodings by name: what a token consists of, and the alphabet in the order of its values. The first that fits counts.
ENCODINGS = (
    ("hex_lower", "[0-9a-f]+", "0123456789abcdef"),
    ("hex_upper", "[0-9A-F]+", "0123456789ABCDEF"),
    ("base32", "[A-Z2-7]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base62", "[A-Za-z0-9]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
    ("base64", "[A-Za-z0-9+/]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "[A-Za-z0-9_-]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)
MIN_TOKEN = 16
TOKEN = r"[A-Za-z0-9+/_-]"
#: Tokens of letters in one case, or of digits, are words and numbers: no encoding of keys consists of them.
PLAIN = r"(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]+|[+/_-]+)"
#: Where a token begins that is long enough and not plain.
BEGIN = rf"(?<!{TOKEN})(?={TOKEN}{{{MIN_TOKEN}}})(?!{PLAIN}(?!{TOKEN}))"
#: Characters that a cell of the test of uniformity expects at least; styles of decoys.
PER_CELL, STYLES = 3, 4
#: Decoys of a class of length from which its own null is taken; fewer take that of all classes, and so few the fixed one
#: (mean and deviation of log(h / n) among decoys of invented prose).
OWN_NULL, ANY_NULL, FIXED_NULL = 200, 30, (-1.15, 0.45)
#: Least deviation of a null.
LEAST_SPREAD = 0.3
#: Matches whose places are summed at a time: a text's work grows with its matches, not with their square.
BLOCK = 128


def _kinds(alphabet: str) -> str:
    """Each character's kind for the test of runs: capital, small letter, other; in alphabets of one case letter, other."""
    if not (any(map(str.isupper, alphabet)) and any(map(str.islower, alphabet))):
        return "".join(str(int(c.isalpha())) for c in alphabet)
    return "".join("0" if c.isupper() else "1" if c.islower() else "2" for c in alphabet)


def _by_encoding(value) -> Column:  # noqa: ANN001
    """A column of value(name, alphabet) by the column r.encoding."""
    return F.element_at(F.create_map(*[x for name, _, alphabet in ENCODINGS for x in (F.lit(name), F.lit(value(name, alphabet)))]), F.col("r.encoding"))


#: Steps of the p-value grid per factor of 10, and how far down it goes.
STEPS, LOWEST = 20, 12


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value evaluated once: a lambda's own variables are, what lies outside it is not."""
    return F.element_at(F.transform(F.array(value), use), 1)


def find_all(text: Column, pattern: str, hint: str, least: int) -> Column:
    """array<struct<start,end,text>>: leftmost non-overlapping matches whose group 1 has `least` characters, in code points.

    Each match is taken with the gap before it; the last gap ends at the end of the text, so the scan is linear.
    Texts without the hint are not scanned again.
    """
    whole = F.lit(rf"(?s)(.*?)(?:({pattern})|\z)")
    gaps, found, values = (F.regexp_extract_all(text, whole, F.lit(i)) for i in (1, 2, 3))
    none = F.array().cast("array<struct<start:int,end:int,text:string>>")
    piece = F.transform(
        F.arrays_zip(gaps.alias("g"), found.alias("m"), values.alias("v")),
        lambda x: F.struct(F.length(x["g"]).alias("g"), F.length(x["m"]).alias("m"), F.length(x["v"]).alias("v"), x["m"].alias("t")),
    )

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["g"]
        span = F.array(F.struct(begin.alias("start"), (begin + x["m"]).alias("end"), x["t"].alias("text")))
        keep = (x["m"] > 0) & (x["v"] >= least)
        return F.struct((begin + x["m"]).alias("at"), F.when(keep, F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    def located(p: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(p) / BLOCK).cast("int") - 1), lambda i: F.slice(p, i * BLOCK + 1, BLOCK))
        return _bound(blocks, told)

    def told(blocks: Column) -> Column:
        length = lambda block: F.aggregate(block, F.lit(0), lambda a, x: a + x["g"] + x["m"])
        begins = F.aggregate(F.transform(blocks, length), F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))
        places = F.zip_with(blocks, F.slice(begins, 1, F.size(blocks)), lambda b, at: F.struct(b.alias("b"), at.alias("at")))
        within = lambda z: F.aggregate(z["b"], F.struct(z["at"].alias("at"), none.alias("out")), step, lambda acc: acc["out"])
        return F.flatten(F.transform(places, within))

    spans = _bound(piece, located)
    return F.when(text.rlike(hint), spans).otherwise(none)


def normal_upper(z: Column) -> Column:
    """P(Z > z), by a rational approximation of the error function (absolute error below 1.5e-7)."""
    a = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * a)
    # fixed values of the approximation
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    tail = 0.5 * poly * F.exp(-a * a)
    return F.when(z >= 0, tail).otherwise(1 - tail)


def chi2_upper(x: Column, df: Column) -> Column:
    """P(chi-squared with df > x), by Wilson and Hilferty's cube root."""
    v = 2.0 / (9.0 * df)
    return normal_upper((F.pow(x / df, F.lit(1 / 3)) - (1 - v)) / F.sqrt(v))


def randomness(token: Column) -> Column:
    """struct<encoding, alphabet, chars>: the inferred encoding and the token's characters; null for tokens of none."""
    encoding = F.coalesce(*[F.when(token.rlike(f"^{shape}$"), F.lit(name)) for name, shape, _ in ENCODINGS])
    table = F.create_map(*[x for name, _, alphabet in ENCODINGS for x in (F.lit(name), F.lit(alphabet))])
    alphabet = F.element_at(table, encoding)
    return F.when(encoding.isNotNull() & ~token.rlike(f"^{PLAIN}$"), F.struct(encoding.alias("encoding"), alphabet.alias("alphabet"), F.split(token, "").alias("chars")))


def with_h(tokens: DataFrame) -> DataFrame:
    """Adds n and h to rows with r = randomness(token), not null."""
    rows = tokens.withColumn("k", F.length("r.alphabet")).withColumn("n", F.size("r.chars"))
    rows = rows.withColumn("v", F.expr("transform(r.chars, c -> instr(r.alphabet, c) - 1)"))
    # uniformity over c cells of the alphabet's values in their order, as even as they can be
    rows = rows.withColumn("c", F.least("k", F.greatest(F.lit(2), F.floor(F.col("n") / PER_CELL))).cast("int"))
    rows = rows.withColumn("cell", F.expr("transform(v, x -> int(x * c div k))"))
    x2 = "aggregate(sequence(0, c - 1), 0d, (a, j) -> a + pow(size(filter(cell, x -> x = j)), 2) / (n * (ceil((j + 1) * k / c) - ceil(j * k / c)) / k)) - n"
    rows = rows.withColumn("p_uniform", chi2_upper(F.greatest(F.lit(0.0), F.expr(x2)), F.col("c") - 1))
    # changes of kind between neighbours: with sums s2, s3 of the shares' powers each has mean 1 - s2, and variance and
    # covariance with the next follow from s2 and s3
    power = lambda e: _by_encoding(lambda name, alphabet: sum((_kinds(alphabet).count(str(i)) / len(alphabet)) ** e for i in range(3)))
    s2, s3 = power(2), power(3)
    text = F.array_join("r.chars", "")
    kinds = F.coalesce(*[F.when(F.col("r.encoding") == name, F.translate(text, alphabet, _kinds(alphabet))) for name, _, alphabet in ENCODINGS])
    changes = F.length(F.regexp_replace(kinds, r"(.)\1*", "x")) - 1
    spread = (F.col("n") - 1) * s2 * (1 - s2) + 2 * (F.col("n") - 2) * (s3 - s2 * s2)
    z_runs = (changes - (F.col("n") - 1) * (1 - s2)) / F.sqrt(spread)
    rows = rows.withColumn("p_runs", F.least(F.lit(1.0), 2 * normal_upper(F.abs(z_runs))))
    # lag-1 products of centred values: mean 0, variance (n-1) * s^4 under independence, s^2 = (k^2-1)/12
    lag = "aggregate(sequence(1, n - 1), cast(0 as double), (a, i) -> a + (v[i] - (k - 1) / 2) * (v[i - 1] - (k - 1) / 2))"
    z_lag = F.expr(lag) / (F.sqrt(F.col("n") - 1) * (F.col("k") * F.col("k") - 1) / 12)
    rows = rows.withColumn("p_serial", F.least(F.lit(1.0), 2 * normal_upper(F.abs(z_lag))))
    floor = F.lit(1e-100)
    half = -(F.log(F.greatest("p_uniform", floor)) + F.log(F.greatest("p_runs", floor)) + F.log(F.greatest("p_serial", floor)))
    return rows.withColumn("h", F.greatest(half, F.lit(1e-3))).withColumn("length_class", F.least(F.floor(F.log2(F.col("n") / MIN_TOKEN) * 2), F.lit(16)).cast("int"))


def findings(tokens: DataFrame, decoys: DataFrame, fdr: float) -> DataFrame:
    """Rows of with_h(tokens) for which Benjamini-Hochberg rejects "ordinary" within their class of length."""
    score = F.log(F.col("h") / F.col("n"))
    # both tables of a few rows are stored: else the battery's plan stands in the driver again at each of their uses
    by_class = stored(decoys.groupBy("length_class").agg(F.count("*").alias("m"), F.sum(score).alias("s"), F.sum(score * score).alias("q")))  # 17 rows at most
    total = by_class.agg(F.sum("m").alias("tm"), F.sum("s").alias("ts"), F.sum("q").alias("tq"))
    classes = tokens.sparkSession.range(17).select(F.col("id").cast("int").alias("length_class"))
    null = classes.join(F.broadcast(by_class), "length_class", "left").join(F.broadcast(total))
    of = lambda m, s, q: F.struct((F.col(s) / F.col(m)).alias("mean"), F.sqrt(F.greatest(F.lit(0.0), F.col(q) / F.col(m) - F.pow(F.col(s) / F.col(m), F.lit(2.0)))).alias("spread"))
    fixed = F.struct(F.lit(FIXED_NULL[0]).alias("mean"), F.lit(FIXED_NULL[1]).alias("spread"))
    null = null.select("length_class", F.when(F.col("m") >= OWN_NULL, of("m", "s", "q")).when(F.col("tm") >= ANY_NULL, of("tm", "ts", "tq")).otherwise(fixed).alias("null"))
    rows = tokens.join(F.broadcast(null), "length_class")  # 17 rows
    p = normal_upper((F.col("null.mean") - score) / F.greatest(F.col("null.spread"), F.lit(LEAST_SPREAD)))
    stepped = rows.withColumn("step", F.ceil(F.log10(F.greatest(p, F.lit(10.0**-LOWEST))) * STEPS).cast("int"))
    counts = stepped.groupBy("length_class", "step").agg(F.count("*").alias("m"))  # at most 17 x 241 rows
    w = Window.partitionBy("length_class")
    below, every = F.sum("m").over(w.orderBy("step")), F.sum("m").over(w)
    passed = F.pow(F.lit(10.0), F.col("step") / STEPS) <= below / every * fdr
    cuts = stored(counts.select("length_class", F.when(passed, F.col("step")).alias("step")).groupBy("length_class").agg(F.max("step").alias("cut")))
    return stepped.join(F.broadcast(cuts), "length_class").where("step <= cut")


def _named(spans: Column, kind: int, name: str) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind"), F.lit(name).alias("name")))


def _ordinary(text: Column, style: int) -> Column:
    """The text's words in one run as names, paths and numbered parts are written: what decoys are cut from."""
    words = F.regexp_extract_all(text, F.lit(r"([A-Za-z][a-z]+)"), F.lit(1))
    numbered = F.transform(words, lambda w, i: F.concat(F.initcap(w), F.when(i % 5 == 3, (i * 37 % 1000).cast("string")).otherwise(F.lit(""))))
    return F.array_join(F.transform(words, F.initcap), "") if style == 0 else F.array_join(numbered, ("", "", "-", "/")[style])


def _decoys(text: Column, found: Column) -> Column:
    """A stretch of each style's run for each length that the text's tokens have; the lengths add up to no more than the text's."""
    sizes = F.array_distinct(F.transform(found, lambda t: t["end"] - t["start"]))
    place = lambda run, n: F.pmod(F.xxhash64(text, n), F.length(run) - n + 1).cast("int") + 1
    cut = lambda run: F.transform(F.filter(sizes, lambda n: n <= F.length(run)), lambda n: run.substr(place(run, n), n))
    return F.flatten(F.transform(F.array(*[_ordinary(text, i) for i in range(STYLES)]), cut))


def scan(docs: DataFrame, fdr: float = 0.01) -> DataFrame:
    """doc_id, spans array<struct<start,end,kind int,name>>: a row for each row of docs (doc_id, text).

    Kinds 0 to 2 are KINDS; kind 3 ("random") are tokens the battery finds that overlap no span of the others.
    Spans are in code points, end exclusive, by start, then kind. Null and empty texts have none. Rows that agree in id
    and text have the same spans; null ids are rows like any other. A text of any length is scanned whole, in time
    that grows with its length and its matches. An empty table gives no rows.
    """
    kinds = []
    for i, (name, pattern, least) in enumerate(KINDS):
        spans = find_all(F.col("text"), pattern, HINTS[i], least)
        kinds.append(_named(spans, i, name))
    tokens = find_all(F.col("text"), f"({BEGIN}{TOKEN}+)", BEGIN, MIN_TOKEN)
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("base", F.concat(*kinds)).withColumn("found", tokens)
    decoys = F.when(F.size("found") > 0, _decoys(F.col("text"), F.col("found")))
    # a row's own mark, so that repeated rows and null ids stay apart: rows that agree in id and text are alike
    rows = stored(rows.select("doc_id", F.xxhash64("text").alias("row_key"), "base", F.col("found").alias("tokens"), decoys.alias("decoys")))
    once = rows.where(F.size("tokens") > 0).dropDuplicates(["doc_id", "row_key"])
    # a token overlaps a base span that begins before its end if the farthest end of those lies beyond its start
    places = once.select("doc_id", "row_key", F.explode(F.concat(F.transform("tokens", lambda t: F.struct(t["end"].alias("at"), F.lit(0).alias("base"), t["start"].alias("start"), t["end"].alias("end"), t["text"].alias("token"))), F.transform("base", lambda b: F.struct(b["start"].alias("at"), F.lit(1).alias("base"), b["start"].alias("start"), b["end"].alias("end"), F.lit("").alias("token"))))).alias("x")).select("doc_id", "row_key", "x.*")
    reach = F.max(F.when(F.col("base") == 1, F.col("end"))).over(Window.partitionBy("doc_id", "row_key").orderBy("at", "base").rowsBetween(Window.unboundedPreceding, 0))
    free = places.withColumn("reach", reach).where("base = 0 and (reach is null or reach <= start)")
    tested = stored(with_h(free.withColumn("r", randomness(F.col("token"))).where("r is not null")).select("doc_id", "row_key", "start", "end", "n", "h", "length_class"))
    decoys = once.select(F.explode("decoys").alias("token"))
    decoys = with_h(decoys.withColumn("r", randomness(F.col("token"))).where("r is not null")).select("n", "h", "length_class")
    kept = findings(tested, decoys, fdr)
    more = kept.groupBy("doc_id", "row_key").agg(F.collect_list(F.struct(F.col("start"), F.col("end"), F.lit(3).alias("kind"), F.lit("random").alias("name"))).alias("more"))
    more = more.select(F.col("doc_id").alias("d"), F.col("row_key").alias("k"), "more")
    joined = rows.select("doc_id", "row_key", "base").join(more, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("row_key") == F.col("k")), "left")
    # sorted as structs: by start, then kind, which follows it
    flat = F.transform(F.concat("base", F.coalesce("more", F.array().cast(more.schema["more"].dataType))), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["name"].alias("name")))
    every = F.transform(F.array_sort(flat), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["name"].alias("name")))
    return joined.select("doc_id", every.alias("spans"))
