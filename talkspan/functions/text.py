"""Text expressions. Lengths are in code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def words(text: Column) -> Column:
    """Runs of characters other than white space."""
    return F.filter(F.split(F.trim(text), r"\s+"), lambda x: x != "")


def overlap_word(word: Column) -> Column:
    """Lower case, letters, digits and underscores only. Text should be in NFC: see udfs.nfc."""
    return F.regexp_replace(F.lower(F.trim(word)), r"[^\p{L}\p{Nd}_]", "")


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance over the greater length; 1 for two empty strings."""
    n = F.greatest(F.length(a), F.length(b))
    return F.when(n == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / n)


def words_match(a: Column, b: Column, least: float = 0.8) -> Column:
    """Equal; or one within the other, both longer than two; or similar. Empty words match only each other."""
    inside = (F.length(a) > 2) & (F.length(b) > 2) & (F.contains(a, b) | F.contains(b, a))
    return F.when((a == "") | (b == ""), a == b).otherwise((a == b) | inside | (similarity(a, b) >= least))


def phrase(text: Column) -> Column:
    """Trimmed, white space collapsed, upper case."""
    return F.upper(F.regexp_replace(F.trim(text), r"\s+", " "))


def search_key(text: Column) -> Column:
    return F.lower(F.trim(text))


def phrase_score(line: Column, default: float, low: float = 0.0, high: float = 8.0) -> tuple[Column, Column]:
    """Phrase and clamped score of a line "phrase :score"; without a number after the last colon, all is phrase."""
    m = F.regexp_extract(line, r"^(.*):\s*([-+]?[0-9]*\.?[0-9]+)\s*$", 2)
    score = F.coalesce(F.when(m != "", m.try_cast("double")), F.lit(default))
    body = F.when(m != "", F.regexp_extract(line, r"^(.*):\s*[-+]?[0-9]*\.?[0-9]+\s*$", 1)).otherwise(line)
    return phrase(body), F.least(F.lit(high), F.greatest(F.lit(low), score))


def is_phrase_line(line: Column) -> Column:
    """Neither blank nor a comment."""
    return (F.trim(line) != "") & ~F.trim(line).startswith("#")


def score_text(score: Column) -> Column:
    """Two decimals at most, without trailing zeros."""
    s = F.format_string("%.2f", score)
    return F.regexp_replace(s, r"\.?0+$", "")


def base_name(path: Column) -> Column:
    """What follows the last slash, without the last extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"(.)\.[^.]*$", "$1")


def extension(path: Column, default: str = "") -> Column:
    e = F.regexp_extract(path, r".\.([^./\\]+)$", 1)
    return F.when(e == "", F.lit(default)).otherwise(F.lower(e))


def display_name(name: Column, default: str = "untitled") -> Column:
    """Control characters and slashes to blanks, collapsed and trimmed; a default for nothing."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit("")), r"[\x00-\x1F/\\]", " "), " +", " "))
    return F.when(clean == "", F.lit(default)).otherwise(clean)


def abbreviate(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit("..."))).otherwise(text)


def byte_size(n: Column, units: tuple[str, ...] = ("KB", "MB", "GB")) -> Column:
    """Bytes below 1024, else one decimal of the greatest unit that gives 1 or more."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for i, unit in enumerate(units):
        step = 1024 ** (i + 1)
        out = F.when(n >= step, F.concat(F.format_string("%.1f", F.floor(n * 10 / step + 0.5) / 10), F.lit(" " + unit))).otherwise(out)
    return out


def clock(seconds: Column) -> Column:
    """mm:ss; minutes go on beyond 99."""
    s = F.greatest(F.lit(0), F.floor(seconds)).cast("long")
    return F.format_string("%02d:%02d", F.floor(s / 60).cast("long"), (s % 60).cast("long"))


def colour(rgb: Column) -> Column:
    return F.concat(F.lit("#"), F.lpad(F.hex(rgb.bitwiseAND(0xFFFFFF)), 6, "0"))


def speaker_label(speaker: Column, prefix: str = "Người nói ") -> Column:
    return F.concat(F.lit(prefix), (speaker + 1).cast("string"))


def ends_sentence(text: Column) -> Column:
    return text.rlike(r"""[.!?:;]["')\]]*$""")


def is_mark(token: Column) -> Column:
    return token.isin(":", ".", ",", "?")


def change_case(token: Column, label: Column) -> Column:
    """Case edits by label; others leave the token."""
    first, n = F.left(token, F.lit(1)), F.length(token)
    tail = token.substr(F.lit(2), n)
    second = F.concat(first, F.upper(token.substr(F.lit(2), F.lit(1))), token.substr(F.lit(3), n))
    but_last = F.concat(F.upper(token.substr(F.lit(1), n - 1)), F.right(token, F.lit(1)))
    return (
        F.when(label == "LOWER", F.lower(token)).when(label == "UPPER", F.upper(token)).when(label == "CAPITAL", F.concat(F.upper(first), tail))
        .when((label == "CAPITAL_1") & (n > 1), second).when((label == "UPPER_-1") & (n > 1), but_last).otherwise(token)
    )


def edit_kind(label: Column) -> Column:
    """The allowed edits: an appended mark of : . , ? or a change of case; null for others."""
    mark = F.regexp_extract(label, r"^\$APPEND_([:.,?])$", 1)
    case = F.regexp_extract(label, r"^\$TRANSFORM_CASE_(LOWER|UPPER|CAPITAL|CAPITAL_1|UPPER_-1)$", 1)
    return F.when(mark != "", F.struct(F.lit("append").alias("kind"), mark.alias("arg"))).when(case != "", F.struct(F.lit("case").alias("kind"), case.alias("arg")))


def tidy_marks(text: Column) -> Column:
    """Colons to blanks, commas and dots collapsed, a blank after marks and none before, no leading comma."""
    steps = ((":", " "), (r"(\s*,)+", ","), (r"\.{4,}", "..."), (r",\s*\.", "."), (r"([,?]|\.(?=[^.]))\s*", "$1 "), (r"\s+([,.?])", "$1"), (r"^\s*,\s*", ""), (r"\s+", " "))
    for pattern, by in steps:
        text = F.regexp_replace(text, pattern, by)
    return F.trim(text)


def one_comma(sentence: Column, least: int = 8) -> Column:
    """Sentences of fewer than `least` words keep only their first comma."""
    at = F.locate(",", sentence)
    first = sentence.substr(F.lit(1), at)
    return F.when((F.size(words(sentence)) < least) & (at > 0), F.concat(first, F.replace(sentence.substr(at + 1, F.length(sentence)), F.lit(",")))).otherwise(sentence)


def sentences(text: Column) -> Column:
    return F.filter(F.split(text, r"(?<=[.?!])\s+"), lambda x: x != "")


def capital_first(text: Column) -> Column:
    return F.concat(F.upper(F.left(text, F.lit(1))), text.substr(F.lit(2), F.length(text)))


def polish(text: Column) -> Column:
    """Marks tidied, commas of short sentences thinned, sentences begun with a capital."""
    return F.array_join(F.transform(sentences(tidy_marks(text)), lambda s: capital_first(one_comma(s))), " ")


def nth_word_end(text: Column, n: Column) -> Column:
    """Characters up to the end of the n-th word; 0 for n < 1, all of the text beyond its last word."""
    parts = F.regexp_extract_all(text, F.lit(r"\s*\S+"), F.lit(0))
    taken = F.slice(parts, 1, F.greatest(F.lit(0), n).cast("int"))
    return F.when(n < 1, F.lit(0)).when(n >= F.size(parts), F.length(text)).otherwise(F.aggregate(taken, F.lit(0), lambda a, x: a + F.length(x)))
