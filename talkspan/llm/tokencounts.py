"""Token counts per field or section: whole texts are encoded once, and tokens go to sections by their spans.

A byte-level tokenizer's tokens are runs of the text's bytes, so running sums of their lengths are their spans; spans
in characters follow from the bytes that begin a character. Sections are half-open spans. Token and section spans are
both sorted, so binary searches join them.

Rules for a token that crosses sections: "first" gives it to the section with its first character, "most" to the one
with most of its characters (the earlier at a tie), "split" to each in proportion to its characters.
A token whose bytes only continue a character lies where that character begins.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
RULES = ("first", "most", "split")


@lru_cache(maxsize=2)
def encoding(path: str):
    import tiktoken
    from public_tokenizers import PATTERN

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, i in ranks.items():
        sizes[i] = len(token)
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), sizes


def token_spans(text: str, path: str = RANKS) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each token, in code points."""
    enc, sizes = encoding(path)
    ids = np.asarray(enc.encode_ordinary(text), np.int64)
    ends = np.cumsum(sizes[ids])
    raw = np.frombuffer(text.encode("utf-8"), np.uint8)
    if len(ends) and ends[-1] != len(raw):
        raise ValueError("the tokens do not add up to the text")
    if len(raw) == len(text):
        return ends - sizes[ids], ends
    begun = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))  # characters begun before each byte
    starts = ends - sizes[ids]
    inside = (raw[np.minimum(starts, len(raw) - 1)] & 0xC0) == 0x80 if len(starts) else np.zeros(0, bool)
    return begun[starts] - inside, begun[ends]


def attribute(starts: np.ndarray, ends: np.ndarray, section_ends: np.ndarray, rule: str) -> tuple[np.ndarray, int]:
    """Tokens of each section (sections follow one another from 0), and how many tokens cross sections."""
    n = len(section_ends)
    first = np.minimum(np.searchsorted(section_ends, starts, "right"), n - 1)
    last = np.maximum(first, np.minimum(np.searchsorted(section_ends, np.maximum(ends - 1, starts), "right"), n - 1))
    crossing = np.nonzero(first != last)[0]
    if rule == "first" or not len(crossing):
        return np.bincount(first, minlength=n).astype(float), len(crossing)
    whole = np.bincount(np.delete(first, crossing), minlength=n).astype(float)
    begins = np.concatenate(([0], section_ends[:-1]))
    for i in crossing.tolist():
        part = np.arange(first[i], last[i] + 1)
        held = np.minimum(ends[i], section_ends[part]) - np.maximum(starts[i], begins[part])
        if rule == "most":
            whole[part[np.argmax(held)]] += 1
        else:
            whole[part] += held / held.sum()
    return whole, len(crossing)


def line_ends(text: str) -> np.ndarray:
    """Ends of a text's lines, each with its line break."""
    at = np.nonzero(np.frombuffer(text.encode("utf-32-le"), "<u4") == 10)[0] + 1
    return np.concatenate((at, [len(text) + 1]))


def count(docs: DataFrame, sections: Column | None = None, id_col: str = "doc_id", text_col: str = "text", rule: str = "first", path: str = RANKS) -> DataFrame:
    """doc_id, n_tokens long, n_crossing long, tokens array<double>: a row for each row of docs.

    sections: array<int>, the sections' ends in code points, rising; the last section also takes what lies beyond,
    and no ends make one section. Without sections each line with its line break is one. Null and empty texts have no tokens: 0 for each section.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")

    by_line = sections is None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, crossing, tokens = [], [], []
            cuts = b.column(2)
            for i in range(b.num_rows):
                text = b.column(1)[i].as_py() or ""
                if by_line:
                    ends = line_ends(text)
                else:
                    ends = cuts[i].values.to_numpy() if cuts[i].is_valid else np.zeros(0, np.int64)
                starts, stops = token_spans(text, path)
                held, cross = attribute(starts, stops, ends if len(ends) else np.array([len(text)]), rule)
                n.append(len(starts))
                crossing.append(cross)
                tokens.append(held)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(crossing, pa.int64()), pa.array(tokens, pa.list_(pa.float64()))], ["doc_id", "n_tokens", "n_crossing", "tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), (F.lit(None) if by_line else sections).cast("array<int>").alias("ends"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, n_crossing long, tokens array<double>")


def count_fields(rows: DataFrame, fields: list[str], id_col: str, rule: str = "first", path: str = RANKS, between: str = "\n") -> DataFrame:
    """count() of `fields` joined by `between`, which belongs to the field before it. Null fields are empty."""
    values = [F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]
    text = F.concat_ws(between, *values)
    ends, so_far = [], F.lit(0)
    for v in values:
        so_far = so_far + F.length(v) + len(between)
        ends.append(so_far)
    return count(rows.select(F.col(id_col), text.alias("text"), F.array(*ends).alias("ends")), F.col("ends"), id_col, "text", rule, path)
