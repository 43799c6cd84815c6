"""Folds over an item's ordered rows: what depends on its own earlier decisions. One Python call per item."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator, Sequence
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from talkspan.operators import merge


def folded(rows: DataFrame, key: str, run: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """run on each item's rows; the result's columns follow schema, which begins with the key."""

    def one(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = run(pdf)
        out.insert(0, key, k[0])
        return out

    return rows.groupBy(key).applyInPandas(one, f"{key} {dict(rows.dtypes)[key]}, {schema}")


def each(rows: DataFrame, run: Callable[..., tuple], schema: str) -> DataFrame:
    """run on each row's values, in Arrow batches: what needs no other row. The result's columns follow schema."""
    names = [f.strip().split(" ")[0] for f in schema.split(", ")]
    empty = rows.sparkSession.createDataFrame([], schema)
    kinds = empty._jdf.schema().json()

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema
        from pyspark.sql.types import StructType

        import json

        to = to_arrow_schema(StructType.fromJson(json.loads(kinds)))
        for b in batches:
            out = [run(*values) for values in zip(*[c.to_pylist() for c in b.columns], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], to.field(n).type) for i, n in enumerate(names)], names)

    return rows.mapInArrow(go, schema)


# --- turns

TURN = "start_ms long, end_ms long, speaker int"


def natural(turns: list[tuple], word_mids: list[int] | None, short: int = 2000, few: int = 3, gap: int = 2000) -> list[tuple]:
    """Turns (start, end, speaker) where short stretches inside another speaker's stretch take that speaker.

    A stretch is a run of one speaker's turns less than `gap` apart, over others' turns. In order of start, a stretch
    that is not itself inside one holds those of others that begin before its end and end by it. A held stretch that
    is shorter than `short` as a whole and has at most `few` words (none known: any number) goes to its first holder
    with all its turns. Fewer than three turns stay.
    """
    turns = sorted(turns, key=_order)
    if len(turns) < 3:
        return turns
    by: dict[int, list[list]] = {}
    for i, (s, e, sp) in enumerate(turns):
        own = by.setdefault(sp, [])
        if own and s - own[-1][1] < gap:
            own[-1][1] = max(own[-1][1], e)
            own[-1][3].append(i)
        else:
            own.append([s, e, sp, [i]])
    stretches = sorted((x for own in by.values() for x in own), key=lambda x: x[0])  # at a tie by first appearance
    held: dict[int, int] = {}
    for a, (_, end, sp, _) in enumerate(stretches):
        if a in held:
            continue
        for b in range(a + 1, len(stretches)):
            if stretches[b][0] >= end:
                break
            if stretches[b][1] <= end and stretches[b][2] != sp and b not in held:
                held[b] = sp
    out = [list(t) for t in turns]
    for b, sp in held.items():
        s, e, _, members = stretches[b]
        words = sum(s <= m <= e for m in word_mids) if word_mids else 0
        if e - s < short and words <= few:
            for i in members:
                out[i][2] = sp
    return [tuple(t) for t in out]


def _order(turn: tuple) -> tuple:
    return turn[0], turn[2], turn[1]


def merged(turns: list[tuple], gap: int | None) -> list[tuple]:
    out: list[list] = []
    for s, e, sp in turns:
        if out and out[-1][2] == sp and (gap is None or s - out[-1][1] <= gap):
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e, sp])
    return [tuple(t) for t in out]


def _turns(pdf: pd.DataFrame) -> list[tuple]:
    return list(zip(pdf["start_ms"].tolist(), pdf["end_ms"].tolist(), pdf["speaker"].tolist(), strict=True))


def _frame(turns: Sequence[tuple]) -> pd.DataFrame:
    return pd.DataFrame(list(turns), columns=["start_ms", "end_ms", "speaker"])


def clean_turns(turns: DataFrame, key: str, ordinal: str = "turn_no") -> DataFrame:
    """key, start_ms, end_ms, speaker: gaps up to 300 ms merged, zones of fragments dissolved, natural(), gaps up to
    500 and then 300 ms merged. Only natural() is a fold; the rest is windows."""
    one = merge.gap_merge(turns, [key], 300, ordinal).withColumnRenamed("n", ordinal)
    two = merge.fragment_zones(one, [key], ordinal=ordinal)

    def settled(pdf: pd.DataFrame) -> pd.DataFrame:
        ts = _turns(pdf)
        return _frame(merged(sorted(natural(ts, None), key=_order), 500) if len(ts) > 2 else ts)

    three = folded(two, key, settled, TURN)
    return merge.gap_merge(three.withColumn(ordinal, three["start_ms"]), [key], 300, ordinal).drop("n")


def drop_blips(turns: list[tuple], least: int = 780) -> list[tuple]:
    """Turns up to `least` long go; between two of one speaker they lengthen the one before."""
    out: list[tuple] = []
    for i, (s, e, sp) in enumerate(turns):
        if e - s > least:
            out.append((s, e, sp))
        elif out and i + 1 < len(turns) and out[-1][2] == turns[i + 1][2]:
            out[-1] = (out[-1][0], max(out[-1][1], e), out[-1][2])
    return out


def post_process(turns: DataFrame, key: str, ordinal: str = "turn_no") -> DataFrame:
    """key, start_ms, end_ms, speaker (by held time): overlaps cut in the middle, gaps up to 4 s merged, blips
    dropped, neighbours merged."""
    cut = merge.midpoint_cut(turns, [key], ordinal)
    joined = merge.gap_merge(cut, [key], 4000, ordinal, sort=False)
    kept = folded(joined, key, lambda pdf: _frame(merged(drop_blips(sorted(_turns(pdf))), None)), TURN)
    rank = merge.rank_speakers(kept, [key]).select(key, "speaker", "rank")
    return kept.join(rank, [key, "speaker"]).select(key, "start_ms", "end_ms", rank["rank"].alias("speaker"))


# --- texts of overlapping chunks


def overlap_word(word: str | None) -> str:
    """Letters, decimal digits and underscores of a word in lower case and normal form C."""
    kept = lambda c: c == "_" or unicodedata.category(c)[0] == "L" or unicodedata.category(c) == "Nd"
    return "".join(filter(kept, unicodedata.normalize("NFC", (word or "").lower().strip())))


def alignment(tail: list[str], head: list[str], match: Callable[[str, str], bool], least: float = 0.5) -> tuple[int, int, int] | None:
    """(matches, words of tail after its last match, words of head up to its last match): head laid over tail at every
    offset, the first one with the most matches that are `least` of the words over each other."""
    known = {(x, y): match(x, y) for x in set(tail) for y in set(head)}
    table = np.array([[known[x, y] for y in head] for x in tail], bool).reshape(len(tail), len(head))
    best = None
    for off in range(1 - len(tail), len(head)):
        over = np.diagonal(table, off)
        hits = np.flatnonzero(over)
        if len(hits) > (best[0] if best else 0) and len(hits) >= least * len(over):
            last = int(hits[-1])
            best = (len(hits), len(tail) - 1 - max(0, -off) - last, max(0, off) + last + 1)
    return best


def similar(a: str, b: str, least: float = 0.8) -> bool:
    if not a or not b:
        return a == b
    if a == b or (min(len(a), len(b)) > 2 and (a in b or b in a)):
        return True
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return 1 - row[-1] / max(len(a), len(b)) >= least


def seam(tail: list[tuple], head: list[tuple], most: int = 100) -> tuple[int, int]:
    """Words to drop from the end of what is there, and words of the next chunk to pass over: the words (text, start,
    end, prob) of both in their overlap meet at the last match of their alignment, of `most` words a side.

    Where words are left over behind that match on the left, or nothing matches, the surer rest stays whole: the left
    one, and the next chunk goes on behind the overlap, or the next chunk, and all of the left's overlap goes.
    """
    if not tail or not head:
        return 0, 0
    a, b = [overlap_word(w[0]) for w in tail[-most:]], [overlap_word(w[0]) for w in head[:most]]
    found = alignment(a, b, similar)
    hits, drop, skip = found or (0, len(tail), 0)
    if hits and not (drop and hits < min(len(a), len(b))):
        return drop, skip
    mean = lambda ws: sum(w[3] for w in ws) / len(ws) if ws else 1.0
    return (0, len(head)) if mean(tail[len(tail) - drop :]) > mean(head[skip:]) else (len(tail), 0)


def stitch(chunks: list[dict], least_ms: int = 50, most_ms: int = 3000) -> list[tuple]:
    """Words (text, start, end, prob) of one text out of chunks (start_ms, end_ms, words) whose neighbours overlap: by
    seam(), over `most_ms` at most; chunks that share no more than `least_ms` follow one another."""
    out: list[tuple] = []
    before = None
    for c in chunks:
        drop = skip = 0
        if before is not None and before["end_ms"] - c["start_ms"] > least_ms:
            shared = min(most_ms, before["end_ms"] - c["start_ms"])
            drop, skip = seam([w for w in before["words"] if w[1] >= before["end_ms"] - shared], [w for w in c["words"] if w[1] < c["start_ms"] + shared])
        out = out[: max(0, len(out) - drop)] if c["words"] else out
        out.extend(c["words"][skip:])
        before = c
    return out


MARKS = frozenset(":.,?")


def join_lists(parts: list[list[str]], most: int = 16, least: int = 6) -> list[str]:
    """Token lists whose ends repeat each other.

    The last `most` tokens that are no marks meet the first of the next list, in lower case. Of the longest shared run
    of `least` or more, the first `most` - `least` tokens (but never the whole run) come from the left, the others from
    the right. Without one all of the left stays and as many tokens of the right go, but its last.
    """
    out: list[str] = []
    for p in parts:
        if not out:
            out = list(p)
            continue
        left = list(islice((i for i in range(len(out) - 1, -1, -1) if out[i] not in MARKS), most))[::-1]
        right = list(islice((i for i, t in enumerate(p) if t not in MARKS), most))
        ours, theirs = [out[i].lower() for i in left], [p[i].lower() for i in right]
        n = next((k for k in range(min(len(ours), len(theirs)), least - 1, -1) if ours[len(ours) - k :] == theirs[:k]), 0)
        kept = min(most - least, (n or len(right)) - 1)
        if n:
            del out[left[len(left) - n + kept] :]
        out.extend(p[right[kept] :] if right else p)
    return out


# --- edits


def apply_edits(tokens: list[str], edits: list[tuple[int, str, str]]) -> list[str]:
    """tokens after edits (index, kind, arg): "append" adds a mark unless one follows, "case" changes the token."""
    out, shift = list(tokens), 0
    for i, kind, arg in sorted(edits, key=lambda e: e[0]):
        at = i + shift
        if not 0 <= at < len(out):
            continue
        if kind == "append":
            if at + 1 < len(out) and out[at + 1] in ".,?:":
                continue
            out.insert(at + 1, arg)
            shift += 1
        else:
            t = out[at]
            new = {"LOWER": t.lower(), "UPPER": t.upper(), "CAPITAL": t[:1].upper() + t[1:]}
            new |= {"CAPITAL_1": t[:1] + t[1:2].upper() + t[2:], "UPPER_-1": t[:-1].upper() + t[-1:]} if len(t) > 1 else {}
            out[at] = new.get(arg, t)
    return out


def refine(tokens: list[str], predict: Callable[[list[str], int], list[tuple[int, str, str]]], rounds: int = 3) -> list[str]:
    """Edits predicted again on their own result, until nothing changes or a text comes back."""
    seen = {tuple(tokens)}
    for n in range(rounds):
        new = apply_edits(tokens, predict(tokens, n))
        if new == tokens or tuple(new) in seen:
            return new
        seen.add(tuple(new))
        tokens = new
    return tokens
