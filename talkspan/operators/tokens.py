"""Vocabularies, word pieces, phrase automata and beam search over given log-probabilities."""

from __future__ import annotations

import math
import unicodedata
from collections import deque
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np


def unigram(text: str, vocab: dict[str, float], mark: str = "▁", unknown: float = -20.0) -> list[str]:
    """Pieces of the best total score of NFKC text, with a mark before each word; a character of no piece costs
    `unknown`. The longer last piece wins a tie."""
    s = mark + mark.join(unicodedata.normalize("NFKC", text).split())
    if s == mark:
        return []
    longest = max(map(len, vocab), default=1)
    best, back = [0.0] + [-math.inf] * len(s), [0] * (len(s) + 1)
    for end in range(1, len(s) + 1):
        for start in range(max(0, end - longest), end):
            score = vocab.get(s[start:end], unknown if end - start == 1 else -math.inf)
            if best[start] + score > best[end]:
                best[end], back[end] = best[start] + score, start
    out, end = [], len(s)
    while end:
        out.append(s[back[end] : end])
        end = back[end]
    return out[::-1]


def word_pieces(word: str, vocab: set[str] | dict, unknown: str = "[UNK]", most: int = 100) -> list[str]:
    """Longest pieces from the left, later ones with ##; the whole word is unknown if a part is, or if it is long."""
    if len(word) > most:
        return [unknown]
    out, at = [], 0
    while at < len(word):
        lead = "##" if at else ""
        end = next((e for e in range(len(word), at, -1) if lead + word[at:e] in vocab), None)
        if end is None:
            return [unknown]
        out.append(lead + word[at:end])
        at = end
    return out


@dataclass
class Node:
    token: int = -1
    step: float = 0.0  # score of the edge here
    total: float = 0.0  # along the path
    done: float = 0.0  # not zero where a phrase ends here or at a suffix
    is_end: bool = False
    next: dict[int, "Node"] = field(default_factory=dict)
    fail: "Node | None" = None
    suffix: "Node | None" = None  # the longest phrase that ends here but is shorter than the path


class PhraseGraph:
    """Automaton of token phrases: a path through a phrase gains its score by parts, and loses them if it leaves the
    phrase before its end. A path that completes a phrase keeps its score, once, and begins anew at the root; so a
    phrase that another begins with ends that one too. Of an edge's scores the highest counts; a path's sum is that of
    when its phrase was added."""

    def __init__(self, phrases: Iterable[tuple[list[int], float]]):
        self.root = Node()
        self.root.fail = self.root
        for tokens, score in phrases:
            node = self.root
            for i, t in enumerate(tokens):
                child = node.next.setdefault(t, Node(t))
                child.step = max(child.step, score) if child.step else score
                child.total = node.total + child.step
                child.is_end |= i + 1 == len(tokens)
                if child.is_end:
                    child.done = child.total
                node = child
        queue = deque([self.root])
        while queue:  # breadth first: a node's fail lies nearer the root
            node = queue.popleft()
            for t, child in node.next.items():
                f = node.fail
                while f is not self.root and t not in f.next:
                    f = f.fail
                child.fail = f.next[t] if node is not self.root and t in f.next else self.root
                child.suffix = child.fail if child.fail.is_end else child.fail.suffix
                if child.suffix is not None:
                    child.done += child.suffix.done
                queue.append(child)

    def forward(self, node: Node, token: int) -> tuple[float, Node]:
        """Gain and next state of a token."""
        at = node
        while at is not self.root and token not in at.next:
            at = at.fail
        to = at.next.get(token, self.root)
        if to.done == 0.0:
            return to.total - node.total, to
        return (to if to.is_end else to.suffix).total - node.total, self.root

    def finish(self, node: Node) -> float:
        """What an unfinished phrase gives back at the end."""
        return -node.total


@dataclass
class Hypothesis:
    tokens: tuple[int, ...]
    score: float
    state: Node | None
    frames: tuple[int, ...] = ()

    def mean(self, prefix: int = 0) -> float:
        return self.score / (len(self.tokens) + prefix)


def beam_search(log_probs: np.ndarray, beam: int = 8, blank: int = 0, graph: PhraseGraph | None = None, prefix: int = 2) -> Hypothesis:
    """Best hypothesis by score per token over frames of log-probabilities; one token a frame at most.

    Hypotheses of equal tokens join by log-sum-exp. Blanks add no token. The earlier wins a tie.
    """
    hyps = [Hypothesis((), 0.0, graph.root if graph else None)]
    for t, row in enumerate(log_probs):
        total = np.array([h.score for h in hyps])[:, None] + row[None, :]
        order = np.argsort(-total, axis=None, kind="stable")[:beam]
        merged: dict[tuple[int, ...], Hypothesis] = {}
        for flat in order.tolist():
            h, token = hyps[flat // len(row)], flat % len(row)
            score = float(total.ravel()[flat])
            if token == blank:
                new = Hypothesis(h.tokens, score, h.state, h.frames)
            else:
                gain, state = graph.forward(h.state, token) if graph else (0.0, None)
                new = Hypothesis((*h.tokens, token), score + gain, state, (*h.frames, t))
            old = merged.get(new.tokens)
            if old is None:
                merged[new.tokens] = new
            else:
                old.score = float(np.logaddexp(old.score, new.score))
        hyps = list(merged.values())
    if graph:
        for h in hyps:
            h.score += graph.finish(h.state)
    return max(hyps, key=lambda h: h.mean(prefix))


def context_tokens(ys: list[int], prefix: int = 2) -> list[int]:
    """Tokens after the context prefix, without blanks and specials."""
    return [y for y in ys[prefix:] if y > 0]
