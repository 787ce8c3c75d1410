"""Main text of web pages: a linear-chain conditional random field over leaf blocks.

Blocks are labelled as article or not. Features are the tags and class words around a block and the shape
of its text, never its words. Weights are fitted on labelled pages, which ``labelled_pages`` makes in many
layouts; pages are decoded with Viterbi's algorithm.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagework.llm.labelled_pages import labelled_pages
from passagework.llm.leaf_blocks import Block, leaf_blocks

PAGES, SEED = 700, 11
STEPS, STEP, DECAY = 120, 0.4, 1e-4
REGIONS = ("article", "main", "nav", "header", "footer", "aside", "form", "section", "table")


def features(block: Block, place: float) -> list[str]:
    """Names of the features that are on; ``place`` runs from 0 at the first block to 1 at the last."""
    tags = set(block.path)
    words = len(block.text.split())
    size = min(words, 3) if words < 4 else 4 if words < 8 else 5 if words < 20 else 6 if words < 60 else 7
    share = block.linked / max(block.total, 1)
    end = block.text[-1]
    region = next((t for t in reversed(block.path) if t in REGIONS), "none")
    return [
        "any", f"leaf {block.path[-1] if block.path else 'none'}", f"in {region}", f"size {size}",
        f"links {0 if share < 0.1 else 1 if share < 0.5 else 2 if share < 0.9 else 3}",
        f"end {'stop' if end in '.!?' else 'alnum' if end.isalnum() else 'other'}", f"sign {'©' in block.text}",
        f"place {0 if place < 0.1 else 2 if place > 0.9 else 1}",
        *(f"tag {t}" for t in tags), *(f"name {n}" for n in block.names),
        f"{region} size {size}", *(f"{n} in article" for n in block.names if "article" in tags)]


class Chain:
    """Weights by feature name (log odds of the label 1), of transitions, and of the first label."""

    def __init__(self, weights: dict[str, float], moves: np.ndarray, first: np.ndarray) -> None:
        self.weights, self.moves, self.first = weights, moves.tolist(), first.tolist()

    def decode(self, blocks: list[Block]) -> list[bool]:
        """The most likely labels; a tie is decided for label 0."""
        if not blocks:
            return []
        weight, last = self.weights.get, max(len(blocks) - 1, 1)
        (stay0, up), (down, stay1) = self.moves
        scores, back = None, []
        for i, block in enumerate(blocks):
            x = sum(weight(name, 0.0) for name in features(block, i / last))
            if scores is None:
                scores = (self.first[0], self.first[1] + x)
                continue
            a, b = scores
            back.append((b + down > a + stay0, b + stay1 > a + up))
            scores = (max(a + stay0, b + down), max(a + up, b + stay1) + x)
        labels = [scores[1] > scores[0]]
        for pair in reversed(back):
            labels.append(pair[labels[-1]])
        return labels[::-1]

    def text(self, page: str) -> str:
        blocks = leaf_blocks(page)
        return "\n\n".join(b.text for b, yes in zip(blocks, self.decode(blocks), strict=True) if yes)


def fit(pages: Iterable[tuple[list[Block], list[bool]]], steps: int = STEPS) -> Chain:
    """Maximise the regularised likelihood of the labels by gradient ascent with per-weight step sizes."""
    pages = [(blocks, labels) for blocks, labels in pages if blocks]
    index: dict[str, int] = {}
    rows, columns, where = [], [], []
    longest = max(len(blocks) for blocks, _ in pages)
    y = np.zeros((len(pages), longest), np.int64)
    on = np.zeros((len(pages), longest), bool)
    for p, (blocks, labels) in enumerate(pages):
        y[p, :len(labels)], on[p, :len(labels)] = labels, True
        for t, block in enumerate(blocks):
            for name in features(block, t / max(len(blocks) - 1, 1)):
                rows.append(len(where))
                columns.append(index.setdefault(name, len(index)))
            where.append(p * longest + t)
    rows, columns, where = np.array(rows), np.array(columns), np.array(where)
    n, k = len(pages), len(index)
    weights, moves, first = np.zeros(k), np.zeros((2, 2)), np.zeros(2)
    seen = [np.full(k, 1e-6), np.full((2, 2), 1e-6), np.full(2, 1e-6)]
    both = on[:, 1:] & on[:, :-1]
    counted = np.stack([[(both & (y[:, :-1] == a) & (y[:, 1:] == b)).sum() for b in (0, 1)] for a in (0, 1)])
    begun = np.bincount(y[:, 0], minlength=2)
    for _ in range(steps):
        flat = np.zeros(n * longest)
        flat[where] = np.bincount(rows, weights[columns], len(where))
        emit = np.zeros((n, longest, 2))
        emit[:, :, 1] = flat.reshape(n, longest)
        ahead, behind = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        ahead[:, 0] = first + emit[:, 0]
        for t in range(1, longest):
            step = np.logaddexp.reduce(ahead[:, t - 1, :, None] + moves, axis=1) + emit[:, t]
            ahead[:, t] = np.where(on[:, t, None], step, ahead[:, t - 1])
        for t in range(longest - 2, -1, -1):
            step = np.logaddexp.reduce(moves + (emit[:, t + 1] + behind[:, t + 1])[:, None, :], axis=2)
            behind[:, t] = np.where(on[:, t + 1, None], step, 0.0)
        total = np.logaddexp.reduce(ahead[:, -1], axis=1)
        p1 = np.exp(ahead[:, :, 1] + behind[:, :, 1] - total[:, None])
        pair = np.exp(ahead[:, :-1, :, None] + moves + (emit[:, 1:] + behind[:, 1:])[:, :, None, :]
                      - total[:, None, None, None])
        slope = [np.bincount(columns, (y - p1).reshape(-1)[where][rows], k) / n - DECAY * weights,
                 (counted - (pair * both[:, :, None, None]).sum(axis=(0, 1))) / n - DECAY * moves,
                 (begun - np.array([(1 - p1[:, 0]).sum(), p1[:, 0].sum()])) / n - DECAY * first]
        for value, grad, sums in zip((weights, moves, first), slope, seen, strict=True):
            sums += grad ** 2
            value += STEP * grad / np.sqrt(sums)
    return Chain({name: float(weights[i]) for name, i in index.items()}, moves, first)


@cache
def standard_chain(pages: int = PAGES, seed: int = SEED) -> Chain:
    return fit(labelled_pages(pages, seed))


def main_text(page: Column, chain: Chain | None = None) -> Column:
    """The article of each whole page: its blocks in page order, joined by empty lines.

    Character references are decoded, white space inside a block becomes one space. Null and empty pages,
    and pages without an article, give the empty string; equal pages give equal texts.
    """
    model = chain or standard_chain()

    @F.arrow_udf(T.StringType())
    def text(pages: pa.Array) -> pa.Array:
        return pa.array([model.text(x.as_py() or "") for x in pages], pa.string())

    return text(F.coalesce(page, F.lit("")))


def extract(pages: DataFrame, html_column: str = "html", out: str = "text", chain: Chain | None = None) -> DataFrame:
    """``pages`` with the column ``out`` added (a column of that name is replaced); all rows stay.

    A null, empty or textless page has an empty text, pages of any length are read whole, equal pages get equal texts,
    and an empty table gives an empty table.
    """
    return pages.withColumn(out, main_text(F.col(html_column), chain))
