"""Ratcliff-Obershelp similarity of titles.

Spark has no such function and edit distance is a different measure, so this is a pandas
UDF. Titles repeat, so each batch scores a (title, candidates) pair once, and letters in
common, counted for all titles at once, rule out most full comparisons.
"""

from __future__ import annotations

import difflib

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

from dossierlake.functions import text as tx
from dossierlake.functions.vocabulary import CONTENTS_TITLES


class _Pool:
    """Candidates that titles are compared with, and the scores of titles already compared."""

    def __init__(self, names: tuple[str, ...], coverage: bool, zero: frozenset):
        # A matcher prepares its second text once.
        self.matchers = [difflib.SequenceMatcher(None, "", name) for name in names]
        self.coverage, self.zero, self.known = coverage, zero, {}
        self.letters = np.unique(_codes("".join(names))[0])
        self.counts, self.sizes = self._counted(names)
        # For each title its score without a full comparison, and the largest ratio that each candidate can have with it.
        self.bounds: dict[str, tuple[float, np.ndarray]] = {}

    def _counted(self, titles) -> tuple[np.ndarray, np.ndarray]:
        """How often each letter of the candidates stands in each title, and the lengths of the titles."""
        codes, sizes = _codes(*titles)
        row, n = np.repeat(np.arange(len(titles)), sizes), max(len(self.letters), 1)
        at = np.searchsorted(self.letters, codes)
        own = at < len(self.letters)
        own[own] = self.letters[at[own]] == codes[own]
        return np.bincount(row[own] * n + at[own], minlength=len(titles) * n).reshape(len(titles), n), sizes

    def bound(self, titles: list[str], most: int = 4096) -> None:
        """Works out the bounds of titles that have none yet: no ratio is above the share of letters in common."""
        new = [x for x in dict.fromkeys(titles) if x not in self.bounds]
        for start in range(0, len(new), most):
            some = new[start: start + most]
            counts, sizes = self._counted(some)
            upper = np.ones((len(some), len(self.matchers)))
            for k, (own, size) in enumerate(zip(self.counts, self.sizes)):
                both = sizes + size
                np.divide(2.0 * np.minimum(counts, own).sum(axis=1), both, out=upper[:, k], where=both > 0)
            for title, high in zip(some, upper):
                self.bounds[title] = (0.0, np.zeros(0)) if title in self.zero else (self._covered(title), high)

    def _covered(self, title: str) -> float:
        best = 0.0
        for m in self.matchers if self.coverage else ():
            if m.b in title or title in m.b:
                short, long = sorted((len(title), len(m.b)))
                if long:
                    best = max(best, 0.5 + 0.45 * short / long)
        return best

    def most(self, title: str) -> float:
        """The largest score that the title can have."""
        low, high = self.bounds[title]
        return max(low, high.max(initial=0.0))

    def score(self, title: str) -> float:
        """The best score of the title; the likeliest candidates are compared first, and those that cannot be better not at all."""
        if title not in self.known:
            best, high = self.bounds[title]
            for k in np.argsort(-high, kind="stable"):
                if high[k] <= best:
                    break
                self.matchers[k].set_seq1(title)
                best = max(best, self.matchers[k].ratio())
            self.known[title] = best
        return self.known[title]


def _codes(*titles: str) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all titles, and how many each has."""
    return np.frombuffer("".join(titles).encode("utf-32-le", "surrogatepass"), np.uint32), np.array([len(x) for x in titles], np.int64)


def _pooled(titles: pd.Series, pools: pd.Series, coverage: bool, zero: frozenset) -> list[_Pool]:
    """The candidates of each row, equal ones once, with the bounds of all their titles; null candidates are left out."""
    prepared, given, out = {}, {}, []
    for row, pool in zip(titles, pools):
        pool = tuple(p for p in pool if p is not None)
        if pool not in prepared:
            prepared[pool] = _Pool(pool, coverage, zero)
        out.append(prepared[pool])
        given.setdefault(pool, []).extend(t for t in row if t is not None)
    for pool, every in given.items():
        prepared[pool].bound(every)
    return out


def _score_lists(titles: pd.Series, pools: pd.Series, coverage: bool, zero: frozenset) -> pd.Series:
    """Scores of each row's titles against its candidates; a null title scores 0, null candidates are left out."""
    return pd.Series([[0.0 if t is None else pool.score(t) for t in row] for row, pool in zip(titles, _pooled(titles, pools, coverage, zero))])


def _best_of(row, pool: _Pool, threshold: float) -> tuple[int | None, float | None]:
    """Place of the first title with the best score of the row, and the score; none below the threshold.

    Titles are compared by what they can score at most, until no other can reach the best.
    """
    # A null title scores 0.
    found = {None: 0.0} if any(t is None for t in row) and threshold <= 0 else {}
    floor = threshold
    for high, title in sorted(((pool.most(t), t) for t in dict.fromkeys(row) if t is not None), reverse=True):
        if high < floor:
            break
        found[title] = pool.score(title)
        floor = max(floor, found[title])
    best = max(found.values(), default=None)
    if best is None or best < threshold:
        return None, None
    return next(i for i, t in enumerate(row) if found.get(t) == best), best


def heading_scores(title_keys: Column, pool_keys: Column) -> Column:
    """Score of each heading of a document against its candidates; contents headings score 0."""
    zero = frozenset(CONTENTS_TITLES)

    @F.pandas_udf("array<double>")
    def score(titles: pd.Series, pools: pd.Series) -> pd.Series:
        return _score_lists(titles, pools, True, zero)

    return score(title_keys, pool_keys)


def best_heading(title_keys: Column, pool_keys: Column, threshold: float) -> Column:
    """struct<at, score>: 0-based place and score of the heading with the highest of `heading_scores`, the first on ties; nulls below the threshold."""
    zero = frozenset(CONTENTS_TITLES)

    @F.pandas_udf("at int, score double")
    def best(titles: pd.Series, pools: pd.Series) -> pd.DataFrame:
        found = [_best_of(row, pool, threshold) for row, pool in zip(titles, _pooled(titles, pools, True, zero))]
        return pd.DataFrame({"at": pd.array([at for at, _ in found], "Int32"), "score": pd.array([score for _, score in found], "Float64")})

    return best(title_keys, pool_keys)


def best_ratio(title: Column, names: list[str]) -> Column:
    """Highest plain ratio of a title against fixed names."""
    keys = F.transform(F.array(*[F.lit(n) for n in names]), lambda n: tx.title_key(n))

    @F.pandas_udf("array<double>")
    def score(titles: pd.Series, pools: pd.Series) -> pd.Series:
        return _score_lists(titles, pools, False, frozenset())

    return score(F.array(tx.title_key(title)), keys)[0]
