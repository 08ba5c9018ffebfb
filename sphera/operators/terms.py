"""Index and query terms for regions and points: an inverted index whose join is on strings.

A document's terms are its cells' ancestors and (marked `$`) its covering's cells; a query's likewise, so that two
coverings that intersect share a term. Levels go from min_level to max_level by level_mod.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sphera.functions import cells

MARK = "$"


@dataclass(frozen=True)
class Options:
    min_level: int = 4
    max_level: int = 16
    level_mod: int = 1
    points_only: bool = False
    optimize_for_space: bool = False

    @property
    def true_max(self) -> int:
        return self.max_level - (self.max_level - self.min_level) % self.level_mod

    @property
    def levels(self) -> range:
        return range(self.min_level, self.max_level + 1, self.level_mod)


def _ancestor(cell: Column, at: int, prefix: str) -> Column:
    return F.concat(F.lit(prefix), cells.token(cells.parent(cell, at)))


def _covering(cell: Column, at: int, prefix: str) -> Column:
    return F.concat(F.lit(prefix + MARK), cells.token(cells.parent(cell, at)))


def point_index_terms(leaf: Column, o: Options = Options(), prefix: str = "") -> Column:
    return F.array(*[_ancestor(leaf, at, prefix) for at in o.levels])


def point_query_terms(leaf: Column, o: Options = Options(), prefix: str = "") -> Column:
    own = [_ancestor(leaf, o.true_max, prefix)]
    return F.array(*own, *([] if o.points_only else [_covering(leaf, at, prefix) for at in reversed(o.levels)]))


def region_index_terms(df: DataFrame, cell: str, keys: list[str], o: Options = Options(), prefix: str = "") -> DataFrame:
    """keys, term of coverings given as rows (keys, cell) of levels in o.levels; each term once for a key."""
    c, at = F.col(cell), cells.level(F.col(cell))
    terms = [F.when(at < o.true_max, F.concat(F.lit(prefix + MARK), cells.token(c)))]
    terms.append(F.when((at == o.true_max) | F.lit(not o.optimize_for_space), F.concat(F.lit(prefix), cells.token(c))))
    terms += [F.when(at > level, _ancestor(c, level, prefix)) for level in o.levels]
    return df.select(*keys, F.explode_outer(F.array(*terms)).alias("term")).where("term is not null").distinct()


def region_query_terms(df: DataFrame, cell: str, keys: list[str], o: Options = Options(), prefix: str = "") -> DataFrame:
    c, at = F.col(cell), cells.level(F.col(cell))
    terms = [F.concat(F.lit(prefix), cells.token(c))]
    if not o.points_only:
        if o.optimize_for_space:
            terms.append(F.when(at < o.true_max, F.concat(F.lit(prefix + MARK), cells.token(c))))
        terms += [F.when(at > level, _covering(c, level, prefix)) for level in o.levels]
    return df.select(*keys, F.explode_outer(F.array(*terms)).alias("term")).where("term is not null").distinct()


def candidates(index: DataFrame, query: DataFrame, doc: str, q: str) -> DataFrame:
    """Distinct (doc, q) that share a term."""
    return index.join(query, "term").select(doc, q).distinct()
