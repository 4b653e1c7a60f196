"""Mixing sources to target weights by iterative proportional fitting.

One aggregation gives the tokens of every (source, language, topic) cell. The driver rakes cell weights until the
weighted tokens match the three target marginals, and turns them into sampling probabilities; a second pass keeps each
document by comparing a hash of its id with the probability of its cell. Text is never shuffled: the cells are a small
table and the second pass is a filter.

A document without a topic column gets the bucket of its dominant term: of its words of at least five letters
(lower-cased), the most frequent, ties to the smallest; documents without such a word are in bucket 0.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, fresh, q
from .packing import token_count

TOPICS = 8
#: Cells are held by the driver and sent to the tasks; more than this is refused, since a category is then no category.
MAX_CELLS = 200_000
MISSING = "\x00missing"


def dominant_term(text: str | None) -> str | None:
    counts = Counter(w for w in WORD.findall((text or "").lower()) if len(w) > 4)
    if not counts:
        return None
    most = max(counts.values())
    return min(w for w, n in counts.items() if n == most)


def topic_of(text: str | None, topics: int = TOPICS) -> int:
    term = dominant_term(text)
    return 0 if term is None else xxhash.xxh64_intdigest(term.encode("utf-8", "surrogatepass")) % topics


def rake(tokens: np.ndarray, targets: list[np.ndarray], rounds: int = 200, tolerance: float = 1e-9) -> np.ndarray:
    """Factors by which to multiply ``tokens`` (one axis a marginal) so that its shares along each axis meet ``targets``.

    Categories without tokens are left out of their target and the rest is scaled up, so the targets are consistent with
    empty categories; where empty cells make them unreachable, the last round's fit stands.
    """
    factors = np.where(tokens > 0, 1.0, 0.0)
    if not tokens.sum():
        return factors
    shares = tokens / tokens.sum()
    axes = range(tokens.ndim)
    goals = []
    for axis, target in zip(axes, targets):
        rest = tuple(a for a in axes if a != axis)
        goal = np.where(shares.sum(axis=rest) > 0, target, 0.0)
        goals.append((rest, goal / goal.sum() if goal.sum() else shares.sum(axis=rest)))
    for _ in range(rounds):
        worst = 0.0
        for axis, (rest, goal) in zip(axes, goals):
            now = (shares * factors).sum(axis=rest)
            ratio = np.divide(goal, now, out=np.zeros_like(goal), where=now > 0)
            worst = max(worst, np.abs(now - goal).max())
            factors = factors * ratio.reshape([-1 if a == axis else 1 for a in axes])
        if worst < tolerance:
            break
    return factors


def probabilities(tokens: np.ndarray, factors: np.ndarray, keep_share: float) -> np.ndarray:
    """min(1, c * factor) with the c that keeps ``keep_share`` of all tokens in expectation.

    Cells that reach 1 are exhausted: they can't give more, so the marginals are met up to those.
    """
    goal = keep_share * tokens.sum()
    low, high = 0.0, 1.0
    while (np.minimum(1, high * factors) * tokens).sum() < goal * (1 - 1e-12) and high < 1e18:
        high *= 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if (np.minimum(1, mid * factors) * tokens).sum() < goal else (low, mid)
    return np.minimum(1, high * factors)


def smoothed(values: list[str], totals: dict[str, float], power: float) -> np.ndarray:
    """Target shares in proportion to tokens**power: 1 keeps the corpus, 0 makes all categories equal."""
    w = np.array([max(totals.get(v, 0.0), 0.0) ** power if totals.get(v, 0.0) > 0 else 0.0 for v in values])
    return w / w.sum() if w.sum() else w


def _columns(docs: DataFrame, source_col: str, lang_col: str, topic_col: str | None, text_col: str, topics: int):
    @F.pandas_udf("string")
    def topic(texts: pd.Series) -> pd.Series:
        return pd.Series([str(topic_of(t, topics)) for t in texts], index=texts.index, dtype=object)

    name = [F.coalesce(q(c).cast("string"), F.lit(MISSING)) for c in (source_col, lang_col)]
    return *name, F.coalesce(q(topic_col).cast("string"), F.lit(MISSING)) if topic_col else topic.asNondeterministic()(q(text_col))  # else a filter on it would run it twice


def mix(
    docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, keep_share: float = 0.5, seed: int = 11, powers: tuple[float, float, float] = (0.5, 0.7, 0.0),
    topics: int = TOPICS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic_col: str | None = None,
) -> DataFrame:
    """A sample of the rows of ``docs``, all columns as they were, whose tokens meet target marginals in expectation.

    ``targets`` maps "source", "lang" and "topic" to {category: weight}; a category that isn't named has weight 0, and a
    marginal that isn't given is the corpus's own smoothed by ``powers``. Null categories are a category of their own
    (named by MISSING). A row stays where a seeded hash of its id is below the probability of its cell, so rows that share
    an id and a cell stay or go together, and rows with a null id too. Empty texts have no tokens: in a cell with tokens
    they have its probability, in a cell without any they go. Texts of any length are counted whole. An empty table gives an
    empty table. Extra columns of any name pass through. More than ``MAX_CELLS`` cells are refused with an error, since a category
    is then no category; nothing is left out.
    """
    source, lang, topic = _columns(docs, source_col, lang_col, topic_col, text_col, topics)
    cells = docs.select(source.alias("s"), lang.alias("l"), topic.alias("t"), token_count(q(text_col)).cast("long").alias("n")).groupBy("s", "l", "t").agg(F.sum("n").alias("n"))
    rows = cells.limit(MAX_CELLS + 1).collect()
    if len(rows) > MAX_CELLS:
        raise ValueError(f"more than {MAX_CELLS} cells of source, language and topic; group the categories first")
    p = cell_probabilities({(r.s, r.l, r.t): r.n for r in rows}, targets, keep_share, powers)
    spark = docs.sparkSession
    table = spark.createDataFrame([(*k, v) for k, v in sorted(p.items()) if v > 0], "s string, l string, t string, p double")
    s, l, t, n = (fresh(docs.columns, x) for x in "sltp")
    table = F.broadcast(table.toDF(s, l, t, n))  # bounded by MAX_CELLS
    # 52 bits of a hash of the id as a number in [0, 1)
    u = F.shiftrightunsigned(F.xxhash64(q(id_col), F.lit(seed)), 12).cast("double") / F.lit(float(1 << 52))
    marked = docs.withColumns({s: source, l: lang, t: topic})
    return marked.join(table, [s, l, t]).where(u < q(n)).select(*[q(c) for c in docs.columns])


def cell_probabilities(tokens: dict[tuple[str, str, str], int], targets: dict[str, dict[str, float]] | None, keep_share: float, powers: tuple[float, float, float]) -> dict[tuple[str, str, str], float]:
    if not tokens:
        return {}
    names = [sorted({k[a] for k in tokens}) for a in range(3)]
    cube = np.zeros([len(n) for n in names])
    for k, n in tokens.items():
        cube[tuple(names[a].index(k[a]) for a in range(3))] += n
    goals = []
    for axis, kind in enumerate(("source", "lang", "topic")):
        totals = dict(zip(names[axis], cube.sum(axis=tuple(a for a in range(3) if a != axis))))
        given = (targets or {}).get(kind)
        goals.append(np.array([float(given.get(v, 0.0)) for v in names[axis]]) if given is not None else smoothed(names[axis], totals, powers[axis]))
    p = probabilities(cube, rake(cube, goals), keep_share)
    return {k: float(p[tuple(names[a].index(k[a]) for a in range(3))]) for k in tokens}


def query(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
