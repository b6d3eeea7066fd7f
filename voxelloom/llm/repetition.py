"""How much of a document repeats what the same document has said before, and which documents repeat too much.

The share is measured exactly over whole texts. Thresholds adapt: of each language and source a mergeable quantile
sketch of the shares is made, and a quantile of it is the threshold there; thresholds are joined back and documents
above theirs come out.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelloom.runtime import Scratch, fresh, small

RUN = 5

#: Size of a sketch: groups of at most so many rows are held whole, and a sketch never has more than some times as many.
SKETCH_K = 4_096
#: The rank error of a KLL sketch of size k is a / k ** b (fixed values of the sketch).
RANK_ERROR = (2.296, 0.9723)
#: Ranks between which a level's is looked for.
GRID = 512

#: Runs of letters, and of signs such as ½ or ², which no short class of re leaves out.
_WORD = re.compile(r"[^\W\d_]+")
#: Words of a very long text are numbered piece by piece of so many characters, cut where no word is.
_PIECE = 1 << 20


def _words(text: str) -> list[str]:
    """Unbroken runs of letters, in lower case, which has as many letters."""
    words = _WORD.findall(text.replace("\u0130", "i").lower())
    if "".join(words).isalpha() or not words:
        return words
    return [w for x in words for w in ([x] if x.isalpha() else "".join(c if c.isalpha() else " " for c in x).split())]


def _numbers(text: str) -> np.ndarray:
    """A number for each word, equal for words equal without case."""
    seen: dict[str, int] = {}
    number = seen.setdefault
    if len(text) <= _PIECE:
        words = _words(text)
        return np.fromiter((number(w, len(seen)) for w in words), dtype=np.int64, count=len(words))
    out, at = array("q"), 0
    while at < len(text):
        end = min(len(text), at + _PIECE)
        while end < len(text) and text[end].isalpha():
            end += 1
        out.extend(number(w, len(seen)) for w in _words(text[at:end]))
        at = end
    return np.frombuffer(out, dtype=np.int64)


def repeated_words(text: str | None, run: int = RUN) -> tuple[int, int]:
    """(words, repeated words) of a text: a word is repeated if it lies in a run of `run` words that also starts earlier.

    Words are unbroken runs of letters, compared without case; all else separates. Runs are compared by their words
    and not by a hash, so there are no false hits.
    """
    if not text:
        return 0, 0
    ids = _numbers(text)
    n = len(ids)
    if n <= run:
        return n, 0
    kinds = int(ids.max()) + 1
    key, length = ids, 1
    room = kinds
    while length < run:
        if room > (1 << 62) // kinds:
            key = np.unique(key, return_inverse=True)[1]
            room = int(key.max()) + 1
        key = key[:-1] * kinds + ids[length:]
        room *= kinds
        length += 1
    order = np.argsort(key, kind="stable")
    run_of = key[order]
    again = order[1:][run_of[1:] == run_of[:-1]]
    if not len(again):
        return n, 0
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + run, -1)
    return n, int((np.cumsum(edge[:-1]) > 0).sum())


def repetition_shares(df: DataFrame, text: str, keep: list[str], run: int = RUN) -> DataFrame:
    """`keep`, words, repeated, share. A text without words, or null, has the share 0. One pass, no shuffle."""
    words, repeated, share, body = fresh(keep, "words", "repeated", "share", "body")
    schema = df.select(*keep, F.lit(0).cast("bigint").alias(words), F.lit(0).cast("bigint").alias(repeated), F.lit(0.0).alias(share)).schema

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([repeated_words(t.as_py(), run) for t in batch.column(body)], dtype=np.int64).reshape(-1, 2)
            shares = found[:, 1] / np.maximum(found[:, 0], 1)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(found[:, 0]), pa.array(found[:, 1]), pa.array(shares)], [*keep, words, repeated, share])

    return df.select(*keep, F.col(text).alias(body)).mapInArrow(measure, schema)


def share_sketches(shares: DataFrame, by: list[str], value: str = "share", k: int = SKETCH_K) -> DataFrame:
    """(by, sketch, n): a KLL sketch of each group's values, made by parts before the shuffle. Nulls are not counted."""
    return shares.where(F.col(value).isNotNull()).groupBy(*by).agg(F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(k)).alias("sketch"), F.count("*").alias("n"))


def merge_sketches(parts: DataFrame, by: list[str]) -> DataFrame:
    """(by, sketch, n) of parts that came at other times or have finer groups."""
    return parts.groupBy(*by).agg(F.kll_merge_agg_double("sketch").alias("sketch"), F.sum("n").alias("n"))


def adaptive_thresholds(sketches: DataFrame, by: list[str], quantile: float, least: float, most: float) -> DataFrame:
    """(by, threshold): the quantile of each group's sketch, held within [least, most]."""
    at = F.kll_sketch_get_quantile_double(F.col("sketch"), F.lit(float(quantile)))
    return sketches.select(*by, F.least(F.greatest(at, F.lit(float(least))), F.lit(float(most))).alias("threshold"))


def rank_error(k: int = SKETCH_K) -> float:
    """What a rank read from a sketch of this k is off by at most, in 99 of 100 cases."""
    return RANK_ERROR[0] / k ** RANK_ERROR[1]


def rank_bands(sketches: DataFrame, by: list[str], level: float, error: float) -> DataFrame:
    """(by, lower, upper): quantiles of each group's sketch, at least `error` below and above the rank that `level` has in it.

    `lower` is a value of the group that is at most `level`, or null where none lies so deep; `upper` is one above it, or
    the group's greatest. Both are values, so what lies beyond them is known for certain, however far off the rank is.
    """
    rank = F.kll_sketch_get_rank_double(F.col("sketch"), F.lit(float(level)))
    # A sketch is only asked for fixed ranks: those of a grid. As one text, for the driver builds it much faster.
    grid = F.expr(f"kll_sketch_get_quantile_double(sketch, array({', '.join(f'{k / GRID!r}D' for k in range(GRID + 1))}))")
    below, above = F.floor((rank - error) * GRID).cast("int"), F.ceil(F.least(F.lit(1.0), rank + error) * GRID).cast("int")
    cut = sketches.select(*by, grid.alias("grid"), below.alias("below"), above.alias("above"))
    return cut.select(*by, F.when(F.col("below") > 0, F.get("grid", F.col("below"))).alias("lower"), F.get("grid", F.col("above")).alias("upper"))


def _keyed(shares: DataFrame, language: str, source: str, scratch: Scratch) -> tuple[DataFrame, list[str]]:
    """The rows, written once, with what groups them: languages without case, nulls as a group of their own."""
    by = fresh(shares.columns, "language_key", "source_key")
    keys = (F.lower(F.trim(F.coalesce(F.col(language), F.lit("")))), F.coalesce(F.col(source), F.lit("")))
    return scratch.save(shares.withColumns(dict(zip(by, keys))), "shares"), by


def repetitive(shares: DataFrame, language: str, source: str, *, quantile: float = 0.99, least: float = 0.05, most: float = 1.0, share: str = "share", scratch: Scratch | None = None) -> DataFrame:
    """Rows of `shares` whose `share` is above the threshold of their language and source, with `threshold`.

    Languages count without case; a null language or source is a group of its own. `most` is where a threshold never
    goes beyond: with most = m every document above m comes out, whatever is usual in its group. Every row counts,
    repeated ones too. An empty table gives an empty one.
    """
    scratch = scratch or Scratch(shares.sparkSession, "repetition")
    keyed, by = _keyed(shares, language, source, scratch)
    (threshold,) = fresh(keyed.columns, "threshold")
    sketches = scratch.save(share_sketches(keyed, by, share), "sketches")
    limits = scratch.save(adaptive_thresholds(sketches, by, quantile, least, most).withColumnRenamed("threshold", threshold), "thresholds")
    return keyed.join(small(limits), by).where(F.col(share) > F.col(threshold)).drop(*by)


def above_level(shares: DataFrame, language: str, source: str, level: float, exact: Column, *, share: str = "share", scratch: Scratch | None = None) -> DataFrame:
    """Rows of `shares` whose `share` is above `level`, with the `lower` and `upper` threshold of their language and source.

    Thresholds are read from each group's sketch, around the rank that `level` has there. Rows above the upper one come
    out and rows up to the lower one don't, by the join alone; `exact` decides those between, which are about twice the
    sketch's rank error of each group. Groups as in repetitive(); rows with a null share don't come out. An empty table gives an empty one.
    """
    scratch = scratch or Scratch(shares.sparkSession, "repetition")
    keyed, by = _keyed(shares, language, source, scratch)
    lower, upper = fresh(keyed.columns, "lower", "upper")
    sketches = scratch.save(share_sketches(keyed, by, share), "sketches")
    bands = scratch.save(rank_bands(sketches, by, level, rank_error()).select(*by, F.col("lower").alias(lower), F.col("upper").alias(upper)), "bands")
    over = F.col(share) > F.col(upper)
    open_ = F.col(lower).isNull() | (F.col(share) > F.col(lower))
    return keyed.join(small(bands), by).where(over | (open_ & exact)).drop(*by)
