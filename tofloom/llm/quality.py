"""Quality rules with adaptive thresholds, in DataFrame operations only.

Fixed rules come first (too few words, or over half of the words inside
repeated three-word windows).  The other cutoffs adapt: for every language and
source, mergeable quantile sketches (``percentile_approx``) give the quartiles
of each measure over all documents, and a document outside the fence
``q75 + 3 (q75 - q25)`` (below, likewise) goes.  A fence never gets nearer to the typical
value than a documented floor, so that a group of very even documents doesn't
lose its ordinary ones.

A group with over a quarter of junk lifts its own ``q75``.  Where ``bounded``
is set, the fence is therefore held by what the middle and the better side say:
it doesn't pass both ``q50 + 7 (q50 - q25)`` of the group (the same place where
the spread is even) and that of all documents, each with the floor.  This holds
up to half of junk in a group; beyond, the group passes for one of its own kind.
The pipeline sets it; the query ``op9_quality`` has the plain fence of its SQL.

Edge cases: a null text counts as empty; null languages and sources form groups
of their own; an empty table gives an empty result; repeated rows are judged
alike and all kept or all dropped.  Columns of the input keep their names; what
the operator adds is in the single struct ``__quality``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_RE, let, materialize, text_of, words_of

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
FENCE = 3.0
#: The fence's distance from the median, in spreads from the median to the other side's quartile.
HALF_FENCE = 2 * FENCE + 1
#: Sketch size: quantiles are off by 1/ACCURACY of the rows at most.
ACCURACY = 2000
#: Hashes that a text has twice or more among which each of its windows is looked up; with more of them all windows are sorted.
FEW = 32
#: Groups (some hundred bytes each) whose thresholds may be broadcast.
BROADCAST_GROUPS = 50_000
#: measure -> (side of the fence, nearest that the fence may come)
MEASURES = {
    "symbol_ratio": ("high", 0.05),
    "dup_line_ratio": ("high", 0.50),
    "repeat_ratio": ("high", 0.30),
    "mean_word_chars": ("both", 4.0),
}


def repeated_words(words: Column) -> Column:
    """Number of words inside three-word windows that occur twice or more.

    Windows are hashed.  Where no two hashes are equal, that's all; else hashes
    are sorted with their positions, and neighbours with equal hashes are
    confirmed word by word.
    """

    def of(ws: Column) -> Column:
        n = F.size(ws)
        hashes = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(ws[i], ws[i + 1], ws[i + 2]))

        def same(a: Column, b: Column) -> Column:
            i, j = a["i"], b["i"]
            return (a["h"] == b["h"]) & (ws[i] == ws[j]) & (ws[i + 1] == ws[j + 1]) & (ws[i + 2] == ws[j + 2])

        def positions(ks: Column) -> Column:
            m = F.size(ks)
            again = F.filter(
                F.sequence(F.lit(0), m - 1),
                lambda k: ((k > 0) & same(ks[k], ks[F.greatest(k - 1, F.lit(0))]))
                | ((k < m - 1) & same(ks[k], ks[F.least(k + 1, m - 1)])),
            )
            return F.transform(again, lambda k: ks[k]["i"])

        def covered(hs: Column) -> Column:
            twice = let(F.sort_array(hs), lambda s: F.array_distinct(F.filter(s, lambda h, k: (k > 0) & (h == s[F.greatest(k - 1, F.lit(0))]))))
            keyed = F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
            keyed = let(twice, lambda few: F.filter(keyed, lambda x: (F.size(few) > FEW) | F.array_contains(few, x["h"])))
            # By the order of values, not array_sort's, which is a lambda function.
            windows = F.transform(let(F.sort_array(keyed), positions), lambda p: F.array(p, p + 1, p + 2))
            return F.size(F.array_distinct(F.flatten(windows)))

        repeats = let(hashes, lambda hs: F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0)).otherwise(covered(hs)))
        return F.when(n < 4, F.lit(0)).otherwise(repeats)

    return let(words, of)


def measures(text: Column) -> Column:
    """Struct of the counts of one non-null text."""
    lines = F.filter(F.split(text, "\n"), lambda line: F.rlike(line, F.lit(WORD_RE)))

    def of(ws: Column) -> Column:
        return F.struct(
            F.size(ws).cast("long").alias("n_words"),
            F.char_length(F.array_join(ws, "")).cast("long").alias("word_chars"),
            F.octet_length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
            let(lines, lambda ls: F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
            F.size(lines).cast("long").alias("n_lines"),
            repeated_words(ws).cast("long").alias("n_repeat_words"),
        )

    return let(words_of(text), of)


def _ratios(q: str) -> dict[str, Column]:
    def per(top: str, bottom: str) -> Column:
        return F.coalesce(F.try_divide(F.col(f"{q}.{top}").cast("double"), F.col(f"{q}.{bottom}")), F.lit(0.0))

    return {
        "symbol_ratio": per("n_symbols", "word_chars"),
        "dup_line_ratio": per("n_dup_lines", "n_lines"),
        "repeat_ratio": per("n_repeat_words", "n_words"),
        "mean_word_chars": per("word_chars", "n_words"),
    }


def _quartiles(ratios: dict[str, Column]) -> list[Column]:
    return [F.percentile_approx(r, [0.25, 0.5, 0.75], ACCURACY).alias(f"q_{name}") for name, r in ratios.items()]


def _bound(quartiles: Column, side: int, floor: float) -> Column:
    """The farthest place of a fence, above (side 1) or below (-1) the median."""
    q25, q50, q75 = (quartiles[k] for k in range(3))
    return q50 + side * F.greatest(HALF_FENCE * (q50 - q25 if side > 0 else q75 - q50), F.lit(floor))


def judge(
    docs: DataFrame, carry: list[str], text: str = "text", lang: str = "lang", source: str = "source", bounded: bool = False
) -> DataFrame:
    """``carry`` columns of every document and the struct ``__quality`` (counts, base_failed, kept).

    The texts are read once; counts are written to the shared folder beside the
    carried columns, then summarised and joined.  The threshold table has a row
    per language and source; it is counted, and broadcast only up to
    ``BROADCAST_GROUPS`` rows, beyond which run-time skew handling splits the hot source.
    """
    counted = docs.select(
        F.struct(*carry).alias("__row"),
        F.col(lang).alias("__lang"),
        F.col(source).alias("__source"),
        measures(text_of(text)).alias("__m"),
    )
    counted = materialize(counted)
    ratios = _ratios("__m")
    quartiles = counted.groupBy("__lang", "__source").agg(*_quartiles(ratios))
    if bounded:
        whole = counted.agg(*_quartiles(ratios)).select(*(F.col(f"q_{name}").alias(f"all_{name}") for name in ratios))
        quartiles = quartiles.crossJoin(F.broadcast(whole))
    limits = []
    for name, (side, floor) in MEASURES.items():
        q25, q75 = F.col(f"q_{name}")[0], F.col(f"q_{name}")[2]
        reach = F.greatest(FENCE * (q75 - q25), F.lit(floor))
        high, low = q75 + reach, q25 - reach
        if bounded:
            own, every = F.col(f"q_{name}"), F.col(f"all_{name}")
            high = F.least(high, F.greatest(_bound(own, 1, floor), _bound(every, 1, floor)))
            low = F.greatest(low, F.least(_bound(own, -1, floor), _bound(every, -1, floor)))
        limits.append(high.alias(f"high_{name}"))
        if side == "both":
            limits.append(low.alias(f"low_{name}"))
    limits = quartiles.select(F.col("__lang").alias("__l"), F.col("__source").alias("__s"), *limits)
    limits = materialize(limits)
    if limits.count() <= BROADCAST_GROUPS:  # else a shuffled join
        limits = F.broadcast(limits)
    joined = counted.join(
        limits, F.col("__lang").eqNullSafe(F.col("__l")) & F.col("__source").eqNullSafe(F.col("__s")), "left"
    )
    fine = F.lit(True)
    for name, (side, _) in MEASURES.items():
        fine = fine & (ratios[name] <= F.col(f"high_{name}"))
        if side == "both":
            fine = fine & (ratios[name] >= F.col(f"low_{name}"))
    m = F.col("__m")
    failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])
    return joined.select(
        *(F.col("__row")[c].alias(c) for c in carry),
        F.struct(
            *(m[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
            failed.alias("base_failed"),
            (~failed & fine).alias("kept"),
        ).alias("__quality"),
    )


def keep_good(docs: DataFrame, **options) -> DataFrame:
    """The documents that pass, with their own columns."""
    return judge(docs, docs.columns, **options).where("__quality.kept").select(*docs.columns)
