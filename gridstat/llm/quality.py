"""Quality rules: base statistics of whole texts, and robust multivariate outliers among what the base rules keep.

The outlier rule estimates centre and scatter of transformed statistics by the
minimum covariance determinant, for each language and source, each language and
all rows.  Of each group the fraction ``COVER`` with the least Mahalanobis distance
is refitted (a concentration step) until no group's determinant falls by more than
``SETTLED``; this from two starts (medians with quartile ranges, and the same with
the directions of spatial signs), of which the one with the smaller determinant is
taken.  A reweighted step follows.

A step is one combinable aggregate: the rows' moments by group and class of
distance (``STEP_BINS`` classes for each doubling, so the cut is exact to that
width); the classes up to the wanted share of rows are then added up.  So a group
is never brought together, whatever its size, all rows take part, and equal input
gives equal results.  Every group, however small, has its own estimate, drawn toward
that of its language as if ``DRAWN`` rows of it were in the group; languages are
drawn toward all rows in the same way.

A document is rejected beyond the distance that one of ``ONE_IN`` rows of a normal
distribution would reach.

Defined cases: a null or empty text has no words and fails; null languages and
sources are a value of their own; a null doc_id is carried; repeated rows count
each; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridstat.functions.tails import chi2_isf, chi2_sf
from gridstat.sources.scratch import discard, stash

from .arrowtext import Texts, Words, mix, new_key, span_hashes, texts, whitespace_table, window_hashes

MIN_WORDS = 10
REPEAT_PERCENT = 20
REPEAT_WINDOW = 5
COVER = 0.75
PRIOR = 20
STEP_BINS = 32
START_BINS = 256
SETTLED = 0.01
DRAWN = 200
SALTS = 16
ONE_IN = 1e12
#: Name and least standard deviation of each transformed statistic.
STATS = {"length": 0.1, "word_chars": 0.03, "symbols": 0.5, "capitals": 0.15, "stops": 0.15, "variety": 0.05}
FEATURE_SCHEMA = "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, " + ", ".join(
    f"x{i} double" for i in range(len(STATS))
)
_PAIRS = list(combinations_with_replacement(range(len(STATS)), 2))


def _mask(chars: bytes) -> np.ndarray:
    m = np.zeros(256, np.int32)
    m[list(chars)] = 1
    return m


_SYMBOLS = _mask(b"#*$%&|<>")
_CAPITALS = _mask(bytes(range(0x41, 0x5B)))
_STOPS = _mask(b".,;:!?")
_LEADS = np.array([(b & 0xC0) != 0x80 for b in range(256)], np.int32)


def _per_row(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    c = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=c[1:])
    return c[off[1:]] - c[off[:-1]]


def statistics(t: Texts, hash_key: np.uint64 = np.uint64(0)) -> dict[str, np.ndarray]:
    """The base statistics of each text of a slice, and counts for the transformed ones."""
    w = Words(t, whitespace_table(), hash_key)
    salt = mix(np.arange(t.n, dtype=np.uint64))
    out = {
        "n_words": np.diff(w.off),
        "word_chars": _per_row(_LEADS[t.data] * w.inside, t.off),
        "n_symbols": _per_row(_SYMBOLS[t.data], t.off),
        "capitals": _per_row(_CAPITALS[t.data], t.off),
        "stops": _per_row(_STOPS[t.data], t.off),
    }
    # lines with a word, equal to an earlier one of the same text
    breaks = np.flatnonzero(t.data == 10)
    start, end = np.sort(np.concatenate([t.off[:-1], breaks + 1])), np.sort(np.concatenate([breaks, t.off[1:]]))
    words_before = np.concatenate([[0], np.cumsum(w.inside)])
    full = words_before[end] > words_before[start]
    start, end = start[full], end[full]
    row = np.searchsorted(t.off, start, "right") - 1
    _, one = np.unique(mix(span_hashes(t.data, start, end, hash_key) ^ salt[row]), return_index=True)
    out["n_dup_lines"] = np.bincount(row, minlength=t.n) - np.bincount(row[one], minlength=t.n)
    # words inside any window that the text has twice
    g, at = window_hashes(w, REPEAT_WINDOW)
    key = mix(g ^ salt[w.row[at]])
    s = np.sort(key)
    twice = np.unique(s[1:][s[1:] == s[:-1]])
    step = np.zeros(len(w.hash) + 1, np.int64)
    if len(twice):
        i = np.minimum(np.searchsorted(twice, key), len(twice) - 1)
        hit = at[twice[i] == key]
        np.add.at(step, hit, 1)
        np.add.at(step, hit + REPEAT_WINDOW, -1)
    out["n_repeat_words"] = _per_row(np.cumsum(step[:-1]) > 0, w.off)
    k = np.sort((w.row.astype(np.uint64) << np.uint64(52)) | (w.hash >> np.uint64(12)))
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    out["distinct"] = np.bincount((k[new] >> np.uint64(52)).astype(np.int64), minlength=t.n)
    return out


def _transformed(s: dict[str, np.ndarray]) -> list[np.ndarray]:
    """Logarithms of the statistics; short texts' rates are drawn toward usual ones, as if ``PRIOR`` more words were there."""
    n, chars = s["n_words"] + float(PRIOR), s["word_chars"] + 5.0 * PRIOR
    share = lambda k, usual: np.log1p(1000.0 * (s[k] + usual * 5.0 * PRIOR) / chars)
    return [np.log(s["n_words"] + 1.0), np.log(chars / n), share("n_symbols", 0.0), share("capitals", 0.015), share("stops", 0.03), np.log((s["distinct"] + 0.8 * PRIOR) / n)]


def features(docs: DataFrame) -> DataFrame:
    """Base and transformed statistics of every document, in one pass and without a shuffle; words and lines are equal by hashes under a key of this run."""
    hash_key = new_key()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in texts(b.column(3)):
                s = statistics(t, hash_key)
                base = [pa.array(s[k].astype(np.int64)) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
                own = [c.slice(t.first, t.n) for c in b.columns[:3]]
                x = [pa.array(v) for v in _transformed(s)]
                yield pa.RecordBatch.from_arrays([*own, *base, *x], [f.split()[0] for f in FEATURE_SCHEMA.split(", ")])

    cols = [F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), "text"]
    return docs.select(*cols).mapInArrow(run, FEATURE_SCHEMA)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def _keys() -> list[Column]:
    lang, source = (F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-")) for c in ("lang", "source"))
    return [F.to_json(F.struct(lang.alias("l"), source.alias("s"))), F.to_json(F.struct(lang.alias("l"))), F.lit("{}")]


def _distance(prefix: str = "") -> Column:
    y = [F.col(f"x{i}") - F.col(f"m{i}") for i in range(len(STATS))]
    total = F.lit(0.0)
    for i, j in _PAIRS:
        total = total + F.col(f"a{i}_{j}") * y[i] * y[j] * (1.0 if i == j else 2.0)
    return total


P = len(STATS)
_X = [f"x{i}" for i in range(P)]
_FIT = "k string, start int, n double, det double, " + ", ".join([f"m{i} double" for i in range(P)] + [f"a{i}_{j} double" for i, j in _PAIRS] + [f"v{i}_{j} double" for i, j in _PAIRS])
_FLOOR = np.diag(np.square(list(STATS.values())))


def _square(columns: list[np.ndarray]) -> np.ndarray:
    out = np.empty((len(columns[0]), P, P))
    for c, (i, j) in zip(columns, _PAIRS, strict=True):
        out[:, i, j] = out[:, j, i] = c
    return out


def _fits(moments: DataFrame, factor: float) -> DataFrame:
    """Centre, scatter, inverse scatter and determinant from (k, start, n, c.., u.., s..): rows, a near centre and mean first and second moments about it."""
    names = [f.split()[0] for f in _FIT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            v = [c.to_numpy(zero_copy_only=False).astype(np.float64) for c in b.columns[3:]]
            near, mean = np.stack(v[:P], axis=1), np.stack(v[P : 2 * P], axis=1)
            cov = (_square(v[2 * P :]) - mean[:, :, None] * mean[:, None, :]) * factor + _FLOOR
            inv, det = np.linalg.inv(cov), np.linalg.det(cov)
            centre = near + mean
            cols = [pa.array(det)] + [pa.array(centre[:, i]) for i in range(P)] + [pa.array(x[:, i, j]) for x in (inv, cov) for i, j in _PAIRS]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *cols], names)

    cols = ["k", "start", F.col("n").cast("double").alias("n")] + [f"c{i}" for i in range(P)] + [f"u{i}" for i in range(P)] + [f"s{i}_{j}" for i, j in _PAIRS]
    return moments.select(*cols).mapInArrow(run, _FIT)


def _with_params(rows: DataFrame, table: DataFrame) -> DataFrame:
    """rows joined with a written table of a few rows for each ``k``.

    A small table is broadcast, by its measured size.  With very many groups both
    sides are shuffled by group and salt, so that a large group is spread.
    """
    return rows.join(table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["k", "salt"])


def _sums() -> list[Column]:
    """Sums of the differences from a near centre and of their products."""
    y = [F.col(f"x{i}") - F.col(f"m{i}") for i in range(P)]
    return [F.sum(v).alias(f"u{i}") for i, v in enumerate(y)] + [F.sum(y[i] * y[j]).alias(f"s{i}_{j}") for i, j in _PAIRS]


def _mean_sums(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Added up over what the rows still tell apart, and divided by the number of rows."""
    names = [f"u{i}" for i in range(P)] + [f"s{i}_{j}" for i, j in _PAIRS]
    g = rows.groupBy(*keys).agg(F.sum("n").alias("n"), *(F.first(f"c{i}").alias(f"c{i}") for i in range(P)), *(F.sum(c).alias(c) for c in names))
    return g.withColumns({c: F.col(c) / F.col("n") for c in names})


def _centre() -> list[Column]:
    return [F.first(f"m{i}").alias(f"c{i}") for i in range(P)]


def _concentrated(rows: DataFrame, params: DataFrame, cover: float, factor: float) -> DataFrame:
    """The fits of each group's share ``cover`` of rows nearest by ``params``."""
    far = F.floor(F.log2(F.greatest(_distance(), F.lit(1e-6))) * STEP_BINS).cast("int")
    classes = _with_params(rows, params).groupBy("k", "start", far.alias("far")).agg(F.count("*").alias("n"), *_centre(), *_sums())
    each = Window.partitionBy("k", "start")
    before = F.sum("n").over(each.orderBy("far")) - F.col("n")
    inner = classes.withColumns({"before": before, "want": F.ceil(cover * F.sum("n").over(each))}).filter("before < want")
    return _fits(_mean_sums(inner, ["k", "start"]), factor)


def _starts(rows: DataFrame) -> DataFrame:
    """Two first estimates of each group."""
    stat = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.floor(F.col(x) * START_BINS).cast("int").alias("bin")) for i, x in enumerate(_X)))).alias("e")
    bins = rows.select("k", stat).groupBy("k", "e.i", "e.bin").agg(F.count("*").alias("n"))
    each = Window.partitionBy("k", "i")
    upto = F.sum("n").over(each.orderBy("bin")) / F.sum("n").over(each)
    at = lambda q: F.min(F.when(F.col("upto") >= q, (F.col("bin") + 0.5) / START_BINS))
    q = bins.withColumn("upto", upto).groupBy("k", "i").agg(at(0.25).alias("lo"), at(0.5).alias("mid"), at(0.75).alias("hi"))
    one = lambda c, i: F.max(F.when(F.col("i") == i, F.col(c)))
    scale = [F.greatest((one("hi", i) - one("lo", i)) / 1.349, F.lit(s)) for i, s in enumerate(STATS.values())]
    robust = stash(q.groupBy("k").agg(*(one("mid", i).alias(f"m{i}") for i in range(P)), *(scale[i].alias(f"d{i}") for i in range(P))), "scales")
    y = [(F.col(f"x{i}") - F.col(f"m{i}")) / F.col(f"d{i}") for i in range(P)]
    size = F.greatest(sum((v * v for v in y), F.lit(0.0)), F.lit(1e-12))
    signs = _with_params(rows, robust).groupBy("k").agg(F.count("*").alias("n"), *_centre(), *(F.first(f"d{i}").alias(f"d{i}") for i in range(P)), *(F.avg(P * y[i] * y[j] / size).alias(f"s{i}_{j}") for i, j in _PAIRS))
    zero = [F.lit(0.0).alias(f"u{i}") for i in range(P)]
    centre = [f"c{i}" for i in range(P)]
    both = [
        signs.select("k", F.lit(start).alias("start"), "n", *centre, *zero, *((F.col(f"s{i}_{j}") if start or i == j else F.lit(0.0)).alias(f"s{i}_{j}") for i, j in _PAIRS), *(f"d{i}" for i in range(P)))
        for start in (0, 1)
    ]
    scaled = [d.withColumns({f"s{i}_{j}": (F.lit(1.0) if not start and i == j else F.col(f"s{i}_{j}")) * F.col(f"d{i}") * F.col(f"d{j}") for i, j in _PAIRS}) for start, d in enumerate(both)]
    out = stash(_fits(scaled[0].unionByName(scaled[1]), 1.0), "starts")
    discard(robust)
    return out


def _salted(rows: DataFrame) -> DataFrame:
    return rows.withColumn("salt", F.pmod(F.xxhash64(*_X), F.lit(SALTS)).cast("int"))


def least_determinant(points: DataFrame, cover: float = COVER) -> DataFrame:
    """Fits by ``k`` of the share ``cover`` of the points (k, x0..) whose scatter has the least determinant."""
    rows = _salted(points)
    grow = cover / (1 - chi2_sf(chi2_isf(1 - cover, P), P + 2))
    starts = _starts(rows)
    found = [stash(_concentrated(rows, starts, cover, grow), "fits")]
    going = found[0]
    while not going.isEmpty():
        # groups whose determinant still falls go on
        found.append(stash(_concentrated(rows, going, cover, grow), "fits"))
        was = found[-2].select("k", "start", F.col("det").alias("was"))
        # written, so that its size is known where the points are joined with it
        old, going = going, stash(found[-1].join(was, ["k", "start"]).filter(F.col("det") < (1 - SETTLED) * F.col("was")).drop("was"), "falling")
        if old is not found[0]:
            discard(old)
    # of both starts' steps the least determinant: a row for each group and step
    tried = reduce(DataFrame.unionByName, (f.withColumn("step", F.lit(i)) for i, f in enumerate(found)))
    least = tried.groupBy("k").agg(F.min(F.struct("det", "start", "step")).alias("w")).select("k", "w.start", "w.step")
    chosen = stash(tried.join(least, ["k", "start", "step"]).drop("step"), "mcd")
    discard(starts, *found)
    return chosen


def mcd(points: DataFrame, cover: float = COVER) -> DataFrame:
    """Fits by ``k`` of the points that are usual by the minimum covariance determinant."""
    chosen, cut = least_determinant(points, cover), chi2_isf(0.025, P)
    near = _with_params(_salted(points), chosen).filter(_distance() <= cut).groupBy("k", "start").agg(F.count("*").alias("n"), *_centre(), *_sums())
    out = stash(_fits(_mean_sums(near, ["k", "start"]), 0.975 / (1 - chi2_sf(cut, P + 2))), "mcd")
    discard(chosen)
    return out


def _drawn(own: DataFrame, toward: DataFrame, on: str, drawn: float) -> DataFrame:
    """The fits of ``own`` as if each had ``drawn`` more rows of the fit that its column ``on`` names."""
    names = ["k", "n"] + [f"m{i}" for i in range(P)] + [f"v{i}_{j}" for i, j in _PAIRS]
    other = toward.select(*(F.col(c).alias(f"p_{c}") for c in names if c != "n"))
    w = F.col("n") / (F.col("n") + drawn)
    gap = [F.col(f"m{i}") - F.col(f"p_m{i}") for i in range(P)]
    mean = [(F.col(f"p_m{i}") + w * gap[i]).alias(f"m{i}") for i in range(P)]
    scatter = [(w * F.col(f"v{i}_{j}") + (1 - w) * F.col(f"p_v{i}_{j}") + w * (1 - w) * gap[i] * gap[j]).alias(f"v{i}_{j}") for i, j in _PAIRS]
    return own.join(other, own[on] == other["p_k"]).select("k", "n", *mean, *scatter)


def _inverses(fits: DataFrame) -> DataFrame:
    """k, centre and inverse scatter."""
    schema = "k string, " + ", ".join([f"m{i} double" for i in range(P)] + [f"a{i}_{j} double" for i, j in _PAIRS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                inv = np.linalg.inv(_square([c.to_numpy(zero_copy_only=False) for c in b.columns[1 + P :]]))
                yield pa.RecordBatch.from_arrays([*b.columns[: 1 + P], *(pa.array(inv[:, i, j]) for i, j in _PAIRS)], [f.split()[0] for f in schema.split(", ")])

    return fits.select("k", *(f"m{i}" for i in range(P)), *(f"v{i}_{j}" for i, j in _PAIRS)).mapInArrow(run, schema)


def judge(docs: DataFrame, one_in: float = ONE_IN, drawn: float = DRAWN) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance."""
    fine, lang, every = _keys()
    f = stash(features(docs).withColumn("base_failed", base_failed()), "quality")
    passed = f.filter(~F.col("base_failed"))
    points = stash(passed.select(F.explode(F.array(fine, lang, every)).alias("k"), *_X), "points")
    fits = mcd(points)
    names = stash(passed.select(fine.alias("k"), lang.alias("lang_k")).distinct(), "names")
    langs = stash(_drawn(fits.join(names.select(F.col("lang_k").alias("k")).distinct(), "k").withColumn("up", every), fits, "up", drawn), "languages")
    groups = _drawn(fits.join(names, "k"), langs, "lang_k", drawn)
    params = stash(_inverses(groups), "groups")
    discard(points, fits, names, langs)
    rows = _salted(f.withColumn("k", fine))
    failed = rows.filter("base_failed").withColumn("distance", F.lit(None).cast("double"))
    own = _with_params(rows.filter(~F.col("base_failed")), params).withColumn("distance", _distance())
    judged = own.select(*failed.columns).unionByName(failed)
    kept = (~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= chi2_isf(1 / one_in, P))).alias("kept")
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept, "distance")
