"""Quality rules with robust multivariate outliers, in DataFrame operations only.

Base statistics of a text are turned into a vector U of five: symbols per word, word length, share of repeated words,
repeated lines and share of capitals, each on a log scale and in units of SPREAD, the least spread that counts as one.

Each language and source, each language, and the whole corpus get a minimum-covariance-determinant estimate of centre
and scatter. From each of three deterministic starts around the medians (scatters of clipped vectors, of spatial signs
and of hyperbolic tangents), concentration steps take the COVERAGE part of the vectors that are nearest (Mahalanobis)
to the last estimate and estimate anew from these, until the determinant changes no more; of the three ends that of the
least determinant stays. The vectors within INNER of it give the re-weighted estimate. The unit matrix is added to each
scatter, so that a statistic that is constant in a group has spread 1 and small groups have an inverse.

A group of n vectors is judged by n parts of its own estimate and SHRINK parts of its language's, which is mixed with
the corpus's in the same way: small groups lean on larger ones by degrees, at every size. Vectors whose squared distance
is over CUTOFF are rejected.

Medians and quantiles of distances are taken on a grid, from counts per grid value: mergeable, and of a size that does
not grow with a group. Documents that fail the base rules are in no estimate.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch, let

NAMES = ["symbols", "length", "repeats", "lines", "capitals"]
#: In natural units of the log scales below.
SPREAD = [0.4, 0.05, 0.6, 0.5, 0.15]
P = len(NAMES)
COVERAGE = 0.75
STARTS = ("clipped", "signs", "tanh")
#: A determinant has settled when a step lowers its logarithm by less (the grid's ties may even raise it); steps at most,
#: more than any group was seen to need.
SETTLED, MOST_STEPS = 1e-3, 30
#: c of the estimate at this coverage: 0.75 / P(chi2 with 7 degrees < the 0.75 quantile of chi2 with 5).
CONSISTENT = 1.41
#: The 0.975 quantile of chi2 with 5 degrees of freedom, and c there.
INNER, INNER_CONSISTENT = 12.83, 1.055
#: The 0.9999 quantile of chi2 with 5 degrees of freedom.
CUTOFF = 25.74
#: Vectors of its language that a group is mixed with, and of the corpus that a language is mixed with.
SHRINK = 40
#: Estimates of so many groups (under 300 bytes each) are broadcast; more are joined by exchange.
BROADCAST_GROUPS = 20_000
GRID, DISTANCE_GRID, DISTANCE_TOP = 8, 64, 2560
PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]


def repeat_words(words: Column, hashed: Callable[..., Column] = F.xxhash64) -> Column:
    """Words in 3-word windows that the array of words holds twice or more.

    A window is a number: its hash above, its place below in as many bits as places need. Sorted, equal windows are
    neighbours; each one's place then counts the words up to the next such place, 3 at most. Neighbours of equal hashes
    are compared by their words: if any two of a text differ, its windows are sorted by their words instead, so the count
    is exact at any length.
    """

    def count(w: Column) -> Column:
        bits = F.ceil(F.log2(F.size(w).cast("double"))).cast("int")
        top = lambda x: F.call_function("shiftright", x, bits)
        every = F.sequence(F.lit(0), F.size(w) - 3)
        mask = F.call_function("shiftleft", F.lit(1).cast("bigint"), bits) - 1
        place = lambda x: x.bitwiseAND(mask).cast("int")
        word = lambda x, k: F.get(w, place(x) + k)
        same_words = lambda x, y: (word(x, 0) == word(y, 0)) & (word(x, 1) == word(y, 1)) & (word(x, 2) == word(y, 2))
        by_hash = F.sort_array(F.transform(every, lambda i: F.call_function("shiftleft", hashed(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)), bits).bitwiseOR(i.cast("bigint"))))
        by_words = F.sort_array(F.transform(every, lambda i: F.struct(F.get(w, i).alias("a"), F.get(w, i + 1).alias("b"), F.get(w, i + 2).alias("c"), i.cast("bigint").alias("i"))))

        def repeated(s: Column) -> Column:
            near = F.filter(s, lambda x, i: F.coalesce(top(x) == top(F.get(s, i - 1)), F.lit(False)) | F.coalesce(top(x) == top(F.get(s, i + 1)), F.lit(False)))
            return let(near, verified)

        def verified(s: Column) -> Column:
            clash = F.exists(F.transform(s, lambda x, i: F.coalesce((top(x) == top(F.get(s, i + 1))) & ~same_words(x, F.get(s, i + 1)), F.lit(False))), lambda b: b)
            return F.when(clash, let(by_words, repeated_by_words)).otherwise(F.transform(s, lambda x: x.bitwiseAND(mask)))

        def repeated_by_words(s: Column) -> Column:
            same = lambda x, i: F.coalesce((x["a"] == F.get(s, i)["a"]) & (x["b"] == F.get(s, i)["b"]) & (x["c"] == F.get(s, i)["c"]), F.lit(False))
            return F.transform(F.filter(s, lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["i"])

        places = F.sort_array(let(by_hash, repeated))
        return let(places, lambda q: F.aggregate(F.transform(q, lambda x, i: F.least(F.lit(3).cast("bigint"), F.coalesce(F.get(q, i + 1) - x, F.lit(3)))), F.lit(0).cast("bigint"), lambda a, x: a + x))

    return F.when(F.size(words) < 4, F.lit(0).cast("bigint")).otherwise(let(words, count))


def statistics(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str, whole: bool = False) -> DataFrame:
    """id, t (xxhash64 of the text), the base statistics, base_failed, the vector u (array<double>), lang, source of every row; and, if
    `whole`, the row itself as the struct doc."""
    text = F.coalesce(text_col, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    counted = docs.select(
        F.col(id_col).alias("id"),
        F.xxhash64(text_col).alias("t"),
        F.col(lang_col).cast("string").alias("lang"),
        F.col(source_col).cast("string").alias("source"),
        F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        F.regexp_count(text, F.lit("[A-Z]")).cast("bigint").alias("n_capitals"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
        *([F.struct(*docs.columns).alias("doc")] if whole else []),
    )
    counted = counted.select(
        "id", "t", "lang", "source",
        F.size("words").cast("bigint").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
        "n_symbols", "n_dup_lines",
        repeat_words(F.col("words")).alias("n_repeat_words"),
        "n_capitals",
        *(["doc"] if whole else []),
    )
    n, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    logs = [
        F.log1p(100 * F.col("n_symbols") / n),
        F.log(chars / n),
        F.log1p(20 * F.col("n_repeat_words") / n),
        F.log1p(F.col("n_dup_lines").cast("double")),
        F.log1p(20 * F.col("n_capitals") / chars),
    ]
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return counted.select("*", failed.alias("base_failed"), F.array(*(x / s for x, s in zip(logs, SPREAD, strict=True))).alias("u")).drop("n_capitals")


def _key(level: str) -> Column:
    """The group of a row at a level: own (language and source), lang or all."""
    parts = {"own": ["lang", "source"], "lang": ["lang"], "all": []}[level]
    return F.xxhash64(F.lit(level), *(x for c in parts for x in (F.col(c), F.col(c).isNull())))


#: SQL of the squared Mahalanobis distance of u from the centre `m` by the inverse Cholesky factor `w` (rows of a lower triangle).
DISTANCE = " + ".join(f"power({' + '.join(f'w[{i * (i + 1) // 2 + j}] * (u[{j}] - m[{j}])' for j in range(i + 1))}, 2)" for i in range(P))
FAR = f"CAST(least(floor({DISTANCE_GRID} * ln(1 + {DISTANCE})), {DISTANCE_TOP}) AS INT) AS far"


def _sums(x: str) -> list[Column]:
    """n, sums s0.. and sums of products p00, p10, .. of the vectors called x."""
    return [F.expr(e) for e in ("count(*) AS n", *(f"sum({x}[{i}]) AS s{i}" for i in range(P)), *(f"sum({x}[{i}] * {x}[{j}]) AS p{i}{j}" for i, j in PAIRS))]


def _moments(sums: DataFrame, factor: float, *keys: str) -> DataFrame:
    """keys, n, the mean m0.. and the scatter c00, c10, .., the covariance times `factor`."""
    scatter = {(i, j): f"{factor}D * (p{i}{j} / n - s{i} / n * s{j} / n)" for i, j in PAIRS}
    return sums.selectExpr(*keys, "n", *(f"s{i} / n AS m{i}" for i in range(P)), *(f"{f'greatest({x}, 0D)' if i == j else x} AS c{i}{j}" for (i, j), x in scatter.items()))


def _whitening(frame: DataFrame, *keys: str) -> DataFrame:
    """keys, the centre m, the inverse Cholesky factor w of the scatter and the unit matrix, and their determinant's logarithm."""
    have = [f"m{i}" for i in range(P)]
    left = {(i, j): f"c{i}{j} + 1D" if i == j else f"c{i}{j}" for i, j in PAIRS}  # what of the scatter no column of l accounts for
    for j in range(P):
        frame = frame.selectExpr(*keys, *have, *(f"{left[x, y]} AS r{x}{y}" for x, y in PAIRS if y >= j))
        made = [f"sqrt(greatest(r{j}{j}, 1e-9D)) AS l{j}{j}", *(f"r{i}{j} / sqrt(greatest(r{j}{j}, 1e-9D)) AS l{i}{j}" for i in range(j + 1, P))]
        frame = frame.selectExpr(*keys, *have, *made, *(f"r{x}{y}" for x, y in PAIRS if y > j))
        have += [f"l{i}{j}" for i in range(j, P)]
        left = {(x, y): f"r{x}{y} - l{x}{j} * l{y}{j}" for x, y in PAIRS if y > j}
    for d in range(P):  # the inverse, a diagonal after the other
        made = [f"1D / l{i}{i} AS w{i}{i}" if d == 0 else f"-({' + '.join(f'l{i}{k} * w{k}{i - d}' for k in range(i - d, i))}) / l{i}{i} AS w{i}{i - d}" for i in range(d, P)]
        frame = frame.selectExpr(*keys, *have, *made)
        have += [f"w{i}{i - d}" for i in range(d, P)]
    whole = ", ".join(f"w{i}{j}" for i, j in PAIRS)
    return frame.selectExpr(*keys, f"array({', '.join(f'm{i}' for i in range(P))}) AS m", f"array({whole}) AS w", f"2 * ({' + '.join(f'ln(l{i}{i})' for i in range(P))}) AS det")


def _at_share(counts: DataFrame, keys: list[str], grid: str, share: float) -> DataFrame:
    """keys and the least grid value with at least that share of a key's counts `n` up to it."""
    order = Window.partitionBy(*keys).orderBy(grid)  # as many rows as the grid has values
    upto = counts.select("*", F.sum("n").over(order).alias("upto"), F.sum("n").over(Window.partitionBy(*keys)).alias("all"))
    return upto.where(F.col("upto") >= F.ceil(share * F.col("all"))).groupBy(*keys).agg(F.min(grid).alias(grid))


def _medians(rows: DataFrame) -> DataFrame:
    """(g, v, d): medians on the grid, and the spread, 1 and 1.4826 times the median distance from them."""
    long = rows.select("g", F.posexplode("u").alias("k", "x"))
    counts = long.groupBy("g", "k", F.round(F.col("x") * GRID).alias("x")).agg(F.count("*").alias("n"))
    middle = _at_share(counts, ["g", "k"], "x", 0.5).withColumnRenamed("x", "v")
    away = counts.join(middle, ["g", "k"]).groupBy("g", "k", "v", F.abs(F.col("x") - F.col("v")).alias("d")).agg(F.sum("n").alias("n"))
    spread = _at_share(away, ["g", "k", "v"], "d", 0.5).groupBy("g").agg(F.sort_array(F.collect_list(F.struct("k", "v", "d"))).alias("all"))
    wide = lambda x: F.sqrt(1.0 + F.pow(1.4826 * x["d"] / GRID, F.lit(2.0)))
    return spread.select("g", F.transform("all", lambda x: x["v"] / GRID).alias("v"), F.transform("all", wide).alias("d"))


def _starts(rows: DataFrame, near, scratch: Scratch) -> DataFrame:
    """(g, start, m, w, det): around the medians, the scatter of the vectors in units of the spreads after each start's function."""
    middles = scratch.table(_medians(rows), "medians")
    z = F.transform("u", lambda x, i: (x - F.get("v", i)) / F.get("d", i))
    size = F.sqrt(F.aggregate("z", F.lit(1e-9), lambda a, x: a + x * x))
    functions = [F.transform("z", lambda x: F.greatest(F.lit(-2.0), F.least(F.lit(2.0), x))), F.transform("z", lambda x: x * P**0.5 / size), F.transform("z", F.tanh)]
    changed = rows.join(near(middles), "g").select("g", z.alias("z"))
    changed = changed.select("g", F.explode(F.array(*(F.struct(F.lit(name).alias("start"), f.alias("f")) for name, f in zip(STARTS, functions, strict=True)))).alias("x")).select("g", "x.start", "x.f")
    found = _moments(changed.groupBy("g", "start").agg(*_sums("f")), 1.0, "g", "start").join(near(middles), "g")
    scaled = found.select("g", "start", *(F.col("v")[i].alias(f"m{i}") for i in range(P)), *((F.col(f"c{i}{j}") * F.col("d")[i] * F.col("d")[j]).alias(f"c{i}{j}") for i, j in PAIRS))
    # no step's determinant is held against a start's
    return scratch.table(_whitening(scaled, "g", "start").withColumn("det", F.lit(float("inf"))), "starts")


def least_determinant(rows: DataFrame, scratch: Scratch, near) -> DataFrame:
    """(g, start, m, w, det) of each group of rows (g, u): the end of the concentration steps that has the least determinant."""
    now, ends = _starts(rows, near, scratch), []
    for _ in range(MOST_STEPS):
        placed = rows.join(near(now), "g").selectExpr("g", "start", "u", FAR)
        edge = _at_share(placed.groupBy("g", "start", "far").agg(F.count("*").alias("n")), ["g", "start"], "far", COVERAGE).withColumnRenamed("far", "edge")
        inner = placed.join(near(edge), ["g", "start"]).where("far <= edge")
        after = _whitening(_moments(inner.groupBy("g", "start").agg(*_sums("u")), CONSISTENT, "g", "start"), "g", "start")
        moved = after.join(near(now.selectExpr("g", "start", "det AS was")), ["g", "start"]).selectExpr("g", "start", "m", "w", "det", f"was - det < {SETTLED}D AS still")
        moved = scratch.table(moved, "estimates")
        ends.append(moved.where("still").drop("still"))
        now = moved.where("not still").drop("still")
        if now.isEmpty():
            break
    ends.append(now)
    every = ends[0]
    for end in ends[1:]:
        every = every.unionAll(end)
    best = every.groupBy("g").agg(F.min(F.struct("det", "start", "m", "w")).alias("x"))
    return scratch.table(best.select("g", "x.start", "x.m", "x.w", "x.det"), "least")


def _mixed(own: str, other: str) -> list[str]:
    """SQL of the moments of n parts of one estimate and SHRINK parts of another; n is 0 where the first has none."""
    share = f"(coalesce({own}.n, 0) / (coalesce({own}.n, 0) + {SHRINK}D))"
    return [f"{share} * coalesce({own}.{c}, 0D) + (1 - {share}) * {other}.{c} AS {c}" for c in (*(f"m{i}" for i in range(P)), *(f"c{i}{j}" for i, j in PAIRS))]


def estimates(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(own, m, w) of each language and source of rows (lang, source, u, base_failed), from those that do not fail."""
    groups = scratch.table(rows.groupBy(_key("own").alias("own"), _key("lang").alias("lang"), _key("all").alias("all")).agg(F.count("*").alias("rows")), "groups")
    near = F.broadcast if groups.count() <= BROADCAST_GROUPS else (lambda f: f)
    members = rows.where("not base_failed").select(F.explode(F.array(*map(_key, ("own", "lang", "all")))).alias("g"), "u")
    least = least_determinant(members, scratch, near)
    within = members.join(near(least), "g").where(f"{DISTANCE} <= {INNER}")
    found = scratch.table(_moments(within.groupBy("g").agg(*_sums("u")), INNER_CONSISTENT, "g"), "moments")
    langs = groups.select("lang", "all").distinct().alias("k").join(found.alias("o"), F.col("k.lang") == F.col("o.g"), "left").join(found.alias("t"), F.col("k.all") == F.col("t.g"))
    langs = scratch.table(langs.selectExpr("k.lang", *_mixed("o", "t")), "languages")
    own = groups.alias("k").join(found.alias("o"), F.col("k.own") == F.col("o.g"), "left").join(langs.alias("t"), F.col("k.lang") == F.col("t.lang"))
    out = scratch.table(_whitening(own.selectExpr("k.own", *_mixed("o", "t")), "own"), "judges").drop("det")
    return near(out)


def _judged(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str, whole: bool = False) -> DataFrame:
    """The statistics of every row, `distance` and `kept`. The texts are read once; the rest works on the statistics in the shared folder."""
    scratch = Scratch(docs.sparkSession)
    rows = scratch.table(statistics(docs, id_col, text_col, lang_col, source_col, whole), "statistics")
    found = estimates(rows.select("lang", "source", "u", "base_failed"), scratch)
    scored = rows.withColumn("own", _key("own")).join(found, "own", "left").withColumn("distance", F.expr(DISTANCE))
    return scored.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance") <= CUTOFF, F.lit(False)))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row per row of `docs`: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance, t.

    `distance` is the squared robust distance; kept: the base rules pass and it is at most CUTOFF. t is xxhash64 of the
    text. A null text has no words and fails the base rules. Null languages and sources are groups like others. Repeated
    ids and rows each count. Where no document passes, distance is null. Columns of other names are not read.
    """
    judged = _judged(docs, id_col, text_col, lang_col, source_col)
    return judged.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance", "t")


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of `docs` that the rules keep, all columns. Rows go to the shared folder beside their statistics, so no text is exchanged."""
    judged = _judged(docs, id_col, text_col, lang_col, source_col, whole=True)
    return judged.where("kept").select(*(F.col("doc")[c].alias(c) for c in docs.columns))
