"""Quality rules with thresholds learnt per language and source (DataFrame functions only).

Each document gets a few whole-number measures.  Per (language, source) and
measure a quantile sketch counts the values of documents that pass the base
rules in logarithmic bins: a value keeps its five leading bits, so a bin is at
most 1/16 wide relative to its values, a sketch has at most 32 + 16 * 59 bins,
and two sketches merge by adding counts.

No group is too small: to a group's sketch that of its language is added with
the weight of `prior` documents, and to a language's sketch that of everything.
A measure's limits follow from the group's own sketch,

    median +- spread * (mean excess above, or below, the median),

where an excess counts as at most twice its language's, so that a source full of
junk cannot lift its own limits.  A document is an outlier in a family of
measures (marks, words, case, repetition) if the bin of one of them is beyond
its limit; outliers in two families go.  Documents meet their limits by a join.

Defined results
---------------
* Null texts have no words; texts of fewer than 50 words, or with more than half
  of their words in repeated three-word windows, fail the base rule.
* Null languages and sources form groups of their own; a group without a passing
  document has no sketch, and all its documents have failed the base rule.
* Repeated rows are judged, and counted in sketches, one by one.
* Extra columns pass through, but given columns of the results' names are
  replaced; names that start with `q_` are reserved, and refused.
* Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS, cut, let, refuse, words_of

#: measure -> its family
FAMILIES = {"q_symbols": "marks", "q_dup_lines": "repetition", "q_repeats": "repetition", "q_word_chars": "words", "q_upper": "case"}
MEASURES = tuple(FAMILIES)
TWO_SIDED = ("q_word_chars",)  # low values are outliers too
#: SPREAD is the least whole number at which inner folds of the training labels of sf0.1 lose at most 1 % of clean documents.
SPREAD, PRIOR, PARTS = 4, 100, 100  # PARTS: weights are whole numbers of hundredths of a document
MOST_BROADCAST = 20_000  # thresholds (groups of language and source)


def _repeat_words(words: Column) -> Column:
    """Words covered by a three-word window that occurs at least twice in the text.

    Windows compare by 64-bit hash.  Few different repeated windows are looked
    up in a list; many are matched by sorting, so long texts stay n log n.
    """
    long = lambda c: c.cast("long")
    windows = lambda w: F.transform(
        F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    )
    # words newly covered by a window at p, when the last one covered starts at q: min(3, p - q)
    covered = lambda at: F.when(F.size(at) == 0, long(F.lit(0))).otherwise(
        3 + long(F.aggregate(F.sequence(F.lit(1), F.size(at) - 1), long(F.lit(0)), lambda a, k: a + F.least(F.lit(3), F.get(at, k) - F.get(at, k - 1))))
    )
    covered_safe = lambda at: F.when(F.size(at) == 1, long(F.lit(3))).otherwise(covered(at))

    def by_list(h: Column, twice: Column) -> Column:
        at = F.filter(F.transform(h, lambda x, i: F.when(F.array_contains(twice, x), i)), lambda i: i.isNotNull())
        return let(at, covered_safe)

    def by_sort(h: Column) -> Column:
        def marked(s: Column) -> Column:
            same = lambda x, k: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
            return F.sort_array(
                F.transform(F.filter(s, lambda x, k: ((k > 0) & same(x, k - 1)) | same(x, k + 1)), lambda x: x["i"])
            )

        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return let(pairs, lambda s: let(marked(s), covered_safe))

    def of_windows(h: Column) -> Column:
        twice = lambda s: F.array_distinct(F.filter(s, lambda x, k: (k > 0) & (F.get(s, k - 1) == x)))
        some = let(F.sort_array(h), lambda s: let(twice(s), lambda t: F.when(F.size(t) <= 16, by_list(h, t)).otherwise(by_sort(h))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), long(F.lit(0))).otherwise(some)

    return F.when(F.size(words) < 4, long(F.lit(0))).otherwise(let(windows(words), of_windows))


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the q_ measures."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    full_lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(WS)) != "")
    of_words = lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
        _repeat_words(w).alias("n_repeat_words"),
    )
    of_lines = lambda x: F.struct(
        F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")
    )
    out = docs.withColumns(
        {
            "q_w": let(words_of(F.col(text_col)), of_words),
            "q_l": let(full_lines, of_lines),
            "n_symbols": F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long"),
            "q_up_all": (F.char_length(text) - F.char_length(F.regexp_replace(text, "[A-Z]+", ""))).cast("long"),
        }
    )
    share = lambda a, b: F.floor(a * 1000 / F.greatest(b, F.lit(1)))
    return (
        out.withColumns(
            {
                "n_words": F.col("q_w.n_words"),
                "word_chars": F.col("q_w.word_chars"),
                "n_dup_lines": F.col("q_l.dup"),
                "n_repeat_words": F.col("q_w.n_repeat_words"),
            }
        )
        .withColumns(
            {
                "q_symbols": share(F.col("n_symbols"), F.col("word_chars")),
                "q_dup_lines": share(F.col("n_dup_lines"), F.col("q_l.n")),
                "q_repeats": share(F.col("n_repeat_words"), F.col("n_words")),
                "q_word_chars": F.floor(F.col("word_chars") * 100 / F.greatest("n_words", F.lit(1))),
                "q_upper": share(F.col("q_up_all"), F.col("word_chars")),
                "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
            }
        )
        .drop("q_w", "q_l", "q_up_all")
    )


def bin_of(value: Column) -> Column:
    """The lower end of a value's sketch bin: its five leading bits."""
    drop = F.greatest(F.length(F.bin(value)) - 5, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, drop), drop)


def sketches(measured: DataFrame, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Mergeable sketches: rows (lang, source, measure, bin, n) over documents that pass the base rules."""
    rows = measured.where(~F.col("base_failed")).select(
        F.col(lang_col).alias("lang"),
        F.col(source_col).alias("source"),
        F.inline(F.array(*[F.struct(F.lit(m).alias("measure"), bin_of(F.col(m)).alias("bin")) for m in MEASURES])),
    )
    return rows.groupBy("lang", "source", "measure", "bin").agg(F.count("*").alias("n"))


def _listed(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """One row per group and measure: its bins in order, as an array (at most 976) of (bin, n)."""
    merged = sketch.groupBy(*keys, "measure", "bin").agg(F.sum("n").alias("n"))
    return merged.groupBy(*keys, "measure").agg(F.sort_array(F.collect_list(F.struct("bin", "n"))).alias("bins"))


def _smoothed(own: Column, wider: Column, prior: int) -> Column:
    """The wider sketch's bins (bin, n), weighing `PARTS` per document of `own` and prior * PARTS altogether for `wider`."""
    total = F.aggregate(wider, F.lit(0).cast("long"), lambda a, b: a + b["n"])

    def weigh(counts: Column, all_of: Column) -> Column:
        return F.transform(
            wider, lambda b: F.struct(b["bin"].alias("bin"), (PARTS * F.coalesce(counts[b["bin"]], F.lit(0).cast("long")) + F.floor(b["n"] * (prior * PARTS) / all_of)).alias("n"))
        )

    return let(F.map_from_entries(own), lambda counts: let(total, lambda n: weigh(counts, n)))


def _moments(bins: Column) -> Column:
    """(mid, above, below) of a sketch: its median, and a hundred times the mean excess on either side."""
    zero = F.lit(0).cast("long")
    total = F.aggregate(bins, zero, lambda a, b: a + b["n"])

    def mid(all_of: Column) -> Column:
        start = F.struct(zero.alias("n"), F.lit(None).cast("long").alias("at"))
        step = lambda a, b: F.struct((a["n"] + b["n"]).alias("n"), F.coalesce(a["at"], F.when(2 * (a["n"] + b["n"]) >= all_of, b["bin"])).alias("at"))
        return F.aggregate(bins, start, step)["at"]

    def of(all_of: Column, m: Column) -> Column:
        mean = lambda excess: F.floor(100 * F.aggregate(bins, zero, lambda a, b: a + b["n"] * F.greatest(excess(b["bin"]), zero)).cast("double") / all_of)
        return F.struct(m.alias("mid"), mean(lambda b: b - m).alias("above"), mean(lambda b: m - b).alias("below"))

    return let(total, lambda n: let(mid(n), lambda m: of(n, m)))


def thresholds(sketch: DataFrame, spread: int = SPREAD, prior: int = PRIOR) -> DataFrame:
    """(lang, source, and per measure q_max_ and q_min_).  Limits are in the measure's unit; a measure below its median is no outlier if it is one-sided."""
    overall = _listed(sketch, []).select("measure", F.col("bins").alias("all_bins"))
    langs = _listed(sketch, ["lang"]).join(F.broadcast(overall), "measure")  # one row per measure
    langs = langs.select(F.col("lang").alias("l"), F.col("measure").alias("m"), _smoothed(F.col("bins"), F.col("all_bins"), prior).alias("lang_bins"))
    langs = cut(langs.withColumn("wide", _moments(F.col("lang_bins"))))
    own = _listed(sketch, ["lang", "source"]).join(langs, F.col("lang").eqNullSafe(F.col("l")) & (F.col("measure") == F.col("m")))
    own = own.withColumn("own", _moments(_smoothed(F.col("bins"), F.col("lang_bins"), prior)))
    reach = lambda side: F.floor(spread * F.least(f"own.{side}", 2 * F.col(f"wide.{side}")) / 100)
    limits = own.select("lang", "source", "measure", (F.col("own.mid") + reach("above")).alias("most"),
                        F.when(F.col("measure").isin(*TWO_SIDED), F.col("own.mid") - reach("below")).alias("least"))
    pick = lambda m, side: F.max(F.when(F.col("measure") == m, F.col(side)))
    return limits.groupBy("lang", "source").agg(
        *[pick(m, side).alias(m.replace("q_", name)) for m in MEASURES for side, name in (("most", "q_max_"), ("least", "q_min_"))]
    )


def judge(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
          spread: int = SPREAD, prior: int = PRIOR, with_text: bool = True) -> DataFrame:
    """All rows of `docs` with their measures, base_failed and kept.

    Measures are taken once and stored, for the sketches and for the join, which
    costs less than taking them twice; without texts if `with_text` is off.
    Nothing but the sketches is shuffled.
    """
    refuse(docs, "q_")
    measured = measure(docs, text_col)
    measured = cut(measured if with_text else measured.drop(text_col))
    sketch = cut(sketches(measured, lang_col, source_col))
    limit = cut(thresholds(sketch, spread, prior).withColumnsRenamed({"lang": "q_lang", "source": "q_source"}))
    if limit.count() <= MOST_BROADCAST:  # else the join is by key, and skewed groups are split at run time
        limit = F.broadcast(limit)
    beyond: dict[str, Column] = {}
    for m, family in FAMILIES.items():
        high, low = (F.col(m.replace("q_", x)) for x in ("q_max_", "q_min_"))
        out = F.coalesce(bin_of(F.col(m)) > high, F.lit(False)) | F.coalesce(bin_of(F.col(m)) < low, F.lit(False))
        beyond[family] = beyond[family] | out if family in beyond else out
    families = sum((x.cast("int") for x in beyond.values()), F.lit(0))
    joined = measured.join(limit, F.col(lang_col).eqNullSafe(F.col("q_lang")) & F.col(source_col).eqNullSafe(F.col("q_source")), "left")
    return joined.withColumn("kept", ~F.col("base_failed") & (families < 2)).drop(*limit.columns)
