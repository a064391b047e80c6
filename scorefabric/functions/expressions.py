"""Column expressions: everything here stays in the JVM."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Filler words of the timing features, of the edit features and of the repair counts.
FILLERS = ["um", "uh", "er", "ah", "erm", "hmm", "mm", "uhm", "umm", "uhh", "eh", "huh", "hm"]
FILLERS_EDIT = ["um", "uh", "er", "ah", "erm", "hmm", "mm", "uhm", "umm", "uhh", "eh", "hm"]
FILLERS_REPAIR = ["um", "uh", "er", "ah", "erm", "hmm", "mm", "uhm", "umm"]


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def let(value: Column, body) -> Column:
    """body(value) with the value computed once a row, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def packed(columns: dict[str, Column]) -> Column:
    return F.struct(*[c.alias(k) for k, c in columns.items()])


def unpacked(df, keys: list[str], struct: Column):
    """Keys and a struct's fields: the struct is one column first, so that it is computed once a row and not once a field."""
    return df.select(*keys, struct.alias("_s")).select(*keys, "_s.*")


def clip(c: Column, low: float | None = None, high: float | None = None) -> Column:
    """Bounds that leave NULL and NaN as they are (greatest and least alone would not)."""
    out = c
    if high is not None:
        out = F.least(out, F.lit(float(high)))
    if low is not None:
        out = F.greatest(out, F.lit(float(low)))
    return F.when(c.isNotNull() & ~F.isnan(c), out).otherwise(c)


def noise_gate(dyn_range: Column, peak: Column, below: float = 5.0, above: float = 0.9) -> Column:
    """Strict: dynamic range below 5 dB and peak above 0.9."""
    return (dyn_range < below) & (peak > above)


def near_45(duration: Column) -> Column:
    return (F.abs(duration - 45.06) < 0.2).cast("int")


def right_closed(c: Column, edges: list[float], labels: list[str], other: str | None = "nan") -> Column:
    """Bins (a, b]: the label of the first upper edge that is not below c."""
    out = F.when(c.isNull() | (c <= edges[0]), F.lit(other))
    for high, label in zip(edges[1:], labels, strict=True):
        out = out.when(c <= high, F.lit(label))
    return out.otherwise(F.lit(other))


def duration_bin(c: Column) -> Column:
    return right_closed(c, [0, 44, 46, 59, 99], ["<44", "44-46", "46-59", ">=59"])


def stratum(grade: Column) -> Column:
    """max(half-even round of twice the grade, 4)."""
    return F.greatest(F.rint(grade * 2), F.lit(4.0)).cast("int")


def normal_token(c: Column) -> Column:
    """Trimmed, in lower case, without non-word characters at the ends (apostrophes stay)."""
    return F.regexp_replace(F.lower(F.trim(c)), r"(?U)^[^\w']+|[^\w']+$", "")


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("([a-z0-9']+)"), 1)


def without(toks: Column, words: list[str]) -> Column:
    """Filter that keeps repeats (array_except would not)."""
    known = F.array(*[F.lit(w) for w in words])
    return F.filter(toks, lambda t: ~F.array_contains(known, t))


def strip_closing(c: Column) -> Column:
    return F.regexp_replace(c, r"(?i)(thanks|thank you) for watching!?\s*$", "")


def truncate_words(c: Column, n: int = 160) -> Column:
    w = F.split(F.trim(c), r"\s+")
    return F.when(F.size(w) > n, F.concat(F.array_join(F.slice(w, 1, n), " "), F.lit(" ..."))).otherwise(F.array_join(w, " "))


def two_views(a: Column, b: Column) -> Column:
    return F.concat_ws(" [SEP] ", F.trim(F.coalesce(a, F.lit(""))), F.trim(F.coalesce(b, F.lit(""))))


def slug(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\w.-]+", "_")


def view_of(path: Column, prefix: str, suffix: str = "csv") -> Column:
    return F.regexp_extract(path, rf"{prefix}_(.*)\.{suffix}", 1)


def layer_of(name: Column) -> Column:
    return F.regexp_extract(name, r"language_model\.model\.layers\.(\d+)\.", 1).try_cast("int")


def ttr(toks: Column) -> Column:
    return F.when(F.size(toks) > 0, F.size(F.array_distinct(toks)) / F.size(toks)).otherwise(F.lit(0.0))


def mattr(toks: Column, window: int = 50) -> Column:
    """Moving type-token ratio; short texts give their plain ratio."""
    n = F.size(toks)
    ratios = F.transform(F.sequence(F.lit(1), n - window + 1), lambda i: F.size(F.array_distinct(F.slice(toks, i, window))) / F.lit(float(window)))
    return F.when(n <= window, ttr(toks)).otherwise(F.aggregate(ratios, F.lit(0.0), lambda a, x: a + x) / F.size(ratios))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x.cast("double"))


def mean_of(values: Column, empty: float = 0.0) -> Column:
    return F.when(F.size(values) > 0, total(values) / F.size(values)).otherwise(F.lit(empty))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column, eps: float = 0.0) -> Column:
    return F.sqrt(dot(a, a)) + eps


def unit(a: Column, eps: float = 1e-8) -> Column:
    n = norm(a, eps)
    return F.transform(a, lambda x: x.cast("double") / n)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def softmax(a: Column) -> Column:
    v = F.transform(a, lambda x: x.cast("double"))
    e = let(F.array_max(v), lambda top: F.transform(a, lambda x: F.exp(x.cast("double") - top)))
    return let(let(e, lambda w: F.struct(w.alias("w"), total(w).alias("mass"))), lambda s: F.transform(s["w"], lambda x: x / s["mass"]))


def log_softmax(a: Column) -> Column:
    v = F.transform(a, lambda x: x.cast("double"))
    mass = let(F.array_max(v), lambda top: top + F.log(total(F.transform(a, lambda x: F.exp(x.cast("double") - top)))))
    return let(mass, lambda m: F.transform(a, lambda x: x.cast("double") - m))


def half(c: Column) -> Column:
    """The nearest 16-bit float (ties to even), as a double: 11 significant bits, steps of 2^-24 below 2^-14, infinite beyond 65504."""
    x = c.cast("double")
    step = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(F.abs(x))), F.lit(-14)) - 10)
    near = F.rint(x / step) * step
    return F.when((x == 0) | F.isnan(x) | (F.abs(x) == float("inf")), x).when(F.abs(near) > 65504, F.signum(x) * float("inf")).otherwise(near)


def quantile_of(ordered: Column, q: float) -> Column:
    """Linear quantile of an array in ascending order; null for an empty one."""
    at = (F.size(ordered) - 1) * F.lit(q)
    low = F.floor(at).cast("int")
    a = F.get(ordered, low)
    return a + (F.get(ordered, F.least(low + 1, F.size(ordered) - 1)) - a) * (at - low)


def overridden(value: Column, mask: Column, by: float = 0.0) -> Column:
    """`by` where the mask holds; a null mask does not hold."""
    return F.when(mask, F.lit(float(by))).otherwise(value)


def top_candidates(candidates: Column, by: str, n: int = 5) -> Column:
    """The n structs of largest `by`, ties by the other fields in order; nulls of `by` come last."""
    key = F.transform(candidates, lambda c: F.struct((-c[by]).isNull().alias("_n"), (-c[by]).alias("_k"), c.alias("_c")))
    return F.transform(F.slice(F.array_sort(key), 1, n), lambda k: k["_c"])


def names_like(names: list[str], prefix: tuple[str, ...] = (), suffix: tuple[str, ...] = (), deny: tuple[str, ...] = (), include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> list[str]:
    """Names in their order: with one of the prefixes and one of the suffixes (where given), with one of the substrings
    `include` (where given), with none of `exclude`, and not in `deny`."""
    return [n for n in names if n not in deny and (not prefix or n.startswith(prefix)) and (not suffix or n.endswith(suffix)) and (not include or any(i in n for i in include)) and not any(e in n for e in exclude)]


def numeric_columns(df, **which) -> list[str]:
    """names_like over a table's numeric columns."""
    kinds = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")
    return names_like([n for n, k in df.dtypes if k.split("(")[0] in kinds], **which)


def dropped(df, names: list[str], missing_ok: bool = False):
    """df without the named columns; a name that it lacks raises, or with missing_ok is passed over."""
    if not missing_ok and (unknown := [n for n in names if n not in df.columns]):
        raise KeyError(f"no columns {unknown}")
    return df.drop(*names)


def usable(split: Column, noisy: Column) -> Column:
    """Rows that stay: those of the test split, and others that are no noise (null: not known to be noise)."""
    return (split == "test") | ~F.coalesce(noisy, F.lit(False))


def repeats(toks: Column) -> Column:
    """Tokens equal to the one before."""
    pairs = F.zip_with(F.slice(toks, 2, F.greatest(F.size(toks) - 1, F.lit(0))), F.slice(toks, 1, F.greatest(F.size(toks) - 1, F.lit(0))), lambda a, b: a == b)
    return F.when(F.size(toks) > 1, F.size(F.filter(pairs, lambda x: x))).otherwise(0)


def bigram_repeats(toks: Column) -> Column:
    """Positions i >= 3 (from 0) where (t[i-1], t[i]) = (t[i-3], t[i-2])."""
    i = F.sequence(F.lit(4), F.size(toks))
    hit = F.filter(i, lambda k: (F.element_at(toks, k) == F.element_at(toks, k - 2)) & (F.element_at(toks, k - 1) == F.element_at(toks, k - 3)))
    return F.when(F.size(toks) >= 4, F.size(hit)).otherwise(0)


#: Code points that stand for words: all but the first 32 and the surrogates.
MOST_WORDS = 0x110000 - 32 - 0x800


@F.pandas_udf(T.StructType([T.StructField("ref", T.StringType()), T.StructField("hyp", T.StringType())]))
def _spelt(ref: pd.Series, hyp: pd.Series) -> pd.DataFrame:
    """Two lists of words as strings with a code point for each different word of the two."""
    out = []
    for pair in zip(ref, hyp, strict=True):
        place: dict[str, int] = {}
        codes = [[place.setdefault(w, len(place)) + 32 for w in (() if words is None else words)] for words in pair]
        if len(place) > MOST_WORDS:
            raise ValueError(f"{len(place)} different words in two texts; {MOST_WORDS} at most")
        out.append(["".join(chr(c if c < 0xD800 else c + 0x800) for c in code) for code in codes])
    return pd.DataFrame(out, columns=["ref", "hyp"])


def wer(ref: Column, hyp: Column) -> Column:
    """Word edits over reference words: words become code points in Arrow batches, and the JVM's levenshtein counts these.

    An empty reference has 1 where there is a hypothesis, else 0; null lists give null.
    """
    empty = (F.size(hyp) > 0).cast("double")
    edits = let(_spelt(ref, hyp), lambda s: F.levenshtein(s["ref"], s["hyp"]))
    return F.when(ref.isNull() | hyp.isNull(), F.lit(None).cast("double")).when(F.size(ref) == 0, empty).otherwise(edits / F.size(ref))


def score_distribution(bins: Column) -> dict[str, Column]:
    """Nine bins of grades 1.0 to 5.0, with their mass: expectation, sd, tails, argmax."""
    mass = total(bins)
    p = F.transform(bins, lambda x: x.cast("double") / mass)
    grades = F.array(*[F.lit(1 + 0.5 * k) for k in range(9)])
    exp = dot(p, grades)
    second = dot(p, F.transform(grades, lambda g: g * g))
    return {
        "exp": exp,
        "sd": F.sqrt(F.greatest(second - exp * exp, F.lit(0.0))),
        "p_le2": total(F.slice(p, 1, 3)),
        "p_ge45": total(F.slice(p, 8, 2)),
        "mass": mass,
        "argmax": F.element_at(grades, F.array_position(p, F.array_max(p)).cast("int")),
        **{f"p{k + 1}": F.element_at(p, k + 1) for k in range(9)},
    }


def surprisal(nll: Column) -> dict[str, Column]:
    """Mean, population sd, 90th percentile (linear), max, shares below 0.5 and above 6; an empty list counts as [0.0]."""
    v = F.when(F.size(nll) > 0, nll).otherwise(F.array(F.lit(0.0)))
    n, m = F.size(v), total(v) / F.size(v)
    s = F.array_sort(v)
    at = (n - 1) * 0.9
    low = F.floor(at).cast("int")
    a, b = F.element_at(s, low + 1), F.element_at(s, F.least(low + 2, n))
    return {
        "nll_mean": m,
        "nll_sd": F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + (x - m) * (x - m)) / n),
        "nll_p90": a + (b - a) * (at - low),
        "nll_max": F.array_max(v),
        "nll_frac_low": F.size(F.filter(v, lambda x: x < 0.5)) / n,
        "nll_frac_high": F.size(F.filter(v, lambda x: x > 6)) / n,
    }


def band_mean(layers: Column) -> Column:
    """Element-wise mean of an array of equally long arrays."""
    zero = F.transform(F.element_at(layers, 1), lambda x: F.lit(0.0))
    return F.transform(F.aggregate(layers, zero, lambda a, x: F.zip_with(a, x, lambda p, q: p + q.cast("double"))), lambda x: x / F.size(layers))


def valid_tokens(duration: Column, n: int, chunk: int = 375, seconds: float = 30.0, rate: float = 12.5) -> Column:
    """Mask of n audio tokens: in each 30 s chunk of 375 the first ceil(seconds * 12.5) are valid."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (i % chunk) < F.least(F.lit(chunk), F.ceil(F.least(F.lit(seconds), F.greatest(F.lit(0.0), duration - seconds * F.floor(i / chunk))) * rate)))


def frame_count(samples: Column, rate: int = 16000) -> Column:
    return F.least(F.lit(1500), F.ceil(samples / rate * 50)).cast("int")


def words_struct(raw: Column) -> Column:
    """Positional [start, end, word, prob] lists, read as strings, to structs."""
    return F.transform(raw, lambda w: F.struct(w[0].cast("double").alias("start"), w[1].cast("double").alias("end"), w[2].alias("word"), w[3].cast("double").alias("prob")))


def segment_features(segments: Column) -> dict[str, Column]:
    get = lambda f: F.transform(segments, lambda s: s[f].cast("double"))
    return {"avg_logprob_mean": F.when(F.size(segments) > 0, mean_of(get("avg_logprob"))), "avg_logprob_min": F.array_min(get("avg_logprob")), "compression_max": F.array_max(get("compression_ratio")), "no_speech_max": F.array_max(get("no_speech_prob"))}


def segment_aggregates() -> dict[str, Column]:
    """segment_features as aggregates over a row for each segment, which combine before a shuffle."""
    return {"avg_logprob_mean": F.avg("avg_logprob"), "avg_logprob_min": F.min("avg_logprob"), "compression_max": F.max("compression_ratio"), "no_speech_max": F.max("no_speech_prob")}


def timing_features(words: Column, duration: Column) -> Column:
    """A struct of the timing features of a clip from its words (structs start, end, word, prob, in order); see unpacked()."""
    gaps = lambda kept: F.zip_with(F.slice(kept, 2, F.greatest(F.size(kept) - 1, F.lit(0))), F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0))), lambda b, a: F.greatest(b["start"] - a["end"], F.lit(0.0)))
    bound = let(F.filter(words, lambda w: normal_token(w["word"]) != ""), lambda kept: F.struct(kept.alias("kept"), gaps(kept).alias("gaps")))
    return let(bound, lambda w: packed(_timing(w["kept"], w["gaps"], duration)))


def _timing(kept: Column, gaps: Column, duration: Column) -> dict[str, Column]:
    n = F.size(kept)
    minutes = F.greatest(duration, F.lit(1.0)) / 60
    toks = F.transform(kept, lambda w: normal_token(w["word"]))
    span = F.greatest(F.element_at(kept, -1)["end"] - F.element_at(kept, 1)["start"], F.lit(1e-3))
    over = lambda t: F.filter(gaps, lambda g: g >= t)
    p25 = over(0.25)
    cuts = F.filter(F.transform(gaps, lambda g, i: F.when(g >= 0.25, i + 1)), lambda x: x.isNotNull())
    edges = F.concat(F.array(F.lit(0)), cuts, F.array(n))
    runs = let(edges, lambda e: F.zip_with(F.slice(e, 2, F.size(e) - 1), F.slice(e, 1, F.size(e) - 1), lambda b, a: (b - a).cast("double")))
    prob = F.transform(kept, lambda w: w["prob"])
    p10 = let(F.array_sort(prob), lambda o: quantile_of(o, 0.1))
    fillers = F.array(*[F.lit(x) for x in FILLERS])
    some = lambda c: F.when(n > 0, c)
    return {
        "n_words": n,
        "wpm": n / minutes,
        "wpm_span": some(n / (span / 60)),
        "articulation_rate": some(n / F.greatest(total(F.transform(kept, lambda w: w["end"] - w["start"])), F.lit(1e-3))),
        "speech_span_frac": some(span / F.greatest(duration, F.lit(1e-3))),
        "lead_time": some(F.element_at(kept, 1)["start"]),
        "pause25_per_min": some(F.size(p25) / minutes),
        "pause50_per_min": some(F.size(over(0.5)) / minutes),
        "pause100_per_min": some(F.size(over(1.0)) / minutes),
        "pause_mean": some(mean_of(p25)),
        "pause_max": some(F.coalesce(F.array_max(gaps), F.lit(0.0))),
        "pause_time_frac": some(total(p25) / F.greatest(duration, F.lit(1e-3))),
        "mean_run_len": some(mean_of(runs)),
        "max_run_len": some(F.array_max(runs)),
        "word_prob_mean": some(mean_of(prob)),
        "word_prob_p10": some(p10),
        "low_prob_frac": some(F.size(F.filter(prob, lambda x: x < 0.5)) / n),
        "filler_per100": some(100 * F.size(F.filter(toks, lambda t: F.array_contains(fillers, t))) / n),
        "repeat_per100": some(100 * let(toks, repeats) / n),
        "bigram_repeat_per100": some(100 * let(toks, bigram_repeats) / n),
    }
