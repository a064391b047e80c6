"""Syntactic features of a parse: an array of structs (word, sent, pos, tag, dep, head), in order, where `sent` numbers
sentences and `head` is the place of the head from 1, a root's its own. Depths, whose reach doubles seven times, and the moving
type-token ratio are made in Arrow batches, all else by expressions that are linear in the words."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorefabric.functions.expressions import let, mean_of, packed, total
from scorefabric.functions.lexical import moving_ttr

# Dependencies that open a clause, parts of speech and verb tags that are counted.
CLAUSE_DEPS = ["advcl", "ccomp", "xcomp", "acl", "relcl", "csubj", "csubjpass"]
POS_KEYS = ["NOUN", "VERB", "ADJ", "ADV", "PRON", "DET", "ADP", "AUX", "CCONJ", "SCONJ", "PROPN", "INTJ"]
VERB_TAGS = ["VB", "VBD", "VBG", "VBN", "VBP", "VBZ", "MD"]
DEEPEST = 100


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _steps(heads: pd.Series) -> pd.Series:
    out = []
    for row in heads:
        if row is None:
            out.append(None)
            continue
        own = np.arange(len(row))
        to = np.array([k if h is None or h != h else int(h) - 1 for k, h in enumerate(row)], np.int64)
        steps = (to != own).astype(np.int64)
        for _ in range(7):
            steps, to = steps + steps[to], to[to]
        out.append(np.minimum(steps, DEEPEST).astype(np.int32))
    return pd.Series(out, dtype=object)


@F.pandas_udf(T.DoubleType())
def _moving(toks: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else moving_ttr(list(t)) for t in toks], dtype="float64")


def depths(parse: Column) -> Column:
    """Steps from each word to its root, DEEPEST at most; a null head is a root. In Arrow batches."""
    return _steps(F.transform(parse, lambda t: t["head"].cast("int")))


def sentences(parse: Column) -> Column:
    """Structs (words, depth) of the sentences that have a word of letters: their number, and the deepest word of any kind."""
    alpha = F.transform(parse, lambda t: is_word(t["word"]))
    opens = F.filter(F.transform(parse, lambda t, i: F.when((i == 0) | (t["sent"] != F.get(parse, i - 1)["sent"]), i + 1)), lambda i: i.isNotNull())
    ends = lambda o: F.concat(F.slice(o, 2, F.greatest(F.size(o) - 1, F.lit(0))), F.array(F.size(parse) + 1))
    bound = F.struct(opens.alias("opens"), alpha.alias("alpha"), depths(parse).alias("deep"))
    each = lambda s: F.zip_with(s["opens"], ends(s["opens"]), lambda a, b: F.struct(F.size(F.filter(F.slice(s["alpha"], a, b - a), lambda x: x)).alias("words"), F.array_max(F.slice(s["deep"], a, b - a)).alias("depth")))
    return F.filter(let(bound, each), lambda s: s["words"] > 0)


def _is(field: str | None, value: str):
    return lambda t: (t[field] if field else t) == value


def is_word(c: Column) -> Column:
    return c.rlike(r"^\p{L}+$")


def syntax_features(parse: Column, chunks: Column | None = None) -> Column:
    """A struct of all features of a parse; `chunks` is the number of noun chunks. Without words of letters the count is 0 and the
    others are null."""
    words = F.filter(parse, lambda t: is_word(t["word"]))
    moving = _moving(F.transform(words, lambda t: F.lower(t["word"])))
    bound = F.struct(words.alias("words"), sentences(parse).alias("sents"), moving.alias("moving"))
    return let(bound, lambda s: packed(_features(parse, s["words"], s["sents"], s["moving"], chunks)))


def _features(parse: Column, words: Column, sents: Column, moving: Column, chunks: Column | None) -> dict[str, Column]:
    toks = F.transform(words, lambda t: F.lower(t["word"]))
    n, k = F.size(words), F.size(sents)
    some = lambda c: F.when(n > 0, c)
    count = lambda of, test: F.size(F.filter(of, lambda t: test(t)))
    per = lambda c: some(c / F.greatest(k, F.lit(1)))
    lens, deep = F.transform(sents, lambda s: s["words"]), F.transform(sents, lambda s: s["depth"])
    spread = lambda x: let(F.struct(x.alias("x"), mean_of(x).alias("m")), lambda v: F.sqrt(mean_of(F.transform(v["x"], lambda y: (y - v["m"]) * (y - v["m"])))))
    verbs = F.filter(F.transform(parse, lambda t: t["tag"]), lambda x: x.isin(VERB_TAGS))
    return {
        "ling_n_words": n,
        "ttr": some(F.size(F.array_distinct(toks)) / n),
        "mattr50": some(moving),
        "mean_word_len": some(total(F.transform(toks, F.length)) / n),
        "long_word_frac": some(count(toks, lambda w: F.length(w) > 6) / n),
        "n_sents": some(k),
        "sent_len_mean": some(mean_of(lens)),
        "sent_len_std": some(spread(lens)),
        "sent_len_max": some(F.array_max(lens)),
        "dep_depth_mean": some(mean_of(deep)),
        "dep_depth_max": some(F.array_max(deep)),
        "clauses_per_sent": per(count(parse, lambda t: t["dep"].isin(CLAUSE_DEPS))),
        "conj_per_sent": per(count(parse, lambda t: t["dep"] == "conj")),
        "sconj_per_100": some(100.0 * count(parse, lambda t: (t["pos"] == "SCONJ") | (t["dep"] == "mark")) / n),
        "passive_per_100": some(100.0 * count(parse, lambda t: t["dep"].isin("nsubjpass", "auxpass")) / n),
        **({"noun_chunks_per_sent": per(chunks)} if chunks is not None else {}),
        **{f"pos_{p}": some(count(words, _is("pos", p)) / n) for p in POS_KEYS},
        **{f"vtag_{v}": some(count(verbs, _is(None, v)) / n) for v in VERB_TAGS},
        "verb_form_diversity": some(F.size(F.array_distinct(verbs))),
    }
