"""Exact dedup, divergence and search against brute force, on odd rows, on empty tables and with small bounds."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scorefabric.llm import divergence, exact, search

from odd_rows import ODD

LONG = [(20, " ".join(f"w{i % 700}x" for i in range(20_000))), (21, "ab" * 40_000)]


# ---- exact dedup ----


@settings(max_examples=40, deadline=None)
@given(st.sets(st.binary(min_size=32, max_size=32), max_size=400), st.sets(st.binary(min_size=32, max_size=32), max_size=50))
def test_perfect_hash_is_minimal(members, others):
    words = exact._words(sorted(members)) if members else np.zeros((0, 4), np.uint64)
    sizes, flags = exact.perfect(words)
    assert sorted(exact.slots(words, sizes, flags)) == list(range(len(members)))
    if others:
        at = exact.slots(exact._words(sorted(others)), sizes, flags)
        assert ((at >= -1) & (at < max(len(members), 1))).all()


def brute_dedup(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = Counter()
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        first = True
        for i in ids:
            out[(i, keep, len(ids), i == keep and first, hashlib.sha256(t.encode()).hexdigest())] += 1
            first = first and i != keep
    return out


def sha_hex(rows):
    return Counter((r.doc_id, r.keep_id, r.group_size, r.kept, bytes(r.digest).hex()) for r in rows)


COPIES = [*ODD, *LONG, (30, ""), (31, None), (None, "one"), (None, "null ids alone"), (None, "null ids alone"), (40, LONG[0][1]), (41, "one"), (41, "one"), *[(100 + i, "hot") for i in range(60)]]


@pytest.mark.parametrize("split", [None, 0, 9, 120, 1000])
def test_exact_dedup(docs_of, split, monkeypatch):
    monkeypatch.setattr(exact, "SHARD", 4)
    monkeypatch.setattr(exact, "LEAST_HOT", 10)
    got = exact.deduplicated(docs_of(COPIES), F.lit(None).cast("boolean") if split is None else F.col("doc_id") >= split).collect()
    assert sha_hex(got) == brute_dedup(COPIES)
    held = {t or "" for i, t in COPIES if split is not None and i is not None and i >= split}
    assert {bytes(r.digest).hex() for r in got if r.member} == {hashlib.sha256(t.encode()).hexdigest() for t in held}


@pytest.mark.parametrize("split", [0, 9, 120])
def test_texts_that_share_a_digest_stay_apart(docs_of, split):
    def weak(body):
        return F.unhex(F.rpad(F.substring(F.sha2(body, 256), 1, 1), 64, "0")) if "concat" not in str(body) else exact.sha(body)

    got = exact.deduplicated(docs_of(COPIES), F.col("doc_id") >= split, digest=weak).collect()
    want = brute_dedup(COPIES)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got) == Counter(k[:4] for k, n in want.items() for _ in range(n))


def test_exact_dedup_of_nothing(docs_of):
    assert exact.deduplicated(docs_of([]), F.lit(True)).collect() == []


# ---- divergence ----


def brute_divergence(rows, least, top):
    terms = [(lang or "", source or "", [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]) for text, lang, source in rows]
    out = []
    for lang in {x[0] for x in terms}:
        mine = [x for x in terms if x[0] == lang]
        held = Counter(w for *_, ws in mine for w in set(ws))
        kept = sorted((w for w, n in held.items() if n >= least), key=str.encode)
        counts = defaultdict(Counter)
        for _, source, ws in mine:
            counts[source].update(w for w in ws if held[w] >= least)
        p = lambda c: {w: 1 + 10**9 * (c[w] + 5) // (c.total() + 5 * len(kept)) for w in kept}
        shares, whole = {s: p(c) for s, c in counts.items()}, p(sum(counts.values(), Counter()))
        for s, own in shares.items():
            pairs = sorted(((-sum(abs(own[w] - q[w]) for w in kept), o.encode()) for o, q in shares.items() if o != s))
            out += [(lang, s, "pair", o.decode(), -v, k) for k, (v, o) in enumerate(pairs, 1)]
            best = sorted((-(own[w] - whole[w]), w.encode()) for w in kept if counts[s][w] > 0 and own[w] > whole[w])[:top]
            out += [(lang, s, "term", w.decode(), -v, k) for k, (v, w) in enumerate(best, 1)]
    return sorted(out)


def spoken(seed, n=300):
    r = np.random.default_rng(seed)
    words = ["Wort", "ünï", "日本", "a", "B", "zz9yy", "x-y", "É", "é", "\U0001f600", *[f"t{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(90)]]
    out = [(None, None, None), ("", "", ""), ("only here", "xx", "one"), ("12 34 !", "yy", "a"), ("12", "yy", "b"), (LONG[0][1], "en", "s1"), (LONG[1][1], "en", "s1")]
    for _ in range(n):
        own = r.choice(words, int(r.integers(0, 60)), p=(w := r.dirichlet(np.full(len(words), 0.3))) / w.sum())
        out.append((" ".join(own), str(r.choice(["en", "de", ""])), [None, "s1", "s2", "S2", "é"][int(r.integers(0, 5))]))
    return out


@pytest.mark.parametrize("bounds", [(1 << 18, 1 << 17, 1 << 20), (40, 30, 12)])
@pytest.mark.parametrize("least,top", [(3, 5), (1, 50), (1000, 5)])
def test_divergence(spark, bounds, least, top, monkeypatch):
    for name, value in zip(("FLUSH", "CHUNK_ROWS", "BLOCK"), bounds, strict=True):
        monkeypatch.setattr(divergence, name, value)
    rows = spoken(least)
    docs = spark.createDataFrame(rows, "text string, lang string, source string").selectExpr("*", "1 as n", "'x' as term", "2 as docs", "3 as value", "4 as _salt")
    assert sorted(tuple(r) for r in divergence.divergence(docs, least, top).collect()) == brute_divergence(rows, least, top)


def test_shares_are_exact():
    r = np.random.default_rng(0)
    for total in (7, 10**6, 8 * 10**15):
        counts = r.integers(0, total - 5 + 1, 200)
        assert divergence.shares(counts, np.int64(total)).tolist() == [1 + 10**9 * (int(c) + 5) // total for c in counts]


def test_divergence_of_nothing(spark):
    assert divergence.divergence(spark.createDataFrame([], "text string, lang string, source string")).collect() == []


# ---- search ----


def brute_search(docs, items, top=10):
    split = lambda t: [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
    texts = [(i, c) for i, t in docs if (c := Counter(split(t)))]
    big_n, big_l = len(texts), sum(c.total() for _, c in texts)
    df = Counter(w for _, c in texts for w in c)
    out = []
    for item, t in items:
        scores = []
        for i, c in texts:
            m = 10 + 90 * c.total() * big_n // big_l
            s = sum(math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 8 * m)) for w in set(split(t)) if c[w])
            if s > 0:
                scores.append((-s, i is None, i))
        out += [(item, k, i, -s) for k, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:top], 1)]
    return Counter(out)


def library(seed, n=150):
    r = np.random.default_rng(seed)
    words = ["Ä", "ä", "x1", "1x", "日", "one", "ONE", *[f"w{i}" for i in range(60)]]
    texts = [" ".join(r.choice(words, int(r.integers(0, 40)))) for _ in range(n)]
    return [*ODD, *LONG, *[(int(r.integers(50, 90)), t) for t in texts], *[(200 - i, "the same text here") for i in range(30)]]


@pytest.mark.parametrize("bounds", [(1 << 13, 1 << 19, 1 << 10), (7, 1 << 19, 2), (1 << 13, 50, 1)])
def test_search(spark, docs_of, bounds, monkeypatch):
    for name, value in zip(("SHARD_DOCS", "SHARD_POSTINGS", "BLOCK_ITEMS"), bounds, strict=True):
        monkeypatch.setattr(search, name, value)
    docs = library(3)
    items = [(1, "the same text of some words"), (2, "W1 w2 w3-w4 one"), (3, ""), (4, None), (5, "never_seen!"), (6, "w0x w1x w2x ab"), (7, "here here 日本語"), (7, "x1"), (None, "aaaaaaa")]
    df = docs_of(docs)
    n, l = search.totals(df)
    assert (n, l) == (len(t := [len(search.terms_of((x or "").encode())) for _, x in docs if search.terms_of((x or "").encode())]), sum(t))
    index = search.materialise(search.index_of(df, n, l), "postings")
    asked = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as rank", "2 as q", "3 as score", "4 as doc_id")
    got = Counter(tuple(r) for r in search.search(index, n, asked).select("item_id", "rank", "doc_id", "score").collect())
    assert got == brute_search(docs, items)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aZ9 .é日\x00", max_size=12), max_size=8), st.integers(0, 3))
def test_lengths(texts, skip):
    bodies = pa.array([t.encode() for t in texts], pa.binary())
    assert search.lengths(bodies[skip:]).tolist() == [len(search.terms_of(t.encode())) for t in texts[skip:]]


def test_search_of_nothing(spark, docs_of):
    items = spark.createDataFrame([(1, "one")], "item_id long, text string")
    for docs, asked in ((docs_of([]), items), (docs_of([(1, None), (2, " . ")]), items), (docs_of([(1, "one")]), items.limit(0)), (docs_of([(1, "one")]), items.selectExpr("item_id", "cast(null as string) as text"))):
        n, l = search.totals(docs)
        out = search.search(search.materialise(search.index_of(docs, n, l), "postings"), n, asked)
        assert out.collect() == [] and out.columns == ["item_id", "rank", "doc_id", "score"]


# ---- the queries against their SQL ----


@pytest.mark.parametrize("name", ["op11_exact_dedup", "op12_source_divergence", "op13_lexical_search"])
def test_queries(spark, name):
    from scorefabric.llm import queries

    at = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"create view {table} as select * from read_parquet('{at}/{table}.parquet')")
    df = queries.QUERIES[name](spark, at)
    want = con.execute(queries.SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(str, (tuple(r) for r in df.select(*columns).collect()))) == sorted(map(str, want.fetchall()))


# ---- toxicity from a random start ----


def planted(seed, n):
    """Texts of made-up words; toxic ones hold a few words of ten stems in forms of their own, a fiftieth of all words."""
    r = np.random.default_rng(seed)
    syllables = ["an", "er", "ti", "on", "lo", "mi", "sta", "ne", "ru", "pa"]
    word = lambda: "".join(r.choice(syllables, int(r.integers(1, 4))))
    out = []
    for _ in range(n):
        words, toxic = [word() for _ in range(int(r.integers(60, 400)))], r.random() < 0.3
        if toxic:
            for _ in range(max(3, len(words) // 50)):
                words.insert(int(r.integers(0, len(words))), str(r.choice(["vilgak", "scumzo", "trxash", "idjot", "morunk", "losxer", "pathek", "dizgus", "wortlez", "stupiq"])) + word())
        out.append((" ".join(words), int(toxic)))
    return out


def test_random_start_finds_planted_toxic_texts():
    from scorefabric.llm import toxicity

    learnt, asked = planted(0, 900), planted(1, 400)
    model = toxicity.fit([t for t, _ in learnt], [y for _, y in learnt])
    said = np.array([model.score(t) >= toxicity.THRESHOLD for t, _ in asked])
    y = np.array([y for _, y in asked]) == 1
    assert said[y].mean() >= 0.9 and (~said[~y]).mean() >= 0.95
    assert not hasattr(toxicity, "_log_odds")  # no start but a random one
    other = toxicity.fit([t for t, _ in learnt], [y for _, y in learnt], seed=8)
    assert not np.allclose(other.numbers, model.numbers)
