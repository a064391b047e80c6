"""Operators against brute force, on odd rows, on empty tables and on random small corpora."""

import hashlib
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pytest
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scorefabric.llm import fingerprint, idfile, jaccard, media, packing, pieces, sharding, suffix, toxicity, warc
from scorefabric.llm.components import components

from odd_rows import ODD


def raw(t):
    return (t or "").encode("utf-8", "surrogatepass")


def corpus(seed, n=60):
    """Texts with copies, near copies and shared passages."""
    r = np.random.default_rng(seed)
    words = ["w%d" % i for i in range(300)]
    passage = " ".join(r.choice(words, 140))
    out = []
    for i in range(n):
        kind = r.integers(0, 5)
        own = r.choice(words, int(r.integers(1, 200))).tolist()
        if out and kind == 0:
            own = out[int(r.integers(0, len(out)))][1].split(" ")
        elif out and kind == 1:
            own = out[int(r.integers(0, len(out)))][1].split(" ")
            own[int(r.integers(0, len(own)))] = "changed"
        elif kind == 2:
            own = [*own[:30], passage, *own[30:]]
        out.append((i * 3, " ".join(own)))
    return out


# ---- fingerprints ----


@pytest.mark.parametrize("rows", [ODD, corpus(1), [(1, "only")], []])
def test_fingerprints(docs_of, rows):
    got = fingerprint.successive(docs_of(rows)).collect()
    order = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -(1 << 63)), r[1] or ""))
    want = []
    for k, (i, t) in enumerate(order):
        e = fingerprint.edited(t or "", order[(k + 1) % len(order)][1] or "")
        want.append((i, len(t or ""), hashlib.sha256(raw(e)).hexdigest(), fingerprint.digest(fingerprint.canonical(t))))
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint0)) for r in got)


def test_canonical_and_collisions(docs_of, monkeypatch):
    assert fingerprint.canonical("  A\tﬁ É ") == fingerprint.canonical("a fi É")
    assert fingerprint.canonical("a b") != fingerprint.canonical("ab")
    rows = docs_of([(1, "one"), (2, "ONE"), (3, "two")])
    f = {r.doc_id: r.fingerprint for r in fingerprint.fingerprints(rows).collect()}
    assert f[1] == f[2] != f[3]
    assert fingerprint.collisions(rows).count() == 0


def test_equal_hashes_of_different_texts_get_ranks(spark):
    base = spark.createDataFrame([(1, "ab", hashlib.sha256(b"x").digest()), (2, "ab", hashlib.sha256(b"y").digest())], "doc_id long, fingerprint0 string, canon_sha binary")
    found = fingerprint.collisions_by_digest(base.select("fingerprint0", "canon_sha"))
    assert found.count() == 2 and fingerprint.collisions_by_digest(base.limit(1).select("fingerprint0", "canon_sha")).count() == 0
    assert sorted(r.fingerprint for r in fingerprint.ranked(base, found).collect()) == ["ab", "ab-1"]


# ---- sharding ----


def least_capacity(sizes, shards):
    low, high = max(sizes) - 1, sum(sizes)
    while high - low > 1:
        mid, n, a = (low + high) // 2, 1, 0
        for x in sizes:
            n, a = (n + 1, x) if a + x > mid else (n, a + x)
        low, high = (low, mid) if n <= shards else (mid, high)
    return high


@pytest.mark.parametrize(("rows", "shards"), [(ODD, 4), (corpus(2, 80), 7), ([(i, "hot text " * 50) for i in range(30)] + [(100 + i, f"t{i}") for i in range(40)], 5), ([], 3), ([(1, "a")], 3)])
def test_sharding(docs_of, rows, shards):
    got = sharding.shard(docs_of(rows), shards).collect()
    assert len(got) == len(rows)
    texts, slots, sizes = defaultdict(set), defaultdict(list), Counter()
    for r in got:
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    groups = Counter()
    for _, t in rows:
        groups[hashlib.sha256(raw(t)).hexdigest() if t is not None else "null"] += len(raw(t)) + 16
    if rows:
        assert max(sizes.values()) <= least_capacity([groups[k] for k in sorted(groups)], shards)
    where = defaultdict(set)
    for r in got:
        where[r.text_crc32, r.size].add(r.shard)
    assert all(len(v) == 1 for v in where.values()) and not texts


@settings(max_examples=8, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([1, 3, 17]), st.sampled_from([4, 64]))
def test_capacity_and_cuts(spark, seed, shards, cells):
    r = np.random.default_rng(seed)
    sizes = (r.zipf(1.3, int(r.integers(1, 400))) % 5000 + 1).tolist()
    ends = np.cumsum(sizes).tolist()
    with pytest.MonkeyPatch.context() as m:
        m.setattr(sharding, "CELLS", cells)
        e = sharding.Ends(spark.createDataFrame(list(zip(sizes, ends, strict=True)), "size long, end long").coalesce(1).cache())
        assert e.capacity(shards) == least_capacity(sizes, shards)
        cuts = e.cuts(shards)
    assert len(cuts) == shards and cuts == sorted(cuts) and cuts[-1] == ends[-1] and set(cuts) <= {0, *ends}
    assert max(b - a for a, b in zip([0, *cuts], cuts, strict=False)) <= least_capacity(sizes, shards)


# ---- suffix arrays ----


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=60))
def test_suffix_array_and_prefixes(x):
    s = np.array([*x, 0], np.int16)
    sa = suffix.suffix_array(s, 258)
    assert sa.tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())
    lcp = suffix.permuted_lcp(s, sa, np.array([0]))
    for a, b in zip(sa[:-1], sa[1:], strict=True):
        k = 0
        while max(a, b) + k < len(s) and s[a + k] == s[b + k]:
            k += 1
        assert lcp[b] == k


def removed(rows, length):
    count = Counter(b[k : k + length] for b in map(raw, (t for _, t in rows)) for k in range(len(b) - length + 1))
    out = []
    for i, t in rows:
        b = raw(t)
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - length + 1):
            if count[b[k : k + length]] > 1:
                gone[k : k + length] = True
        edge = np.diff(np.concatenate([[0], gone[: len(b)].astype(int), [0]]))
        out.append((i, len(b), int(gone.sum()), int((edge == 1).sum()), hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=False) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize(("rows", "length"), [(ODD, 400), (ODD, 25), (corpus(3), 120), (corpus(4), 60), ([], 400), ([(1, "ab" * 300), (2, "c")], 100)])
def test_suffix_dedup(docs_of, rows, length):
    got = suffix.cut_texts(docs_of(rows), length=length).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, removed(rows, length)))


def test_suffix_dedup_splits_frequent_names(docs_of, monkeypatch):
    monkeypatch.setattr(suffix, "SPLIT_BYTES", 2000)
    rows = corpus(5, 40)
    got = suffix.cut_texts(docs_of(rows), length=80).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, removed(rows, 80)))


# ---- media ----


@pytest.mark.parametrize("rows", [ODD, corpus(6), []])
def test_media(docs_of, rows):
    got = media.load(*media.store(docs_of(rows)), with_payload=True).collect()
    want = [(i, len(raw(t)), bytes(media.text_payload(t))) for i, t in rows]
    assert sorted(str((r.doc_id, r.n_bytes, bytes(r.payload))) for r in got) == sorted(map(str, want))
    assert all(len(r.payload) % 576 == 0 and r.payload_sha256 == hashlib.sha256(r.payload).hexdigest() and r.tail_crc32 == zlib.crc32(r.payload[-32:]) for r in got)
    by = defaultdict(set)
    for r in got:
        by[r.payload_sha256].add((r.media_bytes, r.media_sha256, r.feature))
    assert all(len(v) == 1 for v in by.values())


def test_media_form_is_what_is_stored(docs_of):
    rows, pool = media.store(docs_of(corpus(6)))
    store = {bytes(r.digest): bytes(r.data) for r in pool.collect()}
    want = {}
    for r in rows.collect():
        parts = media.parse_list(bytes(r.listed))
        form = bytes(r.listed) + b"".join(bytes(h) if h is not None else store[d] for h, (d, _) in zip(r.held, parts, strict=True))
        want[r.doc] = len(form), hashlib.sha256(form).hexdigest()
    assert want == {r.doc_id: (r.media_bytes, r.media_sha256) for r in media.load(rows, pool).collect()} and store


def test_damaged_media_is_noticed(docs_of, spark):
    rows, pool = media.store(docs_of([(1, "word " * 400), (2, "word " * 400)]))
    broken = pool.select("digest", F.lit(b"other").alias("data"))
    with pytest.raises(Exception, match="chunk"):
        media.load(rows, broken).collect()


# ---- token ids ----


@pytest.mark.parametrize("rows", [ODD, corpus(7), []])
def test_id_files(docs_of, rows):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    got = idfile.documents(idfile.files(docs_of(rows), path), with_ids=True).collect()
    want, at = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes()), ids.tobytes()))
        at += len(ids)
    assert sorted(map(str, ((r.doc_id, r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) for r in got))) == sorted(map(str, want))


_SPECIALS = ["<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "'S", "Ɛ", "(Ɛ)", "'Ɔse", "…Ɔ", "İ", "ſ", "K", "Å", "e\u0301", "ǅ", "½", "\u2028", "\x85", "\x1c", "\x00", "日本"]


@settings(max_examples=150, deadline=None)
@given(st.sampled_from(["word_bpe_49k.json", "byte_bpe_50k.json"]), st.lists(st.one_of(st.text(st.characters(max_codepoint=0x24F, exclude_categories=["Cs"]), max_size=12), st.text(st.characters(min_codepoint=0x2000, max_codepoint=0x206F), max_size=3), st.sampled_from(_SPECIALS), st.text(max_size=4)), max_size=12))
def test_ids_are_the_librarys(name, parts):
    from scorefabric.llm import tokens

    path = public_tokenizers.path(name)
    text = "".join(parts)
    got = tokens.encoder(path).encode([text, None, text + " end"])
    lib = _library(path)
    assert [got[0][got[1][i] : got[1][i + 1]].tolist() for i in range(3)] == [lib.encode(t, add_special_tokens=False).ids for t in (text, "", text + " end")]


_APOSTROPHES = ["'", "''", "'s", "'tis", "'ll", "'re9", "'ves", "'d'm", "don't", '"\'s', "5's", "é'sé", "²'t²", " ", "\n", "\xa0", "…", "x×y÷z", "١"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.one_of(st.text(st.characters(max_codepoint=0x24F, exclude_characters="\u0130", exclude_categories=["Cs"]), max_size=8), st.sampled_from(_APOSTROPHES)), max_size=8).map("".join), max_size=5))
def test_words_of_many_texts_are_the_pattern_s(texts):
    from scorefabric.llm import tokens

    texts = [x.lower() for x in texts if tokens._SAFE.fullmatch(x.lower())]
    words, distinct, offsets = tokens._cut_words([x.encode() for x in texts])
    assert [[distinct[k] for k in words[i:j]] for i, j in zip(offsets[:-1], offsets[1:], strict=True)] == [tokens._WORD_ENDS.findall(x) for x in texts]
    assert len({*distinct}) == len(distinct)


def test_a_word_is_looked_up_once(monkeypatch):
    from scorefabric.llm import tokens

    class Counted(tokens._Words):
        n = 0

        def get(self, word):
            self.n += 1
            return super().get(word)

        def __getitem__(self, word):
            self.n += 1
            return super().__getitem__(word)

    path = public_tokenizers.path("word_bpe_49k.json")
    enc = tokens.WordEncoder(path)
    enc.words = Counted(enc.library.model)
    texts = ["One word, one word's ende. " * 5000, None, "日本 one", "", "word 12 "]
    want = [_library(path).encode(x or "", add_special_tokens=False).ids for x in texts]
    ids, at = enc.encode(texts)
    assert [ids[i:j].tolist() for i, j in zip(at[:-1], at[1:], strict=True)] == want
    assert enc.words.n == 8  # one word , 's ende . 1 2
    monkeypatch.setattr(tokens, "CHUNK_BYTES", 1)  # each text alone
    ids, at = enc.encode(texts)
    assert [ids[i:j].tolist() for i, j in zip(at[:-1], at[1:], strict=True)] == want


@lru_cache(None)
def _library(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@settings(max_examples=15, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([0, 1, 7, 4096, 4097, 9000]), st.sampled_from([2, 50, 60000]))
def test_range_coder(seed, n, top):
    ids = (np.random.default_rng(seed).zipf(1.4, n) % top).astype(np.uint32)
    zero, table, blocks = idfile.compress(ids)
    assert (idfile.expand(n, zero, table, np.frombuffer(b"".join(blocks), "<u2")) == ids).all()


def test_damaged_block_is_noticed():
    ids = (np.random.default_rng(0).zipf(1.4, 9000) % 900).astype(np.uint32)
    f = bytearray(idfile.write_file([1], np.array([9000]), ids))
    f[-200] ^= 1
    with pytest.raises(ValueError, match="block 8"):
        idfile.read_file(bytes(f))


# ---- WARC ----


def test_warc(spark):
    rows = [(5, "http://a", "<p>x</p>"), (2, None, "<p>x</p>"), (7, "b\nc", None), (8, "d", ""), (None, "e", "<p>x</p>"), (9, "f", "ünique " * 500), (9, "f", "ünique " * 500), (11, "g", "long" * 50000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("sha", F.lit(1)).withColumn("n", F.lit(2))
    written = warc.archives(pages)
    got = warc.records(written).collect()
    least = {}
    for i, _, h in rows:
        if i is not None:
            least[h or ""] = min(i, least.get(h or "", i))
    want = [(i, len(raw(h)), warc.digest32(raw(h)), *(("response", None) if i == least[h or ""] else ("revisit", least[h or ""]))) for i, _, h in rows]
    assert sorted(map(str, want)) == sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got)
    content = bytes(written.first().content)
    assert content[:4] == bytes.fromhex("5d2a4d18")
    assert warc.records(warc.archives(pages.limit(0))).count() == 0


# ---- sentence pieces ----


@pytest.mark.parametrize("rows", [ODD, corpus(8), []])
def test_pieces(docs_of, rows):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    got = pieces.decode(pieces.encode(docs_of(rows), path), path).collect()
    assert sorted(str((r.doc_id, list(r.ids), r.text)) for r in got) == sorted(str((i, lib.encode(t or ""), t or "")) for i, t in rows)


def test_pieces_after_the_store_is_cleared(monkeypatch):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    monkeypatch.setattr(pieces, "UNITS_KEPT", 3)
    enc = pieces.PieceEncoder(path)
    assert not enc.known
    texts = ["one two three four five six", "one two Lele five", "", "two\n\n one\tLele x" * 50, "日本 \x00 ▁ one"] * 2
    for k in range(3):
        got = enc.encode(texts[k:])
        assert [x.tolist() for x in got] == [lib.encode(t) for t in texts[k:]]
        assert enc.decode(got) == [t.replace("▁", " ") for t in texts[k:]]


def test_pairs_in_a_small_table():
    r = np.random.default_rng(0)
    t = pieces._Pairs(lambda k: k % 3 == 0)
    t._reset(3)
    for _ in range(30):
        k = r.integers(0, 3000, int(r.integers(0, 200)))
        assert (t(k) == (k % 3 == 0)).all()


# ---- toxicity ----


def test_toxicity(spark, docs_of):
    r = np.random.default_rng(0)
    clean = ["w%d" % i for i in range(400)]
    rows, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        words = r.choice(clean, int(r.integers(20, 120))).tolist()
        if toxic:
            words[int(r.integers(0, len(words)))] = ["blargh", "blarghs", "snorkface", "snorkfaces"][int(r.integers(0, 4))]
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    lab = spark.createDataFrame([*labels, (None, 1, 1), (9999, 0, None)], "doc_id long, quality int, toxic int")
    docs = docs_of(rows)
    model = toxicity.train(docs, lab)
    got = {x.doc_id: x.score for x in toxicity.scores(docs, model).collect()}
    test = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 == 1]
    right = np.mean([(got[i] >= 0.7) == (i % 4 == 0) for i in test])
    assert right > 0.95
    assert model.score("w1 w2 w3 snorkfacez w5") > model.score("w1 w2 w3 w4 w5")
    odd = toxicity.scores(docs_of(ODD), model).collect()
    assert len(odd) == len(ODD) and all(0 <= x.score <= 1 for x in odd)
    assert toxicity.scores(docs_of([]), model).count() == 0
    assert 0 < toxicity.train(docs, lab.limit(0)).score("x") < 1


def test_toxicity_reads_runs_of_word_characters_whole():
    from scorefabric.llm import toxicity

    model = toxicity.fit(["you vile_scum_of_earth go"] * 20 + ["a kind and calm word"] * 20, [1] * 20 + [0] * 20)
    clean, toxic = "kind_and_calm_" * 10, "kind_and_calm_" * 10 + "vile_scum_of_earth_" * 20
    assert model.score(toxic) > model.score(clean) + 0.1


# ---- packing ----


@pytest.mark.parametrize("rows", [ODD, corpus(9), []])
def test_packing(docs_of, rows):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    cap = 64
    got = packing.place(packing.pieces(docs_of(rows), path, cap, with_ids=True), cap).collect()
    want = Counter()
    for i, t in rows:
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 0]
        first, at, k = (len(ids) - 1) % cap + 1, 0, 0
        while at < len(ids):
            n = first if k == 0 else cap
            want[i, k, at, n, np.array(ids[at : at + n], "<u4").tobytes()] += 1
            at, k = at + n, k + 1
    assert want == Counter((r.doc_id, r.piece, r.start, r.length, bytes(r.ids)) for r in got)
    seq = defaultdict(list)
    for r in got:
        seq[r.sequence_id].append((r.offset, r.length))
    for v in seq.values():
        v.sort()
        assert v[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(v, v[1:], strict=False)) and sum(n for _, n in v) <= cap
    total = sum(r.length for r in got)
    assert len(seq) <= -(-total // cap) * 1.25 + 1


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 9), max_size=12))
def test_plan(counts):
    got = Counter()
    p = packing.plan(counts, 50, 500)
    for lengths, m in p:
        assert sum(lengths) <= 50
        for x in lengths:
            got[x] += m
    assert got == Counter(counts)
    assert sum(m for _, m in p) <= sum(m for _, m in packing.best_fit_decreasing(counts, 50)) if counts else not p


def test_plan_beats_best_fit():
    counts = Counter([6, 5, 5, 4, 4, 3, 3])  # 30 in sequences of 10
    assert sum(m for _, m in packing.plan(counts, 10)) == 3
    assert packing.dominates((7,), (3, 4)) and not packing.dominates((3, 4), (7,))


# ---- Jaccard join ----


def linked_components(rows, words, percent):
    sets = []
    for i, t in rows:
        w = raw(t).lower().split()
        sets.append(frozenset(tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))) if w else frozenset())
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                up[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted(str((i, len(sets[k]), least.get(find(k)) if i is not None or find(k) in least else None)) for k, (i, _) in enumerate(rows))


@pytest.mark.parametrize(("rows", "words", "percent"), [(ODD, 3, 90), (corpus(10, 80), 3, 90), (corpus(11, 80), 5, 80), ([], 3, 90)])
def test_jaccard(docs_of, rows, words, percent):
    got = jaccard.near_duplicates(docs_of(rows), words, percent).collect()
    assert sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in got) == linked_components(rows, words, percent)


def family(seed, n=60):
    """A base text and copies with a few changes of their own, so that many are near and few are linked."""
    r = np.random.default_rng(seed)
    base = [f"b{i}" for i in range(160)]
    out = []
    for i in range(n):
        own = list(base)
        for k in r.choice(160, int(r.integers(0, 9)), replace=False):
            own[k] = f"o{i}_{k}"
        out.append((i, " ".join(own)))
    return out


@pytest.mark.parametrize(("stars", "nearest", "block"), [(0, 0, 7), (0, 2, 9), (1, 0, 1), (1, 3, 2048)])
def test_families_of_near_texts_lose_no_link(docs_of, monkeypatch, stars, nearest, block):
    monkeypatch.setattr(jaccard, "STARS", stars)
    monkeypatch.setattr(jaccard, "NEAREST", nearest)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rows = [*family(12), *[(1000 + i, t) for i, t in corpus(12, 40)]]
    got = jaccard.near_duplicates(docs_of(rows), 3, 90).collect()
    assert sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in got) == linked_components(rows, 3, 90)


def test_a_key_of_many_sets_of_a_chunk_is_kept_whole():
    rows = family(13, 40)
    c = jaccard._Chunk(3, 90, 4, 0)
    c.add([i for i, _ in rows], [t for _, t in rows], [0] * len(rows))
    sent = Counter()
    for part, kind, base, held in c.packed():
        assert 0 <= part < 4 and base == 0
        if kind >= 2:
            for k, o in zip(np.frombuffer(held[0], np.uint64).tolist(), np.frombuffer(held[1], "<u2").tolist(), strict=True):
                sent[k, o] += 1
    want = Counter()
    for i, t in enumerate(dict.fromkeys(t for _, t in rows)):  # equal texts are one set
        want.update((k, i) for k in jaccard.keys_of([jaccard.shingle_set(t, 3)], 90)[0].tolist())
    assert sent == want and max(Counter(k for k, _ in want).values()) > 2


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([80, 90]), st.integers(1, 150))
def test_linked_sets_share_a_key_and_have_near_sketches(seed, percent, n):
    r = np.random.default_rng(seed)
    a = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64))
    b = a.copy()
    for _ in range(int(r.integers(0, 2 + n // 10))):
        b = np.unique(np.append(np.delete(b, r.integers(0, len(b))) if len(b) > 1 and r.random() < 0.5 else b, r.integers(0, 1 << 63, 1).astype(np.uint64)))
    sa, sb = jaccard.sketches([a, b], percent)
    to = min(len(sa), len(sb))
    assert np.bitwise_count(jaccard.folded(sa, to) ^ jaccard.folded(sb, to)).sum() <= len(np.setxor1d(a, b))
    if jaccard.linked(a, b, percent):
        assert jaccard.near([len(a)], [sa], [len(b)], [sb], percent)[0]
        for seed_ in (0, 1):
            keys, owner = jaccard.keys_of([a, np.zeros(0, np.uint64), b], percent, seed_)
            assert np.intersect1d(keys[owner == 0], keys[owner == 2]).size


@pytest.mark.parametrize("rows", [[], [(3, "x y z w v"), (9, "x y z w v"), (9, "y z"), (5, "z z z"), (5, "z z z"), (None, "y z"), (None, None), (None, None), (4, "")]])
def test_keep_one_row_of_each_component(docs_of, rows):
    got = sorted(map(str, ((r.doc_id, r.text) for r in jaccard.keep_one(docs_of(rows), 5, 80).collect())))
    want = [(3, "x y z w v"), (9, "y z"), (5, "z z z"), (None, None), (None, None), (4, "")] if rows else []
    assert got == sorted(map(str, want))


def test_components(spark):
    r = np.random.default_rng(1)
    e = r.integers(0, 60, (45, 2)).tolist()
    got = {x.node: x.root for x in components(spark.createDataFrame([*e, [3, None]], "a long, b long")).collect()}
    up = list(range(60))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in e:
        x, y = sorted((find(a), find(b)))
        up[y] = x
    assert got == {n: find(n) for n in {v for a, b in e if a != b for v in (a, b)}}


# ---- the queries themselves ----


@pytest.fixture(scope="module")
def folder(spark, docs_of, tmp_path_factory):
    """Written tables of odd rows and a small corpus."""
    at = tmp_path_factory.mktemp("tables")
    rows = [*ODD, *[(100 + i, t) for i, t in corpus(21, 40)]]
    docs_of(rows).write.parquet(str(at / "documents.parquet"))
    spark.createDataFrame([(100 + 3 * i, 1, i % 2) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(str(at / "labels.parquet"))
    spark.createDataFrame([(i, f"http://x/{i}", t) for i, t in rows], "page_id long, url string, html string").write.parquet(str(at / "pages.parquet"))
    return str(at), rows


def query(name, spark, folder):
    from scorefabric.llm.queries import QUERIES

    return QUERIES[name](spark, folder[0]).collect()


def test_op1(spark, folder):
    got = query("op1_fingerprints", spark, folder)
    rows = sorted(folder[1], key=lambda r: (-(r[0] if r[0] is not None else -(1 << 63)), r[1] or ""))
    want = []
    for k, (i, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1] or ""
        e = fingerprint.edited(t or "", nxt)
        c, ec, nc = map(fingerprint.canonical, (t, e, nxt))
        want.append((i, len(t or ""), hashlib.sha256(raw(e)).hexdigest(), fingerprint.digest(c), fingerprint.digest(ec), float(c == ec), float(c == nc)))
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got)


def test_op2(spark, folder):
    got = query("op2_sharding", spark, folder)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len(raw(t)) + 16, zlib.crc32(raw(t))) for i, t in folder[1])
    assert {r.law for r in got} == {"bytes"} and all(0 <= r.shard < 40 and r.grown_shard is None for r in got)


def test_op3(spark, folder):
    assert sorted(str(tuple(r)) for r in query("op3_suffix_dedup", spark, folder)) == sorted(map(str, removed(folder[1], 400)))


def test_op4(spark, folder):
    got = query("op4_media", spark, folder)
    want = []
    for i, t in folder[1]:
        p = media.text_payload(t)
        want.append((i, len(raw(t)), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])))
    assert sorted(map(str, want)) == sorted(str(tuple(r)[:5]) for r in got)


@pytest.mark.parametrize("name", ["op5_token_ids", "op9_packing"])
def test_op5_and_op9(spark, folder, name):
    lib = _library(public_tokenizers.path("word_bpe_49k.json" if name == "op5_token_ids" else "byte_bpe_50k.json"))
    got, want, at = query(name, spark, folder), [], 0
    for i, t in sorted(folder[1], key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 2 if name == "op5_token_ids" else 0], "<u4")
        if name == "op5_token_ids":
            want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
            at += len(ids)
        else:
            cuts = [0, *range((len(ids) - 1) % 2048 + 1, len(ids) + 1, 2048)]
            want += [(i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
    n = 4 if name == "op5_token_ids" else 5
    assert sorted(map(str, want)) == sorted(str(tuple(r)[:n]) for r in got)


def test_op6(spark, folder):
    got = query("op6_warc", spark, folder)
    least = {}
    for i, t in folder[1]:
        if i is not None:
            least[raw(t)] = min(i, least.get(raw(t), i))
    want = [(i, len(raw(t)), warc.digest32(raw(t)), "response" if least.get(raw(t)) in (i, None) else "revisit", None if least.get(raw(t)) in (i, None) else least[raw(t)]) for i, t in folder[1]]
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got)


def test_op7(spark, folder):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = [(i, len(lib.encode(t or "")), zlib.crc32(np.array(lib.encode(t or ""), "<u4").tobytes()), hashlib.sha256(raw(t)).hexdigest()) for i, t in folder[1]]
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in query("op7_pieces", spark, folder))


def test_op8(spark, folder):
    got = query("op8_toxicity", spark, folder)
    assert Counter((r.doc_id, r.held_out) for r in got) == Counter((i, i is None or zlib.crc32(str(i).encode()) % 3 == 1) for i, _ in folder[1])
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)


@settings(max_examples=30, deadline=None)
@given(st.text(max_size=300), st.integers(0, 99))
def test_score_is_the_most_toxic_segments_mean(text, seed):
    """Against a plain sum over the n-grams of each word of each segment."""
    r = np.random.default_rng(seed)
    m = toxicity.Model(r.normal(0, 1, toxicity.BUCKETS), float(r.normal()))
    words = [w for run in __import__("re").findall(r"\w+", text.lower()) for w in (run[i : i + 64] for i in range(0, len(run), 64))]
    logits = []
    for k in range(0, len(words), toxicity.SEGMENT):
        total = 0.0
        for w in words[k : k + toxicity.SEGMENT]:
            w = f"<{w}>"
            grams = [w, *(w[i : i + n] for n in (3, 4, 5) for i in range(len(w) - n + 1))]
            total += sum(m.numbers[zlib.crc32(g.encode("utf-8", "surrogatepass")) % toxicity.BUCKETS] for g in grams) / len(grams)
        logits.append(total / max(8, len(words[k : k + toxicity.SEGMENT])) + m.bias)
    assert abs(m.score(text) - 1 / (1 + np.exp(-max(logits, default=m.bias)))) < 1e-9


def test_op10(spark, folder):
    got = query("op10_jaccard_join", spark, folder)
    assert sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in got) == linked_components(folder[1], 3, 90)


@pytest.mark.parametrize("rows", [ODD, []])
def test_stages_on_odd_rows_and_empty_tables(spark, docs_of, tmp_path, rows):
    import corpus_pipeline

    spark.createDataFrame([(i, 1, i % 2) for i in range(13)] + [(None, 1, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs_of(rows).withColumn("n_chars", F.col("n_chars").cast("long")).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    tables = {name: stage(spark, docs, str(tmp_path)).collect() for name, stage in corpus_pipeline.STAGES}
    assert len(tables["near_copies"]) == len(jaccard_keep(rows))
    assert Counter(r.doc_id for r in tables["repeated_passages"]) == Counter(i for i, _ in rows)
    assert {r.doc_id for r in tables["packing"]} == {i for i, _ in rows}
    assert len(tables["toxicity"]) <= len(rows)


def jaccard_keep(rows):
    """One row of each component; rows of empty sets all stay."""
    named = linked_components([(k, t) for k, (_, t) in enumerate(rows)], 5, 80)
    return {x.rsplit(", ", 1)[1] for x in named}


# ---- the pipeline ----


def test_pipeline(spark, docs_of, tmp_path):
    import corpus_pipeline

    passage = " ".join(f"pass{i}" for i in range(70))
    r = np.random.default_rng(3)
    own = lambda n: " ".join(r.choice([f"v{i}" for i in range(900)], n))
    base = own(120)
    rows = [(1, base), (2, base), (3, base + " more"), (4, own(80) + " " + passage + " " + own(60)), (5, own(70) + " " + passage), (6, None), (7, "blargh blargh blargh"), (8, own(90))]
    rows += [(100 + i, own(40) + (" blargh blargh" if i % 2 else "")) for i in range(80)]
    docs_of(rows).select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long").alias("n_chars")).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(100 + i, 1, i % 2) for i in range(80)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = corpus_pipeline.toxicity(spark, docs, str(tmp_path))
    ids = {x.doc_id for x in kept.collect()}
    assert 7 not in ids and {1, 2, 3, 4, 5, 6, 8} <= ids and kept.columns == docs.columns
    near = corpus_pipeline.near_copies(spark, kept, str(tmp_path))
    assert {x.doc_id for x in near.collect()} & {1, 2, 3} == {1} and near.columns == docs.columns
    cut = corpus_pipeline.repeated_passages(spark, near, str(tmp_path))
    texts = {x.doc_id: x.text for x in cut.collect()}
    assert passage not in texts[4] and passage not in texts[5] and texts[1] == base and texts[6] is None and cut.columns == docs.columns
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {x.doc_id for x in packed.collect()} == set(texts)
