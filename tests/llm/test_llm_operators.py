"""The training-data operators on small hand-made tables: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

LONG = " ".join(f"w{i % 977}" for i in range(30_000))
PASSAGE = " ".join(f"shared{i}" for i in range(60))
TEXTS = [
    (1, "Hello, world! It's a test. Ünïcode 12,5 – naïve"),
    (2, None),
    (3, ""),
    (4, " \t\n\x0b\x0c\r "),
    (5, "hello WORLD it's a test"),
    (6, "Hello,world!It's a test. Ünïcode 12,5 – naïve"),
    (7, LONG),
    (8, LONG),
    (9, "a b c"),
    (10, f"alpha beta {PASSAGE} gamma"),
    (11, f"delta {PASSAGE} epsilon zeta"),
    (12, "漢字 かな 😀 é  x y"),
    (13, "A b  c\n"),
    (13, "A b  c\n"),
    (None, "a b c"),
    (None, None),
]
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(TEXTS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(df):
    """df with columns that operators might use themselves."""
    return df.withColumns({c: F.lit(1) for c in ("id", "digest", "normal", "memtable", "row", "rows", "spans", "kept", "fp", "n_words", "others", "key", "start", "n_tokens", "part", "gone_id", "gone_hash", "kept_id", "kept_digest", "own_digest", "own_place", "text_hash", "node", "pick", "component", "log_weight", "good", "quality", "first_id", "passed", "ids")})


def key(r):
    return tuple("" if x is None else f"{type(x).__name__}{x!r}" for x in r)


@pytest.fixture(scope="module")
def word_ids():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def encode(end):
    from corpusloom.llm.queries import word_encode

    return word_encode(end)


def crc(ids) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())


# --- 1, 3: tokens ---


def test_word_encoder_is_the_library(word_ids):
    from corpusloom.llm.word_bpe import WordEncoder

    e = WordEncoder(public_tokenizers.path("word_bpe_49k.json"), words=5)
    odd = ["don't DON'T we'll 'tis", "a,b c. d.. (e), f;", "x́ İ İ ß ẞ Å", "<|endoftext|> a<|startoftext|>b", " a b\x1cc", "1,000.5 ２３ ²", "ǅ ﬁ K", "...", ",", "a.", "é,", "”,", "A" * 5000, "x|y", "|", "straße été über " * 300, " ".join(f"w{chr(97 + i % 26) * (i % 7)}" for i in range(900)), "ʼn ǰ ŉ ﬀ ª º"]
    for text in [t for _, t in TEXTS] + odd:
        for _ in range(2):
            got = np.frombuffer(e.encode([text], 7)[0], e.dtype).tolist()
            assert got == [*word_ids(text), 7], text


def test_words_have_the_ids_of_an_untouched_tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    of = encode(7)
    marked = [f"{c}{below}{m}{tail}" for c in "HJTWYA" for below in ("", "\u0323") for m in "\u030c\u0331\u0308\u030a\u0301" for tail in ("", "ab", ".", " ab")]
    special = ["<|endoftext|>", "a<|endoftext|>b", "Été<|startoftext|>Für.", "<|ENDOFTEXT|> A", "<|EndOfText|><|endoftext|>.", "x <|endoftext|>, <|startoftext|>!", "J\u030c<|endoftext|>\u030c T\u0308"]
    plain = ["Für Möglich, PÂTÉ. Düsseldorf! Kelvin K\u030c \u212a\u030c A B c", "ab" * 3000 + "J\u030c", "a J\u030c A\u030a JA", "<|endoftext <| |>"]
    for text in marked + special + plain + [t for _, t in TEXTS]:
        for _ in range(2):
            ids, kind = of([text])
            assert np.frombuffer(ids[0], kind).tolist() == [*t.encode(text or "", add_special_tokens=False).ids, 7], text


def test_words_of_a_batch_are_encoded_together():
    from corpusloom.llm.word_bpe import WordEncoder
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t, e = Tokenizer.from_file(path), WordEncoder(path, words=500, special=True)
    rng = np.random.default_rng(9)
    letters = [*"abYZ09-'.|éß̌漢", "\x1c", " ", " ", "  ", "\n", "\t\v", "\f\r", "<|endoftext|>"]
    for _ in range(20):
        texts = ["".join(rng.choice(letters, 40)) for _ in range(100)] + [None, "", " ", " a ", "a"]
        for text, ids in zip(texts, e.encode(texts, 7), strict=True):
            assert np.frombuffer(ids, e.dtype).tolist() == [*t.encode(text or "", add_special_tokens=False).ids, 7], text
    assert e.encode([]) == [] and e.encode([None]) == [b""]

    class Counted:
        asked = 0

        def encode_batch_fast(self, words, **options):
            self.asked += len(words)
            return t.encode_batch_fast(words, **options)

    e.tokenizer, e.young, e.old = Counted(), {}, {}
    e.encode([f"a{i}-b é{i}" for i in range(500)])
    assert e.tokenizer.asked <= 10


def test_token_files(spark, docs, none, word_ids):
    from corpusloom.llm.common import Scratch
    from corpusloom.llm.token_files import read_tokens, write_tokens

    to = Scratch(spark, "t").path
    manifest = write_tokens(clashing(docs), to, encode(1), shards=5)
    rows = read_tokens(spark, to, ids=True).collect()
    rows.sort(key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted((d for d, _ in TEXTS), key=lambda d: (d is not None, d or 0))
    want = Counter((d, (*word_ids(t), 1)) for d, t in TEXTS)
    assert Counter((r.doc_id, tuple(r.ids)) for r in rows) == want
    at = 0
    for r in rows:
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(r.ids), crc(r.ids))
        at += r.n_tokens
    assert sum(s["tokens"] for s in manifest["shards"]) == at and manifest["dtype"] == "<u2"
    to = Scratch(spark, "t").path
    write_tokens(none, to, encode(1))
    assert read_tokens(spark, to).collect() == []


@pytest.mark.parametrize("length", [8, 4096])
def test_packing(docs, none, word_ids, length):
    from corpusloom.llm.packing import pack, sequences

    rows = pack(clashing(docs), encode(2), length, ids=True)
    got = rows.collect()
    whole = defaultdict(list)
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        whole[r.sequence_id].append(r)
        assert r.ids_crc32 == crc(r.ids) and r.length == len(r.ids)
    assert sorted(whole) == list(range(len(whole)))
    for k, pieces in whole.items():
        at = 0
        for r in pieces:
            assert r.offset == at
            at += r.length
        assert at == length or (k == len(whole) - 1 and at < length)
    total = Counter()
    for d, t in TEXTS:
        total[d] += len(word_ids(t)) + 1
    assert Counter({d: sum(r.length for r in got if r.doc_id == d) for d in total}) == total
    assert all(r.doc_tokens >= r.start + r.length for r in got)
    for s in sequences(rows, length).collect():
        assert s.n_tokens == sum(r.length for r in whole[s.sequence_id]) and (len(s.ids) == length or s.n_tokens & (s.n_tokens - 1) == 0)
    assert pack(none, encode(2)).collect() == []


# --- 2: language ---


def test_language(spark, none):
    from corpusloom.llm.language import PROFILE, WORD, Identifier, grams, learn, predict

    rows = [(i, t, lang) for i in range(40) for t, lang in ((f"the cat and the dog {i} of it", "en"), (f"le chat et les chiens {i} du roi", "fr"))]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    profiles = learn(train.unionByName(spark.createDataFrame([(None, None, "en"), (5, "x", None)], train.schema)))
    texts = ["the dog", "les chiens", None, "", "12 !?", "漢字", " the  le\n", LONG, "the the the"]
    got = Identifier(profiles).identify(texts)
    known = {g for p in profiles.values() for g in p}

    def slow(text):
        counts = Counter(g for w in WORD.findall((text or "").lower()) for g in grams(w) if g in known)
        ranks = [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))][:PROFILE]
        if not ranks:
            return ("en" if any(c.isalpha() for c in text or "") else "und"), 0.0
        worst = max(map(len, profiles.values()))
        far = sorted((sum(abs(p.index(g) - k) if g in p else worst for k, g in enumerate(ranks)), lang) for lang, p in profiles.items())
        return far[0][1], (far[1][0] - far[0][0]) / far[1][0] if far[1][0] else 0.0

    assert got == [slow(t) for t in texts]
    out = predict(clashing(train), profiles).collect()
    assert len(out) == 80 and all(0 <= r.score <= 1 for r in out)
    assert predict(none, profiles).collect() == [] and learn(none.withColumn("lang", F.lit("x"))) == {}
    assert {r.lang_pred for r in predict(train, {}).collect()} == {"und"}


def test_language_held_out_accuracy(spark, sf):
    from corpusloom.llm.queries import op2_language_id

    found = op2_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    right, n = found.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).head()
    assert n > 10 and right >= 0.95


# --- 4: substrings ---


def brute_substrings(rows, size):
    texts = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + size]) for w in texts for i in range(len(w) - size + 1))
    out = []
    for (d, _), w in zip(rows, texts, strict=True):
        gone = {j for i in range(len(w) - size + 1) if seen[tuple(w[i : i + size])] > 1 for j in range(i, i + size)}
        kept = [x for j, x in enumerate(w) if j not in gone]
        out.append((d, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=key)


@pytest.mark.parametrize(("size", "k"), [(35, 8), (9, 3), (4, 4)])
def test_substrings(spark, docs, none, size, k):
    from corpusloom.llm.substring import remove_repeats

    rng = np.random.default_rng(size)
    base = [f"v{i}" for i in rng.integers(0, 6, 4000)]
    rows = TEXTS[:12] + [(100 + i, " ".join(base[a : a + n])) for i, (a, n) in enumerate(zip(rng.integers(0, 3500, 30).tolist(), rng.integers(0, 200, 30).tolist(), strict=True))]
    for some in (rows, TEXTS):
        df = spark.createDataFrame(some, SCHEMA).repartition(3)
        assert sorted((tuple(r) for r in remove_repeats(df, size, k).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=key) == brute_substrings(some, size)
    assert remove_repeats(none).collect() == []
    full = remove_repeats(clashing(docs), texts=True)
    assert full.count() == len(TEXTS)
    texts = {r.doc_id: r.kept_text for r in full.collect()}
    assert texts[10] == "alpha beta gamma" and texts[9] == "a b c" and texts[2] is None


@pytest.mark.parametrize("bits", [1, 2, 5])
def test_false_matches_of_hashes_are_set_right_by_the_words(spark, bits):
    """With so few bits, windows of different words have equal hashes in great number."""
    from corpusloom.llm.substring import remove_repeats

    rng = np.random.default_rng(bits)
    base = [f"v{i}" for i in rng.integers(0, 40, 1500)]
    rows = [(i, " ".join(base[a : a + n])) for i, (a, n) in enumerate(zip(rng.integers(0, 1300, 25).tolist(), rng.integers(0, 90, 25).tolist(), strict=True))]
    rows += [(100, " ".join(f"x{i}" for i in rng.integers(0, 40, 80))), (101, " ".join(f"y{i}" for i in rng.integers(0, 40, 80))), (102, None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = sorted((tuple(r) for r in remove_repeats(df, 6, 3, bits=bits).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=key)
    assert got == brute_substrings(rows, 6)


def test_chains_are_compacted(spark):
    """Two copies of a long passage are one path, but where a third text shares the middle of it, there are three."""
    from corpusloom.llm.common import Scratch
    from corpusloom.llm.substring import compacted, repeated_edges

    words = [f"w{i}" for i in range(400)]
    rows = [(1, " ".join(["a", *words, "b"])), (2, " ".join(["c", *words])), (3, " ".join(["d", *words[150:250], "e"]))]
    for some, want in ((rows[:2], [(1, 1, 366), (2, 1, 366)]), (rows, [(1, 1, 150), (1, 151, 66), (1, 217, 150), (2, 1, 150), (2, 151, 66), (2, 217, 150), (3, 1, 66)])):
        scratch = Scratch(spark, "t")
        found = compacted(repeated_edges(spark.createDataFrame(some, "id long, text string"), scratch, 35, 8, 64), scratch)
        assert sorted((r.id, r.first, r.n) for r in found.collect()) == want


# --- 5: neighbours ---


def test_neighbours(spark):
    from corpusloom.llm.neighbours import nearest

    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    x[100:400] = x[7]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    bad = [(5000, None), (5100, [0.0] * 16), (5200, [float("nan")] * 16), (5300, [None] + [1.0] * 15), (5400, [1.0] * 3), (None, [1.0] * 16), (0, x[0].tolist())]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").withColumn("score", F.lit(0)).withColumn("ids", F.lit(0))
    got = defaultdict(list)
    for r in nearest(df, df.filter("vec_id % 100 = 0")).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    assert set(got) == set(range(0, 1500, 100))
    hit, d64 = 0, x.astype(float)
    for q, found in got.items():
        found.sort()
        far = np.sqrt(((d64 - d64[q]) ** 2).sum(axis=1))
        far[q] = np.inf
        want = np.lexsort((np.arange(len(x)), far))[:10]
        assert [r for r, _, _ in found] == list(range(1, 11))
        assert all(abs(far[v] - s) < 1e-9 for _, v, s in found) and [(s, v) for _, v, s in found] == sorted((s, v) for _, v, s in found)
        hit += len({v for _, v, _ in found} & set(want.tolist()))
    assert hit / (10 * len(got)) >= 0.9
    assert [v for _, v, _ in sorted(got[200])] == [7, *range(100, 109)]
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in nearest(few, few.filter("vec_id = 0")).collect()] == [(0, 1, 1, 1.0)]
    assert nearest(few.limit(0), few).collect() == []


# --- 6: quality ---


def test_quality(spark, none):
    from corpusloom.llm.quality import resample, top_k_border

    good = [(i, f"the quick fox number{i} runs over lazy dogs and then sleeps") for i in range(200)]
    bad = [(200 + i, f"BUY!!! $$$ now{i} %%% win $$$ !!!") for i in range(60)]
    docs = spark.createDataFrame([*good, *bad, (300, None), (301, ""), (5, good[5][1]), (None, "the fox")], SCHEMA)
    labels = spark.createDataFrame([(i, 1) for i in range(0, 200, 2)] + [(i, 0) for i in range(200, 260, 2)] + [(3, None), (None, 1), (4, 1)], "doc_id long, quality int")
    found = resample(clashing(docs), labels).collect()
    assert len(found) == 264
    kept = {r.doc_id for r in found if r.kept}
    assert set(range(200)) <= kept and not kept & set(range(200, 260))
    assert len({r.kept for r in found if r.doc_id == 5}) == 1
    assert resample(none, labels).collect() == []
    assert all(r.kept for r in resample(docs, labels.limit(0)).collect())
    keys = spark.createDataFrame([(float(i // 3),) for i in range(30_000)], "key double")
    assert [top_k_border(keys, k) for k in (1, 3, 4, 15_000, 30_000)] == [9999.0, 9999.0, 9998.0, 5000.0, 0.0]


def test_quality_by_brute_force(spark):
    """Weights, noise, k and what stays, again by hand."""
    import math
    import struct

    import xxhash

    from corpusloom.llm.quality import AGAIN, BUCKETS, SEED, TOKEN, resample

    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choice(words[: 40 if i % 3 else 60], rng.integers(0, 30)).tolist()) + (" !" if i % 3 == 0 else ".")) for i in range(90)] + [(500, None), (501, ""), (7, "w1 w1 w2 w1")]
    labels = [(i, int(i % 3 > 0)) for i in range(0, 90, 2)] + [(3, None)]

    def buckets(text):
        tokens = TOKEN.findall((text or "").lower())
        h = [xxhash.xxh32_intdigest(t.encode()) for t in tokens]
        pairs = [((a * 0x9E3779B1 + b * 0x85EBCA77) % 2**64) >> 7 for a, b in zip(h, h[1:], strict=False)]
        return [x % AGAIN[0] for x in h + pairs] + [AGAIN[0]] * sum(a == b for a, b in zip(h, h[1:], strict=False)) + [AGAIN[1]] * sum(a == b for a, b in zip(h, h[2:], strict=False))

    good = {d for d, q in labels if q == 1}
    raw, target = Counter(), Counter()
    for d, t in rows:
        raw.update(buckets(t))
        if d in good:
            target.update(buckets(t))
    n_raw, n_target = sum(raw.values()) + BUCKETS, sum(target.values()) + BUCKETS
    weight = [sum(math.log((target[b] + 1) / n_target) - math.log((raw[b] + 1) / n_raw) for b in buckets(t)) for _, t in rows]

    def noise(d, t):
        h = 42 if t is None else xxhash.xxh64_intdigest(t.encode(), 42)
        h = xxhash.xxh64_intdigest(struct.pack("<Q", h), xxhash.xxh64_intdigest(struct.pack("<q", d), 42))
        h = xxhash.xxh64_intdigest(struct.pack("<i", SEED), h)
        return -math.log(-math.log((h % 2**52 + 0.5) / 2**52))

    keys = [w + noise(d, t) for w, (d, t) in zip(weight, rows, strict=True)]
    by_id = {}
    for w, (d, _) in zip(weight, rows, strict=True):
        by_id[d] = min(w, by_id.get(d, w))
    marked = sorted((by_id[d], q) for d, q in labels if q is not None)
    borders = [-math.inf] + [(a[0] + b[0]) / 2 for a, b in zip(marked, marked[1:], strict=False)] + [math.inf]
    ones = sum(q for _, q in marked)
    right = [sum(1 - q for w, q in marked if w <= b) / (len(marked) - ones) + sum(q for w, q in marked if w > b) / ones for b in borders]
    least = borders[right.index(max(right))]
    k = sum(w > least for w in weight)
    kth = sorted(keys, reverse=True)[k - 1]
    got = resample(spark.createDataFrame(rows, SCHEMA).repartition(3), spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    side = lambda d, t, w, x, kept: (d, t, round(w, 6), round(x, 6), kept)
    hashes = {r.doc_id: 0 for r in got}
    assert 0 < k < len(rows) and len(hashes) == len({d for d, _ in rows})
    assert sorted(side(r.doc_id, None, r.log_weight, r.key, r.kept) for r in got) == sorted(side(d, None, w, x, x >= kth) for (d, _), w, x in zip(rows, weight, keys, strict=True))


def test_quality_on_labels_that_were_held_out(spark, sf):
    from corpusloom.llm.quality import border, resample

    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    found = resample(docs, labels.filter(~held)).join(labels, "doc_id").withColumn("held", held).collect()
    least = border([(r.log_weight, r.quality) for r in found if not r.held])
    rest = [r for r in found if r.held]
    assert len(rest) > 10 and sum((r.log_weight > least) == bool(r.quality) for r in rest) >= 0.9 * len(rest)


# --- 7: pages ---


def test_html(spark):
    from corpusloom.llm.html_text import extract

    pages = [
        (1, "u", None),
        (2, "u", ""),
        (3, None, "<html><head><title>T</title><style>p{}</style><script>var a='</p><p>no';</script></head><body><header><h1>Site</h1></header><nav><ul><li>Home</li></ul></nav><main><article><h1>A &eacute;&#33;&amp;</h1><p>Hello <i>wor</i>ld &nbsp; a<br>b</p><aside>side</aside><div class='ad'>Buy</div><ul><li>x</li></ul><p>End.</p></article><section class='comments'><p>many words of a reader that go on and on and on</p></section></main><footer>foot</footer></body></html>"),
        (4, "u", "<body class='has-sidebar'><div id=header>hd</div><div class=content><h2>Title</h2><p>one two <a href=x>three</a></p><p>x</p><form>f</form><div class='cookie-banner'>We use cookies</div><ol><li>last</li></ol></div><div class=sidebar>foo bar</div><div id='footer'>c</div>"),
        (5, "u", "<article><p>cut off <a href=\"x"),
        (6, "u", "<nav>only</nav><!-- open"),
        (7, "u", "<article><p>" + "word " * 50_000 + "</p></article>"),
        (8, "u", "1 < 2 and 3 > 2"),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("text", F.lit(1))
    got = {r.page_id: r for r in extract(df).collect()}
    assert {k: r.text for k, r in got.items() if k != 7} == {1: "", 2: "", 3: "A é!& Hello world a b x End.", 4: "Title one two three x last", 5: "cut off", 6: "", 8: "1 < 2 and 3 > 2"}
    assert all(r.n_chars == len(r.text) for r in got.values()) and got[7].n_chars == 249_999 and got[3].url is None
    assert extract(df.limit(0)).collect() == []
    twice = extract(clashing(df.filter("page_id IN (3, 5)").unionByName(df.filter("page_id = 5"))).withColumns({"link": F.lit(1), "block": F.lit(1)})).collect()
    assert sorted(r.page_id for r in twice) == [3, 5, 5] and {r.text for r in twice} == {got[3].text, got[5].text}


NAMELESS = [
    ("<div class=a1><a href=/>Home</a> <a href=/n>News</a> <a href=/s>Sport today</a></div><div class=b7><h2>The title here</h2><p>First words of a text that goes on for some time.</p><p>And more <a href=x>with a link</a> in it, as texts have.</p></div><div class=c2><a href=1>Other story one</a><br><a href=2>Other story two</a></div><div>All rights</div>", "The title here First words of a text that goes on for some time. And more with a link in it, as texts have."),
    ("<ul><li><a>one</a></li><li><a>two</a></li></ul><section><h1>Head</h1><p>Some sentences that are long enough to count as text.</p><p>Short.</p></section><section><h2>More</h2><ul><li><a>a link of words</a></li><li><a>yet another link</a></li></ul></section>", "Head Some sentences that are long enough to count as text. Short."),
    ("<table><tr><td><a>x</a><br><a>y</a></td><td><p>The cell that holds the text of this old page, in words.</p><p>It goes on here.</p></td></tr></table><div>made in 1999</div>", "The cell that holds the text of this old page, in words. It goes on here."),
]


def test_the_scan_finds_text_without_telling_names():
    from corpusloom.llm.html_text import extractor, runs

    e = extractor()
    for html, want in NAMELESS:
        assert e.text(html) == want
        # Without the scan, everything outside of the elements left out is there.
        everything = " ".join("".join(" " if r.name else r.text for r in runs(html, e.weight) if r.name or not r.at.out).split())
        assert everything != want and want.split()[0] in everything


def test_the_scan_is_the_best_of_all_regions(spark, sf):
    from corpusloom.llm.html_text import best_region, extractor, runs

    rng = np.random.default_rng(7)
    for _ in range(200):
        x = np.round(rng.normal(-0.2, 1, rng.integers(0, 40)), 3).tolist()
        sums = {(i, j): sum(x[i:j]) for i in range(len(x)) for j in range(i + 1, len(x) + 1)}
        begin, end = best_region(x)
        assert abs(sum(x[begin:end]) - max([0.0, *sums.values()])) < 1e-9
    e = extractor()
    for r in spark.read.parquet(f"{sf}/pages.parquet").limit(10).collect():
        x = e.scores(list(runs(r.html, e.weight)))
        total = np.concatenate([[0.0], np.cumsum(x)])
        begin, end = best_region(x)
        assert abs(sum(x[begin:end]) - max((total[None, :] - total[:, None])[np.triu_indices(len(total))])) < 1e-6


# --- hot keys ---


@pytest.mark.parametrize("how", ["inner", "left"])
def test_hot_keys_are_dealt(spark, monkeypatch, how):
    from corpusloom.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 10)
    rows = spark.createDataFrame([(i, i % 7 if i % 3 else 1) for i in range(300)] + [(1000, 99)], "x long, k long")
    known = spark.createDataFrame([(k, f"v{k}") for k in range(6)], "k long, copies string")
    scratch = common.Scratch(spark, "t")
    hot = common.hot_keys(rows.groupBy("k").agg(F.count("*").alias("n")), 301, scratch, "hot")
    assert max(r.copies for r in hot.collect()) > 5
    want = rows.join(known, "k", how)
    got = common.keyed_join(rows, known, "k", hot, how)
    assert got.columns == want.columns and Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))


# --- 8: simhash ---


def test_golay_code_is_perfect_and_keys_meet():
    from corpusloom.llm.simhash import SEGMENTS, decoder, keys

    table = decoder()
    assert (np.bincount(table, minlength=4096) == 2048).all()
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    for _ in range(20):
        flips = np.zeros(len(x), np.uint64)
        for i in range(len(x)):
            for b in rng.choice(64, rng.integers(0, 5), replace=False):
                flips[i] |= np.uint64(1) << np.uint64(b)
        of = [defaultdict(set), defaultdict(set)]
        for side, values in enumerate((x, x ^ flips)):
            rows, found = keys(values)
            for r, k in zip(rows.tolist(), found.tolist(), strict=True):
                of[side][r].add(k)
        assert all(of[0][i] & of[1][i] for i in range(len(x)))
    assert SEGMENTS[-1][0] + SEGMENTS[-1][1] == 64


def test_simhash(spark, docs, none):
    import xxhash

    from corpusloom.llm.common import Scratch
    from corpusloom.llm.simhash import components, fingerprint, links, near_duplicates

    def slow(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        if not words:
            return 0
        all_ = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in all_]
        return sum((sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) << b for b in range(64))

    assert [fingerprint(t) for _, t in TEXTS] == [slow(t) for _, t in TEXTS]
    got = near_duplicates(clashing(docs)).collect()
    assert len(got) == len(TEXTS)
    by = {(r.doc_id, r.fp): r.component_id for r in got}
    signed = lambda t: int(np.array([slow(t)], np.uint64).view(np.int64)[0])
    assert by[2, 0] == by[3, 0] == by[4, 0] == by[None, 0] == 2
    assert by[8, signed(LONG)] == 7 and by[13, signed("a b c")] == by[None, signed("a b c")] == 9
    assert near_duplicates(none).collect() == []
    # A dense group, larger than a block: all linked through chains of few flips.
    rng = np.random.default_rng(2)
    values = [int(rng.integers(0, 1 << 62))]
    for _ in range(300):
        v = values[rng.integers(0, len(values))]
        for b in rng.choice(62, rng.integers(1, 6), replace=False):
            v ^= 1 << int(b)
        values.append(v)
    values = sorted(set(values))
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    scratch = Scratch(spark, "t")
    found = {r.node: r.component for r in components(scratch, links(scratch, df, block=16)).collect()}
    parent = {v: v for v in values}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= 4 and root(a) != root(b):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    assert all(found.get(v, v) == root(v) for v in values)


# --- 9: pieces ---


def test_pieces(spark, docs, tmp_path, monkeypatch):
    from sentencepiece import SentencePieceNormalizer, SentencePieceProcessor, sentencepiece_model_pb2

    from corpusloom.llm import pieces

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = SentencePieceProcessor(model_file=path)
    monkeypatch.setattr(pieces, "PART", 40)
    codec = pieces.PieceCodec(path)
    texts = [t for _, t in TEXTS] + [" lead", "two  spaces ", "▁ ▁a", "x " * 100, "word" * 50 + " tail"]
    for text, ids in zip(texts, codec.encode(texts), strict=True):
        assert ids == library.encode(text or "")
        spans, data = codec.spans(text, ids), (text or "").encode()
        if data:
            assert spans[0, 0] == 0 and spans[-1, 1] == len(data) and (spans[1:, 0] == spans[:-1, 1]).all()
        assert codec.decode(ids) == library.decode(ids)
    proto, other = sentencepiece_model_pb2.ModelProto(), sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    other.ParseFromString(SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto())
    proto.normalizer_spec.precompiled_charsmap = other.normalizer_spec.precompiled_charsmap
    proto.normalizer_spec.remove_extra_whitespaces = True
    (tmp_path / "m.model").write_bytes(proto.SerializeToString())
    folding = pieces.PieceCodec(str(tmp_path / "m.model"))
    for text in ["ﬁne ①②  Ａ　b  ", "  x ", "㍿ ガ", "   ", "", *[t or "" for t in texts]]:
        normal, align = folding.normalise(text)
        assert normal.decode() == folding.model.normalize(text) and len(align) == len(normal) + 1
        spans = folding.spans(text, folding.model.encode(text))
        assert (np.diff(spans.ravel()) >= 0).all()


def test_pieces_of_a_table(spark, docs, none):
    from sentencepiece import SentencePieceProcessor

    from corpusloom.llm.pieces import encoded

    library = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rows = encoded(clashing(docs), lambda: public_tokenizers.path("piece_bpe_32k.model")).collect()
    want = Counter((d, tuple(library.encode(t or "")), library.decode(library.encode(t or ""))) for d, t in TEXTS)
    assert Counter((r.doc_id, tuple(r.ids), r.decoded) for r in rows) == want
    assert all(len(r.begins) == len(r.ends) == len(r.ids) for r in rows)
    assert encoded(none, lambda: public_tokenizers.path("piece_bpe_32k.model")).collect() == []


# --- 10: exact ---


def brute_exact(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), d is None, d or 0, d))
    return sorted(((d, min(g)[3], len(g), hashlib.sha256(n.encode()).hexdigest()) for n, g in groups.items() for *_, d in g), key=key)


@pytest.mark.parametrize("weak", [False, True])
def test_exact(docs, none, weak):
    from corpusloom.llm import exact_dedup

    # A digest of 4 bits makes collisions, which the comparison of bytes must resolve.
    digest = (lambda c: F.unhex(F.concat(F.lit("0"), F.substring(F.sha2(c, 256), 1, 1)))) if weak else exact_dedup.sha256
    index = exact_dedup.DigestIndex(clashing(docs), digest=digest, memtable_bits=1)
    got = index.groups().collect()
    want = brute_exact(TEXTS)
    assert sorted(((r.doc_id, r.keep_id, r.group_size) for r in got), key=key) == sorted((w[:3] for w in want), key=key)
    assert sum(r.kept for r in got) == len({w[3] for w in want})
    assert all(r.doc_id == r.keep_id for r in got if r.kept)
    if not weak:
        assert sorted(((r.doc_id, r.digest.hex()) for r in got), key=key) == sorted(((w[0], w[3]) for w in want), key=key)
        assert {r.text for r in index.contains(docs.sparkSession.createDataFrame([("abc",), ("zzz",)], "text string")).collect()} == {"abc"}
    assert exact_dedup.DigestIndex(none).groups().collect() == []


def test_levels_of_the_index_and_what_a_lookup_opens(spark, docs):
    from corpusloom.llm.exact_dedup import DigestIndex, sha256, without_space

    parts = [docs.filter(F.coalesce(F.col("doc_id") % 3 == r, F.lit(r == 0))) for r in range(3)]
    index = DigestIndex(parts[0], memtable_bits=1, fanout=2)
    index.add(parts[1])
    assert len(index.levels) == 2
    inside = docs.select(sha256(without_space(F.col("text"))).alias("digest")).distinct()
    outside = spark.range(2000).select(sha256(F.concat(F.lit("none"), "id")).alias("digest"))
    found, asked = index.lookup(inside.union(outside))
    # A level is asked for what it has and for hardly anything else.
    assert all(level.table.count() <= a.count() <= level.table.count() + 20 for level, a in zip(index.levels, asked, strict=True))
    both = {r.digest for level in index.levels for r in level.table.collect()}
    assert {bytes(r.digest) for r in found.collect()} == {bytes(d) for d in both}
    index.add(parts[2])
    assert len(index.levels) == 1
    assert sorted(((r.doc_id, r.keep_id, r.group_size) for r in index.groups().collect()), key=key) == sorted((w[:3] for w in brute_exact(TEXTS)), key=key)
    many = spark.range(20_000).select(sha256(F.col("id").cast("string")).alias("digest"))
    from corpusloom.llm.common import Scratch
    from corpusloom.llm.exact_dedup import Filter

    f = Filter(many.filter("true"), 20_000, Scratch(spark, "t"), "f")
    assert f.passes(many).filter("not passed").isEmpty() and f.passes(outside).filter("passed").count() < 500


@pytest.mark.parametrize("repeated", [True, False])
def test_keep_first(spark, docs, none, repeated):
    from corpusloom.llm.exact_dedup import keep_first

    rows = TEXTS if repeated else [(d, t) for d, t in TEXTS[:13]]
    kept = keep_first(clashing(spark.createDataFrame(rows, SCHEMA))).collect()
    assert len(kept) == len({w[3] for w in brute_exact(rows)}) and len(kept[0]) == len(clashing(none).columns)
    assert keep_first(none).collect() == []


# --- the pipeline ---


def test_stages_on_odd_tables(spark, docs, none, sf):
    """Nulls, empty and very long texts, ties, repeated rows, columns of any name, and no rows, in every stage."""
    import corpus_pipeline

    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, clashing(none), sf).collect() == []
        odd = clashing(docs).withColumn("n_chars", F.length("text").cast("long"))
        out = stage(spark, odd, sf)
        rows = out.collect()
        ids = {r.doc_id for r in rows}
        if name == "packing":
            assert ids == {d for d, _ in TEXTS}
            continue
        assert out.columns == odd.columns
        if name == "exact_dedup":
            assert len(rows) == len({w[3] for w in brute_exact(TEXTS)})
        if name == "near_dedup":
            assert ids == {1, 2, 5, 6, 7, 9, 10, 12}
        if name == "substring_dedup":
            assert len(rows) == len(TEXTS) and all(r.n_chars == (None if r.text is None else len(r.text)) for r in rows)




def test_near_dedup_of_the_pipeline_reaches_a_similarity_of_0_8(spark, docs, none):
    import corpus_pipeline
    from corpusloom.llm.common import Scratch, components
    from corpusloom.llm.near import distinct_sets, jaccard_duplicates, links, signatures

    rng = np.random.default_rng(3)
    texts = []
    for _ in range(40):
        words = [f"v{i}" for i in rng.integers(0, 500, 200)]
        texts.append(" ".join(words))
        for changed in (2, 4, 6, 8):
            words[:] = [w if i not in range(0, 40 * changed // 2, 20) else f"x{rng.integers(0, 500)}" for i, w in enumerate(words)]
            texts.append(" ".join(words))
    sliced = [{tuple(t.split()[i : i + 5]) for i in range(196)} for t in texts]
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    pairs = [(j, i) for i in range(len(texts)) for j in range(i) if len(sliced[i] & sliced[j]) >= 0.8 * len(sliced[i] | sliced[j])]
    for j, i in pairs:
        a, b = top(i), top(j)
        root[max(a, b)] = min(a, b)
    want = [top(i) for i in range(len(texts))]
    assert 40 <= len(set(want)) < len(texts)
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA).repartition(3)
    assert {r.doc_id: r.component_id for r in jaccard_duplicates(df).collect()} == dict(enumerate(want))
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, df, "").collect()} == set(want)
    # Small blocks give the same groups.
    scratch = Scratch(spark, "t")
    rows = scratch.table(signatures(df), "signatures")
    ids = {r.node: r.doc_id for r in rows.collect()}
    for block, size in ((2, 1 << 20), (2048, 2000)):
        s = Scratch(spark, "t")
        found = {ids[r.node]: r.component for r in components(s, links(s, df, s.table(distinct_sets(rows), "d"), block, size)).collect()}
        assert Counter(Counter(found.values()).values()) == Counter(n for n in Counter(want).values() if n > 1)
    got = jaccard_duplicates(clashing(docs)).collect()
    by = {(r.doc_id, r.text_hash): r.component_id for r in got}
    assert len(got) == len(TEXTS) and Counter(by.values())[2] == 4 and {c for (d, _), c in by.items() if d in (7, 8)} == {7}
    assert {c for (d, _), c in by.items() if d in (9, 13)} == {9} and jaccard_duplicates(none).collect() == []


def test_scratch_tables_leave_no_shuffle_files(spark):
    import time

    from corpusloom.llm.common import Scratch
    from corpusloom.scratch import CLEANUP

    def files() -> set[str]:
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("|")
        return {f for f in found.split("|") if "shuffle_" in f}

    spark._jvm.System.gc()
    time.sleep(1)
    old, set_before = files(), spark.conf.get(CLEANUP, None)
    table = Scratch(spark, "t").table(spark.range(1000).repartition(5).groupBy((F.col("id") % 7).alias("k")).count(), "t")
    for _ in range(50):
        if not files() - old:
            break
        time.sleep(0.1)
    assert not files() - old and table.agg(F.sum("count")).head()[0] == 1000 and spark.conf.get(CLEANUP, None) == set_before


def test_near_dedup_proposes_by_golay_codewords():
    from corpusloom.llm import near
    from corpusloom.llm.simhash import codewords, decoder

    words = codewords()
    assert (decoder()[words] == np.arange(4096)).all() and min(np.bitwise_count(words[1:] ^ words[0])) == 7
    rng = np.random.default_rng(5)
    # Pairs of sets at a similarity of 0.8, small and large, share a key and are near enough; others hardly ever.
    for first, second, shared, most in ((1, 1, 1, 0), (4, 5, 4, 0), (9, 9, 8, 0), (80, 100, 80, 0), (700, 700, 623, 0), (90, 90, 10, 2)):
        missed = 0
        for _ in range(60):
            x = rng.integers(0, 1 << 64, first + second - shared, np.uint64)
            margin = np.array([near.margins(x[:first]), near.margins(x[first - shared :])])
            a, b = near.golay_keys(margin, np.array([first, second]))
            assert len(set(a.tolist())) == len(a) == 2 * near.SEGMENTS * near.CODEWORDS
            missed += bool(set(a.tolist()) & set(b.tolist())) and np.count_nonzero((margin[0] > 0) != (margin[1] > 0)) <= near.FAR
        assert missed <= most if shared < first / 2 else missed == 60
    # The counts are those of the bits, and the codewords of a segment those that agree best with its counts.
    x = rng.integers(0, 1 << 64, 700, np.uint64)
    bits = near.mix(x[:, None] ^ near.SALTS)[:, :, None] >> np.arange(64, dtype=np.uint64) & np.uint64(1)
    margin = near.margins(x)
    assert (margin == 2 * bits.sum(axis=0).reshape(-1).astype(int) - 700).all()
    keys = near.golay_keys(margin[None], np.array([700]))[0]
    for segment in range(near.SEGMENTS):
        part = margin[23 * segment : 23 * segment + 23]
        score = [sum(int(m) if w >> k & 1 else -int(m) for k, m in enumerate(part)) for w in words.tolist()]
        own = {int(k) & 4095 for k in keys if int(k) >> 12 & 7 == segment}
        assert sorted(score[c] for c in own) == sorted(score)[-near.CODEWORDS :]
    # Proposals join what all pairs of a key would.
    n, near_by = 1500, rng.integers(0, 1 << 64, (700, near.WORDS), np.uint64)
    near_by[::7], near_by[1::11] = near_by[0], near_by[1]
    key, node = np.sort(rng.integers(0, 100, n)), rng.integers(0, 700, n)

    def groups(edges):
        label = np.arange(700)
        for a, b in edges:
            label[label == label[a]] = label[b]
        return {frozenset(np.nonzero(label == v)[0].tolist()) for v in label.tolist()}

    pairs = [(node[i], node[j]) for i in range(n) for j in range(i) if key[i] == key[j] and np.bitwise_count(near_by[node[i]] ^ near_by[node[j]]).sum() <= near.FAR]
    found = list(zip(*near.proposals(key, node, near_by[node]), strict=True))
    assert groups(found) == groups(pairs) and len(found) < len(pairs)
    # A group of near copies gives much the same edges under each of its keys.
    copies = rng.integers(0, 1 << 62, 50)
    edges = set()
    for _ in range(40):
        some = rng.permutation(copies)[:40]
        edges.update(zip(*(x.tolist() for x in near.proposals(np.zeros(40, np.int64), some, np.zeros((40, near.WORDS), np.uint64))), strict=True))
    assert len(edges) <= 6 * 50


def test_small_graphs_take_one_round(spark):
    """The last edges are joined at once, whatever the graph's shape, and the tables of the rounds don't stay."""
    from pathlib import Path

    from corpusloom.llm.common import Scratch, components

    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 130)] + [(203, 201), (202, 203)]
    expected = {k: 0 for k in range(41)} | {k: 100 for k in range(100, 130)} | {k: 201 for k in range(201, 204)}
    plain = spark.createDataFrame(edges, "a long, b long")
    node = lambda c: F.struct((F.col(c) < 0).alias("no_id"), F.when(F.col(c) >= 0, F.col(c)).alias("id"), (-F.col(c)).alias("key"))
    for at_once, rounds in ((None, 1), (0, 99)):
        limit = {} if at_once is None else {"at_once": at_once}
        scratch = Scratch(spark, "one-round")
        found = components(scratch, plain, **limit)
        names = {p.name for p in Path(scratch.path.removeprefix("file://")).iterdir()}
        assert len([n for n in names if "went" in n or "ends" in n]) == 1
        assert len([n for n in names if "hot" in n]) < rounds
        assert {r.node: r.component for r in found.collect()} == expected
        of_structs = components(Scratch(spark, "one-round"), plain.select(node("a").alias("a"), node("b").alias("b")), **limit)
        assert {r.node.id: r.component.id for r in of_structs.collect()} == expected
