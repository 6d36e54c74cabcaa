"""Own encoding with a given vocabulary against the library that the vocabulary was made for."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
spm = pytest.importorskip("sentencepiece")

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return spm.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def texts() -> list[str | None]:
    rng = random.Random(4)
    pool = ["the ", " ", "   ", "\n", "▁", "é", "漢字", "😀", "ing", "tion", "\t", "<s>", "<0x0A>", "हिन्दी ", "a", "b", "aaaa", "\x00", "ñandú ", ".", "  x"]
    return [None, "", " ", "\n", "word", *("".join(rng.choice(pool) for _ in range(rng.randint(1, 20))) for _ in range(300))]


def test_vocabulary(spark, library):
    from corpusloom.operators.pieces import vocabulary

    rows = vocabulary(spark, PATH).collect()
    assert [(r.id, r.piece, r.is_byte, r.is_unknown) for r in sorted(rows)] == [(i, library.id_to_piece(i), library.is_byte(i), library.is_unknown(i)) for i in range(library.get_piece_size())]


def test_words_give_the_ids_of_texts(spark, library, texts):
    from corpusloom.operators.pieces import encoded_words, marked_words

    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = df.select("doc_id", marked_words(F.col("text")).alias("ws")).collect()
    distinct = spark.createDataFrame(sorted({(w,) for r in rows for w in r.ws}), "word string")
    ids = {r.word: r.ids for r in encoded_words(distinct, PATH).collect()}
    for r in rows:
        assert [i for w in r.ws for i in ids[w]] == library.encode(texts[r.doc_id] or "")


def test_sums(spark, library, texts):
    from corpusloom.operators.pieces import piece_frequency, piece_measures, piece_totals, round_trips

    rows = [(i, t, None if i % 3 == 0 else f"c{i % 3}") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, class string").repartition(3)
    want, freq = defaultdict(Counter), Counter()
    for _, t, c in rows:
        ids = library.encode(t or "")
        freq.update(ids)
        want[c].update(documents=1, n_tokens=len(ids), n_chars=len(t or ""), n_bytes=len((t or "").encode()))
        if any(w for w in (t or "").replace("\n", " ").split(" ")):
            want[c].update(worded=1, tokens=len(ids), byte=sum(library.is_byte(i) for i in ids))
    got = {r["class"]: r for r in piece_totals(df, PATH, ["class"]).collect()}
    assert {c: (r.documents, r.n_tokens, r.n_chars, r.n_bytes) for c, r in got.items()} == {c: (w["documents"], w["n_tokens"], w["n_chars"], w["n_bytes"]) for c, w in want.items()}
    assert {r.token: r.n for r in piece_frequency(df, PATH).collect()} == freq
    for r in piece_measures(df, PATH, ["class"]).collect():
        w = want[r["class"]]
        assert (r.documents, r.tokens) == (w["worded"], w["tokens"]) and r.byte_fallback_rate == pytest.approx(w["byte"] / w["tokens"]) and r.unk_rate == 0
    assert piece_measures(df, PATH, []).head().tokens == sum(w["tokens"] for w in want.values())
    same = {r.doc_id: r.same for r in round_trips(df, PATH).collect()}
    assert same == {i: library.decode(library.encode(t or "")) == (t or "") for i, t, _ in rows}
    assert piece_totals(df.limit(0), PATH, ["class"]).count() == 0 and piece_frequency(df.limit(0), PATH).count() == 0


def test_merges_go_by_score_then_from_the_left():
    from corpusloom.operators.pieces import merged

    assert merged("aaa", {"aa": 0.0}) == ["aa", "a"]
    assert merged("abc", {"ab": -2.0, "bc": -1.0}) == ["a", "bc"]
    assert merged("abab", {"ab": -1.0, "abab": -2.0}) == ["abab"] and merged("", {}) == []


def test_sweep_equals_an_encoder_for_each_size(spark, texts, tmp_path):
    """Each size of the sweep gives what a model file cut to that size gives."""
    from sentencepiece import sentencepiece_model_pb2

    from corpusloom.operators.pieces import sweep

    more = [*texts, "Restes bleble the ersteres übernommen heines thingtible", "la eaux des ñandú que vient inheedblein"]
    df = spark.createDataFrame([(t,) for t in more], "text string").repartition(3)
    sizes = (3600, 5000, 9000, 32_000)
    got = {r.vocab_size: r for r in sweep(df, PATH, sizes).collect()}
    worded = [t for t in more if any(w for w in (t or "").replace("\n", " ").split(" "))]
    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(open(PATH, "rb").read())
    for size in sizes:
        cut = sentencepiece_model_pb2.ModelProto()
        cut.CopyFrom(proto)
        made = [p for p in proto.pieces if p.type == 1 and len(p.piece) > 1]
        gone = {p.piece for p in made[max(0, size - len(proto.pieces) + len(made)) :]}
        del cut.pieces[:]
        cut.pieces.extend(p for p in proto.pieces if p.piece not in gone)
        assert len(cut.pieces) == size
        library = spm.SentencePieceProcessor(model_proto=cut.SerializeToString())
        ids = [library.encode(t) for t in worded]
        n = sum(map(len, ids))
        assert got[size].tokens == n and got[size].byte_fallback_rate == pytest.approx(sum(library.is_byte(i) for x in ids for i in x) / n) and got[size].unk_rate == 0
    assert sweep(df.limit(0), PATH, sizes).count() == 0
