"""The registered queries of the training-data operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import Scratch, hot_keys, keyed_join, table

WORD_BPE, PIECE_BPE = "word_bpe_49k.json", "piece_bpe_32k.model"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def word_encode(end: int) -> Callable[[list[str | None]], tuple[list[bytes], str]]:
    """Encodes texts with the word BPE file, which each worker finds in its own installation, and ends each with the id `end`."""

    def encode(texts: list[str | None]) -> tuple[list[bytes], str]:
        from corpusloom.llm.word_bpe import encoder

        return (e := encoder(tokenizer_path(WORD_BPE))).encode(texts, end), e.dtype.str

    return encode


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm.token_files import read_tokens, write_tokens

    to = Scratch(spark, "tokens").path
    write_tokens(table(spark, sf_dir, "documents"), to, word_encode(1))
    return read_tokens(spark, to)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm.language import learn, predict

    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(remainder == 0, F.lit(False)))
    return predict(docs, learn(docs.filter(remainder != 0)))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), word_encode(2))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm.substring import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm.neighbours import nearest

    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.filter("vec_id % 100 = 0"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm.quality import resample

    found = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "log_weight", F.col("key").alias("sampling_key"), "kept")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm.html_text import extract

    return extract(table(spark, sf_dir, "pages"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm.simhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm.pieces import encoded

    rows = encoded(table(spark, sf_dir, "documents"), lambda: tokenizer_path(PIECE_BPE))

    def joined(numbers: str) -> Column:
        return F.concat_ws(",", F.col(numbers).cast("array<string>"))

    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(joined("ids"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.crc32(F.concat_ws(";", joined("begins"), joined("ends")).cast("binary")).alias("spans_crc32"),
    )


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm.exact_dedup import DigestIndex

    groups = DigestIndex(table(spark, sf_dir, "documents")).groups()
    return groups.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm.token_counts import prefix_counts, within

    return within(prefix_counts(table(spark, sf_dir, "documents"), lambda: tokenizer_path(WORD_BPE)), 2048)


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm.spelling import misspelt, variants, word_counts

    return variants(word_counts(table(spark, sf_dir, "documents"), change=misspelt(199)))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm.prefix_trie import placed_turns, prefix_trie

    scratch = Scratch(spark, "trie")
    ids, turns = rebuilt(placed_turns(table(spark, sf_dir, "conversations"), scratch), scratch)
    nodes = prefix_trie(turns, ids, scratch)
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved_bytes").alias("saved_tokens"), "ends_sha256")


def rebuilt(turns: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """All conversation ids, and the turns that each has once the first h of its base stand before its own after the first h (h: the id's hash modulo 9; base: the id less its remainder by 5)."""
    conv = F.col("conv_id")
    h = (F.crc32(conv.cast("string").cast("binary")) % 9).alias("h")
    sizes = scratch.table(turns.groupBy("conv_id").agg(F.count("*").alias("n")), "sizes")
    bases = sizes.select(conv.alias("base"), F.col("n").alias("base_n"))
    ids = sizes.select("conv_id", h, (conv - conv % 5).alias("base")).join(bases, "base", "left")
    ids = scratch.table(ids.select("conv_id", "h", "base", F.least("h", F.coalesce("base_n", F.lit(0))).alias("kept")), "ids")
    heads = turns.filter("place < 8").select(conv.alias("base"), "place", "digest", "n_bytes")
    head = heads.join(ids, "base").filter("place < kept").select("conv_id", "place", "digest", "n_bytes")
    long = hot_keys(sizes, sizes.agg(F.sum("n")).head()[0] or 0, scratch, "long")
    own = keyed_join(turns, ids.select("conv_id", "h", "kept"), "conv_id", long).filter("place >= h")
    return ids.select("conv_id"), scratch.table(head.union(own.select("conv_id", F.col("place") - F.col("h") + F.col("kept"), "digest", "n_bytes")), "rebuilt")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_files": op1_token_files,
    "op2_language_id": op2_language_id,
    "op3_packing": op3_packing,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_neighbours": op5_neighbours,
    "op6_quality": op6_quality,
    "op7_html_text": op7_html_text,
    "op8_simhash": op8_simhash,
    "op9_pieces": op9_pieces,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_token_counts": op11_token_counts,
    "op12_spelling": op12_spelling,
    "op13_prefix_trie": op13_prefix_trie,
}

#: CRC-32 in SQL: the table of the reflected polynomial, and the sum over a list of bytes.
CRC_TABLE = "crc AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i)))"
CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, {bytes}::BIGINT[]), lambda c, b: xor(c >> 8, crc.t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT)"
UTF8 = "flatten(list_transform(string_split({text}, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)] ELSE [192 + (unicode(x) >> 6), 128 + (unicode(x) & 63)] END))"

ORACLE: dict[str, str] = {
    "op4_substring_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        w AS (SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM d)),
        r AS (SELECT doc_id, i FROM w WHERE win IN (SELECT win FROM w GROUP BY win HAVING count(*) > 1)),
        c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS j FROM r),
        k AS (SELECT x.doc_id, string_agg(x.word, ' ' ORDER BY x.j) AS kept, count(*) AS n
              FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS j FROM d) x LEFT JOIN c ON c.doc_id = x.doc_id AND c.j = x.j
              WHERE c.j IS NULL GROUP BY x.doc_id)
        SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, len(d.ws)::BIGINT - coalesce(k.n, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
        FROM d LEFT JOIN k ON k.doc_id = d.doc_id""",
    "op10_exact_dedup": r"""
        WITH n AS (SELECT doc_id, coalesce(length(text), 0) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS t FROM documents),
        r AS (SELECT *, row_number() OVER w AS k, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY t) AS group_size
              FROM n WINDOW w AS (PARTITION BY t ORDER BY points DESC, doc_id NULLS LAST))
        SELECT doc_id, keep_id, group_size, k = 1 AS kept, sha256(t) AS text_sha256 FROM r""",
    "op12_spelling": rf"""
        WITH RECURSIVE {CRC_TABLE},
        runs AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS r FROM documents WHERE text IS NOT NULL),
        low AS (SELECT coalesce(doc_id::VARCHAR, '') AS doc, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS k FROM runs WHERE length(r) >= 6 GROUP BY ALL),
        hashed AS (SELECT w, k, {CRC.format(bytes=UTF8.format(text="doc || ':' || w"))} AS h FROM low, crc),
        changed AS (SELECT CASE WHEN h % 199 = 0 THEN left(w, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word, k FROM hashed),
        vocab AS (SELECT word, sum(k)::BIGINT AS n FROM changed WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
        gaps AS (SELECT word, n, i, left(word, i::INT - 1) || substr(word, i::INT + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM vocab)),
        near AS (SELECT a.word, b.word AS other, b.n FROM gaps a JOIN gaps b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
                 UNION SELECT g.word, v.word, v.n FROM gaps g JOIN vocab v ON v.word = g.rest
                 UNION SELECT v.word, g.word, g.n FROM gaps g JOIN vocab v ON v.word = g.rest),
        best AS (SELECT word, count(*) AS n_near, first(other ORDER BY n DESC, other) AS other, max(n) AS other_n FROM near GROUP BY word),
        forms AS (SELECT v.word, v.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.other_n >= 5 * v.n THEN b.other END AS form, CASE WHEN b.other_n >= 5 * v.n THEN b.other_n END AS form_n
                  FROM vocab v LEFT JOIN best b USING (word)),
        way AS (SELECT word, word AS root FROM forms WHERE form IS NULL UNION ALL SELECT f.word, w.root FROM forms f JOIN way w ON f.form = w.word)
        SELECT word, form, root, n, n_near, form_n FROM forms JOIN way USING (word)""",
    "op13_prefix_trie": rf"""
        WITH {CRC_TABLE},
        t AS (SELECT conv_id, turn, sha256(strlen(role)::VARCHAR || ':' || role || text) AS d, strlen(text) AS bytes
              FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
        own AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, d) - 1 AS place FROM t),
        ids AS (SELECT conv_id, conv_id - conv_id % 5 AS base, {CRC.format(bytes="list_transform(string_split(conv_id::VARCHAR, ''), lambda x: unicode(x))")} % 9 AS h
                FROM (SELECT DISTINCT conv_id FROM own), crc),
        sized AS (SELECT i.*, least(h, coalesce(n, 0)) AS kept FROM ids i LEFT JOIN (SELECT conv_id AS base, count(*) AS n FROM own GROUP BY ALL) USING (base)),
        rebuilt AS (SELECT s.conv_id, o.place, d, bytes FROM sized s JOIN own o ON o.conv_id = s.base AND o.place < s.kept
                    UNION ALL SELECT s.conv_id, o.place - h + kept, d, bytes FROM sized s JOIN own o ON o.conv_id = s.conv_id AND o.place >= s.h),
        paths AS (SELECT conv_id, place + 1 AS depth, bytes, string_agg(d, ',') OVER (PARTITION BY conv_id ORDER BY place) AS path FROM rebuilt
                  UNION ALL SELECT conv_id, 0, 0, '' FROM ids),
        m AS (SELECT conv_id, depth, bytes, sha256(path) AS node, lag(sha256(path)) OVER (PARTITION BY conv_id ORDER BY depth) AS parent,
                     depth = max(depth) OVER (PARTITION BY conv_id) AS ends FROM paths),
        nodes AS (SELECT node, any_value(parent) AS parent, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(bytes) AS saved,
                         sha256(coalesce(string_agg(CASE WHEN ends THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends_sha256 FROM m GROUP BY node, depth),
        kids AS (SELECT parent AS node, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY ALL),
        below AS (SELECT m.node, sum((k.node IS NULL)::INT)::BIGINT AS n_leaves, sum(x.saved)::BIGINT AS saved_tokens
                  FROM nodes x JOIN m ON m.conv_id = x.conv_id AND m.depth <= x.depth LEFT JOIN kids k ON k.node = x.node GROUP BY m.node)
        SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, b.n_leaves, b.saved_tokens, n.ends_sha256
        FROM nodes n LEFT JOIN nodes p ON p.node = n.parent LEFT JOIN kids k ON k.node = n.node JOIN below b ON b.node = n.node""",
}
