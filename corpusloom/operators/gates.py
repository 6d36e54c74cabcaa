"""Ordered gates: the first condition that fails gives a document's reason, else it is ok."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.config import DEVANAGARI, FETCH_HINDI, FETCH_NEPALI, PROFILES, SYMBOLS, GateConfig, IngestConfig, Profile
from corpusloom.functions.text import SPACE, count_chars, furniture_lines, in_slices, lines, tidied, words

SYMBOL_WORD = "[" + re.sub(r"([\\\\^\]\[-])", r"\\\1", SYMBOLS) + "]"


def cascade(*steps: tuple[str, Column]) -> Column:
    """The name of the first step whose condition holds, else 'ok'; later conditions don't count."""
    (name, first), *rest = steps
    return reduce(lambda c, s: c.when(s[1], s[0]), rest, F.when(first, name)).otherwise("ok")


def trimmed(ws: Column, profile: Profile) -> Column:
    """Words without the marks around them."""
    return F.transform(ws, lambda w: F.btrim(w, F.lit(profile.trim)))


def marker_count(bare: Column, profile: Profile) -> Column:
    return F.size(F.filter(bare, lambda w: w.isin(*profile.markers)))


def ratio(part: Column, whole: Column) -> Column:
    return part / F.nullif(whole, F.lit(0))


def _python(pattern: str) -> str:
    """A character class in Python's syntax."""
    return re.sub(r"\\x\{([0-9A-Fa-f]+)\}", lambda m: re.escape(chr(int(m[1], 16))), pattern)


def _kinds(profiles: tuple[Profile, ...]) -> list[str]:
    """The different scripts that the languages of a group have or don't want."""
    return list(dict.fromkeys(k for p in profiles for k in (p.script, p.foreign) if k))


def _fields(profiles: tuple[Profile, ...]) -> list[str]:
    """What a text is measured by: characters, words, characters without spaces, distinct words, words with symbols, lines, distinct lines; characters of each script; markers of each language."""
    return ["n_chars", "n_words", "n_dense", "n_distinct", "n_symbols", "n_lines", "n_distinct_lines", *(f"kind_{i}" for i in range(len(_kinds(profiles)))), *(f"markers_{p.lang}" for p in profiles)]


def _measurer(profiles: tuple[Profile, ...]) -> Callable[[str], tuple[int, ...]]:
    """Takes the measures of a tidied text, in which single spaces and line ends part words."""
    kinds = [re.compile(f"{_python(k)}+") for k in _kinds(profiles)]
    symbol, trim, markers = re.compile(_python(SYMBOL_WORD)).search, profiles[0].trim, [frozenset(p.markers) for p in profiles]
    every = frozenset().union(*markers)

    def measure(text: str) -> tuple[int, ...]:
        ws = [w for w in text.replace("\n", " ").split(" ") if w]
        ls = text.split("\n")
        found = [b for b in [w.strip(trim) for w in ws] if b in every]
        n, odd = len(text), sum(1 for w in ws if symbol(w)) if symbol(text) else 0
        return (n, len(ws), n - text.count(" ") - text.count("\n"), len(set(ws)), odd, len(ls), len(set(ls)), *(n - len(k.sub("", text)) for k in kinds), *(sum(b in m for b in found) for m in markers))

    return measure


def _measured(group: str, clean: bool) -> Callable[[Iterator[pa.Array]], Iterator[pa.Array]]:
    profiles = PROFILES[group]
    tidy, furniture, names = tidied("\ufeff\u200b\xad", "", True), furniture_lines(), ["text", "n_boilerplate", *_fields(profiles)]
    kinds, measure = [pa.string(), *[pa.int32()] * (len(names) - 1)], _measurer(profiles)

    @in_slices
    def run(texts: list[str | None]) -> pa.Array:
        rows = []
        for text in texts:
            if text is None:
                rows.append((None,) * len(names))
                continue
            gone = 0
            if clean:
                text = tidy(text)
                ls = text.split("\n")
                kept = [x for x in ls if not furniture(x)]
                gone = len(ls) - len(kept)
                text = "\n".join(kept) if gone else text
            rows.append((text if clean else "", gone, *measure(text)))
        columns = zip(*rows, strict=True) if rows else [()] * len(names)
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return run


def gated(df: DataFrame, group: str = "latin", cfg: GateConfig = GateConfig(), clean: bool = False) -> DataFrame:
    """df (tidied text, lang) with reason: why a text is not for the corpus, by the profile of its language in the group.

    All measures of a text are taken in one pass over it in an Arrow batch, and the cascade is an expression of
    those numbers: lambdas over a text's words take some twenty times as long in the JVM, where they are
    interpreted. With clean, the same pass tidies raw texts and takes out furniture lines first, and n_boilerplate
    tells how many; so texts go to Python and back once. A language outside the group has no script or markers,
    and is rejected as low_script.
    """
    schema = ", ".join(["text string", *(f"{c} int" for c in ("n_boilerplate", *_fields(PROFILES[group])))])
    rows = df.withColumn("_m", F.arrow_udf(_measured(group, clean), schema)("text"))
    if clean:
        rows = rows.withColumns({"n_boilerplate": F.col("_m.n_boilerplate"), "text": F.col("_m.text")})
    # The reason comes from a generator, which filters on it don't pass: pushed down, they would take the measures again.
    reason = gate_reason(F.col("lang"), lambda c: F.col(f"_m.{c}"), group, cfg)
    return rows.select("*", F.inline(F.array(F.struct(reason.alias("reason"))))).drop("_m")


def gate_reason(lang: Column, of: Callable[[str], Column], group: str = "latin", cfg: GateConfig = GateConfig()) -> Column:
    """The cascade over the measures of a text, which `of` gives by name."""
    profiles, kinds = PROFILES[group], _kinds(PROFILES[group])

    def of_lang(values: dict[str, Column], otherwise: int) -> Column:
        pairs = list(values.items())
        return reduce(lambda c, p: c.when(lang == p[0], p[1]), pairs[1:], F.when(lang == pairs[0][0], pairs[0][1])).otherwise(otherwise) if pairs else F.lit(otherwise)

    def share(kind: str) -> Column:
        return ratio(of_lang({p.lang: of(f"kind_{kinds.index(k)}") for p in profiles if (k := getattr(p, kind))}, 0), of("n_dense"))

    n, counts = of("n_words"), {p.lang: of(f"markers_{p.lang}") for p in profiles}
    best_other = F.greatest(*(F.when(lang == k, F.lit(-1)).otherwise(c) for k, c in counts.items()))
    return cascade(
        ("too_short_chars", of("n_chars") < cfg.min_chars),
        ("too_few_words", n < cfg.min_words),
        ("empty", of("n_dense") == 0),
        ("low_script", share("script") < cfg.min_script_ratio),
        ("code_mixed", share("foreign") > cfg.max_foreign_ratio),
        ("no_language_markers", reduce(lambda a, b: a + b, counts.values()) < cfg.min_markers),
        ("wrong_language", of_lang(counts, 0) <= best_other),
        ("repetitive", ratio(of("n_distinct"), n) < cfg.min_unique_word_ratio),
        ("bad_mean_word_length", ~ratio(of("n_dense"), n).between(cfg.min_mean_word, cfg.max_mean_word)),
        ("symbol_heavy", ratio(of("n_symbols"), n) > cfg.max_symbol_ratio),
        ("duplicate_lines", 1 - ratio(of("n_distinct_lines"), of("n_lines")) > cfg.max_duplicate_line_ratio),
    )


def prefilter_reason(text: Column, language: Column, wanted: str | Column) -> Column:
    """Before any work: blank texts, and records that name another language."""
    return cascade(("empty", F.coalesce(F.regexp_replace(text, f"[{SPACE}]+", "") == "", F.lit(True))), ("wrong_language_field", F.coalesce(language != wanted, F.lit(False))))


def cheap_reason(text: Column, script: str = DEVANAGARI, cfg: IngestConfig = IngestConfig(), name: str = "not_script") -> Column:
    """A shallow look at records from a large source: length, then the script of the letters at the start."""
    head = F.substring(text, 1, cfg.head)
    letters = F.regexp_count(head, F.lit(r"[\p{L}\p{Nl}\p{No}]"))
    own = F.regexp_count(head, F.lit(rf"(?=[\p{{L}}\p{{Nl}}\p{{No}}]){script}"))
    return cascade(("too_short", F.length(text) < cfg.min_chars), ("no_letters", letters == 0), (name, ratio(own, letters) < cfg.min_script_ratio))


def fetched_reason(text: Column, lang: str, cfg: GateConfig = GateConfig()) -> Column:
    """The check of a fetched page in Devanagari, against the shorter marker lists."""
    ws, packed = words(text), F.regexp_replace(text, f"[{SPACE}]+", "")
    of_hindi, of_nepali = Profile("hindi", DEVANAGARI, None, FETCH_HINDI), Profile("nepali", DEVANAGARI, None, FETCH_NEPALI)
    hindi, nepali = (marker_count(trimmed(ws, p), p) for p in (of_hindi, of_nepali))
    own, other, name = (hindi, nepali, "looks_nepali") if lang == "hindi" else (nepali, hindi, "looks_hindi")
    return cascade(
        ("empty", F.length(packed) == 0),
        ("devanagari_ratio", ratio(count_chars(packed, DEVANAGARI), F.length(packed)) < cfg.min_script_ratio),
        ("latin_ratio", ratio(count_chars(packed, "[A-Za-z]"), F.length(packed)) > cfg.max_foreign_ratio),
        ("no_language_markers", hindi + nepali < cfg.min_markers),
        (name, own <= other),
    )


def page_reason(text: Column, script: str = DEVANAGARI, min_chars: int = 400, min_script: float = 0.75) -> Column:
    """The gate of a recognised page: length, script, words, and words broken to pieces."""
    ws, packed = words(text), F.regexp_replace(text, f"[{SPACE}]+", "")
    return cascade(
        ("too_short", F.length(text) < min_chars),
        ("empty", F.length(packed) == 0),
        ("low_script", ratio(count_chars(packed, script), F.length(packed)) < min_script),
        ("too_few_words", F.size(ws) < 40),
        ("fragmented", ratio(F.size(F.filter(ws, lambda w: F.length(w) <= 2)), F.size(ws)) > 0.45),
    )


def text_layer_ok(text: Column, script: str = DEVANAGARI) -> Column:
    """Whether a document's own text layer can be used: 200 characters, a quarter of them in the script."""
    packed = F.regexp_replace(text, f"[{SPACE}]+", "")
    return (F.length(text) >= 200) & (F.coalesce(ratio(count_chars(packed, script), F.length(packed)), F.lit(0.0)) >= 0.25)


def clean_recognised(text: Column, script: str = DEVANAGARI) -> Column:
    """A tidied page without lines of 2 characters or fewer, mostly in another script, or of at most 2 different characters."""

    def good(line: Column) -> Column:
        packed = F.replace(line, F.lit(" "))
        return (F.length(line) > 2) & (count_chars(packed, script) / F.length(packed) >= 0.5) & (F.size(F.array_distinct(F.split(packed, ""))) > 2)

    return F.array_join(F.filter(lines(text), good), "\n")


def provenance_reason(language: Column, provenance_class: Column, method: Column, languages: tuple[str, ...]) -> Column:
    """Whether a record may be written: known language and class, and a method that fits the class."""
    from corpusloom.config import DOWNLOADED_METHODS, MANUAL_METHODS

    return cascade(
        ("bad_language", ~F.coalesce(language.isin(*languages), F.lit(False))),
        ("bad_class", ~F.coalesce(provenance_class.isin("manual", "downloaded"), F.lit(False))),
        ("method_implies_manual", F.coalesce(method.isin(*MANUAL_METHODS) & (provenance_class != "manual"), F.lit(False))),
        ("method_implies_downloaded", F.coalesce(method.isin(*DOWNLOADED_METHODS) & (provenance_class != "downloaded"), F.lit(False))),
    )
