"""Settings: thresholds, budgets and language profiles, with the defaults that results depend on."""

from __future__ import annotations

from dataclasses import dataclass, field

SEED = 20260820


@dataclass(frozen=True)
class GateConfig:
    min_chars: int = 400
    min_words: int = 50
    min_script_ratio: float = 0.70
    max_foreign_ratio: float = 0.12
    min_markers: int = 3
    min_unique_word_ratio: float = 0.30
    min_mean_word: float = 2.0
    max_mean_word: float = 12.0
    max_symbol_ratio: float = 0.10
    max_duplicate_line_ratio: float = 0.30


@dataclass(frozen=True)
class DedupConfig:
    threshold: float = 0.80
    permutations: int = 96
    shingle: int = 5


@dataclass(frozen=True)
class BudgetConfig:
    manual_target_tokens: int = 100_000_000
    downloaded_target_tokens: int = 400_000_000
    min_manual_fraction: float = 0.20
    margin: float = 0.005
    manual_chars_per_token: float = 4.0
    downloaded_chars_per_token: float = 4.0


@dataclass(frozen=True)
class Profile:
    """How a language is told: the script its letters are in, a script that speaks against it, and its frequent words."""

    lang: str
    script: str
    foreign: str | None
    markers: tuple[str, ...]
    trim: str = "।,.!?\"'()"


# Marker words of languages that share a script, the characters stripped from words before
# they are looked up, and the characters that make a word a symbol word.
NEPALI = ("छ", "छन्", "छैन", "गर्छ", "गरेको", "भएको", "लाई", "सँग", "हुन्", "भन्ने", "भन्दा", "गर्ने", "नेपाल", "काठमाडौं", "हरू", "बाट")
HINDI = ("है", "हैं", "था", "थे", "किया", "गया", "रहा", "में", "नहीं", "लेकिन", "क्योंकि", "भारत", "दिल्ली", "करने", "बताया", "को")
SYMBOLS = "#…$%^&*_=+~<>|\\/@"
# The shorter lists of the check after a fetch.
FETCH_NEPALI = NEPALI[:15]
FETCH_HINDI = HINDI[:15]

DEVANAGARI = r"[\x{0900}-\x{097F}]"
LATIN = r"[A-Za-z\x{C0}-\x{FF}]"

#: Profiles that are told from each other, by name of the group.
PROFILES: dict[str, tuple[Profile, ...]] = {
    "devanagari": (Profile("hindi", DEVANAGARI, "[A-Za-z]", HINDI), Profile("nepali", DEVANAGARI, "[A-Za-z]", NEPALI)),
    "latin": (
        Profile("en", LATIN, None, ("the", "of", "and", "to", "in", "is", "that", "it", "for", "was", "on", "with", "are", "be", "this", "from")),
        Profile("es", LATIN, None, ("el", "los", "las", "y", "del", "se", "por", "con", "una", "su", "para", "al", "lo", "como", "más", "o")),
        Profile("fr", LATIN, None, ("le", "les", "et", "des", "est", "du", "dans", "qui", "sur", "au", "pas", "avec", "ce", "il", "par", "pour")),
        Profile("de", LATIN, None, ("der", "die", "und", "das", "den", "von", "zu", "mit", "sich", "auf", "ist", "im", "dem", "nicht", "ein", "eine")),
    ),
}

# Short lines that are page furniture, as one pattern.
BOILERPLATE = (
    r"^यह भी पढ|^इसे भी पढ|^और पढ|^पढ़ें|^यो पनि|^सम्बन्धित|^थप पढ|"
    r"^शेयर|^share|^फॉलो कर|^copyright|^सर्वाधिकार|^all rights reserved|"
    r"^विज्ञापन$|^advertisement$|^tags?:|^ट्याग|^टैग|^comments?$|"
    r"^टिप्पणी$|^प्रतिक्रिया$|^\p{Nd}+$"
)

# Collection methods and what they imply, names of provenance classes, and source priorities.
MANUAL_METHODS = ("scrape", "ocr", "transcription", "typed")
DOWNLOADED_METHODS = ("hf_download", "public_corpus", "dump")
MANUAL_NAMES = ("manual", "ocr", "scrape", "scraped", "transcription", "typed")
DOWNLOADED_NAMES = ("downloaded", "public", "hf", "huggingface")
SOURCE_PRIORITY = {"wikipedia": 1, "sangraha_verified": 2, "sangraha": 3, "sangraha_unverified": 4}
UNKNOWN_PRIORITY = 9

# Parts of file names that tell a public corpus, first hit wins; and the names a text can have in a record.
SOURCE_MARKERS = ("sangraha", "indiccorp", "indic_corp", "oscar", "mc4", "c4", "cc100", "cc_100", "wikipedia", "wiki", "opus", "samanantar", "culturax")
TEXT_KEYS = ("text", "content", "raw_content", "body", "article", "sentence")

# URLs that are no articles, and links not to be followed.
DENY_URL = (
    r"(?i)/tag/|/tags/|/author/|/search|/login|/register|/cart|/wp-json/|"
    r"/feed/?$|/amp/?$|/photo-gallery|/video/|/videos/|/live-|"
    r"/horoscope|/rashifal|/panchang|/page/[0-9]+/?$|"
    r"\.(jpg|jpeg|png|gif|webp|svg|mp4|mp3|pdf|zip|docx?|xlsx?)$"
)
DENY_LINK = (
    r"(?i)/(login|signin|register|cart|search|tag|share|print|comment)"
    r"|[?&](replytocom|share=|print=)"
    r"|\.(jpg|jpeg|png|gif|svg|css|js|zip|mp4|mp3|docx?|xlsx?)($|\?)"
)


@dataclass(frozen=True)
class IngestConfig:
    """Reading a large source by windows, up to a budget of characters."""

    min_chars: int = 200
    min_script_ratio: float = 0.60
    head: int = 2000
    windows: int = 200
    target_tokens: int = 400_000_000
    overcollect: float = 1.45
    chars_per_token: float = 4.0


@dataclass(frozen=True)
class BuildConfig:
    group: str = "latin"
    near_dup: bool = True
    seed: int = SEED
    gates: GateConfig = field(default_factory=GateConfig)
    dedup: DedupConfig = field(default_factory=DedupConfig)
    budget: BudgetConfig | None = field(default_factory=BudgetConfig)
    split_ratios: tuple[float, float, float] = (0.98, 0.01, 0.01)


def pick(*values: object) -> object:
    """The first value that is set: command line, then configuration, then default."""
    return next((v for v in values if v is not None), None)
