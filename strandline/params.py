"""Word lists and numbers, all replaceable for a query."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column

from .functions import text as t

# The lists and numbers below must be these for equal results.
KNOWN_SPONSORS = (
    "draftkings", "athletic greens", "ag1", "meundies", "squarespace", "expressvpn", "nordvpn", "cash app", "betterhelp",
    "onnit", "fleshlight", "manscaped", "ziprecruiter",
)
SALES_KEYWORDS = ("promo code", "code rogan", "discount", "save", "free trial", "sponsored by", "brought to you")
BOILERPLATE = (
    "joe rogan podcast", "check it out", "the joe rogan experience", "train by day", "joe rogan podcast by night", "all day",
    "hello freak bitches", "welcome to the show",
)
SAFE_STARTERS = ("i ", "you ", "we ", "they ", "he ", "she ", "it ", "that ", "and ", "but ", "so ", "yeah", "no ", "what", "how", "why", "when")
BLOCKED_NAMES = (
    "alpha", "alpha brain", "onnit", "squarespace", "cash app", "vpn", "fleshlight", "ting", "dollar shave club", "youtube",
    "twitter", "instagram", "facebook", "google", "alexa", "siri", "clip", "spotify", "zoom", "skype", "iphone", "android",
)
VISUAL_TRIGGERS = (
    "pull that up", "pull it up", "look at that", "see that", "show me that", "google that", "look at this", "watch this",
    "on the screen", "jamie",
)
CHUNK_VISUAL_TRIGGERS = ("pull that up", "look at that", "see that", "on the screen")
HOST_MARKERS = (
    "jamie", "pull that up", "it's entirely possible", "let me ask you this", "have you ever seen", "whoa", "jesus",
    "look at that", "100 percent", "extraordinary", "chimpanzee", "dmt", "sauna", "cold plunge", "elk",
)
STOP_CONCEPTS = ("youtube", "google", "instagram")


@dataclass(frozen=True)
class Lexicons:
    sponsors: tuple[str, ...] = KNOWN_SPONSORS
    keywords: tuple[str, ...] = SALES_KEYWORDS
    boilerplate: tuple[str, ...] = BOILERPLATE
    safe_starters: tuple[str, ...] = SAFE_STARTERS
    blocked_names: tuple[str, ...] = BLOCKED_NAMES
    visual_triggers: tuple[str, ...] = VISUAL_TRIGGERS
    chunk_visual_triggers: tuple[str, ...] = CHUNK_VISUAL_TRIGGERS
    host_markers: tuple[str, ...] = HOST_MARKERS
    extra_marker: str = "jamie"
    stop_concepts: tuple[str, ...] = STOP_CONCEPTS


@dataclass(frozen=True)
class Params:
    """Numbers of all stages, and ``split``, which gives a text's sentences. Prefix lengths of ``None`` read whole texts; ``bounded()`` has the fixed prefixes."""

    lexicons: Lexicons = field(default_factory=Lexicons)
    ngram: int = 6
    min_phrase_docs: int = 5
    ad_min_chars: int = 30
    max_guests: int = 5
    min_feature_chars: int = 100
    min_sentence_tokens: int = 3
    max_concepts: int = 8
    min_concept_chars: int = 3
    window: int = 10
    stride: int = 5
    window_mean: float = 15.0
    chunk_size: int = 1000
    chunk_overlap: int = 200
    min_chunk: int = 50
    banter_chunks: int = 2
    chaos_cut: float = 15.0
    chaos_marker: str = "FC-"
    min_guest_rows: int = 1
    min_concept_rows: int = 2
    host_cut: float = 0.15
    host_min_chars: int = 50
    max_hops: int = 4
    vector_hits: int = 3
    mining_sample: int | None = None
    mining_chars: int | None = None
    sentiment_chars: int | None = None
    feature_chars: int | None = None
    concept_chars: int | None = None
    name_chars: int | None = None
    chunk_chars: int | None = None
    split: Callable[[Column], Column] = t.sentences

    @classmethod
    def bounded(cls, **more) -> Params:
        """The prefixes and the sample that bound the work per document."""
        fixed = {"mining_sample": 500, "mining_chars": 6_000, "sentiment_chars": 50_000, "feature_chars": 100_000, "concept_chars": 15_000, "name_chars": 10_000, "chunk_chars": 500_000}
        return cls(**(fixed | more))
