"""Settings of the ranking engine.

Everything that decides a result (vocabularies, weights, thresholds, phrases) is
collected here as frozen dataclasses; every operator takes its settings as an
argument, so a job can override any of them without touching the code.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce
from operator import add
from types import MappingProxyType

NEUTRAL = 0.5
MISSING_SIMILARITY = -1.0

# ---------------------------------------------------------------------------
# Job titles that pass the pre-filter on the title alone.
# ---------------------------------------------------------------------------
TARGET_TITLES: tuple[str, ...] = (
    "ai engineer",
    "ai research engineer",
    "ai specialist",
    "applied ml engineer",
    "data scientist",
    "junior ml engineer",
    "lead ai engineer",
    "machine learning engineer",
    "ml engineer",
    "nlp engineer",
    "recommendation systems engineer",
    "search engineer",
    "senior ai engineer",
    "senior applied scientist",
    "senior data scientist",
    "senior machine learning engineer",
    "senior nlp engineer",
    "senior software engineer (ml)",
    "staff machine learning engineer",
)

# ---------------------------------------------------------------------------
# Closed vocabularies of the enrichment signals, and their scores.
# ---------------------------------------------------------------------------
ROLE_SCORES: Mapping[str, float] = MappingProxyType(
    {
        "ml_engineer": 1.0,
        "ai_engineer": 0.9,
        "data_scientist": 0.6,
        "recsys_search": 1.0,
        "swe_generic": 0.3,
        "cv_speech": 0.2,
        "data_eng": 0.4,
        "non_tech": 0.0,
    }
)
ROLES: tuple[str, ...] = tuple(ROLE_SCORES)
DEFAULT_ROLE = "swe_generic"

DOMAIN_SCORES: Mapping[str, float] = MappingProxyType(
    {
        "nlp_ir": 1.0,
        "recsys_search": 1.0,
        "generic_swe": 0.3,
        "cv_speech": 0.1,
        "data_eng": 0.4,
        "non_tech": 0.0,
    }
)
DOMAINS: tuple[str, ...] = tuple(DOMAIN_SCORES)
DEFAULT_DOMAIN = "generic_swe"

FLAG_PENALTIES: Mapping[str, float] = MappingProxyType(
    {
        "pure_research": 0.30,
        "langchain_only_recent": 0.30,
        "consulting_only": 0.35,
        "cv_primary": 0.35,
        "stale_coding": 0.20,
        "job_hopper": 0.15,
    }
)
FLAGS: tuple[str, ...] = tuple(FLAG_PENALTIES)
HARD_FLAGS: tuple[str, ...] = (
    "consulting_only",
    "cv_primary",
    "langchain_only_recent",
    "pure_research",
)
SOFT_FLAGS: tuple[str, ...] = ("job_hopper", "stale_coding")

# ---------------------------------------------------------------------------
# Keyword evidence looked up in career text.
# ---------------------------------------------------------------------------
EVIDENCE_KEYWORDS: Mapping[str, tuple[str, ...]] = MappingProxyType(
    {
        "retrieval": (
            "retrieval",
            "rag",
            "semantic search",
            "dense retrieval",
            "embedding",
            "vector search",
            "nearest neighbor",
        ),
        "vector_db": (
            "pinecone",
            "weaviate",
            "qdrant",
            "milvus",
            "faiss",
            "opensearch",
            "elasticsearch",
            "vector database",
            "vector db",
        ),
        "ranking": (
            "ranking",
            "learning to rank",
            "learning-to-rank",
            "recommendation",
            "recommender",
            "recsys",
            "relevance",
        ),
        "evaluation": (
            "ndcg",
            "mrr",
            "map@",
            "a/b test",
            "ab test",
            "offline metric",
            "offline eval",
            "precision@",
            "recall@",
        ),
    }
)

# ---------------------------------------------------------------------------
# Weights of the fit terms and of the availability components.
# The order is the order of addition, which decides the last bits of a score.
# ---------------------------------------------------------------------------
TERM_WEIGHTS: Mapping[str, float] = MappingProxyType(
    {
        "career_sim": 0.22,
        "role_match": 0.20,
        "domain_match": 0.15,
        "product_ratio": 0.12,
        "seniority_fit": 0.08,
        "built_ranking": 0.15,
        "lexical_evidence": 0.08,
    }
)
TERMS: tuple[str, ...] = tuple(TERM_WEIGHTS)

AVAILABILITY_WEIGHTS: Mapping[str, float] = MappingProxyType(
    {
        "recency": 0.25,
        "recruiter_response_rate": 0.15,
        "open_to_work": 0.15,
        "interview_completion_rate": 0.15,
        "notice_period": 0.15,
        "offer_acceptance": 0.07,
        "verified_email": 0.04,
        "verified_phone": 0.04,
    }
)

# ---------------------------------------------------------------------------
# Words and phrases of the explanation texts.
# ---------------------------------------------------------------------------
GENERIC_WORDS: tuple[str, ...] = (
    "ml", "ai", "nlp", "ir", "jd", "llm", "llms", "mle",
    "india", "us", "usa", "uk", "eu", "apac",
)
ROLE_PHRASES: Mapping[str, str] = MappingProxyType(
    {
        "ml_engineer": "a hands-on applied-ML engineer",
        "ai_engineer": "an AI engineer with production exposure",
        "data_scientist": "a data scientist with modelling depth",
        "recsys_search": "a search / recommendation specialist",
        "swe_generic": "a software engineer",
        "cv_speech": "a computer-vision / speech engineer",
        "data_eng": "a data engineer who builds systems",
        "non_tech": "outside the core engineering track",
    }
)
DEFAULT_ROLE_PHRASE = "a relevant engineering profile"
FLAG_PHRASES: Mapping[str, str] = MappingProxyType(
    {
        "pure_research": "a research-only track with little production deployment",
        "langchain_only_recent": "only recent llm-framework experience and limited pre-llm depth",
        "consulting_only": "a services and consulting background rather than product work",
        "cv_primary": "a computer-vision-leaning profile with limited retrieval / ranking work",
        "stale_coding": "limited hands-on production coding recently",
        "job_hopper": "frequent short tenures",
    }
)
GAP_CUES: tuple[str, ...] = (
    "notice", "services", "consult", "research", "vision", "activity", "recent",
    "hop", "tenure", "open to work", "engaged", "available", "framework",
)
# Fixed values: (last rank of the band, tone); ranks beyond the last band are "reasonable".
TONES: tuple[tuple[int, str], ...] = (
    (10, "top-tier match"),
    (30, "strong match"),
    (60, "solid match"),
)
LAST_TONE = "reasonable match"


def ordered_sum(values) -> float:
    """Left-to-right float addition (the built-in ``sum`` compensates rounding)."""
    return reduce(add, values, 0.0)


@dataclass(frozen=True)
class VectorSettings:
    """How a record or a query becomes encoder input."""

    model_id: str = "BAAI/bge-base-en-v1.5"
    dim: int = 768
    passage_prefix: str = ""
    query_prefix: str = "Represent this sentence for searching relevant passages: "
    # Encoder window in characters; None keeps the whole text.
    text_chars: int | None = None


@dataclass(frozen=True)
class FilterSettings:
    """A record survives on its title OR on its similarity (inclusive)."""

    titles: Sequence[str] = TARGET_TITLES
    threshold: float = 0.725


@dataclass(frozen=True)
class IntegritySettings:
    """When a record contradicts itself."""

    top_proficiency: str = "expert"
    role_margin_months: int = 12


@dataclass(frozen=True)
class ScoreSettings:
    """Weights, maps and bounds of the linear score."""

    weights: Mapping[str, float] = field(default_factory=lambda: TERM_WEIGHTS)
    role_scores: Mapping[str, float] = field(default_factory=lambda: ROLE_SCORES)
    domain_scores: Mapping[str, float] = field(default_factory=lambda: DOMAIN_SCORES)
    default_role_score: float = 0.2
    default_domain_score: float = 0.2
    penalties: Mapping[str, float] = field(default_factory=lambda: FLAG_PENALTIES)
    keywords: Mapping[str, Sequence[str]] = field(default_factory=lambda: EVIDENCE_KEYWORDS)
    availability_weights: Mapping[str, float] = field(
        default_factory=lambda: AVAILABILITY_WEIGHTS
    )
    cosine_floor: float = 0.60
    cosine_ceiling: float = 0.80
    availability_floor: float = 0.70
    snapshot_date: str = "2026-06-28"
    recency_days: int = 180
    notice_days: int = 180
    not_open_score: float = 0.3
    home_country: str = "india"
    away_score: float = 0.85
    # Characters of career text searched for evidence; None searches all of it.
    text_chars: int | None = None

    def with_floor(self, floor: float) -> ScoreSettings:
        return replace(self, availability_floor=floor)

    def with_weights(self, weights: Mapping[str, float]) -> ScoreSettings:
        return replace(self, weights=MappingProxyType(dict(weights)))


@dataclass(frozen=True)
class TextSettings:
    """Shape limits of an explanation text."""

    min_chars: int = 30
    max_chars: int = 360
    max_sentences: int = 3
    number_tolerance: float = 0.5
    leading_terms: int = 3
    long_notice_days: int = 90
    low_availability: float = 0.85
    prompt_evidence_chars: int = 240
    similar_at: float = 0.85


@dataclass(frozen=True)
class MetricSettings:
    """Cut-offs and weights of the ranking-quality report."""

    relevant_tier: int = 3
    max_tier: int = 5
    strong_tier: int = 4
    trap_tier: int = 1
    trap_rank: int = 50
    off_target_role: float = 0.30
    inactive_availability: float = 0.85
    buried_rank: int = 100
    composite: Mapping[str, float] = field(
        default_factory=lambda: MappingProxyType(
            {"ndcg_at_10": 0.50, "ndcg_at_50": 0.30, "map": 0.15, "precision_at_10": 0.05}
        )
    )


@dataclass(frozen=True)
class Settings:
    """All settings of one run."""

    vector: VectorSettings = field(default_factory=VectorSettings)
    filter: FilterSettings = field(default_factory=FilterSettings)
    integrity: IntegritySettings = field(default_factory=IntegritySettings)
    score: ScoreSettings = field(default_factory=ScoreSettings)
    text: TextSettings = field(default_factory=TextSettings)
    metric: MetricSettings = field(default_factory=MetricSettings)


DEFAULTS = Settings()
