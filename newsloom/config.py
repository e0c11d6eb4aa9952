"""Settings of the pipeline, as frozen dataclasses; the defaults are those of the established configuration."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

WORD_QUOTA = 100


@dataclass(frozen=True)
class NgramConfig:
    reweight_scheme: str = "sumbasic"  # or "before_selection"
    grouping: str = "per_article"  # or "glob"
    num_sents_per_article: int = 2
    forward_backward: bool = False
    length_limit: int = 4
    num_sents_per_glob: int = 1000
    unigram_weight: float = 0.2
    bigram_weight: float = 0.9
    trigram_weight: float = 0.0
    headline_weight: float = 0.0
    cartesian_weight: float = 0.0
    query_weight: float = 0.0
    bias_weight: float = 0.0


@dataclass(frozen=True)
class LexRankConfig:
    similarity: str = "tf_idf"  # or "tf_idf_vector", "word_vector"
    bias_by: str = "ir"  # or "vector"
    threshold: float | None = None  # None: continuous
    damping: float = 0.4
    bias: bool = True
    rounds: int | None = None  # None: until it converges


@dataclass(frozen=True)
class RealizationConfig:
    similarity_threshold: float = 0.95
    overlap_threshold: float = 0.74
    extra_overlap: float = 0.84
    remove_quotes: bool = True
    remove_questions: bool = True
    minimum_sentence_length: int = 4
    remove_full_spans_that_match: tuple[str, ...] = ()
    remove_subspans_that_match: tuple[str, ...] = ()
    remove_sentence_initial_terms: bool = True
    remove_attributions: bool = True
    remove_pronoun_openings: bool = True
    remove_subjectless: bool = False
    remove_appositives: bool = False


@dataclass(frozen=True)
class OrderingConfig:
    topical_weight: float = 0.1
    succession_weight: float = 0.3
    chrono_weight: float = 0.7


@dataclass(frozen=True)
class Config:
    method: str = "select_ngram"
    max_sentences: int = 20
    ngram: NgramConfig = field(default_factory=NgramConfig)
    lexrank: LexRankConfig = field(default_factory=LexRankConfig)
    realization: RealizationConfig = field(default_factory=RealizationConfig)
    ordering: OrderingConfig = field(default_factory=OrderingConfig)

    @staticmethod
    def from_dict(values: dict) -> Config:
        """Settings from nested dictionaries, such as a parsed settings file; what is absent keeps its default, what is
        unknown is an error."""
        parts = {"ngram": NgramConfig, "lexrank": LexRankConfig, "realization": RealizationConfig, "ordering": OrderingConfig}
        made = {k: parts[k](**{n: tuple(x) if isinstance(x, list) else x for n, x in v.items()}) if k in parts else v for k, v in values.items()}
        return Config(**made)

    @staticmethod
    def from_json(text: str) -> Config:
        return Config.from_dict(json.loads(text))

    def to_json(self) -> str:
        """The effective settings, as they are kept beside a run's summaries."""
        return json.dumps(asdict(self), indent=1)
