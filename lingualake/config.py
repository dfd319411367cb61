"""Project configuration: YAML into checked settings."""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from pathlib import Path
from typing import Any


class ConfigError(ValueError):
    """A configuration that can't be used."""


@dataclass
class Cleaning:
    timestamp: str | None = None
    characters: str = ""
    brackets: bool = False
    punctuation: bool = False
    lowercase: bool = False
    tidy: bool = True


@dataclass
class Fluency:
    word_splitter: str | None = None
    remove_hyphens: bool = True
    remove_duplicates: bool = True
    lowercase: bool = False


@dataclass
class Sections:
    identifier: str | None = None
    number: int | None = None
    has_titles: bool = False


@dataclass
class Embeddings:
    provider: str = "hash"
    dimensions: int = 32
    tokenization_method: str = "whitespace"
    tokenizer: str | None = None
    max_length: int = 512
    lowercase: bool = False
    remove_punctuation: bool = False
    window_sizes: list[Any] = field(default_factory=lambda: [2, 8])
    exclude_punctuation_tokens: bool = False
    window_details: bool = False
    sentences: bool = False


@dataclass
class Randomness:
    window_size: int = 8
    bootstrap: int = 1000
    shuffle_mode: str = "include0_includeN"
    use_tsp_divergence: bool = False
    max_tsp_tokens: int = 100
    n_permute: int | None = None
    random_seed: int = 0


@dataclass
class Logits:
    chunk_size: int = 128
    overlap_size: int = 64
    alpha: float = 1.0
    trailing_artifact_token_sequences: list[list[str]] = field(default_factory=list)


@dataclass
class Perplexity:
    ignore_sequences: list[list[str]] = field(default_factory=list)
    calculate_section_perplexity: bool = True
    calculate_sentence_perplexity: bool = False


@dataclass
class Topics:
    nr_topics: int = 10
    min_topic_size: int = 2
    chunk_text_units: str | None = None
    chunk_size: int = 64
    predefined_topics: list[str] = field(default_factory=list)


METRICS = ("embeddings", "logits", "perplexity", "topic_modeling")
TOKENIZATIONS = ("whitespace", "model", "model_roberta")


@dataclass
class Config:
    """task_name and input_file choose files, corpus_key and corpus_values documents, the rest what is made of them."""

    task_name: str | None = None
    input_file: str = "text"
    corpus_key: str | None = None
    corpus_values: list[str] = field(default_factory=list)
    number_of_speakers: int = 1
    participant_speakertag: Any = None
    keep_speakertags: bool = False
    pipeline_options: dict[str, bool] | None = None
    normalizer: str = "stem"
    metrics_to_extract: list[str] = field(default_factory=list)
    create_aggregation_of_results: bool = True
    document_information: list[str] = field(default_factory=list)
    output_policy: str = "overwrite"
    cleaning: Cleaning = field(default_factory=Cleaning)
    fluency: Fluency | None = None
    sections: Sections = field(default_factory=Sections)
    embeddings: Embeddings = field(default_factory=Embeddings)
    randomness: Randomness | None = None
    logits: Logits = field(default_factory=Logits)
    perplexity: Perplexity = field(default_factory=Perplexity)
    topics: Topics = field(default_factory=Topics)
    unknown: list[str] = field(default_factory=list)

    @property
    def speaker_tags(self) -> list[str]:
        tags = self.participant_speakertag
        return [] if not tags else [tags] if isinstance(tags, str) else list(tags)


_PARTS = {"cleaning": Cleaning, "fluency": Fluency, "sections": Sections, "embeddings": Embeddings, "randomness": Randomness, "logits": Logits, "perplexity": Perplexity, "topics": Topics}


def _part(kind: type, values: Any, where: str, unknown: list[str]):
    if not isinstance(values, dict):
        raise ConfigError(f"{where} must be a mapping")
    names = {f.name for f in fields(kind)}
    unknown += [f"{where}.{k}" for k in values if k not in names]
    return kind(**{k: v for k, v in values.items() if k in names})


def parse(values: dict) -> Config:
    """Settings from a mapping; keys that nothing reads are listed in `unknown`."""
    unknown: list[str] = []
    if not isinstance(values, dict):
        raise ConfigError("a configuration must be a mapping")
    given = dict(values)
    for name, kind in _PARTS.items():
        if given.get(name) is not None:
            given[name] = _part(kind, given[name], name, unknown)
        elif name in given:
            del given[name]
    names = {f.name for f in fields(Config)} - {"unknown"}
    unknown += [k for k in given if k not in names]
    c = Config(**{k: v for k, v in given.items() if k in names}, unknown=unknown)
    if c.input_file not in ("text", "audio"):
        raise ConfigError(f"input_file must be text or audio, not {c.input_file!r}")
    if bad := [m for m in c.metrics_to_extract if m not in METRICS]:
        raise ConfigError(f"unknown metrics {bad}; known: {', '.join(METRICS)}")
    from .plans.project import STEPS  # steps are registered there, a project's own too

    if bad := [s for s in c.pipeline_options or {} if s not in STEPS]:
        raise ConfigError(f"unknown pipeline steps {bad}; known: {', '.join(STEPS)}")
    units = c.topics.chunk_text_units
    if units and units not in ("sentence", "fixed") and not (str(units).isdigit() and int(units) > 0):
        raise ConfigError(f"topics.chunk_text_units must be sentence, fixed or a number of tokens, not {units!r}")
    if c.embeddings.tokenization_method not in TOKENIZATIONS:
        raise ConfigError(f"unsupported tokenization method {c.embeddings.tokenization_method!r}; known: {', '.join(TOKENIZATIONS)}")
    if c.embeddings.tokenization_method != "whitespace" and not c.embeddings.tokenizer:
        raise ConfigError("subword tokens need a tokenizer's file")
    if "perplexity" in c.metrics_to_extract and "logits" not in c.metrics_to_extract[: c.metrics_to_extract.index("perplexity")]:
        raise ConfigError("perplexity needs logits before it")
    if c.sections.has_titles and not c.sections.identifier and c.sections.number:
        raise ConfigError("titled sections need an identifier")
    return c


def load(path: str | Path) -> Config:
    import yaml

    with open(path, encoding="utf-8") as f:
        try:
            values = yaml.safe_load(f)
        except yaml.YAMLError as e:
            raise ConfigError(f"{path}: {e}") from e
    return parse(values or {})


def discover(folder: str | Path = ".") -> Path:
    """The one YAML file of a folder."""
    found = sorted(p for p in Path(folder).iterdir() if p.suffix in (".yml", ".yaml") and not p.name.startswith("."))
    if len(found) != 1:
        raise ConfigError(f"{folder} must hold exactly one .yml or .yaml file, not {len(found)}")
    return found[0]
