"""Settings: JSON or YAML with closed keys, typed fields and a hash that does not depend on their order.

The kinds are dataclasses; their fields' types are what a value must be, nested
kinds and lists included, and nothing is converted but whole numbers where a
fraction is asked for. Each kind checks what its fields cannot say alone.
"""

from __future__ import annotations

import hashlib
import json
import math
import types
from dataclasses import MISSING, asdict, dataclass, field, fields, is_dataclass
from typing import Any, Literal, Union, get_args, get_origin, get_type_hints

from boxloom.errors import ConfigError
from boxloom.functions.detections import canonical
from boxloom.functions.schema import SPLITS
from boxloom.functions.strict import boxes_of

#: Settings of an earlier system, refused by name wherever they stand, and the beginnings of others.
OBSOLETE = frozenset(
    """model_path model_name_or_path input_size max_pixels max_seq_length packing resume_from_checkpoint use_vllm
    question_template is_grpo_train sam_path mask_path num_of_query learnable_query connector projection""".split()
)
OBSOLETE_BEGINNINGS = ("mask", "sam_")


def _positive(config: Any, *names: str) -> None:
    for name in names:
        if not getattr(config, name) > 0:
            raise ConfigError(f"{name} must be above 0")


def _not_negative(config: Any, *names: str) -> None:
    for name in names:
        if getattr(config, name) < 0:
            raise ConfigError(f"{name} must not be negative")


@dataclass(frozen=True)
class VocSource:
    name: str
    image_dir: str
    annotation_dir: str


@dataclass(frozen=True)
class CompileConfig:
    """How a dataset is compiled."""

    sources: tuple[VocSource, ...]
    output: str
    seed: int = 17
    negative_per_image: int = 1
    inclusive: bool = True
    train: float = 0.8
    validation: float = 0.1
    test: float = 0.1
    classes: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if not self.sources or len({s.name for s in self.sources}) < len(self.sources):
            raise ConfigError("sources must be named, each once")
        if len(set(self.classes)) < len(self.classes):
            raise ConfigError("classes repeat")
        if abs(sum(self.ratios.values()) - 1) > 1e-9 or min(self.ratios.values()) <= 0:
            raise ConfigError("splits must be positive and add up to 1")
        _not_negative(self, "seed", "negative_per_image")

    @property
    def ratios(self) -> dict[str, float]:
        return {s: getattr(self, s) for s in SPLITS}


@dataclass(frozen=True)
class ScheduleConfig:
    """How training rows are ordered."""

    epochs: float
    seed: int = 17
    world: int = 1
    limit: int = 1536

    def __post_init__(self) -> None:
        _positive(self, "epochs", "world", "limit")


@dataclass(frozen=True)
class EvaluateConfig:
    records: str
    predictions: str
    output: str
    split: Literal["train", "validation", "test"] = "test"


@dataclass(frozen=True)
class Runtime:
    """How a model runs."""

    device: str = "auto"
    dtype: Literal["auto", "float32", "float16", "bfloat16"] = "bfloat16"
    attention: Literal["auto", "eager", "sdpa", "flash_attention_2"] = "flash_attention_2"
    max_new_tokens: int = 192
    local_files_only: bool = False

    def __post_init__(self) -> None:
        if not 1 <= self.max_new_tokens <= 192:
            raise ConfigError("max_new_tokens must be from 1 to 192")


@dataclass(frozen=True)
class Request:
    reference_image: str
    reference_boxes: tuple[tuple[float, ...], ...]
    target_image: str
    query: str

    def __post_init__(self) -> None:
        try:
            boxes_of([list(b) for b in self.reference_boxes])
        except ValueError as e:
            raise ConfigError(f"reference_boxes: {e}") from None


@dataclass(frozen=True)
class DetectConfig:
    """One request to a model."""

    artifact: str
    request: Request
    output: str
    runtime: Runtime = field(default_factory=Runtime)


@dataclass(frozen=True)
class BatchConfig:
    """A manifest of requests."""

    artifact: str
    manifest: str
    output: str
    overwrite: bool = False
    runtime: Runtime = field(default_factory=Runtime)


@dataclass(frozen=True)
class ArtifactConfig:
    """An adapter to be wrapped."""

    source_adapter: str
    output: str
    contract: str
    stage: Literal["sft", "grpo"]
    parent_artifact: str | None = None


@dataclass(frozen=True)
class Optimization:
    epochs: float = 1.0
    max_steps: int | None = None
    learning_rate: float = 2e-4
    gradient_accumulation_steps: int = 8
    weight_decay: float = 0.01
    warmup_steps: int = 0
    checkpoint_steps: int = 100
    seed: int = 17

    def __post_init__(self) -> None:
        _positive(self, "epochs", "learning_rate", "gradient_accumulation_steps", "checkpoint_steps")
        _not_negative(self, "weight_decay", "warmup_steps", "seed")
        if self.max_steps is not None:
            _positive(self, "max_steps")


@dataclass(frozen=True)
class TrainConfig:
    """What a trainer outside this library reads: its data, where it works and how it steps."""

    stage: Literal["sft", "grpo"]
    dataset: str
    work: str
    artifact: str
    parent_artifact: str | None = None
    runtime: Runtime = field(default_factory=Runtime)
    optimization: Optimization = field(default_factory=Optimization)

    def __post_init__(self) -> None:
        if (self.stage == "grpo") != (self.parent_artifact is not None):
            raise ConfigError("grpo needs a parent_artifact, sft has none")


@dataclass(frozen=True)
class PredictConfig:
    """A split of a dataset to be predicted."""

    dataset: str
    artifact: str
    predictions: str
    split: Literal["train", "validation", "test"] = "test"
    runtime: Runtime = field(default_factory=Runtime)


KINDS = {
    "compile": CompileConfig, "schedule": ScheduleConfig, "evaluate": EvaluateConfig, "detect": DetectConfig,
    "batch": BatchConfig, "artifact": ArtifactConfig, "train": TrainConfig, "predict": PredictConfig,
}


def _no_repeats(pairs: list[tuple[str, Any]]) -> dict[str, Any]:
    out: dict[str, Any] = {}
    for k, v in pairs:
        if k in out:
            raise ConfigError(f"key given twice: {k}")
        out[k] = v
    return out


def _refuse_obsolete(value: Any, at: str = "$") -> None:
    if isinstance(value, dict):
        for key, child in value.items():
            if isinstance(key, str) and (key in OBSOLETE or key.startswith(OBSOLETE_BEGINNINGS)):
                raise ConfigError(f"{at}.{key} is a setting of an earlier system")
            _refuse_obsolete(child, f"{at}.{key}")
    elif isinstance(value, list):
        for i, child in enumerate(value):
            _refuse_obsolete(child, f"{at}[{i}]")


def _value(at: str, kind: Any, value: Any) -> Any:
    """``value``, if it is of ``kind``."""
    origin, args = get_origin(kind), get_args(kind)
    if origin in (Union, types.UnionType):
        return None if value is None and type(None) in args else _value(at, next(a for a in args if a is not type(None)), value)
    if origin is Literal:
        if value not in args:
            raise ConfigError(f"{at} must be one of {list(args)}")
        return value
    if origin is tuple:
        if not isinstance(value, list):
            raise ConfigError(f"{at} must be a list")
        return tuple(_value(f"{at}[{i}]", args[0], v) for i, v in enumerate(value))
    if is_dataclass(kind):
        return _build(kind, value, at)
    if kind is float and type(value) is int:
        value = float(value)
    if type(value) is not kind:
        raise ConfigError(f"{at} must be {kind.__name__}")
    if kind is float and not math.isfinite(value):
        raise ConfigError(f"{at} must be finite")
    if kind is str and not value.strip():
        raise ConfigError(f"{at} must not be empty")
    return value


def _build(kind: type, payload: Any, at: str) -> Any:
    if not isinstance(payload, dict):
        raise ConfigError(f"{at} must be a mapping")
    known, hints = {f.name: f for f in fields(kind)}, get_type_hints(kind)
    unknown = sorted(map(str, set(payload) - set(known)))
    missing = sorted(n for n, f in known.items() if n not in payload and f.default is MISSING and f.default_factory is MISSING)
    if unknown or missing:
        raise ConfigError(f"{at}: missing {missing}, unknown {unknown}")
    try:
        return kind(**{k: _value(f"{at}.{k}", hints[k], v) for k, v in payload.items()})
    except ConfigError as e:
        raise e if str(e).startswith(at) else ConfigError(f"{at}: {e}") from None


def _parsed_yaml(text: str) -> Any:
    """YAML without merge keys and repeated keys, of plain kinds only."""
    try:
        import yaml
    except ImportError:
        raise ConfigError("YAML settings need the yaml module; JSON does not") from None

    class Loader(yaml.SafeLoader):
        pass

    def mapping(loader: Any, node: Any) -> dict[str, Any]:
        loader_pairs = [(loader.construct_object(k, deep=True), v) for k, v in node.value]
        if any(k == "<<" for k, _ in loader_pairs):
            raise ConfigError("merge keys are not taken")
        return _no_repeats([(k, loader.construct_object(v, deep=True)) for k, v in loader_pairs])

    Loader.add_constructor(yaml.resolver.BaseResolver.DEFAULT_MAPPING_TAG, mapping)
    Loader.add_constructor("tag:yaml.org,2002:merge", lambda loader, node: "<<")
    try:
        return yaml.load(text, Loader=Loader)  # noqa: S506  a subclass of the safe loader
    except yaml.YAMLError as e:
        raise ConfigError(f"not YAML: {e}") from None


def load(text: str, yaml: bool = False) -> Any:
    """A config from JSON (or YAML) text with ``kind`` and the fields of that kind."""
    try:
        payload = _parsed_yaml(text) if yaml else json.loads(text, object_pairs_hook=_no_repeats)
    except json.JSONDecodeError as e:
        raise ConfigError(f"not JSON: {e}") from None
    if not isinstance(payload, dict) or payload.get("kind") not in KINDS:
        raise ConfigError(f"kind must be one of {sorted(KINDS)}")
    _refuse_obsolete(payload)
    kind = payload.pop("kind")
    return _build(KINDS[kind], payload, kind)


def kind_of(config: Any) -> str:
    return next(k for k, c in KINDS.items() if isinstance(config, c))


def as_mapping(config: Any) -> dict[str, Any]:
    """The config with its kind and all defaults filled in."""
    return {"kind": kind_of(config)} | asdict(config)


def config_hash(config: Any) -> str:
    """SHA-256 of the canonical form with defaults filled in."""
    return hashlib.sha256(canonical(as_mapping(config), ascii_only=True).encode()).hexdigest()
