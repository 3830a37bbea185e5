"""Settings: defaults, a YAML or JSON file over them, and environment variables over both."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, field, fields, replace
from pathlib import Path


@dataclass(frozen=True)
class Settings:
    """What changes results. Weights of the stages and of the vote must sum to 1, give or take a fifth."""

    vote_svm: float = 0.4
    vote_llm: float = 0.6
    stage1_weight: float = 0.6
    stage2_weight: float = 0.4
    svc_c: float = 1.0
    top_features: int = 50
    neighbours: int = 5
    folds: int = 3
    seed: int = 42
    train: float = 0.7
    val: float = 0.15
    test: float = 0.15
    batch_size: int = 5
    data_dir: str = "data"
    extra: dict = field(default_factory=dict)

    def __post_init__(self):
        for name, total in (("vote", self.vote_svm + self.vote_llm), ("stage", self.stage1_weight + self.stage2_weight)):
            if not 0.8 <= total <= 1.2:
                raise ValueError(f"{name} weights sum to {total}")
        if abs(self.train + self.val + self.test - 1) > 1e-6:
            raise ValueError("shares of train, val and test must sum to 1")

    @classmethod
    def load(cls, path: str | None = None, prefix: str = "NETQUARRY_", environ: dict[str, str] | None = None) -> Settings:
        """Unknown names of the file are kept in `extra`; environment variables are the prefix and the upper-case name."""
        found = _read(path) if path else {}
        kinds = {f.name: f.type for f in fields(cls) if f.name != "extra"}
        own = {k: v for k, v in found.items() if k in kinds}
        for name, kind in kinds.items():
            if (value := (os.environ if environ is None else environ).get(prefix + name.upper())) is not None:
                own[name] = {"int": int, "float": float}.get(kind, str)(value)
        return replace(cls(**own), extra={k: v for k, v in found.items() if k not in kinds})

    def save(self, path: str) -> None:
        Path(path).write_text(json.dumps(asdict(self), indent=2))


def _read(path: str) -> dict:
    text = Path(path).read_text()
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("a YAML file needs PyYAML; use JSON") from e
        return yaml.safe_load(text) or {}
    return json.loads(text)
