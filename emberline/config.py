"""Every knob of the learned layer, with a JSON form."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields


@dataclass
class Config:
    # fixed values: defaults that results must agree with
    alpha: float = 0.05
    lambda_base: float = 0.05
    beta: float = 1.0
    w0: float = 0.5
    r_clip: float = 1.0
    setpoint: float = 0.5
    k_i: float = 0.02
    ewma_beta: float = 0.8
    scale_min: float = 0.25
    scale_max: float = 8.0
    integral_min: float = -500.0
    integral_max: float = 500.0
    depth: int = 2
    fan: float = 0.9
    activation_epsilon: float = 1e-6
    theta: float = 0.01
    norm_target: float = 1.0
    authority_by_kind: dict[str, float] = field(default_factory=dict)
    authority_default: float = 0.0
    trust_by_origin: dict[str, float] = field(default_factory=dict)
    functional_kinds: list[str] = field(default_factory=list)
    feedback_gamma: float = 0.5
    feedback_hit: float = 1.0
    feedback_miss_penalty: float = 0.0
    sleep_downscale: float = 0.6
    sleep_theta: float = 0.05
    protect_top_frac: float = 0.2

    @classmethod
    def from_json(cls, text: str) -> Config:
        """All fields optional; unknown ones, such as comments, are ignored."""
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in json.loads(text).items() if k in known})

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)
