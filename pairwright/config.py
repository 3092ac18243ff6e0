"""Parameters of inference, with their defaults."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace


@dataclass(frozen=True)
class Config:
    """Dots in parameter names are underscores here."""

    allow_unseen_nodes: bool = True
    manual_n_peek: int = 1
    ranking_enabled: bool = True
    ranking_ntop: int = 5
    algo_max_outer_loops: int | None = None
    algo_quickstart: bool = False
    algo_hardcase: bool = False
    inference_enabled: bool = True
    inference_update_attrs: bool = True
    refresh_window: int = 20
    refresh_patience: int = 72
    refresh_thresh: float = 0.052
    refresh_method: str = "binomial"
    redun_enabled: bool = True
    redun_pos: int = 2
    redun_neg: int = 2
    redun_enforce_pos: bool = True
    redun_enforce_neg: bool = True
    redun_neg_only_auto: bool = True
    queue_conf_thresh: str | None = None
    autoreview_enabled: bool = True
    autoreview_prioritize_nonpos: bool = True
    thresholds: dict[str, float] = field(default_factory=dict)

    def subparams(self, prefix: str) -> dict:
        """Parameters whose names begin with ``prefix`` and an underscore, without it."""
        start = prefix.replace(".", "_") + "_"
        return {f.name[len(start) :]: getattr(self, f.name) for f in fields(self) if f.name.startswith(start)}

    def with_params(self, **params) -> Config:
        """A copy with other values; an unknown name is an error."""
        return replace(self, **{k.replace(".", "_"): v for k, v in params.items()})
