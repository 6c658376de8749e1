"""Run settings: model file, then run file, then explicit values; 'None' means unset."""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from typing import Any


@dataclass(frozen=True)
class RunConfig:
    """Defaults are the shipped settings."""

    seed: int = 42
    node_col_name: str = "node_id"
    label_col: str | None = None
    table_features: list[str] = field(default_factory=list)
    graph_features: list[str] = field(default_factory=lambda: ["degree", "betweenness", "pagerank", "closeness_centrality", "shortest_path_length"])
    node_att_norm_method: str = "minmax"
    node_att_norm_target: list[str] = field(default_factory=lambda: ["degree", "betweenness", "closeness_centrality", "pagerank"])
    bin_size: int = 42
    ratio_of_data: tuple[float, float, float] = (0.70, 0.10, 0.20)
    min_cc_size: int = 4
    max_cc_size: int = 500_000_000
    use_aug: bool = True
    add_const_to_node: bool = False
    aug_subgraph_steps: int = 3
    extra: dict[str, Any] = field(default_factory=dict)


def load_config(*paths: str, **given: Any) -> RunConfig:
    """Settings of the YAML files in turn, later ones winning, then keyword values."""
    import yaml

    merged: dict[str, Any] = {}
    for path in paths:
        with open(path) as f:
            merged.update(yaml.safe_load(f) or {})
    merged.update(given)
    merged = {k: None if v == "None" else v for k, v in merged.items()}
    if "SEED" in merged:
        merged["seed"] = merged.pop("SEED")
    known = {f.name for f in fields(RunConfig)} - {"extra"}
    return RunConfig(**{k: v for k, v in merged.items() if k in known}, extra={k: v for k, v in merged.items() if k not in known})
