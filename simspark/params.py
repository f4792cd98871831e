"""Defaults of the engine. They are the published defaults of the pipeline that the engine re-expresses."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    k: int = 5
    num_perm: int = 128
    bands: int = 32
    wl_iters: int = 2
    kpath_k: int = 3
    kpath_per_node: int = 32
    topk_recall: int = 128
    min_candidates: int = 10
    min_tokens: int = 3
    template_degree_soft: int = 64
    template_degree_hard: int = 128
    threshold: float = 0.6
    min_coverage: float = 0.3
    high: float = 0.55
    alpha: float = 0.7
    unknown_penalty: float = 0.05
    prog_threshold: float = 0.6
    func_threshold: float = 0.6
    topk_pairs: int = 200
    rerank_topk: int = 50
    align_sim: float = 0.3
    level_tolerance: int = 1
    min_cluster_size: int = 8
    epsilon: float = 0.35
    weight_semantic: float = 0.5
    weight_effect: float = 0.25
    weight_graph: float = 0.25


DEFAULT = Params()
