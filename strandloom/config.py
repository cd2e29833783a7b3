"""Options of a deduplication run, with their defaults."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    umi_dist: int = 2
    damaged_umi_dist: int = 3
    collision_budget: float = 0.01
    damaged_collision_budget: float = 0.5
    max_umi_edits: int = 5
    pos_tol: int = 20
    no_position: bool = False
    ignore_strand: bool = False
    bridge_exon_max: int = 50
    chimera_clip: int = 60
    min_mapq: int = 1
    min_qs: float = 0.0
    rep: str = "junction-consensus"
    lenient_junctions: bool = False
    full_length: bool = True
    fl_cov: float = 0.8
    fl_terminal: int = 25
    mode: str = "filter"

    @property
    def positions(self) -> bool:
        return not (self.no_position or self.ignore_strand)
