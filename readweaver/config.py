"""Options of index building and alignment, all of them effective."""
from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class GenomeConfig:
    bin_size: int = 18  # chromosomes are padded to multiples of 2**bin_size
    kmer_size: int = 14


@dataclass(frozen=True)
class AnnotationConfig:
    feature: str = "exon"
    transcript_tag: str = "transcript_id"
    gene_tag: str = "gene_id"
    gene_name_tags: tuple[str, ...] = ("gene_name",)
    gene_type_tags: tuple[str, ...] = ("gene_type", "gene_biotype")
    chr_prefix: str = ""
    overhang: int = 100


@dataclass(frozen=True)
class SeedConfig:
    min_split_length: int = 20
    max_seeds_per_read: int = 1000
    start_every: int = 50  # seed starts are len // (1 + len // start_every) apart
    min_tail: int = 6  # no search with fewer bases left


@dataclass(frozen=True)
class WindowConfig:
    bin_bits: int = 16
    anchor_max_rep: int = 50
    max_rep: int = 10_000
    anchor_dist_bins: int = 9
    flank_bins: int = 4
    max_seeds: int = 50
    max_windows: int = 10_000


@dataclass(frozen=True)
class ScoreConfig:
    match: int = 1
    mismatch: int = -1
    gap_open: int = 0
    deletion_open: int = -2
    deletion_base: int = -2
    insertion_open: int = -2
    insertion_base: int = -2
    boundary_slack: int = 1
    annotated_bonus: int = 2
    min_intron: int = 21
    max_intron: int = 589_824
    max_mismatch: int = 10
    max_exons: int = 20
    #: Mismatches allowed at a junction by class non-canonical, GT/AG, GC/AG, AT/AC; -1 is no limit.
    junction_mismatches: tuple[int, ...] = (0, -1, 0, 0)
    length_scale: float = 0.25
    length_shift: float = 0.5


@dataclass(frozen=True)
class FilterConfig:
    max_multimap: int = 10
    score_range: int = 1
    min_score_share: float = 0.66
    min_match_share: float = 0.66
    max_stored: int = 100


@dataclass(frozen=True)
class AlignConfig:
    genome: GenomeConfig = field(default_factory=GenomeConfig)
    annotation: AnnotationConfig = field(default_factory=AnnotationConfig)
    seeds: SeedConfig = field(default_factory=SeedConfig)
    windows: WindowConfig = field(default_factory=WindowConfig)
    scores: ScoreConfig = field(default_factory=ScoreConfig)
    filters: FilterConfig = field(default_factory=FilterConfig)
