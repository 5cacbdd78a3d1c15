"""Experiment settings: data locations, modality switches and run parameters."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

# ---------------------------------------------------------------------------
# Data set names, file stems, id columns, vector widths.
# ---------------------------------------------------------------------------
DATASETS = ("lncRNA-drug", "miRNA-drug", "circRNA-drug")

PAIR_FILE = "responsed_RNA-drug"
LEFT_SEQUENCE_FILE = "ALLRNA-seq"
RIGHT_SEQUENCE_FILE = "ALLdrug-smiles"
LEFT_ID_COLUMN = "RNA_ID"
RIGHT_ID_COLUMN = "CID"

# (side, modality) -> (switch, file stem, vector width)
MODALITIES = {
    ("left", "seq"): ("left_seq", "Features_RNAFM_RNA_640D", 640),
    ("left", "struct"): ("left_struct", "secondary_feature_RNA", 128),
    ("left", "disease"): ("left_disease", "onehot_RNA_matrix", 1690),
    ("right", "seq"): ("right_seq", "Features_ChemBERTa_Drug_768D", 768),
    ("right", "graph"): ("right_struct", "ALLdrug-graph-features", 512),
    ("right", "ecfp"): ("right_struct", "ALLdrug-ECFP-features", 512),
    ("right", "disease"): ("right_disease", "onehot_Drug_matrix", 1690),
}

SWITCHES = (
    "left_seq",
    "left_struct",
    "left_disease",
    "right_seq",
    "right_struct",
    "right_disease",
)

METRICS = ("accuracy", "auc_roc", "pr_auc", "f1", "precision", "recall")
LOSSES = ("ce", "focal", "label_smoothing", "weighted_ce")
FUSIONS = ("pooled", "concat")
CLASSIFIERS = ("logistic", "mlp", "gbt")
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class ExperimentConfig:
    """Parameters of one cross-validated run."""

    dataset: str = "miRNA-drug"
    enabled: tuple[str, ...] = SWITCHES
    n_folds: int = 5
    negative_ratio: int = 1
    seed: int = 42
    dedupe: bool = True
    fusion: str = "pooled"
    common_dim: int = 64
    classifier: str = "logistic"
    classifier_params: dict = field(default_factory=dict)
    loss: str = "ce"
    focal_alpha: float = 0.25
    focal_gamma: float = 2.0
    label_smoothing: float = 0.1
    class_weights: tuple[float, float] | None = None
    patience: int = 5
    min_delta: float = 0.001
    max_epochs: int = 100
    missing: str = "error"
    parallel_folds: int = 2

    def __post_init__(self):
        unknown = set(self.enabled) - set(SWITCHES)
        if unknown:
            raise ValueError(f"unknown modality switches: {sorted(unknown)}")
        for name, value, allowed in (
            ("fusion", self.fusion, FUSIONS),
            ("classifier", self.classifier, CLASSIFIERS),
            ("loss", self.loss, LOSSES),
        ):
            if value not in allowed:
                raise ValueError(f"{name} must be one of {allowed}, got {value!r}")

    def as_dict(self) -> dict:
        return asdict(self)


def enabled_modalities(cfg: ExperimentConfig) -> list[str]:
    """Switched-on modalities in their fixed order."""
    return [s for s in SWITCHES if s in cfg.enabled]


def enabled_tables(cfg: ExperimentConfig) -> list[tuple[str, str]]:
    """(side, modality) tables a run has to scan; one switch may govern two tables."""
    return [key for key, (switch, _, _) in MODALITIES.items() if switch in cfg.enabled]


def input_dim(cfg: ExperimentConfig) -> int:
    """Total concatenated width of the enabled modalities."""
    return sum(MODALITIES[key][2] for key in enabled_tables(cfg))


def dataset_catalogue(root: str, name: str, fmt: str = "parquet") -> dict:
    """Paths of every table of a data set, without touching the file system."""
    if name not in DATASETS:
        raise ValueError(f"unknown data set {name!r}; known: {DATASETS}")
    base = f"{root.rstrip('/')}/{name}"
    return {
        "pairs": f"{base}/{PAIR_FILE}.{fmt}",
        "splits": f"{base}/splits/{name}",
        "left_sequences": f"{base}/{LEFT_SEQUENCE_FILE}.{fmt}",
        "right_sequences": f"{base}/{RIGHT_SEQUENCE_FILE}.{fmt}",
        "modalities": {
            (side, modality): {
                "path": f"{base}/{stem}.{fmt}",
                "id_col": LEFT_ID_COLUMN if side == "left" else RIGHT_ID_COLUMN,
                "dim": width,
                "fmt": fmt,
            }
            for (side, modality), (_, stem, width) in MODALITIES.items()
        },
    }
