"""pairlab: pair-association experiments as Spark DataFrame operators."""

from pairlab.config import ExperimentConfig, dataset_catalogue

__all__ = ["ExperimentConfig", "dataset_catalogue"]
