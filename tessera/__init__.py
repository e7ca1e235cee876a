"""Document segmentation and corpus preparation on Spark."""

from tessera.config import ChunkerConfig
from tessera.operators.chars import extract_features
from tessera.plans.segment import SegmentEngine, chunk, engine_of

__all__ = ["ChunkerConfig", "SegmentEngine", "chunk", "engine_of", "extract_features"]
__version__ = "0.2.0"
