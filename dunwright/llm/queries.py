"""Importing this module registers every query of the package."""

from . import (  # noqa: F401
    fingerprints, html_templates, jaccard_join, kd_search, language_id, mixing, quality_classifier, resampling,
    run_detection, segmentation, token_counts, toxicity, url_rules)
from .registry import ORACLES, QUERIES  # noqa: F401
