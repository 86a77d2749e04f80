"""All queries of the engine and the SQL that each must agree with."""

from __future__ import annotations

from tessera.plans import dialogue, form_rule_views, form_views, intake, mapping_views, matching, quoting, record_views, scoring, spatial_views, text_views, training_views, value_views
from tessera.plans.registry import ORACLES, QUERIES

FLAGSHIP = "fuse_candidates"

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES", "dialogue", "form_rule_views", "form_views", "intake", "mapping_views", "matching", "quoting", "record_views", "scoring", "spatial_views", "text_views", "training_views", "value_views"]
