"""Helpers that shape physical plans: staged tables, hot keys, bounded broadcasts."""

from glyphmill.plans.barrier import keep
from glyphmill.plans.spread import spread
from glyphmill.plans.staging import drop_stages, shared_dir, stage, write_stage

__all__ = ["drop_stages", "keep", "shared_dir", "spread", "stage", "write_stage"]
