"""Every registered query."""

from . import catalog_plans, cluster_plans, dedup_plans, mart_plans, search_plans, state_plans, stream_plans, text_plans  # noqa: F401
from .registry import PLANS, SQL  # noqa: F401
