"""Imports every plan module so that its queries are registered."""

from fleetpulse.plans import (  # noqa: F401
    capture_plans, config_plans, diagnostic_plans, histogram_plans, rate_plans, rollup_plans, scalar_plans, span_plans, stream_plans, table_plans)
from fleetpulse.plans.registry import ORACLES, PLANS

__all__ = ["ORACLES", "PLANS"]
