"""The registered queries; importing this package registers them."""

from tideframe.plans import bars, dividends, fundamentals, realtime, reference_data
from tideframe.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "bars", "dividends", "fundamentals", "realtime", "reference_data"]
