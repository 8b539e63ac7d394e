"""Player-tracking and injury analytics as Spark DataFrame transformations."""

from fieldpulse.operators.series import Series

__all__ = ["Series"]
__version__ = "0.1.0"
