"""Daily-price, insider-filing and trade-disclosure analytics as Spark DataFrame operators."""

__version__ = "0.1.0"
