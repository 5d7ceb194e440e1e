"""Stock-health analytics as Spark DataFrame transformations."""
from stockhealth.policy import DEFAULT_POLICY, Policy

__all__ = ["DEFAULT_POLICY", "Policy"]
