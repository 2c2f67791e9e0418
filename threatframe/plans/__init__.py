"""threatframe.plans: shipped rule sets and reference data."""
