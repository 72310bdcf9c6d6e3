"""Part of the rule engine."""
