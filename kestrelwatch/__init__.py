"""Security-event analytics on Spark: counts, outliers and a multi-event state monitor."""

from kestrelwatch.rules import RuleSet, load_rules, rules_from_dict

__all__ = ["RuleSet", "load_rules", "rules_from_dict"]
