"""Health, override, cooldown and freshness rules in batch form."""
