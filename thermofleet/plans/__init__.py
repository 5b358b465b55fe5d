"""Comfort schedules, costs, plan options and plan scores, as tables."""
