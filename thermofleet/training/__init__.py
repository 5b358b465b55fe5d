"""Training and scoring jobs for temperature models."""
