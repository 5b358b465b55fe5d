"""What was decided, what happened, and the reports on both."""
