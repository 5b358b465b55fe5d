"""Thermal time constants and effector gains fitted per site and sensor."""
