"""Composite jobs and the choice of resolution per tile."""
