"""Readers of session logs and exports, and projections of tables to memories."""
