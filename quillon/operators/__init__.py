"""Relational and time-series operators over long panels."""
