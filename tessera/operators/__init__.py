"""Operators over panels: rolling, cross-sectional, relational, statistical and portfolio."""
