"""Operators on trajectories and series, as DataFrame transformations."""
