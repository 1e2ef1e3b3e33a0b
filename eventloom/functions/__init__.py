"""Scalar building blocks: column expressions only, no actions."""
