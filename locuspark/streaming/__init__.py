"""Stages that also run as streams."""
