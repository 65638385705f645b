"""Readers for the landed formats and writers for the layers."""
