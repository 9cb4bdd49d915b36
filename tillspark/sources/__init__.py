"""Readers that give retail lines as a DataFrame."""
