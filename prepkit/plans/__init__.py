"""Declarative jobs that combine operators."""
