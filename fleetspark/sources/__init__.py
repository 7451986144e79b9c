"""Schemas, loaders, fixtures and the synthetic fleet."""
