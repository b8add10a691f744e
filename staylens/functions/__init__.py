"""Reusable Column expressions; everything here stays inside Catalyst/codegen."""
