"""Assemblies of operators into whole jobs."""
