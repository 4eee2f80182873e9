"""Registered queries, their inputs and their oracles."""
