"""Readers that turn raw shapes into typed DataFrames."""
