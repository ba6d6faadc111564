"""Operators that turn raw web and chat tables into training data."""
