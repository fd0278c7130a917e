"""Operators for preparing text at corpus scale. Nothing outside this folder imports it."""
