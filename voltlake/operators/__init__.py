"""Composable DataFrame transforms."""
