"""Composed plans: operators chained into one lazy DataFrame plan each."""
