"""Plans: what a run would do, and what the registry looks like after it."""
