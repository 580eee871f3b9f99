"""From load tiers to a load plan, and running it."""
