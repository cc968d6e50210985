"""Plans that build a graph step by step."""
