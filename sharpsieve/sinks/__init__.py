"""What a run writes."""
