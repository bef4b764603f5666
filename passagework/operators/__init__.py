"""operators of passagework."""
