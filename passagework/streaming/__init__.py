"""streaming of passagework."""
