"""sources of passagework."""
