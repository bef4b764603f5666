"""functions of passagework."""
