"""plans of passagework."""
