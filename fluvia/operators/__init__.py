"""Stream-style operators as DataFrame plans."""
