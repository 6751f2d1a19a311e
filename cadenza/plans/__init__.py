"""What plans share."""
