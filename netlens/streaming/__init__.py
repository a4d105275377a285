"""The same analyses over file streams."""
