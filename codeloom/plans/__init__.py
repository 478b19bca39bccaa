"""Plans that compose operators."""
