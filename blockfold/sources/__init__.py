"""Where histories come from and go to."""
