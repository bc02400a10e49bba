"""Tables that the stages read and write."""
