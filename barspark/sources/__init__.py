"""Tables that the operators read and write."""
