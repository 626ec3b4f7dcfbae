"""Column helpers, fixed rule tables and distributed ordering."""
